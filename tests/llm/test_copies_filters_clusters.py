"""Operators 11 to 13 against brute force, on odd rows and at their limits."""

import hashlib
import math
from collections import defaultdict
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.llm import clustering, exact_dedup, filter_audit

DOC = "doc_id long, text string, lang string, source string, row string, hash string, part string, id string, copies int, key string, n int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
TEXTS = [(1, None), (None, "a b c"), (None, "a b c"), (7, "A B c"), (2, ""), (2, ""), (3, LONG), (4, LONG.upper()), (9, LONG + "."), (5, " \t\n"), (6, "Ärger"), (8, "ärger"), (10, "a" * 50_000), (11, "A" * 50_000), (12, "a" * 50_001), (13, "x # y"), (13, "x # y"), (14, "x # y")]


def lower(s):
    return (s or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 5 else "en", "s", "r", "h", "p", "x", 1, "k", 2) for i, t in TEXTS], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- exact dedup -----------------------------------------------------------------------------------------------------


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for t, ids in groups.items():
        top = max(ids, key=lambda i: -1 if i is None else i)
        kept = ids.index(top)
        out += [(i, top, len(ids), k == kept, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("n_digest", [16, 1])
def test_exact_dedup_on_odd_rows(odd, n_digest):
    """With digests of one byte most chunks share theirs, and are named by content."""
    got = exact_dedup.deduplicate(odd, n_digest=n_digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_groups(TEXTS)


@pytest.mark.parametrize("limit", ["MAX_SHARED", "MAX_DOUBLED"])
def test_exact_dedup_beyond_its_broadcasts(odd, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, limit, 1)
    assert sorted((tuple(r) for r in exact_dedup.deduplicate(odd, n_digest=1).collect()), key=repr) == expected_groups(TEXTS)


def test_hot_groups_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 20)
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 5)
    rows = [(i, "hot one" if i % 3 == 0 else "HOT two" if i % 3 == 1 else f"text {i % 40}") for i in range(300)]
    for n_digest in (16, 1):
        got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), n_digest=n_digest)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_groups(rows)


def test_one_digest_of_two_contents_keeps_texts_apart(spark):
    """256 digests of one byte, 600 different one-chunk texts: by digests alone many would be equal."""
    rows = [(i, f"text number {i % 600}") for i in range(1200)]
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), n_digest=1)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_groups(rows)
    raw = exact_dedup.recipes(spark.createDataFrame(rows, "doc_id long, text string"), n_digest=1)
    assert raw.select("recipe").distinct().count() == 600


def test_exact_dedup_ids_of_text_and_empty_table(spark, empty):
    got = exact_dedup.deduplicate(spark.createDataFrame([("a", "x"), ("b", "X"), ("c", "y")], "name string, body string"), "name", "body")
    assert sorted((r.name, r.keep_id, r.kept) for r in got.collect()) == [("a", "b", False), ("b", "b", True), ("c", "c", True)]
    assert exact_dedup.deduplicate(empty).collect() == []


def test_cuts_depend_on_content():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 200_000).astype(np.uint8)
    whole = np.concatenate([np.frombuffer(b"other document", np.uint8), text, np.zeros(0, np.uint8), np.frombuffer(b"new head" * 100, np.uint8), text])
    offs = np.cumsum([0, 14, len(text), 0, 800 + len(text)])
    start, end = exact_dedup.cuts(whole, offs)
    assert (end - start).max() <= exact_dedup.MOST and start[0] == 0 and end[-1] == len(whole) and (start[1:] == end[:-1]).all()
    first = {bytes(whole[a:b]) for a, b in zip(start, end) if 14 <= a < offs[2]}
    later = {bytes(whole[a:b]) for a, b in zip(start, end) if a >= offs[3]}
    assert len(first & later) >= len(first) - 2 and len(first) > 60
    alone = exact_dedup.cuts(text, np.array([0, len(text)]))
    inside = (start >= 14) & (start < offs[2])
    assert (start[inside] - 14 == alone[0]).all()


def test_recipes_are_small(odd):
    r = exact_dedup.recipes(odd).where("size > 100000").selectExpr("max(length(recipe) / size)").first()[0]
    assert r < 0.05


# --- filter audit ----------------------------------------------------------------------------------------------------


def failures(text):
    t = text or ""
    words = t.translate(dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")).split(" ")
    words = [w for w in words if w]
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
    return out | ({"D"} if set(t) & set("#$%&*|") else set())


def expected_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    docs = []
    for i, t, part in rows:
        f = failures(t)
        if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows):
            f |= {"E"}
        docs.append((part or "", f, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        share = defaultdict(int)
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                hit = [d for d in mine if letter in d[1]]
                gone = [d for d in hit if not d[1] & before]
                share[letter] += len(gone)
                out[part, "".join(order), step] = [sum(not d[1] & (before | {letter}) for d in mine), len(gone), len(hit) - len(gone), sum(d[1] == {letter} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


LABELS = [(3, 1, 0), (3, 1, 1), (4, 0, 1), (14, 1, 1), (None, 1, 1), (9, None, 1), (77, 1, 1)]


@pytest.mark.parametrize("limits", [None, ("MAX_SHARED", 0), ("ROWS_A_TASK", 1)])
def test_audit_against_brute_force(spark, odd, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(filter_audit, *limits)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1)).withColumn("bits", F.lit(1))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(odd, labels).collect()}
    assert got == expected_audit([(i, t, None if i == 5 else "en") for i, t in TEXTS], LABELS)


def test_audit_of_random_texts(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcABC#éß"), rng.integers(1, 4)))
    rows = [(i, " ".join(word() for _ in range(rng.integers(0, 160))), ["en", "de", None][i % 3]) for i in range(60)]
    rows += [(100 + i, rows[int(rng.integers(60))][1], "de") for i in range(40)]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 140, 2)]
    got = filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()} == expected_audit(rows, labels)


def test_audit_empty(spark, empty):
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


# --- clustering ------------------------------------------------------------------------------------------------------


def test_hilbert_curve_steps_to_neighbours():
    for dim, bits in ((2, 3), (3, 2), (4, 2), (1, 4)):
        cells = np.array(list(product(range(1 << bits), repeat=dim)))
        keys = clustering.hilbert_key(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def expected_clusters(rows, k, rounds, dim):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * float(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    near = lambda v: min(((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c)))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        for n, vs in of.items():
            c[n] = [sum(col) // len(vs) for col in zip(*vs)]
    found = [(i, near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, (d, n) in found:
        inertia[n] += d
    cap = (1 << 63) - 1
    return sorted(((i, n, d, min(inertia[n], cap), min(sum(inertia.values()), cap), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, (d, n) in found), key=repr)


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e30])
def test_clusters_against_brute_force(spark, scale):
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=4) * 0.2 + rng.integers(0, 3, 4)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(150)] + [(7, rows[8][1]), (7, rows[9][1]), (None, rows[10][1])]
    rows = [(i, [x * scale for x in v]) for i, v in rows]
    rows += [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1.0, 2.0, 3.0]), (906, [0.0] * 4)]
    table = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], "vec_id long, embedding array<double>, id string, vec string, cells string")
    got = clustering.cluster(table, dim=4, k=7, rounds=3, block=16)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_clusters(rows, 7, 3, 4)


def test_fewer_vectors_than_centroids_and_empty(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    table = spark.createDataFrame(rows, "name string, v array<double>")
    assert sorted((tuple(r) for r in clustering.cluster(table, "name", "v", dim=2).collect()), key=repr) == expected_clusters(rows, 40, 5, 2)
    assert clustering.cluster(table.where("false"), "name", "v", dim=2).collect() == []


def test_boxes_spare_comparisons(spark):
    """On vectors that lie in clumps most centroids are ruled out by a block's box."""
    rng = np.random.default_rng(2)
    at = rng.normal(size=(20, 16)) * 4
    rows = [(i, (at[i % 20] + rng.normal(size=16) * 0.1).tolist()) for i in range(4000)]
    vectors = clustering.kept_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 16)
    boxed = clustering.blocks(vectors, 16, block=64)
    found = clustering.totals(boxed, 16, np.floor(at * 256).astype(np.int64))
    assert sum(n for (_, d), n in found.items() if d == -1) == 4000
    assert found[0, -3] < 0.4 * 20 * 4000
