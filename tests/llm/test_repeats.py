"""Maximal repeats and substring dedup against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from verdance.llm import substring_dedup
from verdance.llm.substring_dedup import common_words, maximal_repeats, spread_join, surroundings

WIDTH = 20


def corpus():
    """Documents of shared passages in changing surroundings, copies, texts that repeat themselves, short and empty ones."""
    rng = random.Random(7)
    fresh = iter(f"u{i}" for i in range(10**6))
    new = lambda n: [next(fresh) for _ in range(n)]
    passages = [new(n) for n in (19, 20, 21, 60, 150)]
    docs = [sum((new(rng.randint(0, 15)) + p[rng.randint(0, 3) : len(p) - rng.randint(0, 3)] for p in rng.sample(passages, 3)), []) for _ in range(30)]
    growing = new(40)
    docs += [growing, growing + new(40)]
    docs += [docs[-1] + new(40), docs[-1][10:] + docs[3], docs[3], docs[3]]
    docs += [["k"] * 70, ["k"] * 45, ["a", "b", "c"] * 40, (new(11) + ["line"]) * 1, [], ["x"] * 19]
    line = new(12)
    docs += [line * 15, new(5) + line * 4]
    return {i: w for i, w in enumerate(docs)}


def brute(docs):
    """(doc, start of each window that starts earlier as well)."""
    seen, late = set(), set()
    for i, w in sorted(docs.items()):
        for s in range(len(w) - WIDTH + 1):
            x = tuple(w[s : s + WIDTH])
            late |= {(i, s)} if x in seen else set()
            seen.add(x)
    return late


def check(docs, repeats):
    covered = set()
    for r in repeats:
        a, b, s, t, n = docs[r.doc_id], docs[r.source], r.start, r.source_start, r.length
        assert n >= WIDTH and (r.source, t) < (r.doc_id, s)
        assert a[s : s + n] == b[t : t + n] and len(a[s : s + n]) == len(b[t : t + n]) == n
        assert s == 0 or t == 0 or a[s - 1] != b[t - 1]
        assert s + n == len(a) or t + n == len(b) or a[s + n] != b[t + n]
        covered |= {(r.doc_id, k) for k in range(s, s + n - WIDTH + 1)}
    assert covered == brute(docs)
    assert len({tuple(r) for r in repeats}) == len(repeats)


def test_maximal_repeats_are_those_of_brute_force(spark):
    docs = corpus()
    d = spark.createDataFrame([(i, " \n".join(w), "x", 1) for i, w in docs.items()], "doc_id long, text string, ats string, lo int")
    repeats = maximal_repeats(d, WIDTH).collect()
    check(docs, repeats)
    own = [r for r in repeats if r.doc_id == r.source]
    k = next(i for i, w in docs.items() if w == ["k"] * 70)
    assert [(r.start, r.length, r.source_start) for r in own if r.doc_id == k] == [(1, 69, 0)]  # one repeat, not fifty
    removed = {r.doc_id: r.n_removed for r in substring_dedup.deduplicate(d, WIDTH).collect()}
    late = brute(docs)
    assert removed == {i: len({s + k for j, s in late if j == i for k in range(WIDTH)}) for i in docs}


def test_lists_that_are_not_broadcast_and_hot_keys(spark, monkeypatch):
    docs = corpus()
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    from verdance.llm.decontamination import keyed

    c = keyed(d, "doc_id", "text")
    got = substring_dedup.extended(c, substring_dedup.matches(c, WIDTH, 0), 0, reach=2)
    check(docs, got.select(F.col("__id").alias("doc_id"), F.col("lo").alias("start"), (F.col("hi") - F.col("lo")).alias("length"), F.col("s_id").alias("source"), F.col("s_lo").alias("source_start")).collect())

    left = spark.range(12_000).select(F.when(F.col("id") < 9_000, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first")).where("k < 11000")
    joined = spread_join(left, right, ["k"])
    assert joined.columns == ["k", "v", "first"] and joined.count() == 11_000 and joined.select("v").distinct().count() == 11_000
    assert spread_join(left.limit(0), right.limit(0), ["k"]).count() == 0


def test_surroundings_in_parts(spark):
    text = " ".join(f"w{i}" for i in range(50))
    c = spark.createDataFrame([(1, 0, text), (2, 0, None)], "__id long, __sub long, __text string")
    asked = spark.createDataFrame([(1, 0, i, i + 3) for i in range(47)], "__id long, __sub long, lo long, hi long")
    got = {r.lo: r for r in surroundings(c, asked, 2, True, most=5).collect()}
    assert len(got) == 47 and got[0].before == b"" and bytes(got[5].before) == b"w4 w3" and bytes(got[5].after) == b"w8 w9" and bytes(got[46].after) == b"w49"
    assert len({bytes(r.digest) for r in got.values()}) == 47
    assert common_words(b"a b c", b"a b d") == 2 and common_words(b"", b"") == 0 and common_words(b"a", b"a b") == 1


def test_repeats_of_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, passage), (5, passage), (5, f"x {passage} y"), (5, passage), (6, None), (7, ""), (8, "p1 p2"), (9, "z" * 100_000 + " " + passage)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.start, r.length, r.source, r.source_start) for r in maximal_repeats(d).collect()), key=repr)
    assert got == sorted([(5, 0, 30, None, 0), (5, 1, 30, None, 0), (9, 1, 30, None, 0)], key=repr)
    assert maximal_repeats(d.limit(0)).collect() == [] and maximal_repeats(d.where("doc_id > 5 and doc_id < 9")).collect() == []
