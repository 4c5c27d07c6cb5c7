"""MinHash near-dedup (operator 2): Order MinHash candidates, verified by banded alignment.

Exact copies meet by a hash of the text and go on as one node. A node's shingles (runs of five words) are labelled with
their occurrence number; for each of BANDS hash functions the two smallest labelled shingles, in text order, make one
bucket key. In each round a node is compared with a few leaders of other classes, those it shares most keys with,
and the classes that prove linked are joined; a round makes at most LEADERS pairs a node. Nodes that at last still share keys with
another class meet by their rarest shingles (prefix filtering), whatever the size of a bucket, so that no link is left
out."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, class_table, lower_table, mix, range_hash, runs, segments, small, written

#: Words in a shingle, hash functions, keys that two nodes must share (at similarity 0.8 a pair misses that in about five
#: of a million cases), leaders that a node is compared with in a round, nodes
#: of a key to one leader in later rounds, later rounds at most.
SHINGLE, BANDS, SHARED, LEADERS, GROUP, ROUNDS = 5, 16, 2, 16, 4, 3
_CLASSES, _LOWER = class_table(), lower_table()


def node_of(text: Column) -> Column:
    """16-byte hash of a text; null for a text without a word, which is nobody's copy."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text)))


def shingles(words: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of SHINGLE words (its only run if it has fewer) and the documents' offsets."""
    n = np.diff(seg)
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    cut = np.concatenate([[0], np.cumsum(many)])
    start = np.arange(cut[-1]) - np.repeat(cut[:-1], many) + np.repeat(seg[:-1], many)
    return range_hash(words, start, start + np.repeat(np.minimum(n, SHINGLE), many)), cut


def occurrence(values: np.ndarray) -> np.ndarray:
    """How often each value occurred before."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    out = np.empty(len(s), np.int64)
    out[order] = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    return out


def order_min_hashes(sh: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """[documents, BANDS]: of each hash function, the two smallest labelled shingles in text order, hashed together.
    Every document has a shingle."""
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    labelled = mix(sh + occurrence(mix(sh ^ mix(doc.astype(np.uint64) + np.uint64(1)))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(cut) - 1, BANDS), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for band in range(BANDS):
        h = mix(labelled ^ mix(np.array([band + 101], np.uint64)))
        low = np.minimum.reduceat(h, cut[:-1])
        at = np.flatnonzero(h == low[doc])
        h[at] = top
        second = np.minimum.reduceat(h, cut[:-1])
        at2 = np.flatnonzero(h == second[doc])
        first_at, second_at = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        first_at[doc[at[::-1]]], second_at[doc[at2[::-1]]] = at[::-1], at2[::-1]
        a, b = labelled[first_at], np.where(second == top, np.uint64(band), labelled[second_at])
        swap = (second != top) & (second_at < first_at)
        out[:, band] = mix(np.where(swap, b, a) * np.uint64(3) + mix(np.where(swap, a, b) + np.uint64(band + 1)))
    return out


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, node, n (shingles), sig (array<long>) and words (32-bit word hashes as bytes) of each row; node null, sig and
    words empty for a text without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(2)):
                s, e, doc = runs(_CLASSES[data], offs)
                words, seg = range_hash(_LOWER[data], s, e).astype("<u4"), segments(doc, hi - lo)
                full = np.flatnonzero(np.diff(seg))
                n, lists = np.zeros(hi - lo, np.int64), np.zeros(0, np.int64)
                if len(full):
                    sh, cut = shingles(words, np.append(seg[full], seg[-1]))
                    n[full] = np.diff(cut)
                    lists = order_min_hashes(sh, cut).view(np.int64).ravel()
                sig = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * BANDS)]), pa.int32()), pa.array(lists))
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((4 * seg).astype(np.int32)), pa.py_buffer(words)])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int32()), sig, raw], ["id", "node", "n", "sig", "words"])

    part = docs.select(F.col(key).alias("id"), node_of(F.col(text)).alias("node"), F.col(text).alias("text"))
    return part.mapInArrow(run, part.select("id", "node").schema.add("n", "integer").add("sig", T.ArrayType(T.LongType())).add("words", "binary"))


def alignment(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity L / (len a + len b - L) with L the longest common subsequence of the occurrence-labelled shingles
    within the band that `least` allows; 0 where the shingles in common already rule `least` out."""
    n, m = len(a), len(b)
    both = int(np.floor((n + m) * (1 - least) / (1 + least) + 1e-9))  # most shingles that may stay without partner
    la, lb = mix(a + occurrence(a).astype(np.uint64) * np.uint64(77)), mix(b + occurrence(b).astype(np.uint64) * np.uint64(77))
    _, i, j = np.intersect1d(la, lb, assume_unique=True, return_indices=True)
    if n + m - 2 * len(i) > both:
        return 0.0
    near = np.abs(i - j) <= both
    i, j = i[near], j[near]
    tails: list[int] = []
    for x in j[np.argsort(i)].tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails) / (n + m - len(tails))


def _labelled(raw: bytes) -> np.ndarray:
    """The occurrence-labelled shingles of a text's words, as alignment() has them."""
    w = np.frombuffer(raw, "<u4").astype(np.uint64)
    sh = shingles(w, np.array([0, len(w)]))[0]
    return mix(sh + occurrence(sh).astype(np.uint64) * np.uint64(77))


def verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """x, y of pairs(x, y) that share SHARED keys and whose alignment reaches `least`. words(nid, sig, words). The two
    texts of a pair are of about one size, so what a pair carries is bounded by its own texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sh(raw: bytes) -> np.ndarray:
            w = np.frombuffer(raw, "<u4")
            return shingles(w, np.array([0, len(w)]))[0]

        for batch in batches:
            good, last, seen = [], None, None
            a, b = (c.flatten().to_numpy().reshape(-1, BANDS) for c in (batch.column(4), batch.column(5)))
            for near, p, q in zip(((a == b).sum(axis=1) >= SHARED).tolist(), batch.column(2), batch.column(3), strict=True):
                if not near:
                    good.append(False)
                    continue
                p, q = p.as_py(), q.as_py()
                if q != last:
                    last, seen = q, sh(q)
                good.append(alignment(sh(p), seen, least) >= least)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    a, b = (words.select(F.col("nid").alias(v), F.col("words").alias(f"w{v}"), F.col("sig").alias(f"s{v}")) for v in "xy")
    both = pairs.join(a, "x").join(b, "y").select("x", "y", "wx", "wy", "sx", "sy")
    return both.mapInArrow(run, "x long, y long")


def ends(pairs: DataFrame) -> DataFrame:
    """Both nodes of each pair, as rows."""
    return pairs.select(F.col("x").alias("nid")).unionByName(pairs.select(F.col("y").alias("nid")))


def components(edges: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """node and comp (the smallest node it is linked with, directly or not) of every node of edges(x, y). Labels go to
    neighbours and are then followed one step further, until nothing changes; every round is a written table."""
    both = written(edges.select(F.col("x").alias("node"), F.col("y").alias("to")).unionByName(edges.select(F.col("y").alias("node"), F.col("x").alias("to"))))
    now = written(both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("comp")))
    few = now.count() <= max_broadcast  # the same number of rows in every round
    while True:
        label = now.select(F.col("node").alias("to"), F.col("comp").alias("c"))
        near = both.join(F.broadcast(label) if few else label, "to").groupBy("node").agg(F.min("c").alias("c"))
        low = near.join(F.broadcast(now) if few else now, "node").select("node", F.col("comp").alias("before"), F.least("comp", "c").alias("comp"))
        up = now.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = written(low.join(F.broadcast(up) if few else up, "comp").select("node", "before", F.least("comp", "up").alias("comp")))
        now = new.select("node", "comp")
        if not new.where(F.col("before") != F.col("comp")).limit(1).count():
            return now


def joined(placed: DataFrame, edges: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """placed(nid, comp) after the classes that edges(x, y) link are made one."""
    x, y = (placed.select(F.col("nid").alias(v), F.col("comp").alias(f"c{v}")) for v in "xy")
    between = edges.join(x, "x").join(y, "y").where("cx != cy").select(F.col("cx").alias("x"), F.col("cy").alias("y"))
    up = small(components(between).select(F.col("node").alias("comp"), F.col("comp").alias("up")), max_broadcast)
    return written(placed.join(up, "comp", "left").select("nid", F.coalesce("up", "comp").alias("comp")))


def _apart(a: str, b: str, least: float) -> Column:
    """Whether two numbers of shingles allow the similarity."""
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b)


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x < y").distinct()


def untested(pairs: DataFrame, tested: DataFrame, max_broadcast: int) -> DataFrame:
    """The distinct pairs(x, y) that tested(x, y) lacks. They are written first, as Spark would move the anti-join to
    before the distinct, where a pair stands once for each key that its nodes share."""
    return written(written(pairs).join(small(tested, max_broadcast), ["x", "y"], "left_anti"))


def crowded(keys: DataFrame, placed: DataFrame, max_broadcast: int) -> DataFrame:
    """key, nid, n, comp and size (its nodes) of the keys of keys(key, nid, n) that nodes of several classes have. The
    keys are counted first, so that while they are few the nodes of a frequent key stay where they are."""
    labelled = keys.select("key", "nid", "n").join(placed, "nid")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 < c1").select("key", "size")
    return labelled.join(small(written(mixed), max_broadcast), "key").select("key", "nid", "n", "comp", "size")


def leader_pairs(keys: DataFrame, salt: int, least: float) -> DataFrame:
    """x, y: each node of keys(key, nid, n, comp, size) with leaders of other classes, those it meets most often. A key's
    nodes are dealt by hash into groups of about GROUP; each group has two leaders, of its smallest and its largest
    class. After the first of these rounds only nodes of classes that links have made lead: for two nodes that are both
    still alone the last step looks."""
    dealt = keys.withColumn("part", F.pmod(F.xxhash64("nid", "key", F.lit(salt)), F.ceil(F.col("size") / GROUP)))
    node = F.struct("comp", "nid", "n")
    leading = dealt.where("nid != comp") if salt else dealt  # a class has its smallest node's name
    led = leading.groupBy("key", "part").agg(F.min(node).alias("a"), F.max(node).alias("b"))
    met = dealt.join(led, ["key", "part"]).select("nid", "n", "comp", F.when(F.col("comp") == F.col("a.comp"), F.col("b")).otherwise(F.col("a")).alias("o"))
    return _ordered(_closest(met.where((F.col("comp") != F.col("o.comp")) & _apart("n", "o.n", least)).select("nid", F.col("o.nid").alias("other")), 1), "nid", "other")


def _closest(met: DataFrame, least_times: int) -> DataFrame:
    """nid, other: of met(nid, other) the LEADERS others that each node meets most often. The lists have one entry a key
    of the node, so they are short."""
    each = F.transform(F.array_distinct("met"), lambda o: F.struct(F.size(F.filter("met", lambda x: x == o)).alias("times"), F.xxhash64(o).alias("o"), o.alias("other")))
    best = F.slice(F.sort_array(F.filter(each, lambda x: x["times"] >= least_times), False), 1, LEADERS)
    return met.groupBy("nid").agg(F.collect_list("other").alias("met")).select("nid", F.explode(best["other"]).alias("other"))


def prefix_entries(tokens: np.ndarray, times: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and places by which a text can meet another of similarity `least`, rare ones first. Two such texts of p <= q
    shingles share at least o = least (p + q) / (1 + least) of them, so that in any one order of all shingles the first
    one they share stands before p - o + 1 in the one and q - o + 1 in the other: the larger text goes as far as a text of
    `least` its size wants, the smaller as far as one of its own size. times[bin of the shingle] gives the order; a
    shingle whose bin was met once is in no other text."""
    n, bin_ = len(tokens), times[(tokens % np.uint64(len(times))).astype(np.int64)]
    order = np.lexsort((tokens, bin_))[: n - int(np.ceil(least * n - 1e-9)) + 1]
    place = np.flatnonzero(bin_[order] > 1)
    return tokens[order][place].view(np.int64), place.astype(np.int32)


def prefix_pairs(words: DataFrame, least: float) -> DataFrame:
    """All pairs (x, y) of different classes that can reach `least`, from words(nid, words, comp); no pair that reaches it
    is left out (prefix filtering with places and sizes). In each shingle's list the nodes outside its largest class meet
    the others; nodes of one class never meet."""
    bins = 1 << 21

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int32)
        for batch in batches:
            for raw in batch.column(0):
                np.add.at(total, (_labelled(raw.as_py()) % np.uint64(bins)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at].astype(np.int64))], ["bin", "times"])

    # a table of fixed size; its order decides the work alone, and no pair
    got = words.select("words").mapInArrow(count, "bin long, times long").groupBy("bin").agg(F.sum("times").alias("times")).toArrow()
    counted = np.zeros(bins, np.int32)
    counted[got["bin"].to_numpy()] = np.minimum(got["times"].to_numpy(), 2**31 - 1)
    times = words.sparkSession.sparkContext.broadcast(counted)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                tokens = [_labelled(raw.as_py()) for raw in part.column(1)]
                out = [prefix_entries(t, times.value, least) for t in tokens]
                many, n = np.array([len(k) for k, _ in out]), np.array([len(t) for t in tokens], np.int32)
                row = pa.array(np.repeat(np.arange(len(many)), many))
                yield pa.record_batch([pa.array(np.concatenate([k for k, _ in out])), pa.array(np.concatenate([p for _, p in out])), pa.array(np.repeat(n, many)), part.column(0).take(row), part.column(2).take(row)], ["key", "place", "n", "nid", "comp"])

    entries = written(words.select("nid", "words", "comp").mapInArrow(emit, "key long, place int, n int, nid long, comp long"))
    least_shared = lambda p, q: F.ceil(F.lit(least / (1 + least)) * (F.col(p) + F.col(q)) - 1e-9)
    early = F.col("place") <= F.col("n") - least_shared("n", "n")
    of = entries.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("many"), F.max(early).alias("early"))
    mixed = of.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", "many").alias("most"), F.max("early").alias("early")).where("comps > 1 and early").select("key", "most")
    met = written(entries.join(mixed, "key"))
    a, b = (met.where(early if v == "a" else F.lit(True)).select("key", "most", *(F.col(c).alias(f"{c}_{v}") for c in ("place", "n", "nid", "comp"))) for v in "ab")
    shared = least_shared("n_a", "n_b")
    fits = (F.col("comp_a") != F.col("comp_b")) & (F.col("n_a") <= F.col("n_b")) & _apart("n_a", "n_b", least) & (F.col("place_a") <= F.col("n_a") - shared) & (F.col("place_b") <= F.col("n_b") - shared)
    outer = a.where("comp_a != most").join(b.drop("most"), "key").where(fits).select("nid_a", "nid_b")
    inner = a.where("comp_a = most").drop("most").join(b.where("comp_b != most"), "key").where(fits).select("nid_a", "nid_b")
    return _ordered(outer.unionByName(inner), "nid_a", "nid_b")


def near_duplicates(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text", max_broadcast: int = 200_000) -> DataFrame:
    """id, node, class_id, class_node, n_copies and n_links for every row: class_id is the smallest id of the row's class, class_node
    that row's text hash, n_copies the rows with the very text, n_links the links found that hold the class together. Links are alignments of at least `least`; a class is what
    links connect. A text without a word (null, empty, white space) is alone in its class, with a null node; a null id
    comes before all others; ids keep their type. Repeated rows are copies of each other. Other columns of docs play no part."""
    rows = written(sketches(docs, key, text))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.count_if(F.col("id").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = written(nodes.sortWithinPartitions("node").withColumn("nid", F.monotonically_increasing_id()))
    keys = nodes.select(F.explode("sig").alias("key"), "nid", "n")
    leads = keys.groupBy("key").agg(F.min("nid").alias("lead"), F.min_by("n", "nid").alias("n2"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    multi = written(keys.join(leads, "key"))

    def words_of(wanted: DataFrame, most: int) -> DataFrame:
        """nid, sig and words of the wanted nodes, at most `most`."""
        named = nodes.select("nid", "node", "rep").join(wanted.distinct(), "nid", "left_semi")
        named = F.broadcast(named) if most <= max_broadcast else named
        found = rows.select("id", "node", "sig", "words").join(named, "node").where(F.col("id").eqNullSafe(F.col("rep"))).select("nid", "sig", "words")
        return written(found.dropDuplicates(["nid"]))

    def links_of(pairs: DataFrame) -> DataFrame:
        return written(verified(pairs, words_of(ends(pairs), 2 * pairs.count()), least))

    met = multi.where((F.col("nid") != F.col("lead")) & _apart("n", "n2", least)).select("nid", F.col("lead").alias("other"))
    tested = written(_closest(met, SHARED).select(F.col("other").alias("x"), F.col("nid").alias("y")))
    edges = links_of(tested)
    placed = joined(nodes.select("nid", F.col("nid").alias("comp")), edges, max_broadcast)
    left = crowded(multi, placed, max_broadcast)
    for salt in range(ROUNDS):
        left = written(left)
        pairs = untested(leader_pairs(left, salt, least), tested, max_broadcast)
        many = pairs.count()
        if not many:
            break
        found = links_of(pairs)
        tested, edges = tested.unionByName(pairs), edges.unionByName(found)
        linked = found.count()
        placed = joined(placed, found, max_broadcast) if linked else placed
        left = crowded(left, placed, max_broadcast)
        if not linked:
            break
    apart = left.groupBy("nid", "comp").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= SHARED)
    apart = written(apart.select("nid", "comp"))
    if many := apart.count():
        words = words_of(apart.select("nid"), many)
        pairs = untested(prefix_pairs(words.join(small(apart, max_broadcast), "nid"), least), tested, max_broadcast)
        edges = edges.unionByName(written(verified(pairs, words, least)))
    placed = nodes.select("nid").join(components(edges, max_broadcast).withColumnRenamed("node", "nid"), "nid", "left").select("nid", F.coalesce("comp", "nid").alias("comp"))
    final = nodes.join(placed, "nid").select("nid", "node", "n_copies", F.struct(F.when(F.col("nulls") == 0, F.col("rep")).alias("id"), "node").alias("lead"), "comp")
    led = final.groupBy("comp").agg(F.min("lead").alias("class"))
    links = ends(edges).groupBy("nid").agg(F.count(F.lit(1)).alias("n_links"))
    classes = final.join(led, "comp").join(links, "nid", "left").select("node", "n_copies", F.col("class.id").alias("class_id"), F.col("class.node").alias("class_node"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.select("id", "node").join(classes, "node", "left").select("id", "node", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "class_node", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text", max_broadcast: int = 200_000) -> DataFrame:
    """docs without all but one row of each class; rows without a word all stay. Columns of any name are kept."""
    found = written(near_duplicates(docs, least, key, text))
    leads = (F.col("id").eqNullSafe(F.col("class_id"))) & (F.col("node") == F.col("class_node"))
    gone = written(found.where(F.col("node").isNotNull() & ~leads).select(F.col("id").alias("gone_id"), F.col("node").alias("gone_node")).distinct())
    twice = found.where(F.col("node").isNotNull() & leads).groupBy("id", "node").count().where("count > 1").limit(1).count()
    packed = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), node_of(F.col(text)).alias("node"))
    kept = packed.join(small(gone, max_broadcast), (F.col("node") == F.col("gone_node")) & F.col("id").eqNullSafe(F.col("gone_id")), "left_anti")
    if twice:
        kept = kept.where("node is null").unionByName(kept.where("node is not null").dropDuplicates(["id", "node"]))
    return kept.select("row.*")
