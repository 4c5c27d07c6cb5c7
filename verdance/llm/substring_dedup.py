"""Substring dedup (operator 8): seed and extend. Documents meet on winnowed anchors, matches are extended both ways to
maximal repeats, and every word of a window that also starts earlier goes.

Each window of `width` words has one anchor: the smallest hash of its k-word grams. An anchor stands for the run of
windows that choose it, and equal windows choose equal anchors at equal places. So windows need comparing only among the
occurrences of one anchor, and only if the anchor occurs twice. Occurrences whose whole runs are equal form a class, and
meet the class's first occurrence; the first ones of anchors with several classes meet window by window. That gives each
repeated window one earlier occurrence, never all pairs; within a document it is the one just before, so that a text which
repeats itself is one long repeat. What meets at one shift of two documents is a match. A match is
compared as a whole by a 128-bit digest of its words, then word by word beyond both its ends until the words differ or a
document ends, which makes it a maximal repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, class_table, mix, range_hash, runs, segments, small, written
from .decontamination import keyed

_CLASSES = class_table()
GRAM = 8


def anchor_runs(words: np.ndarray, seg: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """From word hashes and document offsets: anchor hash, first and last window start, document of each run of windows
    with one anchor. Nothing for documents of fewer than width words."""
    reach = width - GRAM + 1
    n = len(words)
    z = np.zeros(0, np.int64)
    if n < width:
        return np.zeros(0, np.uint64), z, z, z
    at = np.arange(n - GRAM + 1)
    grams = range_hash(words, at, at + GRAM)
    best = np.arange(n - width + 1) + np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1)
    doc = np.searchsorted(seg, np.arange(n - width + 1), side="right") - 1
    valid = np.arange(n - width + 1) + width <= seg[doc + 1]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return np.zeros(0, np.uint64), z, z, z
    p = best[starts]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    lo, hi = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    return grams[p[new]], lo, hi, doc[lo]


def second_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of each word data[s:e]: a sum of its bytes mixed with their places, no polynomial, so that
    words which range_hash confuses differ here. Words have a byte at least."""
    if not len(s):
        return np.zeros(0, np.uint64)
    n = e - s
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    mixed = mix(data[np.repeat(s, n) + place].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1))
    return mix(np.add.reduceat(mixed, first) + n.astype(np.uint64))


def previous(doc: np.ndarray, c: np.ndarray, d: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The greatest smaller at of an entry with equal doc, c and d; -1 if there is none."""
    order = np.lexsort((at, d, c, doc))
    same = np.ones(max(len(order) - 1, 0), bool)
    for x in (doc, c, d):
        same &= x[order[1:]] == x[order[:-1]]
    out = np.full(len(order), -1, np.int64)
    out[order[1:][same]] = at[order[:-1][same]]
    return out


def anchors(corpus: DataFrame, width: int) -> DataFrame:
    """a (anchor), c and d (hashes of its whole run of windows), __id, __sub, at (first window start x 64 + further windows)
    and prev (first window start of the last equal run before in the same document, or -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offs in chunks(batch.column(2)):
                s, e, doc = runs(_CLASSES[data], offs)
                words, seg = range_hash(data, s, e), segments(doc, hi - lo)
                a, first, last, of = anchor_runs(words, seg, width)
                if len(a):
                    c = mix(range_hash(words, first, last + width) + (last - first).astype(np.uint64))
                    d = range_hash(second_hash(data, s, e), first, last + width)
                    at = (first - seg[of]) * 64 + (last - first)
                    cols = [a.view(np.int64), c.view(np.int64), d.view(np.int64), ids[lo + of], subs[lo + of], at, previous(of, c, d, first - seg[of])]
                    yield pa.record_batch([pa.array(x) for x in cols], ["a", "c", "d", "__id", "__sub", "at", "prev"])

    return corpus.mapInArrow(run, "a long, c long, d long, __id long, __sub long, at long, prev long")


def _within_budget(df: DataFrame, size: str, max_values: int) -> bool:
    return (df.agg(F.sum(F.size(size) + 4)).first()[0] or 0) <= max_values


def spread_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right, which has one row a key and in n its number of rows in left; n is left out. Keys of more
    than 4,096 rows and a 100,000th of all are broadcast, so that their rows stay where they are: they are fewer than
    100,000 at any size. The others are shuffled."""
    total, most = right.agg(F.sum("n"), F.max("n")).first()
    limit = max(4096, (total or 0) // 100_000)
    if (most or 0) <= limit:
        return left.join(right.drop("n"), keys)
    hot = F.broadcast(right.where(F.col("n") > limit).drop("n"))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col("n") <= limit).drop("n"), keys)
    return left.join(hot, keys).unionByName(rest)


def _islands(spans: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping and touching [lo, hi) of one document and equal `by` as one."""
    part = Window.partitionBy("__id", "__sub", *by).orderBy("lo", "hi")
    reach = F.max("hi").over(part.rowsBetween(Window.unboundedPreceding, -1))
    found = spans.repartition("__id", "__sub").withColumn("new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int"))
    found = found.withColumn("island", F.sum("new").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy("__id", "__sub", *by, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def matches(corpus: DataFrame, width: int, max_values: int = 2_000_000) -> DataFrame:
    """__id, __sub, lo, hi, s_id, s_sub, s_lo: words [lo, hi) of a document that stand earlier, from s_lo on, in document
    s_id, s_sub. Every window that starts earlier lies in one of them; they need not be maximal."""
    found = written(anchors(corpus, width))
    firsts = found.where("prev < 0").drop("prev")
    twice = written(firsts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    seeds = written(spread_join(firsts, twice, ["a"]))
    place = F.struct("__id", "__sub", "at")
    classes = written(seeds.groupBy("a", "c", "d").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    later = spread_join(seeds, classes.where("n > 1"), ["a", "c", "d"]).where(place != F.col("first"))
    lo = F.shiftright("at", 6)
    hi = (lo + F.col("at").bitwiseAND(63) + width).alias("hi")
    own = found.where("prev >= 0").select("__id", "__sub", lo.alias("lo"), hi, F.col("__id").alias("s_id"), F.col("__sub").alias("s_sub"), F.col("prev").alias("s_lo"))
    links = later.select("__id", "__sub", lo.alias("lo"), hi, F.col("first.__id").alias("s_id"), F.col("first.__sub").alias("s_sub"), F.shiftright("first.at", 6).alias("s_lo"))

    several = written(classes.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    edges = spread_join(classes.select("a", "first"), several, ["a"]).select("first.*").groupBy("__id", "__sub").agg(F.collect_list("at").alias("ats"))
    edges = written(edges)
    if _within_budget(edges, "ats", max_values):
        edges = F.broadcast(edges)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for lo, hi, data, offs in chunks(batch.column(2)):
                s, e, doc = runs(_CLASSES[data], offs)
                words, seg = range_hash(data, s, e), segments(doc, hi - lo)
                ats = wanted.slice(lo, hi - lo)
                of = np.repeat(np.arange(hi - lo), ats.value_lengths().to_numpy())
                at = ats.flatten().to_numpy()
                more = at % 64 + 1
                start = np.repeat(at // 64, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                of = np.repeat(of, more)
                w, v = (range_hash(x, seg[of] + start, seg[of] + start + width) for x in (words, second_hash(data, s, e)))
                cols = [w.view(np.int64), v.view(np.int64), ids[lo + of], subs[lo + of], start, previous(of, w, v, start)]
                yield pa.record_batch([pa.array(x) for x in cols], ["w", "v", "__id", "__sub", "lo", "prev"])

    windows = written(corpus.join(edges, ["__id", "__sub"]).select("__id", "__sub", "__text", "ats").mapInArrow(around, "w long, v long, __id long, __sub long, lo long, prev long"))
    where = F.struct("__id", "__sub", "lo")
    ahead = windows.where("prev < 0").drop("prev")
    earliest = written(ahead.groupBy("w", "v").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    single = spread_join(ahead, earliest, ["w", "v"]).where(where != F.col("first"))
    end = (F.col("lo") + width).alias("hi")
    again = windows.where("prev >= 0").select("__id", "__sub", "lo", end, F.col("__id").alias("s_id"), F.col("__sub").alias("s_sub"), F.col("prev").alias("s_lo"))
    single = single.select("__id", "__sub", "lo", end, F.col("first.__id").alias("s_id"), F.col("first.__sub").alias("s_sub"), F.col("first.lo").alias("s_lo"))
    links = links.unionByName(own).unionByName(single).unionByName(again)
    shifted = links.withColumn("shift", F.col("lo") - F.col("s_lo")).drop("s_lo")
    return written(_islands(shifted, ["s_id", "s_sub", "shift"]).select("__id", "__sub", "lo", "hi", "s_id", "s_sub", (F.col("lo") - F.col("shift")).alias("s_lo")))


def surroundings(corpus: DataFrame, asked: DataFrame, reach: int, digest: bool, max_values: int = 2_000_000, most: int = 4096) -> DataFrame:
    """For each of the distinct asked(__id, __sub, lo, hi): before and after, the up to `reach` words next to [lo, hi),
    nearest first, joined by a space, and, if asked, digest of the words in it. A text meets at most about `most` ranges
    a task; lists of ranges are broadcast up to max_values numbers, else shuffled with the texts."""
    crowd = asked.groupBy("__id", "__sub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    parts = F.pmod(F.xxhash64("lo", "hi"), F.ceil(F.coalesce("n", F.lit(1)) / most))
    dealt = asked.join(small(written(crowd), max_values // 4), ["__id", "__sub"], "left").withColumn("part", parts)
    lists = written(dealt.groupBy("__id", "__sub", "part").agg(F.flatten(F.collect_list(F.array("lo", "hi"))).alias("ranges")).drop("part"))
    if _within_budget(lists, "ranges", max_values):
        lists = F.broadcast(lists)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__id", "__sub", "lo", "hi", "before", "after", "digest"]
        step = max(16, 1_000_000 // reach)  # ranges in an Arrow batch
        for batch in batches:
            for row in range(batch.num_rows):
                words = (batch.column(2)[row].as_py() or "").encode().split()
                ranges = batch.column(3)[row].values.to_numpy()
                lo, hi = ranges[::2], ranges[1::2]
                for at in range(0, len(lo), step):
                    both = list(zip(lo[at : at + step].tolist(), hi[at : at + step].tolist(), strict=True))
                    before = [b" ".join(words[max(0, a - reach) : a][::-1]) for a, _ in both]
                    after = [b" ".join(words[b : b + reach]) for _, b in both]
                    sums = [hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest() if digest else None for a, b in both]
                    of = pa.array(np.full(len(both), row))
                    yield pa.record_batch([batch.column(0).take(of), batch.column(1).take(of), pa.array(lo[at : at + step]), pa.array(hi[at : at + step]), *(pa.array(x, pa.binary()) for x in (before, after, sums))], names)

    asked_of = corpus.join(lists, ["__id", "__sub"]).select("__id", "__sub", "__text", "ranges")
    return asked_of.mapInArrow(look, "__id long, __sub long, lo long, hi long, before binary, after binary, digest binary")


def common_words(a: bytes, b: bytes) -> int:
    """How many words two lists have in common before they first differ."""
    n = 0
    for x, y in zip(a.split(), b.split(), strict=False):
        if x != y:
            break
        n += 1
    return n


def extended(corpus: DataFrame, found: DataFrame, max_values: int = 2_000_000, reach: int = 64) -> DataFrame:
    """The maximal repeats around found (as matches() has them): each is compared by a digest of its words and extended
    to both sides while the words agree. First one word is compared at each end, which settles most; the ends that agree
    go on with `reach` words, then eight times as many, until none is open."""
    range_of = ["__id", "__sub", "lo", "hi"]
    source = [F.col("s_id").alias("__id"), F.col("s_sub").alias("__sub"), F.col("s_lo").alias("lo"), (F.col("s_lo") + F.col("hi") - F.col("lo")).alias("hi")]
    done, now, look = [], found, 1
    while True:
        digest = look == 1

        def grow(batches: Iterator[pa.RecordBatch], look: int = look) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = (np.array([common_words(a, b) for a, b in zip(batch[x].to_pylist(), batch[f"s_{x}"].to_pylist(), strict=True)], np.int64) for x in ("before", "after"))
                lo, hi, s_lo = (batch[c].to_numpy() for c in ("lo", "hi", "s_lo"))
                cols = [batch["__id"], batch["__sub"], pa.array(lo - left), pa.array(hi + right), batch["s_id"], batch["s_sub"], pa.array(s_lo - left), pa.array((left == look) | (right == look))]
                yield pa.record_batch(cols, ["__id", "__sub", "lo", "hi", "s_id", "s_sub", "s_lo", "open"])

        times = written(now.select(*source).groupBy(*range_of).agg(F.count(F.lit(1)).alias("n")))
        asked = written(now.select(*range_of).unionByName(times.select(*range_of)).distinct())
        seen = written(surroundings(corpus, asked, look, digest, max_values).dropDuplicates(range_of))
        theirs = times.join(seen, range_of).select(*(F.col(c).alias(f"s_{c}") for c in range_of[:3]), F.col("hi").alias("s_hi"), *(F.col(c).alias(f"s_{c}") for c in ("before", "after", "digest")), "n").withColumnsRenamed({"s___id": "s_id", "s___sub": "s_sub"})
        ours = now.join(seen, range_of).withColumn("s_hi", F.col("s_lo") + F.col("hi") - F.col("lo"))
        met = spread_join(ours, written(theirs), ["s_id", "s_sub", "s_lo", "s_hi"])
        met = met.where(F.col("digest") == F.col("s_digest")) if digest else met
        met = met.select(*range_of, "s_id", "s_sub", "s_lo", "before", "after", "s_before", "s_after")
        grown = written(met.mapInArrow(grow, "__id long, __sub long, lo long, hi long, s_id long, s_sub long, s_lo long, open boolean").distinct())
        done.append(grown.where("not open").drop("open"))
        now = grown.where("open").drop("open")
        if not now.limit(1).count():
            break
        look = reach if digest else look * 8
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return written(out.distinct())


def maximal_repeats(docs: DataFrame, width: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, length, source, source_start: words [start, start + length) of a document that also stand from
    source_start on in document `source`, earlier (a smaller id, or the same document and an earlier start), `width`
    words or more, and that cannot be made longer on either side. Every window that starts earlier lies in a repeat with
    one earlier occurrence of it, so a passage of n documents makes about n repeats, not n x n. Texts of fewer words,
    empty and null ones have none; a null id comes before all others."""
    corpus = keyed(docs, key, text)
    real = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c))
    return extended(corpus, matches(corpus, width)).select(real("__id").alias(key), F.col("lo").alias("start"), (F.col("hi") - F.col("lo")).alias("length"), real("s_id").alias("source"), F.col("s_lo").alias("source_start"))


def removed_spans(corpus: DataFrame, width: int, max_values: int = 2_000_000) -> DataFrame:
    """__id, __sub and spans: merged [start, end) word ranges that maximal repeats cover, as start and end in turn. Lists
    that join the texts are broadcast up to max_values numbers, else shuffled."""
    repeats = extended(corpus, matches(corpus, width, max_values), max_values)
    merged = _islands(repeats.select("__id", "__sub", "lo", "hi"), [])
    listed = merged.groupBy("__id", "__sub").agg(F.flatten(F.sort_array(F.collect_list(F.array("lo", "hi")))).alias("spans"))
    listed = written(listed)
    return F.broadcast(listed) if _within_budget(listed, "spans", max_values) else listed


def deduplicate(docs: DataFrame, width: int = 20, key: str = "doc_id", text: str = "text", kept_text: bool = False) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) and, if asked, kept_text. Null texts
    have no words. Rows with equal ids and different texts are different documents (ordered by a hash of the text); rows
    equal in both are one document and keep the same words. A null id comes before all others."""
    corpus = keyed(docs, key, text)
    spans = removed_spans(corpus, width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                total, gone, sums, texts = [], [], [], []
                for text_, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    words = (text_ or "").encode().split()
                    total.append(len(words))
                    if cuts:
                        kept, at = [], 0
                        for a, b in zip(cuts[::2], cuts[1::2], strict=True):
                            kept += words[at:a]
                            at = b
                        words = kept + words[at:]
                    gone.append(total[-1] - len(words))
                    joined = b" ".join(words)
                    sums.append(hashlib.sha256(joined).hexdigest())
                    if kept_text:
                        texts.append(joined.decode())
                cols = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
                names = [key, "n_words", "n_removed", "kept_sha256"]
                yield pa.record_batch(cols + [pa.array(texts, pa.string())] * kept_text, names + ["kept_text"] * kept_text)

    out = corpus.join(spans, ["__id", "__sub"], "left").select(F.when(F.col("__id") != -(1 << 63), F.col("__id")).alias(key), "__text", "spans")
    return out.mapInArrow(cut, f"`{key}` long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * kept_text)
