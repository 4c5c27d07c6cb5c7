"""Toxicity (operator 4): FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lower_table, mix, range_hash, runs, written

#: Hashed features; the dense table of a task has as many floats (16 MB).
BUCKETS = 1 << 22


def _classes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[128:] = 1
    t[[b for b in range(128) if chr(b).isalnum()]] = 1
    return t


_CLASSES, _LOWER = _classes(), lower_table()


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word pairs and pairs with one word skipped (A-Z lower-cased), with their documents."""
    low = _LOWER[data]
    starts, ends, doc = runs(_CLASSES[low], offs)
    h = range_hash(low, starts, ends)
    found, of = [h], [doc]
    for gap in (1, 2):
        same = np.flatnonzero(doc[gap:] == doc[:-gap]) if len(h) > gap else np.zeros(0, np.int64)
        found.append(mix(h[same] * np.uint64(2 * gap + 1) + (h[same + gap] ^ np.uint64(gap))))
        of.append(doc[same])
    return (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(of)


def ftrl(rows: list[tuple[np.ndarray, float]], start: tuple[np.ndarray, np.ndarray, np.ndarray], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates over rows (distinct features, label). Feature BUCKETS is the bias, which
    has no L1. start: sorted features, weights, squared gradient sums. Returns features, weights, sums."""
    names = np.unique(np.concatenate([np.array([BUCKETS]), start[0], *(f for f, _ in rows)]))
    local = [np.searchsorted(names, f) for f, _ in rows]
    at, bias = np.searchsorted(names, start[0]), len(names) - 1
    n, z = np.zeros(len(names)), np.zeros(len(names))
    first = np.full(len(names), l1)
    first[bias] = 0
    n[at] = start[2]
    w0 = start[1]
    z[at] = -(w0 * ((beta + np.sqrt(n[at])) / alpha + l2)) - np.sign(w0) * first[at]
    for _ in range(epochs):
        for f, (_, y) in zip(local, rows, strict=True):
            i = np.append(f, bias)
            c = first[i]
            w = np.where(np.abs(z[i]) <= c, 0.0, (np.sign(z[i]) * c - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    w = np.where(np.abs(z) <= first, 0.0, (np.sign(z) * first - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return names, w, n


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", max_train: int = 16000, shard_rows: int = 4000, rounds: int = 1, epochs: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.18, l2: float = 1.0, min_docs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features and weights, averaged over shards of about shard_rows rows after each round (iterative parameter
    mixing): a weight is the mean over the shards that have the feature. At most max_train labelled rows (lowest hashes of
    the key) are used; null keys or labels teach nothing, of several labels of one key the highest counts. A shard's L1 is
    l1 times the root of its rows; features that fewer than min_docs of all the used rows have are left out."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(label).cast("double").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__k"), "__k").limit(max_train)
    rows = written(docs.select(F.col(key), F.col(text).alias("__text")).join(F.broadcast(chosen), F.col(key) == F.col("__k")).select(F.xxhash64("__k", F.lit(2)).alias("at"), F.coalesce("__text", F.lit("")).alias("text"), "__y"))
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.hash("at"), F.lit(shards)))
    model = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))

    def distinct(column: pa.Array) -> list[np.ndarray]:
        """Each text's different features."""
        out = []
        for _, _, data, offs in chunks(column):
            f, doc = features(data, offs)
            pair = np.unique(doc * (BUCKETS * 2) + f)
            cut = np.searchsorted(pair, np.arange(len(offs)) * (BUCKETS * 2))
            out += [pair[a:b] & (BUCKETS * 2 - 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for f in distinct(batch.column(0)):
                total[f] += 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at].astype(np.int64))], ["feature", "rows"])

    often = rows.select("text").mapInArrow(count, "feature long, rows long").groupBy("feature").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= min_docs)
    common = np.zeros(BUCKETS + 1, bool)
    common[often.toArrow().column("feature").to_numpy()] = True  # at most BUCKETS rows
    bits = np.packbits(common)

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("at", "ascending"), ("text", "ascending")])
        labels, kept = group.column("__y").to_numpy() > 0, np.unpackbits(bits).astype(bool)
        docs_ = [f[kept[f]] for f in distinct(group.column("text").combine_chunks())]
        names, w, n = ftrl(list(zip(docs_, labels.astype(float), strict=True)), model, epochs, alpha, beta, l1 * len(labels) ** 0.5, l2)
        return pa.table({"feature": pa.array(names, pa.int64()), "w": pa.array(w, pa.float64()), "n": pa.array(n, pa.float64())})

    for _ in range(rounds):
        mixed = rows.groupBy("shard").applyInArrow(fit, "feature long, w double, n double").groupBy("feature").agg(F.avg("w").alias("w"), F.avg("n").alias("n"))
        got = mixed.where(F.abs("w") > 1e-3).orderBy("feature").toArrow()  # sparse by L1, at most BUCKETS + 1 rows
        model = tuple(got.column(c).to_numpy() for c in ("feature", "w", "n"))
    return model[0], model[1]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """keep columns and score of every row; a null or empty text has the bias alone. Kept columns may have any names; a
    kept `score` is replaced."""
    keep = [c for c in dict.fromkeys(keep) if c.lower() != "score"]
    inner = {c: f"__kept{i}" for i, c in enumerate(keep)}
    docs = docs.select(F.col(text).alias("__body"), *(F.col(c).alias(k) for c, k in inner.items()))
    keep, text = list(inner.values()), "__body"
    names, weights = model
    names, weights = names.astype(np.int64), weights.astype(np.float64)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(BUCKETS + 1, np.float32)
        dense[names] = weights
        bias = float(dense[BUCKETS])
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for lo, hi, data, offs in chunks(batch.column(batch.schema.get_field_index("__text"))):
                f, doc = features(data, offs)
                hit = np.flatnonzero(dense[f])
                pair = np.unique(doc[hit] * (BUCKETS * 2) + f[hit])
                out[lo:hi] += np.bincount(pair // (BUCKETS * 2), weights=dense[pair % (BUCKETS * 2)], minlength=hi - lo)
            p = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(p, pa.float64())], [*keep, "score"])

    scored = docs.select(*keep, F.col(text).alias("__text")).mapInArrow(apply, docs.select(*keep).schema.add("score", "double"))
    return scored.select(*(F.col(k).alias(c) for c, k in inner.items()), "score")
