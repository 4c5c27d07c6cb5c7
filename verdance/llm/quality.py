"""Quality classifier (operator 1): random-indexing word vectors, pooled per document, then a two-layer network with
temperature-calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, mix, range_hash, runs, segment_sum, segments, written

#: Hashed vocabulary, dimensions, and non-zero entries of a random index vector.
WORDS, DIMS, ONES = 8192, 32, 4


def _classes() -> np.ndarray:
    t = np.full(256, 3, np.uint8)  # symbols
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.isalpha():
            t[b] = 1
        elif c.isdigit():
            t[b] = 2
        elif b in b" \t\n\v\f\r\0":
            t[b] = 0
    return t


_CLASSES = _classes()


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs (0: plus, 1: minus) of each hashed word's random index vector."""
    h = mix(np.arange(1, WORDS * ONES + 1, dtype=np.uint64)).reshape(WORDS, ONES)
    return (h % np.uint64(DIMS)).astype(np.int64), ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (runs of letters, digits or symbols) and their documents."""
    starts, ends, doc = runs(_CLASSES[data], offs)
    return (range_hash(data, starts, ends) % np.uint64(WORDS)).astype(np.int64), doc


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """[WORDS, DIMS] float32: each hashed word's sum of its neighbours' random index vectors over every text, centred,
    scaled to length 1, plus the word's own index vector. Fixed size, whatever the corpus."""
    dims, signs = index_vectors()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WORDS, DIMS), np.int64)
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                w, doc = tokens(data, offs)
                near = np.flatnonzero(doc[1:] == doc[:-1]) if len(w) else []
                if len(near):
                    a, b = np.concatenate([w[near], w[near + 1]]), np.concatenate([w[near + 1], w[near]])
                    both = np.zeros(WORDS * DIMS * 2, np.int64)
                    for k in range(ONES):
                        both += np.bincount((a * DIMS + dims[b, k]) * 2 + signs[b, k], minlength=len(both))
                    both = both.reshape(WORDS, DIMS, 2)
                    total += both[:, :, 0] - both[:, :, 1]
        at = np.flatnonzero(total.any(axis=1))
        if len(at):
            yield pa.record_batch([pa.array(at, pa.int32()), *(pa.array(total[at, k], pa.int64()) for k in range(DIMS))], ["word", *(f"v{k}" for k in range(DIMS))])

    schema = "word int, " + ", ".join(f"v{k} long" for k in range(DIMS))
    summed = docs.select(text).mapInArrow(count, schema).groupBy("word").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIMS)))
    got = summed.toArrow()  # bounded: WORDS rows
    out = np.zeros((WORDS, DIMS))
    for k in range(DIMS):
        out[got.column("word").to_numpy(), k] = got.column(f"v{k}").to_numpy()
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.where(size > 0, out / np.maximum(size, 1e-12), 0)
    out -= np.average(out, axis=0, weights=size[:, 0]) if size.any() else 0
    out = np.where(size > 0, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12), 0)
    own = np.zeros((WORDS, DIMS))
    np.add.at(own, (np.repeat(np.arange(WORDS), ONES), dims.ravel()), 1 - 2 * signs.ravel())
    return (out + own / np.sqrt(ONES)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns and feats (array<float> of 2 x DIMS + 1): mean and spread of the document's word vectors, and the log
    of its number of words. All 0 for an empty or null text."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = np.zeros((batch.num_rows, 2 * DIMS + 1), np.float32)
            for lo, hi, data, offs in chunks(batch.column(batch.schema.get_field_index("__text"))):
                w, doc = tokens(data, offs)
                seg = segments(doc, hi - lo)
                n = np.maximum(np.diff(seg), 1)[:, None]
                v = vectors[w]
                mean = segment_sum(v, seg) / n
                feats[lo:hi, :DIMS] = mean
                feats[lo:hi, DIMS : 2 * DIMS] = np.sqrt(np.maximum(segment_sum(v * v, seg) / n - mean**2, 0))
                feats[lo:hi, -1] = np.log1p(np.diff(seg))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(feats.ravel(), pa.float32()), feats.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in keep), flat], [*keep, "feats"])

    part = docs.select(*keep, F.col(text).alias("__text"))
    return part.mapInArrow(pool, docs.select(*keep).schema.add("feats", T.ArrayType(T.FloatType())))


@dataclass
class Network:
    """Two layers; temperature divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on the log loss with a little weight decay; every fifth row is kept out to choose the temperature. Without
    rows of both labels the score is their share (0.5 without rows)."""
    dims = 2 * DIMS + 1
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Network(np.zeros(dims), np.ones(dims), np.zeros((dims, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    test = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, np.sqrt(2 / dims), (dims, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    zt, yt = z[~test], y[~test]
    for _ in range(epochs):
        at = rng.permutation(len(yt))
        for i in range(0, len(at), 256):
            a, b = zt[at[i : i + 256]], yt[at[i : i + 256]]
            h = np.maximum(a @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - b) / len(b)
            dh = np.outer(d, p[2]) * (h > 0)
            t += 1
            for k, g in enumerate((a.T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum())):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
    held = test if test.any() else ~test
    logit, truth = net.logits(x[held]), y[held]
    loss = lambda t: np.mean(np.logaddexp(0, -np.where(truth > 0, 1, -1) * logit / t))
    net.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss))
    return net


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], label: str = "quality", max_train: int = 20000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """keep columns of docs and score. Word vectors come from every text of docs; the network is fitted on at most
    max_train labelled rows (the lowest hashes of the key), the scores cover every row. labels(key, label): null keys or
    labels teach nothing, of several labels of one key the highest counts. Kept columns may have any names; a kept
    `score` is replaced."""
    keep = [c for c in dict.fromkeys(keep) if c.lower() != "score"]
    inner = {c: f"__kept{i}" for i, c in enumerate(keep)}  # no name of docs meets one of ours
    docs = docs.select(F.col(key).alias("__key"), F.col(text).alias("__body"), *(F.col(c).alias(k) for c, k in inner.items()))
    labels = labels.select(F.col(key).alias("__key"), F.col(label).alias("__label"))
    key, text, label, keep = "__key", "__body", "__label", list(inner.values())
    vectors = word_vectors(docs, text)
    feats = written(pooled(docs, vectors, list(dict.fromkeys([key, *keep])), text))
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(label).cast("double").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__k"), "__k").limit(max_train)
    got = feats.join(F.broadcast(chosen), F.col(key) == F.col("__k")).select("__k", "feats", "__y").orderBy(F.xxhash64("__k"), "__k", "feats").limit(max_train).toArrow()
    y = got.column("__y").to_numpy().astype(np.float64)
    x = got.column("feats").combine_chunks()
    x = x.flatten().to_numpy().reshape(-1, 2 * DIMS + 1) if len(y) else np.zeros((0, 2 * DIMS + 1))
    net = fit(x, (y > 0).astype(np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(batch.schema.get_field_index("feats"))
            p = net.score(f.flatten().to_numpy().reshape(-1, 2 * DIMS + 1).astype(np.float64)) if len(f) else np.zeros(0)
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(p, pa.float64())], [*keep, "score"])

    scored = feats.mapInArrow(score, docs.select(*keep).schema.add("score", "double"))
    return scored.select(*(F.col(k).alias(c) for c, k in inner.items()), "score")
