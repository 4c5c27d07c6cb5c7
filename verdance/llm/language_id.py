"""Language identification by multilingual mixture inference (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, lower_table, runs, segment_sum, segments

BUCKETS = 1 << 16
_LETTER = re.compile(r"[^\W\d_]")


def _byte_classes() -> np.ndarray:
    t = lower_table()
    for b in range(128):
        if not chr(t[b]).isalpha():
            t[b] = 0
    return t


_CLASSES = _byte_classes()


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 4-byte n-grams that end at each letter byte (A-Z lower-cased, non-letters as one boundary), the words
    they lie in (start offsets into the grams) and each word's document."""
    x = _CLASSES[data].astype(np.uint32)
    g = x.copy()
    for k in range(1, 4):
        g[k:] |= x[:-k] << np.uint32(8 * k)
    starts, ends, doc = runs((x > 0).view(np.uint8), offs)
    for k in range(3):  # n-grams must not look into the document before: cut what lies further back than its start
        at = offs[:-1][offs[1:] - offs[:-1] > k] + k
        g[at] &= np.uint32((1 << (8 * (k + 1))) - 1)
    letters = np.flatnonzero(x)
    h = (g[letters] * np.uint32(2654435761)) >> np.uint32(16)
    first = np.concatenate([[0], np.cumsum(ends - starts)])[:-1]
    return h.astype(np.int64), first, np.append(first, len(letters)), doc


def train(docs: DataFrame, max_languages: int = 64) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities [BUCKETS, languages] of hashed n-grams, from docs(text, lang) over all its rows.
    Rows with a null text or language teach nothing. The model has at most BUCKETS x max_languages numbers; more
    languages are refused."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs], dtype=np.int64)
            for lo, hi, data, offs in chunks(batch.column(0)):
                h, _, bounds, doc = grams(data, offs)
                kind = np.repeat(code[lo:hi][doc], np.diff(bounds))
                n = np.bincount(kind * BUCKETS + h, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for i, x in enumerate(names):
                    total[x] = total.get(x, 0) + n[i]
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "gram", "n"])

    labelled = docs.select("text", "lang").where("text is not null and lang is not null")
    seen = labelled.select("lang").distinct().limit(max_languages + 1).count()  # before any task counts for each of them
    if seen > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counted = labelled.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # bounded: BUCKETS rows a language
    names = sorted(set(got.column("lang").to_pylist()))
    model = np.full((BUCKETS, len(names)), 0.01)
    code = {x: i for i, x in enumerate(names)}
    model[got.column("gram").to_numpy(), [code[x] for x in got.column("lang").to_pylist()]] += got.column("n").to_numpy()
    return names, np.log(model / model.sum(axis=0)).astype(np.float32) if names else model.astype(np.float32)


def _em(p: np.ndarray, seg: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of each document's proportions; p: the words' likelihoods. Proportions that are 0 stay 0.
    Also the log likelihood under the last proportions."""
    n = np.diff(seg)
    doc = np.repeat(np.arange(len(n)), n)
    for _ in range(steps):
        r = p * pi[doc]
        r /= r.sum(axis=1, keepdims=True)
        pi = segment_sum(r, seg) / n[:, None]
    return pi, segment_sum(np.log((p * pi[doc]).sum(axis=1)), seg)


def mixture(ll: np.ndarray, seg: np.ndarray, penalty: float = 4.0, steps: int = 6) -> np.ndarray:
    """Proportions [documents, languages] of documents that each have a word: EM with all languages, then the least
    likely language goes as long as the log likelihood, less penalty per language, does not fall."""
    p = np.maximum(np.exp(ll - ll.max(axis=1, keepdims=True)), 1e-30)
    n = np.diff(seg)
    pi, _ = _em(p, seg, np.full((len(n), p.shape[1]), 1 / p.shape[1]), steps)
    pi[(pi < np.minimum(1 / n, 0.05)[:, None]) & (pi < pi.max(axis=1, keepdims=True))] = 0  # under one word: it can't pay
    pi /= pi.sum(axis=1, keepdims=True)
    alive = np.flatnonzero((pi > 0).sum(axis=1) > 1)
    while len(alive):
        take = np.zeros(len(n), bool)
        take[alive] = True
        sub = p[np.repeat(take, n)]
        cut = np.concatenate([[0], np.cumsum(n[alive])])
        now, full = _em(sub, cut, pi[alive], 2)
        less = np.where(now > 0, now, np.inf)
        rows = np.arange(len(alive))
        less[rows, less.argmin(axis=1)] = 0
        less[~np.isfinite(less)] = 0
        less, fewer = _em(sub, cut, less / less.sum(axis=1, keepdims=True), 3)
        good = fewer + penalty >= full
        pi[alive] = np.where(good[:, None], less, now)
        alive = alive[good & ((less > 0).sum(axis=1) > 1)]
    return pi


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", penalty: float = 4.0) -> DataFrame:
    """docs with lang_pred, score (that language's share of the words, 0 to 1) and lang_set (the languages selected by
    penalised likelihood, largest share first, comma-joined). `und`, score 0 and an empty set if text is null or has no
    letter, or if no language was learned. Columns of docs with these names are replaced."""
    names, logs = model
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "lang_set")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            pred, score, sets = ["und"] * len(col), np.zeros(len(col)), [""] * len(col)
            for lo, hi, data, offs in chunks(col) if names else ():
                h, first, bounds, doc = grams(data, offs)
                if not len(first):
                    continue
                ll = np.empty((len(first), len(names)), np.float32)
                for k in range(len(names)):
                    ll[:, k] = np.add.reduceat(logs[h, k], first)
                seg = segments(doc, hi - lo)
                full = np.flatnonzero(np.diff(seg))
                pi = mixture(ll, np.append(seg[full], seg[-1]), penalty)
                best = pi.argmax(axis=1)
                for i, d in enumerate(full):
                    if _LETTER.search(bytes(data[offs[d] : offs[d + 1]]).decode("utf-8", "replace")):
                        pred[lo + d], score[lo + d] = names[best[i]], min(1.0, pi[i, best[i]])
                        sets[lo + d] = ",".join(names[k] for k in np.argsort(-pi[i], kind="stable") if pi[i, k] > 0)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*kept, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], [*keep, "lang_pred", "score", "lang_set"])

    schema = docs.select(keep).schema.add("lang_pred", "string").add("score", "double").add("lang_set", "string")
    return docs.select(*{*keep, text} if text not in keep else keep).mapInArrow(predict, schema)


def held_out(n: int = 3, rest: int = 1) -> Column:
    from .common import crc_mod

    return F.coalesce(crc_mod("doc_id", n) == rest, F.lit(False))
