"""LM scoring (operator 6): a hidden Markov language model. Baum-Welch counts are summed over the partitions; the scaled
forward recursion gives the exact likelihood of each text.

Symbols of the chain: the end, the most frequent words, and TAIL classes (by hash) that hold all other words. Within a
class a word has its add-one share of the class, so the model gives every text, with any words, a probability."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, class_table, lower_table, range_hash, runs, segments, written

#: Classes of rare words; words that are symbols of their own; words whose counts every task holds (12 bytes each).
TAIL, SYMBOLS, HEAD = 256, 16_000, 200_000
#: Hash of the end; no word has it.
END = 0
_CLASSES, _LOWER = class_table(), lower_table()


def hashed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit hashes of the words (A-Z lower-cased) and their documents."""
    starts, ends, doc = runs(_CLASSES[data], offs)
    h = range_hash(_LOWER[data], starts, ends).view(np.int64)
    h[h == END] = 1
    return h, doc


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """h, c: each different word of all the texts, by hash, and its count; END has the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, where = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(where, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            if batch.num_rows:
                held.append((np.array([END]), np.array([batch.num_rows])))
            for _, _, data, offs in chunks(batch.column(0)):
                held.append(np.unique(hashed(data, offs)[0], return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield pa.record_batch([pa.array(held[0][0]), pa.array(held[0][1])], ["h", "c"])
                        held, size = [], 0
        if held:
            h, n = merged()
            for lo in range(0, len(h), 100_000):
                yield pa.record_batch([pa.array(h[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], ["h", "c"])

    return docs.select(text).mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Counts:
    """What every task knows of the vocabulary. head: sorted hashes, their counts and symbols."""

    tokens: int
    types: int
    head: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    tail_tokens: np.ndarray
    tail_types: np.ndarray
    n_symbols: int

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.types + 1))

    def within(self, c: np.ndarray, h: np.ndarray) -> np.ndarray:
        """log10 of a rare word's share of its class."""
        k = h % TAIL
        return np.log10((c + 1) / (self.tail_tokens[k] + self.tail_types[k] + 1))


def _at_most(vocab: DataFrame, limit: int) -> float:
    """The lowest count such that at most limit words have it or more, in steps of an eighth of an octave."""
    step = F.floor(F.log2("c") * 8)
    bins = sorted(vocab.groupBy(step.alias("b")).count().collect(), reverse=True)  # under 520 bins for 64-bit counts
    total = 0
    for b, n in bins:
        total += n
        if total > limit:
            return 2 ** ((b + 1) / 8)
    return 0


def counts_of(vocab: DataFrame, symbols: int = SYMBOLS, head: int = HEAD) -> Counts:
    """The vocabulary's totals and its head: at most `head` words, of which at most `symbols` are symbols."""
    total = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words = vocab.where(F.col("h") != END)
    own, known = max(2.0, _at_most(words, symbols)), max(2.0, _at_most(words, head))
    got = words.where(F.col("c") >= min(known, own) - 1e-9).orderBy("h").toArrow()
    h, c = got.column("h").to_numpy(), got.column("c").to_numpy()
    top = c >= own - 1e-9
    sym = np.where(top, TAIL + np.cumsum(top), 1 + h % TAIL).astype(np.int64)
    rest = words.where(F.col("c") < own - 1e-9).groupBy(F.pmod("h", F.lit(TAIL)).alias("k")).agg(F.sum("c"), F.count(F.lit(1))).collect()
    tokens, types = np.zeros(TAIL), np.zeros(TAIL)
    for k, a, b in rest:
        tokens[k], types[k] = a, b
    return Counts(int(total[0]), int(total[1]), h, c, sym, tokens, types, 1 + TAIL + int(top.sum()))


ENCODED = "row long, n_tokens long, n_known long, base_score double, extra double, symbols binary, rare array<long>"


def encoded(docs: DataFrame, counts: Counts, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns, and of each text: the chain's symbols (16-bit, little-endian), tokens, and what the head tells of
    the known tokens, the base score and the shares of classes. rare: hashes of the words that the head lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        base, within = counts.base(counts.counts), counts.within(counts.counts, counts.head)
        own = counts.symbols > TAIL
        within[own] = 0
        for batch in batches:
            n = batch.num_rows
            size, known, score, extra = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            sym: list[bytes] = []
            rare_at, rare = [np.zeros(1, np.int64)], []
            for lo, hi, data, offs in chunks(batch.column(batch.schema.get_field_index("__text"))):
                h, doc = hashed(data, offs)
                seg = segments(doc, hi - lo)
                at = np.minimum(np.searchsorted(counts.head, h), max(len(counts.head) - 1, 0))
                hit = counts.head[at] == h if len(counts.head) else np.zeros(len(h), bool)
                s = np.where(hit, counts.symbols[at] if len(counts.head) else 0, 1 + h % TAIL).astype("<u2")
                size[lo:hi] += np.diff(seg)
                where, doc_hit = at[hit], doc[hit]
                known[lo:hi] = np.bincount(doc_hit, minlength=hi - lo)
                score[lo:hi] = np.bincount(doc_hit, weights=base[where], minlength=hi - lo)
                extra[lo:hi] = np.bincount(doc_hit, weights=within[where], minlength=hi - lo)
                sym += [s[a:b].tobytes() + b"\0\0" for a, b in zip(seg[:-1], seg[1:], strict=True)]
                rare.append(h[~hit])
                rare_at.append(rare_at[-1][-1] + np.cumsum(np.bincount(doc[~hit], minlength=hi - lo)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(rare_at), pa.int32()), pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64)))
            cols = [pa.array(np.arange(row, row + n)), pa.array(size), pa.array(known), pa.array(score), pa.array(extra), pa.array(sym, pa.binary()), lists]
            row += n
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *cols], [*keep, *(x.split()[0] for x in ENCODED.split(", "))])

    part = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), ENCODED])
    return part.mapInArrow(run, schema)


@dataclass
class Chain:
    """start [K], move [K, K], emit [symbols, K]."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_chain(unigram: np.ndarray, seeds: list[np.ndarray], states: int) -> Chain:
    """Each state begins with the shares of all symbols, half of it replaced by those of one seed text."""
    emit = np.tile(unigram[:, None], (1, states))
    rng = np.random.default_rng(11)
    for k in range(states):
        if k < len(seeds) and len(seeds[k]):
            emit[:, k] = 0.5 * emit[:, k] + 0.5 * np.bincount(seeds[k], minlength=len(unigram)) / len(seeds[k])
        emit[:, k] *= rng.uniform(0.9, 1.1, len(unigram))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Chain(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _segments_of(symbols: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into rows of length (padded with -1), each text's first row, and the texts' sizes."""
    sizes = np.array([len(s) for s in symbols])
    rows = -(-sizes // length)
    out = np.full((rows.sum(), length), -1, np.int32)
    flat = np.concatenate(symbols).astype(np.int32)
    row = np.repeat(np.cumsum(rows) - rows, sizes)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row + pos // length, pos % length] = flat
    return out, np.cumsum(rows) - rows, sizes


def messages(symbols: list[np.ndarray], chain: Chain, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of _segments_of: the share of states before its first word, given the words before, and the
    likelihood of the words after it by its last word's state (up to a factor). Whole texts go forward and backward side
    by side; a text of one row takes no step."""
    sizes = np.array([len(s) for s in symbols])
    rows = -(-sizes // length)
    K = len(chain.start)
    heads, tails = np.tile(chain.start.astype(np.float32), (rows.sum(), 1)), np.ones((rows.sum(), K), np.float32)
    order = np.argsort(-sizes, kind="stable")
    order = order[: int((rows > 1).sum())]
    if not len(order):
        return heads, tails
    flat = np.concatenate(symbols).astype(np.int32)
    begin, row, n = (np.cumsum(sizes) - sizes)[order], (np.cumsum(rows) - rows)[order], sizes[order]
    emit, move, back = chain.emit.astype(np.float32), chain.move.astype(np.float32), chain.move.T.astype(np.float32).copy()
    longer = len(n) - np.searchsorted(n[::-1], np.arange(n[0] + 1), side="right")  # how many have more than t words
    last = (-(-n // length) - 1) * length  # the last row's first word
    open_ = len(n) - np.searchsorted(last[::-1], np.arange(last[0] + 1))  # how many have a row that begins at t or later
    state = np.tile(chain.start.astype(np.float32), (len(n), 1))
    for t, k in enumerate(open_.tolist()):
        now = state[:k] if t == 0 else state[:k] @ move
        if t and t % length == 0:
            heads[row[:k] + t // length] = now
        now = now * emit[flat[begin[:k] + t]]
        state = now / now.sum(axis=1, keepdims=True)
    beta = np.ones((len(n), K), np.float32)
    for t in range(int(n[0]) - 1, length - 1, -1):  # from the word at t back to the one before
        k = int(longer[t])
        now = (emit[flat[begin[:k] + t]] * beta[:k]) @ back
        beta[:k] = now / now.sum(axis=1, keepdims=True)
        if t % length == 0:
            tails[row[:k] + t // length - 1] = beta[:k]
    return heads, tails


def expectations(symbols: list[np.ndarray], chain: Chain, n_symbols: int, length: int = 48, rows: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Exact Baum-Welch counts of whole texts: starts [K], moves [K, K], emissions [symbols, K], and the texts' log
    likelihood. Rows of `length` words are worked on many at a time, each between the messages of the rest of its text."""
    obs, first, sizes = _segments_of(symbols, length)
    heads, tails = messages(symbols, chain, length)
    K = len(chain.start)
    emit = np.vstack([chain.emit, np.ones((1, K))]).astype(np.float32)  # -1: padding, tells nothing
    A, back = chain.move.astype(np.float32), chain.move.T.astype(np.float32).copy()  # noqa: N806
    starts, moves, out, total = np.zeros(K), np.zeros((K, K)), np.zeros((n_symbols, K)), 0.0
    ends, begins = np.empty_like(heads), np.empty_like(heads)
    is_first = np.zeros(len(obs), bool)
    is_first[first] = True
    for lo in range(0, len(obs), rows):
        part = obs[lo : lo + rows]
        b = emit[part.T]  # [length, rows, K]
        alpha, scale = np.empty_like(b), np.empty(part.T.shape, np.float32)
        for t in range(length):
            x = (heads[lo : lo + rows] if t == 0 else alpha[t - 1] @ A) * b[t]
            scale[t] = np.maximum(x.sum(axis=1), 1e-30)
            alpha[t] = x / scale[t][:, None]
        real = part.T >= 0
        total += float(np.log(scale[real]).sum())
        ends[lo : lo + rows] = alpha[-1]
        beta = tails[lo : lo + rows]
        beta = beta / np.maximum((alpha[-1] * beta).sum(axis=1, keepdims=True), 1e-30)
        gamma = alpha  # in place, from the end on
        for t in range(length - 1, 0, -1):
            ahead = b[t] * beta / scale[t][:, None]
            moves += (alpha[t - 1] * real[t][:, None]).T @ ahead
            gamma[t] = alpha[t] * beta
            beta = ahead @ back
        begins[lo : lo + rows] = b[0] * beta / scale[0][:, None]
        gamma[0] = alpha[0] * beta
        gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-30)
        flat, weights = part.T[real], gamma[real]
        out += np.stack([np.bincount(flat, weights=weights[:, k], minlength=n_symbols) for k in range(K)], axis=1)
        starts += gamma[0][is_first[lo : lo + rows]].sum(axis=0)
    later = np.flatnonzero(~is_first)
    moves += ends[later - 1].T @ begins[later]
    return starts, moves * chain.move, out, total


def baum_welch(rows: DataFrame, counts: Counts, states: int = 8, rounds: int = 5, least_gain: float = 1e-3) -> Chain:
    """rows(symbols): Baum-Welch over all of them; each round's counts are summed per symbol by Spark. It ends after
    `rounds`, or when a round raised the log likelihood of a word by less than least_gain."""
    n, names = counts.n_symbols, [f"g{k}" for k in range(states)]
    unigram = np.full(n, 1e-6)
    np.add.at(unigram, counts.symbols[counts.symbols > TAIL], counts.counts[counts.symbols > TAIL])
    unigram[1 : TAIL + 1] += counts.tail_tokens
    unigram[0] += max(counts.tokens - unigram[1:].sum(), 1)
    unigram /= unigram.sum()
    seeds = rows.where(F.length("symbols") >= 200).select("symbols", F.xxhash64("symbols").alias("o")).orderBy("o").limit(states).collect()
    chain, before = first_chain(unigram, [np.frombuffer(bytes(r[0]), "<u2") for r in seeds], states), -np.inf
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], chain: Chain = chain) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n + 2 + states, states))
            for batch in batches:
                texts = [np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()]
                if texts:
                    start, moves, emit, likelihood = expectations(texts, chain, n)
                    total[:n] += emit
                    total[n] += start
                    total[n + 1 : n + 1 + states] += moves
                    total[n + 1 + states, 0] += likelihood
            at = np.flatnonzero(total.any(axis=1))
            yield pa.record_batch([pa.array(at, pa.int32()), *(pa.array(total[at, k]) for k in range(states))], ["sym", *names])

        summed = rows.select("symbols").mapInArrow(run, "sym int, " + ", ".join(f"{x} double" for x in names))
        got = summed.groupBy("sym").agg(*(F.sum(x).alias(x) for x in names)).toArrow()  # bounded: a row a symbol
        total = np.zeros((n + 2 + states, states))
        for k, x in enumerate(names):
            total[got.column("sym").to_numpy(), k] = got.column(x).to_numpy()
        emit, moves = total[:n] + 2.0 * unigram[:, None] * states, total[n + 1 : n + 1 + states] + 0.1
        chain = Chain((total[n] + 0.1) / (total[n] + 0.1).sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        now = total[n + 1 + states, 0] / max(total[:n].sum(), 1)
        if now - before < least_gain:
            break
        before = now
    return chain


def forward(symbols: list[np.ndarray], chain: Chain) -> np.ndarray:
    """log10 likelihood of each text by the scaled forward recursion, texts side by side."""
    sizes = np.array([len(s) for s in symbols])
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate(symbols).astype(np.int64) if len(symbols) else np.zeros(0, np.int64)
    begin = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    out = np.zeros(len(symbols))
    left = len(symbols) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1))
    state = np.tile(chain.start, (len(symbols), 1))
    for t, k in enumerate(left):
        x = (state[:k] if t == 0 else state[:k] @ chain.move) * chain.emit[flat[begin[:k] + t]]
        c = x.sum(axis=1)
        out[:k] += np.log10(c)
        state = x / c[:, None]
    back = np.empty(len(out))
    back[order] = out
    return back


def score_documents(docs: DataFrame, training: Column, keep: list[str], text: str = "text", states: int = 8, rounds: int = 5) -> DataFrame:
    """keep columns and n_tokens, n_known, train_tokens, base_score, score for every row; learns from the rows where
    training holds. A null or empty text is the end alone. Repeated rows count and are scored each. Kept columns may have
    any names; those of the results are replaced."""
    fresh = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in dict.fromkeys(keep) if c.lower() not in fresh]
    inner = {c: f"__kept{i}" for i, c in enumerate(keep)}  # no name of docs meets one of ours
    docs = docs.select(*(F.col(c).alias(k) for c, k in inner.items()), F.col(text).alias("__body"), training.alias("__train"))
    keep, text, marked = list(inner.values()), "__body", docs
    vocab = written(vocabulary(marked.where("__train"), text))
    counts = counts_of(vocab)
    ends = vocab.where(F.col("h") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    rows = written(encoded(marked, counts, [*keep, "__train"], text))
    chain = baum_welch(rows.where("__train"), counts, states, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x, "<u2") for x in batch.column(batch.schema.get_field_index("symbols")).to_pylist()]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*cols, pa.array(forward(texts, chain))], [*batch.schema.names[:-1], "hmm"])

    chained = rows.select(*keep, "row", "n_tokens", "n_known", "base_score", "extra", "symbols")
    scored = chained.mapInArrow(run, chained.drop("symbols").schema.add("hmm", "double"))
    spread = rows.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count(F.lit(1)).alias("n")).join(vocab, "h", "left")
    tails = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(counts.tail_tokens, counts.tail_types, strict=True))]
    classes = F.broadcast(docs.sparkSession.createDataFrame(tails, "k int, ct double, cv double"))
    c = F.coalesce("c", F.lit(0))
    rare = spread.join(classes, F.pmod("h", F.lit(TAIL)) == F.col("k")).groupBy("row").agg(
        F.sum(F.col("n") * F.log10((c + 1) / (counts.tokens + counts.types + 1))).alias("rare_base"),
        F.sum(F.col("n") * F.log10((c + 1) / (F.col("ct") + F.col("cv") + 1))).alias("rare_extra"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    end_base = float(counts.base(np.array([ends]))[0])
    zero = lambda x: F.coalesce(x, F.lit(0))
    return scored.join(rare, "row", "left").select(
        *(F.col(k).alias(c) for c, k in inner.items()), "n_tokens", (F.col("n_known") + zero("rare_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + end_base + zero("rare_base")).alias("base_score"), (F.col("hmm") + F.col("extra") + zero("rare_extra")).alias("score"),
    )
