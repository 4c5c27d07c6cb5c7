"""Packing (operator 3): Karmarkar-Karp multiway differencing of token pieces into windows of one capacity."""

from __future__ import annotations

import functools
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, chunks, class_table, mix, runs

#: Bytes that an encoder keeps: ids, WORD_BYTES for each known word, and of those known by their bytes these and KEY_BYTES;
#: when they are full it starts anew.
CACHE_BYTES = 40 << 20
WORD_BYTES, KEY_BYTES = 48, 120
#: Punctuation that is encoded apart from the letter or digit before it.
TAIL = ".,;:!?|#$%&*+=/)]}"
_CLASSES = class_table()
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes
_IS_TAIL, _IS_ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_IS_TAIL[list(TAIL.encode())] = True
_IS_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True


@functools.lru_cache(maxsize=1)
def load_tokenizer(path: str):
    """The tokenizer (of fixed size, so a worker process keeps it) and which of its tokens end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocab = tokenizer.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    return tokenizer, ends


class Encoder:
    """Token ids of whole texts. The tokenizer never joins text across white space and ends each run of letters with a
    word-end token, so each different word is encoded once and its ids are copied: punctuation at a word's end apart, runs of
    letters many at a time. Words are told apart by all their bytes: up to 15 bytes and the length are two numbers, which are
    compared whenever hashes agree; longer words, and those whose hash another word has, are looked up by their bytes. What it
    keeps is bounded by CACHE_BYTES, and it lives as long as a task."""

    def __init__(self, path: str):
        self.tokenizer, self.ends = load_tokenizer(path)
        self._forget()

    def _forget(self) -> None:
        self.spot: dict[bytes, int] = {}
        self.held = 0
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.names, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each word."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for ids in found for x in ids), np.uint32, size.sum()), size

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone."""
        ids, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), 2000):
            part = words[lo : lo + 2000]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[found])
            # a letter that the tokenizer takes apart makes more word ends than words
            found, many = (found, np.diff(ends, prepend=-1)) if len(ends) == len(part) else self._each(part)
            ids.append(found)
            size.append(many)
        return np.concatenate(ids), np.concatenate(size)

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Adds words that it does not know, each once; their slots."""
        words = [w.decode() for w in new]
        letters = np.fromiter((w.isalpha() for w in words), bool, len(words))
        at, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for kind, how in ((True, self._together), (False, self._each)):
            where = np.flatnonzero(letters == kind)
            ids, many = how([words[i] for i in where.tolist()])
            size[where], at[where] = many, len(self.ids) + np.cumsum(many) - many
            self.ids = np.concatenate([self.ids, ids])
        slots = len(self.at) + np.arange(len(new))
        self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, size])
        self.held += WORD_BYTES * len(new)
        return slots

    def _short(self, raw: bytes, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slots of words of up to 15 bytes, by their two numbers; -1 for a word whose hash stands for another one."""
        names, first, which = np.unique(mix(low ^ mix(high)), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        inside = spot < len(self.names)
        known[inside] = self.names[spot[inside]] == names[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            at = first[fresh]
            slots = self._learn([raw[a:b] for a, b in zip(lo[at].tolist(), hi[at].tolist(), strict=True)])
            put = spot[fresh]
            self.names, self.slot = np.insert(self.names, put, names[fresh]), np.insert(self.slot, put, slots)
            self.low, self.high = np.insert(self.low, put, low[at]), np.insert(self.high, put, high[at])
            spot = np.searchsorted(self.names, names)
        mine = spot[which]
        return np.where((self.low[mine] == low) & (self.high[mine] == high), self.slot[mine], -1)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the texts, one after another, and the texts' offsets; data and offs as chunks() has them."""
        start, end, doc = runs(_CLASSES[data], offs)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        solid = np.maximum.accumulate(np.where(_IS_TAIL[data], 0, np.arange(1, len(data) + 1)))
        core = np.maximum(solid[end - 1], start)  # where the punctuation at the end begins
        cut = np.flatnonzero((core < end) & (core > start) & _IS_ALNUM[data[core - 1]])
        lo, hi = np.insert(start, cut + 1, core[cut]), np.insert(end, cut, core[cut])
        doc = np.insert(doc, cut, doc[cut])
        if self.held + 4 * len(self.ids) > CACHE_BYTES:
            self._forget()
        raw = data.tobytes()
        # eight bytes from each place on, as a number; those after the word's end are blanked
        eight = np.ndarray((len(raw) + 8,), "<u8", raw + bytes(16), strides=(1,))
        size = hi - lo
        low = eight[lo] & _BYTES[np.minimum(size, 8)]
        high = (eight[np.minimum(lo + 8, len(raw))] & _BYTES[np.clip(size - 8, 0, 7)]) | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56))
        which = np.full(len(lo), -1, np.int64)
        few = np.flatnonzero(size <= 15)
        which[few] = self._short(raw, lo[few], hi[few], low[few], high[few])
        rest = np.flatnonzero(which < 0).tolist()
        if rest:
            words = [raw[a:b] for a, b in zip(lo[rest].tolist(), hi[rest].tolist(), strict=True)]
            new = [w for w in dict.fromkeys(words) if w not in self.spot]
            self.spot.update(zip(new, self._learn(new).tolist(), strict=True))
            self.held += sum(map(len, new)) + KEY_BYTES * len(new)
            which[rest] = [self.spot[w] for w in words]
        size = self.size[which]
        cut = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[which] - cut[:-1], size) + np.arange(cut[-1])]
        return ids, cut[np.searchsorted(doc, np.arange(len(offs)))]


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: the two partial partitions of largest spread are merged, the fullest window
    of one with the emptiest of the other, until one partition is left. Returns each window's items."""
    heap = []
    for i, n in enumerate(lengths):
        sums = [0] * windows
        sums[-1] = n
        heap.append((-n, i, sums, [None] * (windows - 1) + [i]))
    heapq.heapify(heap)
    tick = len(lengths)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        merged = sorted(((x + y, k) for k, (x, y) in enumerate(zip(a, reversed(b), strict=True))))
        low = merged[0][0]
        trees = [(of_a[k], of_b[windows - 1 - k]) for _, k in merged]
        tick += 1
        heapq.heappush(heap, (low - merged[-1][0], tick, [s - low for s, _ in merged], trees))
    out: list[list[int]] = []
    for tree in heap[0][3] if heap else [None] * windows:
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(reversed(x))
            elif x is not None:
                items.append(x)
        out.append(items)
    return out


def windows_for(lengths: list[int], capacity: int) -> list[list[int]]:
    """Each window's items (none longer than capacity): differencing into the fewest windows the total allows, and into
    one more as long as the fullest is over the capacity."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        parts = difference(lengths, windows)
        if max(sum(lengths[i] for i in p) for p in parts) <= capacity:
            return parts
        windows += 1


def pack(lengths: list[int], capacity: int, last: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Windows of (item, start in it, length), each of at most capacity, and what is left over. Most items go whole into
    the windows that differencing makes; the last items are kept back and cut to fill the room in those. What is left of
    them goes on to the next group or, with last, into windows of its own."""
    fill, kept = len(lengths), 0
    parts = windows_for(lengths, capacity) if fill else []
    room = len(parts) * capacity - sum(lengths)
    while fill and kept < room:  # the fewer items make fewer windows, with another room
        while fill and kept < room:
            fill -= 1
            kept += lengths[fill]
        parts = windows_for(lengths[:fill], capacity) if fill else []
        room = len(parts) * capacity - sum(lengths[:fill])
    out = [[(i, 0, lengths[i]) for i in p] for p in parts]
    rest = [(i, 0, lengths[i]) for i in range(len(lengths) - 1, fill - 1, -1)]
    for window in sorted(out, key=lambda w: sum(n for _, _, n in w)):
        free = capacity - sum(n for _, _, n in window)
        while free and rest:
            i, start, n = rest.pop()
            take = min(free, n)
            window.append((i, start, take))
            free -= take
            if take < n:
                rest.append((i, start + take, n - take))
    if last and rest:
        out += [[rest[j] for j in p] for p in windows_for([n for _, _, n in rest], capacity)]
        rest = []
    return [w for w in out if w], rest[::-1]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group: int = 96, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces (SCHEMA) of every document's ids, in windows of at most capacity ids. A null or empty text is the end id
    alone; a null key stays null; repeated rows are packed each; other columns play no part. Whole windows are cut from
    long documents; the remainders are packed in groups of `group` pieces or more (16 windows at least) by differencing, the room that leaves is
    filled with the group's last pieces, and what is left of those goes to the task's next group. No shuffle; sequence
    ids hold the partition's number, and a task that runs again gives the same rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = Encoder(tokenizer), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        waiting: list[tuple] = []  # (key, ids of the piece, start in the document, ids of the document)
        total = 0  # ids that wait

        def put(piece: tuple, start: int, n: int, offset: int) -> None:
            k, ids, at, size = piece
            rows.append((k, at + start, n, zlib.crc32(ids[start : start + n]), size, sequence, offset))

        def settle(last: bool) -> None:
            nonlocal sequence, waiting, total
            windows, rest = pack([len(p[1]) for p in waiting], capacity, last)
            for window in windows:
                offset = 0
                for i, start, n in window:
                    put(waiting[i], start, n, offset)
                    offset += n
                sequence += 1
            waiting = [(waiting[i][0], waiting[i][1][start : start + n], waiting[i][2] + start, waiting[i][3]) for i, start, n in rest]
            total = sum(len(p[1]) for p in waiting)

        def emit() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            rows.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1), CHUNK_BYTES):
                flat, cut = encoder.encode(data, offs)
                flat = np.insert(flat, cut[1:], np.uint32(end_id)).astype("<u4")
                cut = (cut + np.arange(len(cut))).tolist()
                for k, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), cut[:-1], cut[1:], strict=True):
                    ids, size = flat[a:b], b - a
                    whole = size - size % capacity
                    for start in range(0, whole, capacity):
                        put((k, ids, 0, size), start, capacity, 0)
                        sequence += 1
                    if whole < size:
                        waiting.append((k, ids[whole:].copy(), whole, size))  # a copy, so that the chunk can go
                        total += size - whole
                    if len(waiting) >= group and total >= 16 * capacity:
                        settle(False)
                if len(rows) > 5000:
                    yield emit()
        if waiting:
            settle(True)
        if rows:
            yield emit()

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)
