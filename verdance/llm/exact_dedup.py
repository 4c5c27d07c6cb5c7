"""Exact dedup (operator 11): content-defined chunks with verified identifiers, and documents compared by their ordered
lists of identifiers (recipes)."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lower_table, mix, written

#: Bytes of a chunk: cuts closer than LEAST to the last one don't count, a stretch without a cut is cut every MOST bytes,
#: and one place in 2^CUT_BITS is a cut.
LEAST, MOST, CUT_BITS = 256, 1 << 14, 11
#: Bytes that decide on a cut; not more than LEAST, so that a document's cuts depend on its own bytes alone.
WINDOW = 32
#: Shared recipes up to which a broadcast picks the documents whose chunks are verified (8 bytes each); beyond, all are.
MAX_SHARED = 1 << 20
#: Groups of more than one in HOT_GROUPS of all rows, and more than HOT_ROWS, with a recipe of at most HOT_BYTES (a text of some
#: hundred thousand bytes) are broadcast: 16 MB at most. Larger recipes and smaller groups are shuffled.
HOT_GROUPS, HOT_ROWS, HOT_BYTES = 1000, 1000, 1 << 14
#: Digests with two contents that are named one by one; beyond, every chunk is its own identifier.
MAX_DOUBLED = 1 << 12
_LOWER = lower_table()
_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def cuts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all documents, in order; a chunk lies in one document."""
    roll = _GEAR[data]
    step = 1
    while step < WINDOW:  # sums over the last 1, 2, 4 ... bytes, the older ones shifted up
        roll[step:] = roll[step:] + (roll[:-step] << np.uint32(step))
        step *= 2
    places = (np.flatnonzero(roll >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    found = []
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if lo == hi:
            continue
        found.append(lo)
        i = bisect_left(places, lo + LEAST)
        while i < len(places) and places[i] < hi:
            found.append(places[i])
            i = bisect_left(places, places[i] + LEAST, i + 1)
    start = np.array(found, np.int64)
    if not len(start):
        return start, start
    end = np.append(start[1:], offs[-1])
    many = -(-(end - start) // MOST)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = np.repeat(start, many) + nth * MOST
    return start, np.minimum(start + MOST, np.repeat(end, many))


def _texts(batches: Iterator[pa.RecordBatch], n_digest: int) -> Iterator[tuple[pa.RecordBatch, int, bytes, list[tuple[bytes, bytes]]]]:
    """Of every document: its batch, its row there, its normalised text, and its chunks as (digest, bytes)."""
    for batch in batches:
        for first, _, data, offs in chunks(batch.column("text")):
            data = _LOWER[data]
            raw = data.tobytes()
            start, end = cuts(data, offs)
            bound = np.searchsorted(start, offs).tolist()
            span = list(zip(start.tolist(), end.tolist(), strict=True))
            places = offs.tolist()
            for d in range(len(places) - 1):
                pieces = [raw[a:b] for a, b in span[bound[d] : bound[d + 1]]]
                yield batch, first + d, raw[places[d] : places[d + 1]], [(hashlib.blake2b(p, digest_size=n_digest).digest(), p) for p in pieces]


def _key(recipe: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(recipe, digest_size=8).digest(), "little", signed=True)


def _recipe(pieces: list[tuple[bytes, bytes]], doubled: frozenset[bytes] | None) -> bytes:
    """The identifiers in order. A digest that stands for one content is its identifier; any other chunk is its own, behind
    its length. The mark before each keeps lists of both kinds apart."""
    out = []
    for digest, piece in pieces:
        own = doubled is None or digest in doubled
        out.append(b"\1" + len(piece).to_bytes(4, "big") + piece if own else b"\0" + digest)
    return b"".join(out)


def _recipes_of(n_digest: int, doubled: frozenset[bytes] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, size, key, recipe = [], [], [], []
            for _, _, text, pieces in _texts([batch], n_digest):
                sha.append(hashlib.sha256(text).hexdigest())
                size.append(len(text))
                recipe.append(_recipe(pieces, doubled))
                key.append(_key(recipe[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(sha, pa.string()), pa.array(size, pa.int64()), pa.array(key, pa.int64()), pa.array(recipe, pa.binary())], ["row", "id", "sha", "size", "key", "recipe"])

    return run


def _pieces_of(n_digest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, piece, held = [], [], [], 0
        for _, _, _, pieces in _texts(batches, n_digest):
            at = _key(_recipe(pieces, frozenset()))
            for d, p in pieces:
                key.append(at)
                digest.append(d)
                piece.append(p)
                held += len(p)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(digest, pa.binary()), pa.array(piece, pa.binary())], ["key", "digest", "piece"])
                    key, digest, piece, held = [], [], [], 0
        if key:
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(digest, pa.binary()), pa.array(piece, pa.binary())], ["key", "digest", "piece"])

    return run


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_digest: int = 16) -> DataFrame:
    """One row a document: row (a number of its own), id, sha (SHA-256 of the normalised text, lowercase hex), size (its
    bytes), key (64-bit hash of the recipe) and recipe, the ordered identifiers of its chunks. Two texts are equal after
    lower-casing A-Z exactly if their recipes are.

    First every chunk is named by a digest of n_digest bytes. Only documents whose lists of digests meet another's can be
    equal, so only their chunks are moved, each content once a task, to see whether one digest has two contents; chunks of
    such a digest are then named by their contents. Null texts are empty and have empty recipes; rows with null or repeated
    ids count each on its own."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = f"row long, id {source.schema['id'].dataType.simpleString()}, sha string, size long, key long, recipe binary"
    out = written(source.mapInArrow(_recipes_of(n_digest, frozenset()), kind))
    shared = written(out.where("size > 0").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    many = shared.limit(MAX_SHARED + 1).count()
    if not many:
        return out
    pieces = source.select("text").mapInArrow(_pieces_of(n_digest), "key long, digest binary, piece binary")
    if many <= MAX_SHARED:
        pieces = pieces.join(F.broadcast(shared), "key", "left_semi")
    contents = pieces.groupBy("digest", "piece").agg(F.lit(1).alias("one"))
    doubled = contents.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest").limit(MAX_DOUBLED + 1).collect()
    if not doubled:
        return out
    names = frozenset(bytes(r.digest) for r in doubled) if len(doubled) <= MAX_DOUBLED else None
    return written(source.mapInArrow(_recipes_of(n_digest, names), kind))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_digest: int = 16) -> DataFrame:
    """One row a document: doc_id, keep_id (id of the row of its group that stays: the largest), group_size, kept, and
    text_sha256. Texts are equal when identical after lower-casing A-Z alone; null counts as empty.

    Of rows that tie in id and text one stays. A null id is smaller than any other: it stays only where all of the group
    are null, and keep_id is null there. Texts never leave their tasks but for verification (see recipes); groups are
    counted before rows meet, and the rows join back by recipe, those of hot groups by broadcast."""
    listed = recipes(docs, id_col, text_col, n_digest)
    best = F.max(F.struct("id", "row")).alias("best")
    groups = listed.groupBy("recipe").agg(best, F.count("*").alias("group_size"))
    # groups of more than a thousandth of the rows are under a thousand, so their rows meet them without a shuffle
    many = max(listed.count() // HOT_GROUPS, HOT_ROWS)
    counted = listed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > many).select("key")
    hot = F.broadcast(written(listed.join(F.broadcast(counted), "key").groupBy("recipe").agg(best, F.count("*").alias("group_size")).where((F.length("recipe") <= HOT_BYTES) & (F.col("group_size") > many))))
    rest = listed.join(hot.select("recipe"), "recipe", "left_anti")
    joined = listed.join(hot, "recipe").unionByName(rest.join(groups, "recipe"))
    return joined.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )
