"""Centroid clustering (operator 13): vectors in Hilbert order are cut into blocks with bounding boxes (zone maps); the
boxes' distances bound which centroids a block can need, and those alone are compared exactly, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Vectors of a block.
BLOCK = 128
#: Steps of each component that the Hilbert curve tells apart, as bits.
CURVE_BITS = 4
#: Components lie within these bounds, so that every squared distance fits in 64 bits; larger ones count as the bound.
BOUND = 1 << 27
LONG = (1 << 63) - 1
Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def hilbert_key(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of cells (whole numbers below 2^bits) on the Hilbert curve through all its dimensions, as bytes that
    sort like it (Skilling, Programming the Hilbert curve, 2004: the axes are turned to the transposed index)."""
    x = np.ascontiguousarray(cells.T.astype(np.uint32))
    for level in range(bits - 1, 0, -1):
        below = np.uint32((1 << level) - 1)
        for axis in x:
            turn = (axis >> np.uint32(level)) & 1 == 1
            swap = np.where(turn, 0, (x[0] ^ axis) & below).astype(np.uint32)
            x[0] ^= np.where(turn, below, swap)
            axis ^= swap if axis is not x[0] else 0
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint32(level)) & 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flip
    planes = np.stack([(x >> np.uint32(level)) & 1 for level in range(bits - 1, -1, -1)])  # level, dimension, row
    packed = np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def kept_vectors(table: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """id and vec (doubles) of the rows whose vector has dim components, none null or non-finite."""
    vec = F.col(vec_col).cast("array<double>")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return table.select(F.col(id_col).alias("id"), vec.alias("vec")).where((F.size("vec") == dim) & F.forall("vec", sound))


def _whole(batch: pa.RecordBatch, dim: int, scale: int) -> np.ndarray:
    values = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(values * scale), -BOUND, BOUND).astype(np.int32)


def _spread(dim: int, scale: int) -> Pass:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _whole(batch, dim, scale).astype(np.float64)
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(v.min(0)), pa.array(v.max(0)), pa.array(v.sum(0)), pa.array((v * v).sum(0)), pa.array(np.full(dim, float(len(v))))], ["d", "lo", "hi", "s", "ss", "n"])

    return run


def _keyed(dim: int, scale: int, axes: np.ndarray, lo: np.ndarray, width: np.ndarray) -> Pass:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _whole(batch, dim, scale)
            cells = np.clip((v[:, axes] - lo) * (1 << CURVE_BITS) / width, 0, (1 << CURVE_BITS) - 1).astype(np.uint32)
            keys = hilbert_key(cells, CURVE_BITS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in v], pa.binary())], ["id", "key", "cells"])

    return run


def _boxed(dim: int, block: int) -> Pass:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def cut(t: pa.Table) -> pa.RecordBatch:
            v = np.frombuffer(b"".join(t.column("cells").to_pylist()), np.int32).reshape(-1, dim)
            ids = t.column("id").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in (v, v.min(0), v.max(0)))], ["ids", "cells", "lo", "hi"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, new]) if rest is not None else new
            while rest.num_rows >= block:
                yield cut(rest.slice(0, block))
                rest = rest.slice(block)
        if rest is not None and rest.num_rows:
            yield cut(rest)

    return run


def blocks(vectors: DataFrame, dim: int, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """Vectors (id, vec) as floor(scale * x), in blocks of neighbours on the Hilbert curve, one row a block: ids, cells (the
    whole numbers, 32 bits each), and the box lo, hi that holds them. Components are taken from the widest spread to the
    narrowest. Vectors of one place on the curve are dealt out by id, so a vector that a third of all rows share fills blocks
    in many tasks."""
    source = vectors.select("id", "vec")
    kind = source.schema["id"].dataType.simpleString()
    spread = source.select("vec").mapInArrow(_spread(dim, scale), "d int, lo double, hi double, s double, ss double, n double")
    rows = sorted(spread.groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n")).collect())
    if not rows:
        return vectors.sparkSession.createDataFrame([], f"ids array<{kind}>, cells binary, lo binary, hi binary")
    axes = np.array([r.d for r in sorted(rows, key=lambda r: (r.s * r.s / r.n - r.ss, r.d))])
    lo, hi = np.array([r.lo for r in rows])[axes], np.array([r.hi for r in rows])[axes]
    keyed = source.mapInArrow(_keyed(dim, scale, axes, lo, hi - lo + 1), f"id {kind}, key binary, cells binary").withColumn("salt", F.xxhash64("id"))
    ordered = keyed.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt").drop("key", "salt")
    return written(ordered.mapInArrow(_boxed(dim, block), f"ids array<{kind}>, cells binary, lo binary, hi binary"))


def nearest(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a block of vectors within the box lo, hi: each one's nearest centroid (of equals the smaller number), the squared
    distance, and the number of centroids compared. A centroid whose least distance from the box is over another's greatest
    can be nobody's nearest."""
    under, over = lo - centroids, centroids - hi
    near = np.maximum(np.maximum(under, over), 0)
    far = np.maximum(np.abs(centroids - lo), np.abs(centroids - hi))
    near, far = (near * near).sum(1), (far * far).sum(1)
    which = np.flatnonzero(near <= far.min())
    c = centroids[which]
    reach = int(max(np.abs(lo).max(), np.abs(hi).max(), np.abs(c).max()))
    if 8 * len(lo) * reach * reach < 1 << 53:  # every term is a whole number that doubles hold
        a, b = v.astype(np.float64), c.astype(np.float64)
        far = ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    else:
        far = np.stack([((v - x) ** 2).sum(1) for x in c], axis=1)
    best = far.argmin(1)
    return which[best], far[np.arange(len(v)), best], len(which)


def _of(batch: pa.RecordBatch, i: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: np.frombuffer(batch.column(c)[i].as_py(), np.int32).astype(np.int64)
    return get("cells").reshape(-1, dim), get("lo"), get("hi")


#: What a pass counts of a cluster beside the sums of its components.
_ROWS, _INERTIA, _COMPARED = -1, -2, -3


def _summed(dim: int, centroids: np.ndarray) -> Pass:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), dim), object)
        count = [[0, 0, 0] for _ in centroids]
        for batch in batches:
            for i in range(batch.num_rows):
                v, lo, hi = _of(batch, i, dim)
                cluster, distance, compared = nearest(v, lo, hi, centroids)
                count[0][2] += compared * len(v)
                for c in np.unique(cluster).tolist():
                    mine = cluster == c
                    sums[c] += v[mine].sum(0)
                    count[c][0] += int(mine.sum())
                    count[c][1] += sum(distance[mine].tolist())
        rows = [(c, d, int(sums[c, d])) for c in range(len(centroids)) if count[c][0] for d in range(dim)]
        rows += [(c, d, n) for c, of in enumerate(count) for d, n in zip((_ROWS, _INERTIA, _COMPARED), of, strict=True) if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([Decimal(r[2]) for r in rows], pa.decimal128(38, 0))], ["cluster", "d", "total"])

    return run


def totals(table: DataFrame, dim: int, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums over all vectors of each (cluster, component); components -1, -2, -3 are rows, inertia and comparisons (all under
    cluster 0). At most clusters * (dim + 3) numbers, whatever the table's size."""
    found = table.select("cells", "lo", "hi").mapInArrow(_summed(dim, centroids), "cluster int, d int, total decimal(38,0)")
    return {(r.cluster, r.d): int(r.total) for r in found.groupBy("cluster", "d").agg(F.sum("total").alias("total")).collect()}


def first_centroids(vectors: DataFrame, order: Column, k: int, scale: int = 256) -> np.ndarray:
    """The k vectors that come first by order (nulls last; ties by components) as whole numbers."""
    rows = vectors.orderBy(order.asc_nulls_last(), "vec").limit(k).select("vec").collect()
    return np.clip(np.floor(np.array([r.vec for r in rows], np.float64) * scale), -BOUND, BOUND).astype(np.int64)


def _assigned(dim: int, centroids: np.ndarray, inertia: dict[int, int]) -> Pass:
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    whole = min(sum(inertia.values()), LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cluster, distance, _ = nearest(*_of(batch, i, dim), centroids)
                of = cluster.tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(i, 1).flatten(), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array([min(inertia[c], LONG) for c in of], pa.int64()), pa.array([whole] * len(of), pa.int64()), pa.array([names[c] for c in of], pa.string())],
                    ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return run


def cluster(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2:", block: int = BLOCK) -> DataFrame:
    """One row a vector of dim components, none null or non-finite: id, cluster, distance (squared, to its centroid),
    cluster_inertia and inertia (distances summed over its cluster and over all), centroid_sha256.

    Components are floor(scale * x). The first centroids are the k vectors of smallest SHA-256 of seed and id; a null id comes
    last, vectors of one id are ordered by components, and of fewer than k vectors all are centroids. Each round assigns
    every vector to its nearest centroid (ties: the smaller number) and moves each centroid that has vectors to the floor of
    their mean; after the last round vectors are assigned once more. Components beyond 2^27 count as 2^27, and sums of
    distances beyond 2^63 - 1 as that. Other rows (null, short, not finite) are left out; an empty table gives no rows.

    A round is one pass over the blocks; only sums (k * dim numbers) reach the driver, and centroids go out with the task."""
    vectors = kept_vectors(table, id_col, vec_col, dim)
    kind = vectors.schema["id"].dataType.simpleString()
    boxed = blocks(vectors, dim, scale, block)
    centroids = first_centroids(vectors, F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256), k, scale)
    schema = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    for _ in range(rounds):
        found = totals(boxed, dim, centroids)
        for c in range(len(centroids)):
            if n := found.get((c, _ROWS)):
                centroids[c] = [found[c, d] // n for d in range(dim)]
    found = totals(boxed, dim, centroids)
    inertia = {c: found.get((c, _INERTIA), 0) for c in range(len(centroids))}
    return boxed.select("ids", "cells", "lo", "hi").mapInArrow(_assigned(dim, centroids, inertia), schema).withColumnRenamed("id", id_col)
