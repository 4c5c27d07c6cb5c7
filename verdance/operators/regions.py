"""Shapes in masks of any size: discs by runs, blobs across tiles, exact distances, running quantiles. A mask holds one row a
pixel; `key` columns name the frame. An image is never one group: work is dealt out by rows, tiles or bands of it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import settled

KEY = ["frame"]
#: Sides, in pixels, of the tiles that are labelled first, and of the blocks of tiles that are joined next.
TILE, BLOCK = 256, 4096
#: Rows or columns of an image that one task of the distance transform holds.
BAND = 128


# --- runs ------------------------------------------------------------------------------------------------------------


def to_runs(mask: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Maximal runs of the mask's rows: key, y, a (first x), b (last x), as longs."""
    w = Window.partitionBy(*key, "y").orderBy("x")
    one = mask.select(*key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    return one.withColumn("run", F.col("x") - F.row_number().over(w)).groupBy(*key, "y", "run").agg(F.min("x").alias("a"), F.max("x").alias("b")).drop("run")


def to_pixels(runs: DataFrame, like: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The pixels of runs, x and y typed as in `like`."""
    kind = dict(like.dtypes)
    return runs.select(*key, F.explode(F.sequence(F.col("a").cast(kind["x"]), F.col("b").cast(kind["x"]))).alias("x"), F.col("y").cast(kind["y"]).alias("y"))


def _grown(runs: DataFrame, radius: int, width: int, height: int, key: Sequence[str]) -> DataFrame:
    """Runs of the pixels within radius of runs, inside the image: a run reaches over the rows around it as a longer or
    shorter one, and runs that touch are merged."""
    row = [*key, "y"]
    reach = F.floor(F.sqrt(F.lit(radius * radius) - F.col("dy") * F.col("dy")))
    wide = runs.withColumn("dy", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).select(*key, (F.col("y") + F.col("dy")).alias("y"), F.greatest(F.col("a") - reach, F.lit(0)).alias("a"), F.least(F.col("b") + reach, F.lit(width - 1)).alias("b"))
    wide = wide.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("a") <= F.col("b")))
    order = Window.partitionBy(*row).orderBy("a", "b")
    new = F.coalesce(F.col("a") > F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int")
    return wide.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*row, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def _shrunk(runs: DataFrame, radius: int, width: int, height: int, key: Sequence[str]) -> DataFrame:
    """Runs of the pixels whose whole disc, as far as it lies in the image, is covered. The gaps of a covered row reach over
    the rows around it like runs do in _grown; what no gap reaches stays, in rows whose neighbours within radius are all
    covered somewhere (a row without a run is all gap)."""
    row = [*key, "y"]
    inside = runs.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("b") >= 0) & (F.col("a") < width)).select(*row, F.greatest("a", F.lit(0)).alias("a"), F.least("b", F.lit(width - 1)).alias("b"))
    w = Window.partitionBy(*row).orderBy("a")
    inside = inside.withColumns({"before": F.lag("b").over(w), "after": F.lead("a").over(w)})
    before, after = F.col("before"), F.col("after")
    gap = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    # before each run a gap, maybe an empty one; the first run of a row also bears its mark, the last one the gap to the edge
    gaps = F.filter(F.array(gap(F.coalesce(before + 1, F.lit(0)), F.col("a") - 1), F.when(before.isNull(), gap(F.lit(-1), F.lit(-1))), F.when(after.isNull(), gap(F.col("b") + 1, F.lit(width - 1)))), lambda g: g.isNotNull() & (g["a"] <= g["b"]))
    free = inside.select(*row, F.explode(gaps).alias("g")).withColumn("dy", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    reach, mark = F.floor(F.sqrt(F.lit(radius * radius) - F.col("dy") * F.col("dy"))), F.col("g.a") < 0
    # a mark stays left of the image; that of the row itself goes to the right of it and closes the row's last run
    near = free.select(*key, (F.col("y") + F.col("dy")).alias("y"), F.when(mark, F.when(F.col("dy") == 0, width).otherwise(-1)).otherwise(F.greatest(F.col("g.a") - reach, F.lit(0))).alias("a"), F.when(mark, F.when(F.col("dy") == 0, width).otherwise(-1)).otherwise(F.least(F.col("g.b") + reach, F.lit(width - 1))).alias("b"), mark.cast("int").alias("mark"))
    order = Window.partitionBy(*row).orderBy("a", "b")
    last = F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    need = F.least(F.col("y") + radius, F.lit(height - 1)) - F.greatest(F.col("y") - radius, F.lit(0)) + 1
    near = near.where((F.col("y") >= 0) & (F.col("y") < height))
    kept = near.withColumn("rows", F.sum("mark").over(Window.partitionBy(*row))).withColumn("last", last)
    return kept.where((F.col("rows") == need) & (F.col("a") > F.col("last") + 1)).select(*row, (F.col("last") + 1).alias("a"), (F.col("a") - 1).alias("b"))


def dilate(mask: DataFrame, radius: int, width: int, height: int, key: Sequence[str] = KEY) -> DataFrame:
    """Pixels within `radius` of the mask, inside the image. Work grows with the runs times the radius, not with the disc's
    area."""
    return to_pixels(_grown(to_runs(mask, key), radius, width, height, key), mask, key)


def erode(mask: DataFrame, radius: int, width: int, height: int, key: Sequence[str] = KEY) -> DataFrame:
    """Pixels whose whole disc, as far as it lies in the image, is in the mask; by runs, like dilate."""
    return to_pixels(_shrunk(to_runs(mask, key), radius, width, height, key), mask, key)


# --- blobs -----------------------------------------------------------------------------------------------------------


def _merge(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest label of the component of each label in pairs."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    return {i: top(i) for i in list(up)}


def _label_tile(runs: pa.Table) -> pa.Table:
    """Runs of one tile with blob: the smallest place (row, then column) of the runs that touch them, by sides or corners."""
    runs = runs.sort_by([("y", "ascending"), ("a", "ascending")])
    y, a, b = (runs.column(c).to_numpy() for c in ("y", "a", "b"))
    name = (y << 32) | a
    rows, first = np.unique(y, return_index=True)
    ends = np.append(first[1:], len(y))
    pairs = []
    for r in np.flatnonzero(np.diff(rows) == 1):
        lo, hi = slice(first[r], ends[r]), slice(first[r + 1], ends[r + 1])
        # of the row above, the first run that ends late enough and the last one that begins early enough
        i, j = np.searchsorted(b[lo], a[hi] - 1), np.searchsorted(a[lo], b[hi] + 1, side="right")
        many = np.maximum(j - i, 0)
        which = np.repeat(i, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs += zip(np.repeat(name[hi], many).tolist(), name[lo][which].tolist(), strict=True)
    root = _merge(pairs)
    return runs.append_column("blob", pa.array([root.get(n, n) for n in name.tolist()], pa.int64()))


def label_runs(runs: DataFrame, key: Sequence[str] = KEY, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """runs(key, y, a, b), cut at tile borders, with blob: the place of the first pixel (row, then column: y * 2^32 + x) of the
    8-connected blob they lie in.

    Runs are labelled in tiles. Labels that touch across a seam are pairs; those within a block of tiles are joined in one
    task, then those that are left in a frame, and every label is replaced by its component's smallest one. A task holds a
    tile's runs, or the pairs along the seams of a block or between blocks (some side lengths, not areas)."""
    kinds = dict(runs.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in key)
    cut = runs.withColumn("tx", F.explode(F.sequence(F.floor(F.col("a") / tile), F.floor(F.col("b") / tile))))
    cut = cut.select(*key, F.floor(F.col("y") / tile).alias("ty"), "tx", "y", F.greatest("a", F.col("tx") * tile).alias("a"), F.least("b", F.col("tx") * tile + tile - 1).alias("b"))
    labelled = settled(cut.groupBy(*key, "ty", "tx").applyInArrow(_label_tile, f"{head}, ty long, tx long, y long, a long, b long, blob long"))
    # pixels on the seams tell their label to their own place and to the places in the next tiles that they touch
    rim = labelled.withColumn("edge", (F.col("y") % tile == tile - 1) | (F.col("y") % tile == 0))
    spots = rim.withColumn("x", F.explode(F.when(F.col("edge"), F.sequence("a", "b")).otherwise(F.array_distinct(F.array("a", "b")))))
    spots = spots.where(F.col("edge") | (F.col("x") % tile == 0) | (F.col("x") % tile == tile - 1)).select(*key, "x", "y", "blob")
    side = lambda dx, dy: F.struct((F.col("x") + dx).alias("x2"), (F.col("y") + dy).alias("y2"))
    below = F.when(F.col("y") % tile == tile - 1, F.array(side(-1, 1), side(0, 1), side(1, 1))).otherwise(F.array())
    right = F.when(F.col("x") % tile == tile - 1, F.array(side(1, -1), side(1, 0), side(1, 1))).otherwise(F.array())
    told = spots.select(*key, "x", "y", "blob", F.explode(F.array_union(F.array(side(0, 0)), F.array_union(below, right))).alias("n"))
    own = (F.col("n.x2") == F.col("x")) & (F.col("n.y2") == F.col("y"))
    asked = F.collect_list(F.when(~own, F.struct(F.col("blob").alias("p"), F.col("x").alias("x1"), F.col("y").alias("y1"))))  # eight at most
    place = told.groupBy(*key, F.col("n.x2").alias("x"), F.col("n.y2").alias("y")).agg(F.max(F.when(own, F.col("blob"))).alias("q"), asked.alias("asked"))
    met = place.where("q is not null").select(*key, "x", "y", "q", F.explode("asked").alias("o")).select(*key, "x", "y", "q", "o.*").where("p <> q")
    whole = lambda c, d: F.when(F.floor(F.col(c) / block) == F.floor(F.col(d) / block), F.floor(F.col(c) / block)).otherwise(F.lit(-1))
    bx, by_ = whole("x", "x1"), whole("y", "y1")
    inner = (bx >= 0) & (by_ >= 0)
    pairs = met.select(*key, F.when(inner, bx).otherwise(F.lit(-1)).alias("bx"), F.when(inner, by_).otherwise(F.lit(-1)).alias("by"), F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    pairs = settled(pairs)

    def join(touching: pa.Table) -> pa.Table:
        root = {i: r for i, r in _merge(list(zip(touching.column("p").to_pylist(), touching.column("q").to_pylist(), strict=True))).items() if i != r}
        own = touching.select(list(key)).slice(0, 1).take(pa.array([0] * len(root), pa.int64()))
        return own.append_column("old", pa.array(list(root), pa.int64())).append_column("new", pa.array(list(root.values()), pa.int64()))

    def renamed(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
        to = names.select(*key, F.col("old").alias(column), F.col("new").alias("__new"))
        return df.join(to, [*key, column], "left").withColumn(column, F.coalesce("__new", column)).drop("__new")

    # a label may lie in several blocks' pairs only if it spans tiles of several blocks; labels are of one tile, so of one block
    within = settled(pairs.where("bx >= 0").groupBy(*key, "bx", "by").applyInArrow(join, f"{head}, old long, new long"))
    between = pairs.where("bx < 0").select(*key, "p", "q")
    between = renamed(renamed(between, within, "p"), within, "q").where("p <> q").groupBy(*key).applyInArrow(join, f"{head}, old long, new long")
    return renamed(renamed(labelled, within, "blob"), between, "blob").select(*key, "y", "a", "b", "blob")


def label_blobs(mask: DataFrame, key: Sequence[str] = KEY, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """mask with blob, the 8-connected blob that each pixel lies in (see label_runs)."""
    runs = label_runs(to_runs(mask, key), key, tile, block)
    kind = dict(mask.dtypes)
    return runs.select(*key, F.explode(F.sequence(F.col("a").cast(kind["x"]), F.col("b").cast(kind["x"]))).alias("x"), F.col("y").cast(kind["y"]).alias("y"), "blob")


def mask_cleanup(mask: DataFrame, width: int, height: int, radius: int = 1, min_area: int = 4, key: Sequence[str] = KEY) -> DataFrame:
    """Opened, then closed with a disc; 8-connected blobs of fewer than min_area pixels are dropped. Pixels are listed only
    at the end."""
    size = (radius, width, height, key)
    closed = _shrunk(_grown(_grown(_shrunk(to_runs(mask, key), *size), *size), *size), *size)
    blobs = label_runs(closed, key)
    large = blobs.groupBy(*key, "blob").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n")).where(F.col("n") >= min_area).select(*key, "blob")
    return to_pixels(blobs.join(large, [*key, "blob"], "left_semi"), mask, key)


# --- distances -------------------------------------------------------------------------------------------------------


def _nearest_in_column(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a band of columns: for each that holds pixels, the distance along it to the nearest, for rows y0 to y1 in bands."""
    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    y0, y1 = int(pdf["y0"].iloc[0]), int(pdf["y1"].iloc[0])
    columns, at = np.unique(x, return_inverse=True)
    low, high = min(y0, int(y.min())), max(y1, int(y.max()))
    far = np.int64(1) << 40
    place = np.arange(low, high + 1)[:, None]
    above, below = np.full((high - low + 1, len(columns)), -far), np.full((high - low + 1, len(columns)), far)
    above[y - low, at] = below[y - low, at] = y
    gap = np.minimum(place - np.maximum.accumulate(above, axis=0), np.minimum.accumulate(below[::-1], axis=0)[::-1] - place)[y0 - low : y1 - low + 1]
    bands = range(y0 // BAND, y1 // BAND + 1)
    cuts = [(b, max(b * BAND - y0, 0), min((b + 1) * BAND - y0, y1 - y0 + 1)) for b in bands]
    rows = [(b, y0 + lo, c, gap[lo:hi, i].astype(np.int32).tobytes()) for b, lo, hi in cuts for i, c in enumerate(columns.tolist())]
    return pd.DataFrame(rows, columns=["band", "top", "x", "gaps"])


def _envelope(columns: np.ndarray, gaps: np.ndarray, row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Least (x - c)^2 + gap^2 over the columns c for queries (row, x): each column is a parabola over its row, and the
    lower envelope of a row's parabolas is built from left to right, for all rows at once. gaps [rows, columns]."""
    n, m = gaps.shape
    high = gaps.astype(np.float64) ** 2 + columns.astype(np.float64) ** 2
    own, start = np.zeros((n, m), np.int64), np.full((n, m), -np.inf)  # parabola number and where its part begins
    top = np.zeros(n, np.int64)
    every = np.arange(n)
    for c in range(1, m):
        live = every
        cross = np.empty(n)
        while len(live):
            last = own[live, top[live]]
            cross[live] = (high[live, c] - high[live, last]) / (2.0 * (columns[c] - columns[last]))
            live = live[cross[live] <= start[live, top[live]]]
            top[live] -= 1
        top += 1
        own[every, top], start[every, top] = c, cross
    out = np.empty(len(x), np.int64)
    order = np.argsort(row, kind="stable")
    bounds = np.searchsorted(row[order], np.arange(n + 1))
    for r in range(n):
        mine = order[bounds[r] : bounds[r + 1]]
        if len(mine):
            c = own[r, np.searchsorted(start[r, : top[r] + 1], x[mine], side="right") - 1]
            out[mine] = (x[mine] - columns[c]) ** 2 + gaps[r, c].astype(np.int64) ** 2
    return out


def distances(spots: DataFrame, patch: DataFrame, by: Sequence[str]) -> DataFrame:
    """spots(by, x, y), distinct, with d: the exact Euclidean distance to the nearest pixel of patch(by, x, y); spots of a
    `by` without a patch are left out. Separable: distances along each column, then the lower envelope of the columns'
    parabolas in each row. Work is linear in the pixels of the box that holds both; a task holds a band of it."""
    kinds = dict(spots.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    whole = [F.col(c).cast("long").alias(c) for c in "xy"]
    asked = spots.select(*by, *whole)
    reach = asked.groupBy(*by).agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    column = patch.select(*by, *whole).distinct().join(reach, list(by)).withColumn("strip", F.floor(F.col("x") / BAND))

    def columns_of(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _nearest_in_column(pdf)
        return out.assign(**{k: [pdf[k].iloc[0]] * len(out) for k in by})[[*by, *out.columns]]

    gaps = column.groupBy(*by, "strip").applyInPandas(columns_of, f"{head}, band long, top long, x long, gaps binary")

    def rows_of(spot: pd.DataFrame, gap: pd.DataFrame) -> pd.DataFrame:
        if not len(spot) or not len(gap):
            return pd.DataFrame(columns=[*by, "x", "y", "d"])
        gap = gap.sort_values("x")
        table = np.stack([np.frombuffer(g, np.int32) for g in gap["gaps"]], axis=1)
        y = spot["y"].to_numpy() - int(gap["top"].iloc[0])
        used, row = np.unique(y, return_inverse=True)
        d = np.sqrt(_envelope(gap["x"].to_numpy(), table[used], row, spot["x"].to_numpy()))
        return spot[[*by, "x", "y"]].assign(d=d)

    banded = asked.withColumn("band", F.floor(F.col("y") / BAND)).groupBy(*by, "band").cogroup(gaps.groupBy(*by, "band"))
    found = banded.applyInPandas(rows_of, f"{head}, x long, y long, d double")
    return found.select(*by, F.col("x").cast(kinds["x"]).alias("x"), F.col("y").cast(kinds["y"]).alias("y"), "d")


# --- running quantiles -----------------------------------------------------------------------------------------------


def running_quantile(values: np.ndarray, ends: np.ndarray, q: float) -> np.ndarray:
    """The q quantile (linear between neighbours) of values[:n] for every n in ends (at least 1), in n log n: values are
    ranked, and a wavelet matrix over the ranks' bits finds the k-th smallest of every prefix at once."""
    order, rank = np.unique(values, return_inverse=True)
    bits = max(1, int(len(order) - 1).bit_length())
    level, counts = rank, []
    for bit in range(bits - 1, -1, -1):
        one = (level >> bit) & 1
        counts.append(np.concatenate([[0], np.cumsum(1 - one)]))
        level = np.concatenate([level[one == 0], level[one == 1]])

    def kth(k: np.ndarray) -> np.ndarray:
        lo, hi, found = np.zeros_like(ends), ends.copy(), np.zeros_like(ends)
        k = k.copy()
        for depth, zeros in enumerate(counts):
            inside = zeros[hi] - zeros[lo]
            up = k >= inside
            k = np.where(up, k - inside, k)
            found = found * 2 + up
            lo, hi = np.where(up, zeros[-1] + lo - zeros[lo], zeros[lo]), np.where(up, zeros[-1] + hi - zeros[hi], zeros[hi])
        return order[found]

    ends = np.asarray(ends, np.int64)
    place = (ends - 1) * q
    below = np.floor(place).astype(np.int64)
    low, high = kth(below), kth(np.minimum(below + 1, ends - 1))
    return low + (high - low) * (place - below)
