"""Series of one metric: building, jumps, retreats, daily values, several views, sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..schemas import EXCLUDED_BY_DEFAULT
from .frames import flag_filter, hours_filter, manual_filter, time_axis


def build_series(rows: DataFrame, by: Sequence[str], exclusions: DataFrame | None = None, hours: str | None = None, zone: str = "UTC", exclude: Sequence[str] = EXCLUDED_BY_DEFAULT, unit: float | None = None, t0: str | None = None) -> DataFrame:
    """rows(by, ts, frame_file, plot, y, unc, flags) with t, manual, outside_hours and excluded: by a flag, by hand, by the
    hour, without a value, or before t0."""
    out = flag_filter(rows, exclude)
    out = manual_filter(out, exclusions) if exclusions is not None else out.withColumn("manual", F.lit(None).cast("string"))
    out = hours_filter(out, hours, zone) if hours else out.withColumn("outside_hours", F.lit(False))
    out = time_axis(out, by, unit, t0)
    bad = F.col("excluded_by_flag") | F.col("y").isNull() | F.isnan("y") | (F.col("t") < 0) | F.col("manual").isNotNull() | F.col("outside_hours")
    return out.withColumn("excluded", bad).drop("excluded_by_flag")


def median(values: Column) -> Column:
    """Median of an array without nulls."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def detect_jumps(points: DataFrame, by: Sequence[str], order: Sequence[str] = ("t",), sides: int = 3, limit: float = 4.0) -> DataFrame:
    """points(by, t, y, unc, excluded) with jump: the value lies off the Theil-Sen line through up to `sides` usable
    neighbours on each side (one at least on each, three in all) by more than limit x the largest of 1.4826 MAD of the
    neighbours about their median residual, the own uncertainty, and a floor. Only usable points take part."""
    w = Window.partitionBy(*by, "excluded").orderBy(*order)
    pair = F.struct("t", "y")
    before, after = F.collect_list(pair).over(w.rowsBetween(-sides, -1)), F.collect_list(pair).over(w.rowsBetween(1, sides))
    near = points.withColumn("__b", before).withColumn("__a", after).withColumn("__top", F.max(F.abs("y")).over(Window.partitionBy(*by, "excluded")))
    near = near.withColumn("__p", F.concat("__b", "__a"))
    slopes = F.flatten(F.transform("__p", lambda p, i: F.transform(F.slice("__p", i + 2, 2 * sides), lambda q: F.when(q["t"] != p["t"], (q["y"] - p["y"]) / (q["t"] - p["t"])))))
    near = near.withColumn("__m", median(F.filter(slopes, lambda x: x.isNotNull())))
    near = near.withColumn("__c", median(F.transform("__p", lambda p: p["y"] - F.col("__m") * p["t"])))
    near = near.withColumn("__r", F.transform("__p", lambda p: p["y"] - F.col("__m") * p["t"] - F.col("__c")))
    near = near.withColumn("__mid", median(F.col("__r")))
    mad = median(F.transform("__r", lambda r: F.abs(r - F.col("__mid"))))
    tested = ~F.col("excluded") & (F.size("__b") > 0) & (F.size("__a") > 0) & (F.size("__p") >= 3)
    size = F.greatest(1.4826 * mad, F.coalesce(F.nanvl("unc", F.lit(0.0)), F.lit(0.0)), 1e-9 + 1e-6 * F.col("__top"))
    jump = F.abs(F.col("y") - F.col("__m") * F.col("t") - F.col("__c")) > limit * size
    return near.withColumn("jump", F.coalesce(tested & jump, F.lit(False))).drop("__b", "__a", "__p", "__m", "__c", "__r", "__mid", "__top")


def mark_retreats(points: DataFrame, by: Sequence[str], order: Sequence[str] = ("t",), used: Column | None = None) -> DataFrame:
    """points with retreat: a usable value lies below the running maximum of the usable ones by more than 3 x its
    uncertainty (none: 0)."""
    use = ~F.col("excluded") if used is None else used
    top = F.max(F.when(use, F.col("y"))).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    far = top - F.col("y") > F.greatest(3 * F.coalesce("unc", F.lit(0.0)), F.lit(1e-9))
    return points.withColumn("retreat", F.coalesce(use & far, F.lit(False)))


def daily_series(points: DataFrame, by: Sequence[str], zone: str = "UTC", how: str = "median") -> DataFrame:
    """One row per local day from the usable rows: y by median, mean or p90, the median time, n_frames."""
    y = {"median": F.percentile("y", 0.5), "mean": F.avg("y"), "p90": F.percentile("y", 0.9)}[how]
    day = F.to_date(F.from_utc_timestamp("ts", zone))
    sec = F.col("ts").cast("timestamp").cast("double")
    used = points.where(~F.col("excluded")).withColumn("day", day)
    return used.groupBy(*by, "day").agg(y.alias("y"), F.percentile(sec, 0.5).alias("ts_mid"), F.count(F.lit(1)).alias("n_frames"))


#: Values that a bootstrap draws at once in a task.
DRAWN = 1 << 20


def _xxhash64(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """xxHash64 of 32-bit whole numbers, one seed each: what F.xxhash64 gives for one more int column after the seed."""
    u = np.uint64
    p1, p2, p3, p5 = u(0x9E3779B185EBCA87), u(0xC2B2AE3D27D4EB4F), u(0x165667B19E3779F9), u(0x27D4EB2F165667C5)
    h = (seeds + p5 + u(4)) ^ (values.astype(np.uint64) * p1)
    h = ((h << u(23)) | (h >> u(41))) * p2 + p3
    h = (h ^ (h >> u(33))) * p2
    h = (h ^ (h >> u(29))) * p3
    return h ^ (h >> u(32))


def _resampled(ys: pa.Array, base: pa.Array, draws: int, how: str) -> pa.Array:
    """Variance of the medians (or means) of `draws` resamples of each list, null for a null list. Value i of draw d is the
    one at place xxhash64(base, d, i) modulo the list's length. Lists of one length are drawn side by side, a long one in
    blocks of draws; sums run in the order of the draws."""
    size = pc.fill_null(pc.list_value_length(ys), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, start = ys.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
    seed, var = base.to_numpy(zero_copy_only=False).view(np.uint64), np.zeros(len(size))
    for n in np.unique(size[size > 0]).tolist():
        every = np.flatnonzero(size == n)
        wide = max(1, DRAWN // (draws * n))
        for rows in (every[k : k + wide] for k in range(0, len(every), wide)):
            values, one = flat[start[rows][:, None] + np.arange(n)], np.arange(len(rows))[None, :, None]
            total, squares = np.zeros((1, len(rows))), np.zeros((1, len(rows)))
            deep = max(1, DRAWN // (len(rows) * n))
            for d in (np.arange(k, min(k + deep, draws)) for k in range(0, draws, deep)):
                place = np.mod(_xxhash64(np.arange(n), _xxhash64(d[:, None], seed[rows])[:, :, None]).view(np.int64), n)
                drawn = values[one, place]
                if how == "median":
                    drawn.sort(axis=2)
                    stat = (drawn[:, :, (n - 1) // 2] + drawn[:, :, n // 2]) / 2
                else:
                    stat = np.add.accumulate(drawn, axis=2)[:, :, -1] / n
                total = np.add.accumulate(np.concatenate([total, stat]))[-1:]
                squares = np.add.accumulate(np.concatenate([squares, stat * stat]))[-1:]
            var[rows] = np.maximum(squares - total * total / draws, 0)[0] / (draws - 1)
    return pa.array(var, mask=size == 0)


def daily_uncertainty(points: DataFrame, by: Sequence[str], zone: str = "UTC", how: str = "median", draws: int = 400, seed: int = 1) -> DataFrame:
    """by, day, unc: root of the squared mean frame uncertainty (only if every frame has one) and the squared standard
    error: a bootstrap of `draws` seeded resamples from 3 frames on, sd/sqrt(2) for 2, none for 1. Draws are hashes of
    (seed, day, draw, place), so the result does not depend on the partitioning; they are summed up inside the day's
    row, which holds one day's frames, over Arrow batches of days."""
    used = points.where(~F.col("excluded")).withColumn("day", F.to_date(F.from_utc_timestamp("ts", zone)))
    days = used.groupBy(*by, "day").agg(F.sort_array(F.collect_list(F.col("y").cast("double"))).alias("ys"), F.when(F.bool_and(F.col("unc").isNotNull()), F.avg("unc")).alias("own"), F.stddev_samp("y").alias("sd"))
    n = F.size("ys")
    boot = F.arrow_udf(lambda ys, base: _resampled(ys, base, draws, how), DoubleType())
    spread = days.withColumn("var", boot(F.when(n >= 3, F.col("ys")), F.xxhash64(F.lit(seed), F.col("day"), *by)))
    se = F.when(n >= 3, F.sqrt("var")).when(n == 2, F.col("sd") / F.sqrt(F.lit(2.0)))
    return spread.select(*by, "day", F.sqrt(F.coalesce(F.col("own") ** 2, F.lit(0.0)) + F.coalesce(se**2, F.lit(0.0))).alias("unc"), n.alias("n_frames"))


def combine_views(rows: DataFrame, by: Sequence[str], first: str, how: str = "max", tolerance: float = 60.0) -> DataFrame:
    """One row for each row of the first camera: the value over it and, for each other camera, its row nearest in time
    within the tolerance (the earlier one on ties); n_views, best camera (the first listed on ties), spread (largest less
    smallest). rows(by, camera, ts, y). Both sides meet in time buckets as wide as the tolerance."""
    sec = F.col("ts").cast("timestamp").cast("double")
    own = rows.where((F.col("camera") == first) & F.col("y").isNotNull()).select(*by, F.col("ts").alias("at"), sec.alias("s0"), F.col("y").alias("y0"))
    own = own.withColumn("view", F.row_number().over(Window.partitionBy(*by).orderBy("at", "y0")))
    other = rows.where((F.col("camera") != first) & F.col("y").isNotNull()).select(*by, "camera", sec.alias("s1"), F.col("y").alias("y1"), F.floor(sec / tolerance).alias("bucket"))
    spread = own.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("s0") / tolerance) + k for k in (-1, 0, 1)))))
    near = spread.join(other, [*by, "bucket"]).where(F.abs(F.col("s1") - F.col("s0")) <= tolerance)
    best = near.groupBy(*by, "view", "camera").agg(F.min(F.struct(F.abs(F.col("s1") - F.col("s0")).alias("d"), "s1", "y1")).alias("m"))
    views = best.select(*by, "view", "camera", F.col("m.y1").alias("y")).unionByName(own.select(*by, "view", F.lit(first).alias("camera"), F.col("y0").alias("y")))
    order = F.when(F.col("camera") == first, F.lit("")).otherwise(F.col("camera"))
    value = {"max": F.max("y"), "mean": F.avg("y"), "median": F.percentile("y", 0.5)}[how]
    out = views.groupBy(*by, "view").agg(value.alias("y"), F.count(F.lit(1)).alias("n_views"), F.max(F.col("y")).alias("__hi"), F.min("y").alias("__lo"), F.min(F.struct((-F.col("y")).alias("v"), order.alias("o"), "camera")).alias("b"))
    return own.select(*by, "view", "at").join(out, [*by, "view"]).select(*by, "view", "at", "y", "n_views", F.col("b.camera").alias("best"), (F.col("__hi") - F.col("__lo")).alias("spread"))


def mean_spread(views: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return views.groupBy(*by).agg(F.avg(F.when(F.col("n_views") > 1, F.col("spread"))).alias("mean_spread"))


def sensitivity_compare(rows: DataFrame, baseline: str, by: Sequence[str] = ()) -> DataFrame:
    """Each variant against the baseline over the frames that both use: n, mean and largest absolute change, signed mean,
    change at the last one, and the mean change in units of the baseline's mean uncertainty. rows(by, variant, frame_file,
    ts, y, unc, excluded). A variant without a shared frame has an error."""
    used = rows.where(~F.col("excluded") & F.col("y").isNotNull())
    base = used.where(F.col("variant") == baseline).select(*by, "frame_file", F.col("y").alias("y0"), F.col("unc").alias("u0"))
    joined = used.where(F.col("variant") != baseline).join(base, [*by, "frame_file"]).withColumn("d", F.col("y") - F.col("y0"))
    out = joined.groupBy(*by, "variant").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("d")).alias("mean_abs"), F.max(F.abs("d")).alias("max_abs"), F.avg("d").alias("mean_change"), F.max(F.struct("ts", "frame_file", "d"))["d"].alias("last_change"), F.avg("u0").alias("__u"))
    every = rows.where(F.col("variant") != baseline).select(*by, "variant").distinct()
    joined = every.join(out, [*by, "variant"], "left").withColumn("in_units", F.when(F.col("__u") > 0, F.col("mean_abs") / F.col("__u"))).drop("__u")
    return joined.withColumn("error", F.when(F.col("n").isNull(), F.lit("no shared frame"))).withColumn("n", F.coalesce("n", F.lit(0)))


def variant_grid(spark, uses: Sequence[str]) -> DataFrame:
    """variant and its settings (map) for what the run uses: hsv, cleanup, threshold, lighting, front."""
    all_ = [
        ("hsv", "hsv_wider", {"hsv_step": "1"}), ("hsv", "hsv_narrower", {"hsv_step": "-1"}), ("cleanup", "no_cleanup", {"cleanup": "off"}), ("threshold", "threshold_0.35", {"threshold": "0.35"}), ("threshold", "threshold_0.65", {"threshold": "0.65"}),
        ("lighting", "lighting_off", {"lighting": "off"}), ("lighting", "lighting_background", {"lighting": "background"}), ("front", "front_25", {"front_percentile": "25"}), ("front", "front_75", {"front_percentile": "75"}),
    ]
    return spark.createDataFrame([("baseline", {})] + [(name, over) for kind, name, over in all_ if kind in uses], "variant string, overrides map<string,string>")


def quality_long(rows: DataFrame, keep: Sequence[str], columns: Sequence[str] = ("mean_brightness", "sharpness")) -> DataFrame:
    """Quality columns next to the metric in long form."""
    return rows.unpivot(list(keep), list(columns), "quantity", "value")
