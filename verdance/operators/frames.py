"""Choosing frames and rows: cameras, flags, manual exclusions, hours, time axis, matching (all plain DataFrame work)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EXCLUDED_BY_DEFAULT, METRICS


def choose_camera(frames: DataFrame, by: Sequence[str] = (), explicit: str | None = None) -> DataFrame:
    """by columns and camera: the explicit one, else the camera with most ok frames; the one seen first wins ties."""
    ok = frames.where("status = 'ok'")
    if explicit is not None:
        return ok.select(*by).distinct().withColumn("camera", F.lit(explicit)) if by else ok.sparkSession.createDataFrame([(explicit,)], "camera string")
    counted = ok.groupBy(*by, "camera").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("seen"))
    return counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "seen", "camera")).alias("b")).select(*by, "b.camera", (-F.col("b.n")).alias("n_frames"))


def cameras_with_frames(frames: DataFrame, configured: Sequence[str] = ()) -> DataFrame:
    """camera and position: configured cameras in their order, then the others by name; only those with ok frames."""
    have = frames.where("status = 'ok'").select("camera").distinct()
    order = F.array_position(F.array(*map(F.lit, configured)), F.col("camera")) if configured else F.lit(0)
    key = F.when(order > 0, order).otherwise(F.lit(len(configured) + 1))
    return have.withColumn("position", F.row_number().over(Window.orderBy(key, "camera")))  # one row a camera: tiny


def frames_for_analysis(frames: DataFrame, files: DataFrame, camera: str, by: Sequence[str] = ()) -> DataFrame:
    """ok rows of the camera whose file exists, with is_reference: the first in time, of each `by` (an experiment) or of
    all."""
    mine = frames.where((F.col("status") == "ok") & (F.col("camera") == camera)).join(files.select("file").distinct(), "file", "left_semi")
    first = mine.groupBy(*by).agg(F.min(F.struct("ts", "file")).alias("first"))
    joined = mine.join(first, list(by)) if by else mine.crossJoin(first)  # without `by` one row
    return joined.withColumn("is_reference", F.struct("ts", "file") == F.col("first")).drop("first")


def flag_filter(rows: DataFrame, exclude: Sequence[str] = EXCLUDED_BY_DEFAULT, flags: str = "flags") -> DataFrame:
    """rows with excluded_by_flag: one of the flags is excluded. Null flags count as none."""
    hit = F.arrays_overlap(F.coalesce(flags, F.array().cast("array<string>")), F.array(*map(F.lit, exclude)).cast("array<string>"))
    return rows.withColumn("excluded_by_flag", F.coalesce(hit, F.lit(False)))


def manual_filter(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """rows with manual: the reason of the first listed exclusion (pos) of the frame for this plot or for every plot
    (blank), null if there is none."""
    listed = exclusions.select(F.col("frame_file").alias("__f"), F.coalesce("plot", F.lit("")).alias("__p"), "reason", "pos")
    each = listed.where("__p <> ''").groupBy("__f", "__p").agg(F.min(F.struct("pos", "reason")).alias("one"))
    every = listed.where("__p = ''").groupBy(F.col("__f").alias("__g")).agg(F.min(F.struct("pos", "reason")).alias("all"))
    joined = rows.join(each, (F.col("frame_file") == F.col("__f")) & (F.col("plot") == F.col("__p")), "left").join(every, F.col("frame_file") == F.col("__g"), "left")
    return joined.withColumn("manual", F.least("one", "all")["reason"]).drop("__f", "__p", "__g", "one", "all")


def local_hour(ts: Column, zone: Column | str) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return F.hour(local) + F.minute(local) / 60 + F.floor(F.second(local)) / 3600


def parse_hours(text: str) -> tuple[float, float]:
    """`10-14` or `9:30-15` as hours; an empty window is refused."""
    start, end = (sum(float(x) / 60**i for i, x in enumerate(part.strip().split(":"))) for part in text.split("-"))
    if start == end:
        raise ValueError(f"empty window of hours: {text}")
    return start, end


def hours_filter(rows: DataFrame, window: str, zone: Column | str = "UTC", ts: str = "ts") -> DataFrame:
    """rows with outside_hours: the local time of day is not in [start, end); a start after the end wraps midnight."""
    start, end = parse_hours(window)
    h = local_hour(F.col(ts), zone)
    inside = (h >= start) & (h < end) if start < end else (h >= start) | (h < end)
    return rows.withColumn("outside_hours", ~inside)


def time_axis(rows: DataFrame, by: Sequence[str], unit: float | None = None, t0: str | None = None, ts: str = "ts") -> DataFrame:
    """rows with t, the time since t0 (a column) or the first row of the series, excluded ones too, in units of seconds
    `unit`; without one, by the span: under 2 h minutes, under 3 d hours, else days."""
    w = Window.partitionBy(*by)
    sec = lambda c: c.cast("timestamp").cast("double")
    begin = sec(F.col(t0)) if t0 else F.min(sec(F.col(ts))).over(w)
    span = F.max(sec(F.col(ts))).over(w) - begin
    size = F.lit(unit) if unit else F.when(span < 7200, 60.0).when(span < 259200, 3600.0).otherwise(86400.0)
    return rows.withColumn("t", (sec(F.col(ts)) - begin) / size)


def default_metric(rows: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRICS, ts: str = "ts") -> DataFrame:
    """by columns and metric: the first of metrics that is not null in the first row of the series."""
    first = rows.groupBy(*by).agg(F.min(F.struct(ts, *metrics)).alias("r"))
    return first.select(*by, F.coalesce(*(F.when(F.col(f"r.{m}").isNotNull(), F.lit(m)) for m in metrics)).alias("metric"))


def metric_unc_pairing(rows: DataFrame, by: Sequence[str], used: Column, unc: str = "unc") -> DataFrame:
    """rows with weighted: every used row of the series has an uncertainty above 0."""
    good = F.bool_and(F.when(used, F.coalesce(F.col(unc) > 0, F.lit(False)))).over(Window.partitionBy(*by))
    return rows.withColumn("weighted", F.coalesce(good, F.lit(False)))


def pick_evenly(rows: DataFrame, by: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """At most count rows of each group, evenly spaced and with the first and the last: positions round(i (n-1)/(count-1))
    with halves to even. count <= 1: the last row; count >= n: all."""
    w = Window.partitionBy(*by)
    placed = rows.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    step = F.transform(F.sequence(F.lit(0), F.lit(max(count - 1, 0))), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(max(count - 1, 1))).cast("int"))
    chosen = F.col("pos") == F.col("n") - 1 if count <= 1 else (F.col("n") <= count) | F.array_contains(step, F.col("pos").cast("int"))
    return placed.where(chosen).drop("n")


def validation_template(rows: DataFrame, by: Sequence[str], count: int) -> DataFrame:
    """frame_file, plot, ts of evenly spaced measured frames with a blank value for each plot."""
    frames = rows.groupBy(*by, "frame_file").agg(F.min("ts").alias("ts"))
    picked = pick_evenly(frames, by, ["ts", "frame_file"], count).select(*by, "frame_file", "pos")
    plots = rows.select(*by, "frame_file", "plot").distinct()
    return picked.join(plots, [*by, "frame_file"]).withColumn("value", F.lit(None).cast("double"))


def frame_key_match(hand: DataFrame, frames: DataFrame) -> DataFrame:
    """hand(hand_id, key) with the frame_id that it names: by file path, name or stem, else by a prefix of the timestamp
    text that only one frame has; null where nothing matches. frames(frame_id, file, ts_text)."""
    name = F.element_at(F.split("file", "/"), -1)
    keys = frames.select("frame_id", F.explode(F.array_distinct(F.array("file", name, F.regexp_replace(name, r"\.[^.]*$", "")))).alias("key"))
    named = hand.join(keys.groupBy("key").agg(F.min("frame_id").alias("by_name")), "key", "left")
    rest = named.where("by_name is null and length(key) > 0").select("hand_id", "key")
    # a prefix join by equality: the frames' prefixes of just the lengths that occur
    lengths = F.broadcast(rest.agg(F.collect_set(F.length("key")).alias("sizes")))
    prefixes = frames.crossJoin(lengths).select("frame_id", F.explode(F.transform("sizes", lambda n: F.when(n <= F.length("ts_text"), F.substring(F.col("ts_text"), F.lit(1), n)))).alias("key")).where("key is not null")
    single = prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("frame_id").alias("by_time")).where("n = 1")
    return named.join(single.select("key", "by_time"), "key", "left").select("hand_id", "key", F.coalesce("by_name", "by_time").alias("frame_id"))


def frame_status(frames: DataFrame, by: Sequence[str] = ("camera",)) -> DataFrame:
    """Per camera: saved, failed, first, last, median gap (element n//2 of the sorted gaps) and largest gap in seconds."""
    ok = F.when(F.col("status") == "ok", F.col("ts").cast("timestamp").cast("double"))
    w = Window.partitionBy(*by, F.col("status") == "ok").orderBy("ts")
    gaps = frames.withColumn("gap", ok - F.lag(F.col("ts").cast("timestamp").cast("double")).over(w))
    sorted_ = F.sort_array(F.collect_list("gap"))
    return gaps.groupBy(*by).agg(
        F.count_if(F.col("status") == "ok").alias("saved"), F.count_if(F.col("status") == "failed").alias("failed"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.get(sorted_, F.floor(F.size(sorted_) / 2).cast("int")).alias("median_gap"), F.max("gap").alias("largest_gap"),
    )


def list_plots(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.select(*by, F.coalesce(F.nullif("plot", F.lit("")), F.lit("main")).alias("plot")).distinct()


def experiment_facts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("experiment").agg(F.countDistinct("frame_file").alias("frames"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.array_sort(F.collect_set("plot")).alias("plots"))


def flag_counts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.select(*by, F.explode("flags").alias("flag")).groupBy(*by, "flag").agg(F.count(F.lit(1)).alias("n"))


#: Seconds of each unit's names.
UNITS = {"ms": 0.001, "s": 1, "sec": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "minute": 60, "minutes": 60, "h": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400}


def parse_duration(text: Column) -> Column:
    """Seconds of `90`, `30s`, `1h30m`, `2 days`; null for what is no duration above 0. The parts must cover the text."""
    t = F.lower(F.trim(text))
    part = r"([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)"
    size = F.create_map(*(x for k, v in UNITS.items() for x in (F.lit(k), F.lit(float(v)))))
    number, unit = F.regexp_extract_all(t, F.lit(part), F.lit(1)), F.regexp_extract_all(t, F.lit(part), F.lit(2))
    bare = t.rlike(r"^[0-9]+(\.[0-9]+)?$")
    covered = t.rlike(rf"^(\s*[0-9]+(\.[0-9]+)?\s*({'|'.join(sorted(UNITS, key=len, reverse=True))})\s*)+$")
    seconds = F.aggregate(F.zip_with(number, unit, lambda a, u: a.cast("double") * F.try_element_at(size, u)), F.lit(0.0), lambda a, b: a + b)
    value = F.when(bare, t.try_cast("double")).when(covered, seconds)
    return F.when(value > 0, value)
