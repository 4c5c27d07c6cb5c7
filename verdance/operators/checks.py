"""Agreement with hand measurements, acceptance suites, health of running experiments."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import Z95
from .study import t_table


def agreement(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bland-Altman over pairs(by, id, auto, hand) with at least 3: bias, sd, its 95 % interval, limits, mean absolute and
    root mean square error, correlation, line of auto on hand, worst pair."""
    p = pairs.where("auto is not null and hand is not null").withColumn("d", F.col("auto") - F.col("hand"))
    g = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("bias"), F.stddev_samp("d").alias("sd"), F.avg(F.abs("d")).alias("mae"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rmse"),
        F.when((F.stddev_samp("auto") > 0) & (F.stddev_samp("hand") > 0), F.corr("auto", "hand")).alias("r"), F.regr_slope("auto", "hand").alias("slope"), F.regr_intercept("auto", "hand").alias("intercept"), F.max(F.struct(F.abs("d").alias("a"), (-F.col("id")).alias("i")))["i"].alias("__w"),
    ).where("n >= 3")
    t = F.broadcast(t_table(pairs.sparkSession))
    g = g.join(t, F.col("df") == F.col("n") - 1, "left").withColumn("half", F.when(F.col("n") > 201, Z95).otherwise(F.col("tq")) * F.col("sd") / F.sqrt("n"))
    return g.withColumns({"worst": -F.col("__w"), "bias_low": F.col("bias") - F.col("half"), "bias_high": F.col("bias") + F.col("half"), "limit_low": F.col("bias") - 1.96 * F.col("sd"), "limit_high": F.col("bias") + 1.96 * F.col("sd")}).drop("__w", "df", "tq", "half")


def uncertainty_honesty(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of |auto - hand| within 2 u and root mean square of it in u, u^2 = auto_unc^2 + hand_unc^2; null unless every
    u is above 0."""
    u = F.sqrt(F.col("auto_unc") ** 2 + F.coalesce("hand_unc", F.lit(0.0)) ** 2)
    p = pairs.withColumn("u", u).withColumn("z", (F.col("auto") - F.col("hand")) / F.nullif("u", F.lit(0.0)))
    good = F.bool_and(F.coalesce(F.col("u") > 0, F.lit(False)))
    return p.groupBy(*by).agg(F.when(good, F.avg(F.when(F.abs("z") <= 2, 1.0).otherwise(0.0))).alias("within_2u"), F.when(good, F.sqrt(F.avg(F.col("z") ** 2))).alias("rms_z"))


def evaluate_bounds(values: DataFrame, bounds: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("case", "check", "metric")) -> DataFrame:
    """keys, value, failures (array) and status: pass, fail, or info without a bound. A null or missing value fails; a drift
    without a baseline too. bounds(keys, min, max, abs_max, max_drift)."""
    j = values.join(bounds.withColumn("__b", F.lit(True)), list(keys), "full").join(baseline.select(*keys, F.col("value").alias("__base")), list(keys), "left")
    v = F.col("value")
    known = v.isNotNull() & ~F.isnan(v)
    rules = [
        ("no value", ~known), ("under min", known & (v < F.col("min"))), ("over max", known & (v > F.col("max"))), ("over abs_max", known & (F.abs(v) > F.col("abs_max"))),
        ("no baseline", F.col("max_drift").isNotNull() & F.col("__base").isNull()), ("drift", known & (F.abs(v - F.col("__base")) > F.col("max_drift"))),
    ]
    fails = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules)))
    bound = F.col("__b").isNotNull()
    return j.select(*keys, "value", F.when(bound, fails).otherwise(F.array().cast("array<string>")).alias("failures"), F.when(~bound, "info").when(F.size(fails) > 0, "fail").otherwise("pass").alias("status"))


def save_baseline(values: DataFrame, path: str, keys: Sequence[str] = ("case", "check", "metric")) -> None:
    """Stores a run's values (keys, value) as the baseline that later runs are held against; null values are no baseline."""
    values.where(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("value"), F.current_timestamp().alias("saved")).write.mode("overwrite").parquet(path)


#: Evaluators of a suite by name: (rows, settings) to values(check, metric, value).
EVALUATORS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def register_evaluator(name: str, evaluate: Callable[[DataFrame, dict], DataFrame]) -> None:
    EVALUATORS[name] = evaluate


def run_suite(cases: Sequence[tuple[str, str, DataFrame, dict]]) -> DataFrame:
    """case, check, metric, value of cases (name, evaluator, rows, settings), for evaluate_bounds and save_baseline."""
    found = [EVALUATORS[how](rows, settings).select(F.lit(name).alias("case"), "check", "metric", F.col("value").cast("double").alias("value")) for name, how, rows, settings in cases]
    return functools.reduce(DataFrame.unionByName, found)


def suite_rollup(results: DataFrame, errors: DataFrame, keys: Sequence[str] = ("case", "check")) -> DataFrame:
    """Per check: passed if it has no error and no failing metric; the row with null keys is the whole suite."""
    each = results.groupBy(*keys).agg(F.count_if(F.col("status") == "fail").alias("failing")).join(errors.select(*keys, F.lit(1).alias("__e")).distinct(), list(keys), "full")
    each = each.select(*keys, F.coalesce("failing", F.lit(0)).alias("failing"), (F.coalesce("failing", F.lit(0)) + F.coalesce("__e", F.lit(0)) == 0).alias("passed"))
    return each.rollup(*keys).agg(F.grouping_id().alias("__g"), F.sum("failing").alias("failing"), F.bool_and("passed").alias("passed")).where(f"__g in (0, {2 ** len(keys) - 1})").drop("__g")


def health_checks(beats: DataFrame, frames: DataFrame, now: str, min_disk_mb: float = 500.0) -> DataFrame:
    """experiment, check, level (ok, warning, problem), detail at the time `now` (text).
    beats(experiment, config_interval_s, interval_s, updated, state, skipped_slots, free_disk_mb, frame_mb) has a row for
    each experiment, its beat columns null if there was none; frames(experiment, ts, status, mean_brightness, sharpness)."""
    t = F.lit(now).cast("timestamp").cast("double")
    sec = lambda c: F.col(c).cast("timestamp").cast("double")
    b = beats.withColumn("iv", F.greatest("config_interval_s", F.coalesce("interval_s", F.lit(0.0)), F.lit(1.0)))
    ok = F.col("status") == "ok"
    f = frames.join(b.select("experiment", "iv"), "experiment").groupBy("experiment").agg(
        F.max(F.when(ok, sec("ts"))).alias("last"), F.count_if((F.col("status") == "failed") & (sec("ts") >= t - 20 * F.col("iv")) & (sec("ts") <= t)).alias("failed"),
        F.min(F.when(ok & F.col("mean_brightness").isNotNull(), F.struct(sec("ts").alias("k"), "mean_brightness", "sharpness"))).alias("a"), F.max(F.when(ok & F.col("mean_brightness").isNotNull(), F.struct(sec("ts").alias("k"), "mean_brightness", "sharpness"))).alias("z"),
    )
    j = b.join(f, "experiment", "left")
    late = lambda age: F.when(age > 5 * F.col("iv"), "problem").when(age > 2 * F.col("iv"), "warning").otherwise("ok")
    done = F.coalesce(F.col("state") == "finished", F.lit(False))
    beat = F.when(done, "ok").when(F.col("updated").isNull(), "warning").otherwise(late(t - sec("updated")))
    fresh = F.when(done, "ok").when(F.col("last").isNull(), "warning").otherwise(late(t - F.col("last")))
    failed = F.coalesce("failed", F.lit(0))
    bright, first = F.col("z.mean_brightness"), F.col("a.mean_brightness")
    image = F.when(bright.isNull(), "ok").when((bright < 15) | (F.abs(bright - first) > 0.4 * first) | (F.col("z.sharpness") < 0.4 * F.col("a.sharpness")), "warning").otherwise("ok")
    disk = F.when(F.col("free_disk_mb") < min_disk_mb, "problem").when(F.col("free_disk_mb") - min_disk_mb < 50 * F.col("frame_mb"), "warning").otherwise("ok")
    checks = [("capture", beat), ("frames", fresh), ("failures", F.when(failed >= 3, "problem").when(failed >= 1, "warning").otherwise("ok")), ("skipped", F.when(F.col("skipped_slots") > 0, "warning").otherwise("ok")), ("image", image), ("disk", disk)]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), c.alias("level")) for n, c in checks)))
    return j.select("experiment", rows.alias("c")).select("experiment", "c.check", "c.level")


RANK = ["ok", "warning", "problem"]


def overall_health(checks: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("level"))
    return checks.groupBy("experiment").agg(F.max(F.struct(rank.alias("r"), "level"))["level"].alias("level"))


def alert_transitions(levels: DataFrame, by: Sequence[str] = ("experiment",), order: Column | str = "ts") -> DataFrame:
    """Rows where the level changes: event problem if it is not ok, recovered if it is ok again; a first ok says nothing."""
    before = F.lag("level").over(Window.partitionBy(*by).orderBy(order))
    event = F.when(before.eqNullSafe(F.col("level")), None).when(F.col("level") != "ok", "problem").when(before.isNotNull(), "recovered")
    return levels.withColumn("event", event).where("event is not null")


def gap_detection(frames: DataFrame, by: Sequence[str], interval: float) -> DataFrame:
    """Rows that come at least one interval late after the row before: late seconds and missed slots."""
    late = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(Window.partitionBy(*by).orderBy("ts")) - interval
    return frames.withColumn("late_s", late).where(F.col("late_s") >= interval).withColumn("missed", F.floor(F.col("late_s") / interval))


def capture_sessions(frames: DataFrame, by: Sequence[str], interval: float) -> DataFrame:
    """Stretches of uninterrupted capture: rows less than two intervals apart."""
    s = frames.groupBy(*by, F.session_window("ts", f"{int(2 * interval)} seconds").alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return s.drop("w")
