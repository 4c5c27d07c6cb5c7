"""Studies: replicates, conditions, comparisons, model selection."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tdist import t_cdf, t_quantile
from ..schemas import Z95
from .growth import akaike_weights


def number_replicates(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "replicate") -> DataFrame:
    """A missing name is the row's position within its condition, all rows counted."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(name, F.coalesce(F.col(name), n.cast("string")))


def study_spec_checks(replicates: DataFrame, conditions: DataFrame, reference: str, params: DataFrame, known: DataFrame) -> DataFrame:
    """problem, detail: an unknown reference, names used twice in a condition, unknown parameters."""
    twice = replicates.where("replicate is not null").groupBy("condition", "replicate").count().where("count > 1").select(F.lit("replicate used twice").alias("problem"), F.concat_ws("/", "condition", "replicate").alias("detail"))
    unknown = params.join(known, "param", "left_anti").select(F.lit("unknown parameter").alias("problem"), F.col("param").alias("detail"))
    there = conditions.agg(F.count_if(F.col("condition") == reference).alias("n")).where("n = 0").select(F.lit("unknown reference").alias("problem"), F.lit(reference).alias("detail"))
    return twice.unionByName(unknown).unionByName(there)


def study_time_unit(points: DataFrame, used: str = "not excluded") -> DataFrame:
    """One unit for all from the longest usable series (t in seconds)."""
    span = points.where(used).agg(F.max("t").alias("longest"))
    return span.select("longest", F.when(F.col("longest") < 7200, "min").when(F.col("longest") < 259200, "h").otherwise("d").alias("unit"))


def t_table(spark, top: int = 200, q: float = 0.975) -> DataFrame:
    """df and t quantile for 1 to top degrees of freedom; beyond, the normal quantile serves (error under 1 %)."""
    return spark.createDataFrame([(k, t_quantile(q, k)) for k in range(1, top + 1)], "df int, tq double")


def describe_condition(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean, sd, se, median, min, max and the 95 % interval by Student's t; no sd under 2."""
    g = values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))
    g = g.withColumn("se", F.col("sd") / F.sqrt("n"))
    t = F.broadcast(t_table(values.sparkSession))
    g = g.join(t, F.col("df") == F.col("n") - 1, "left").withColumn("tq", F.when(F.col("n") > 201, Z95).otherwise(F.col("tq")))
    return g.withColumns({"ci_low": F.col("mean") - F.col("tq") * F.col("se"), "ci_high": F.col("mean") + F.col("tq") * F.col("se")}).drop("df", "tq")


def random_effects(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """DerSimonian-Laird over values(by, value, se): k, q, tau, i2, mean, se and interval, with at least 2 usable rows."""
    v = values.where("value is not null and se > 0").withColumn("w", 1 / F.col("se") ** 2)
    a = v.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("w1"), F.sum(F.col("w") ** 2).alias("w2"), (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("fixed")).where("k >= 2")
    q = v.join(a, list(by)).groupBy(*by, "k", "w1", "w2").agg(F.sum(F.col("w") * (F.col("value") - F.col("fixed")) ** 2).alias("q"))
    c = F.col("w1") - F.col("w2") / F.col("w1")
    q = q.withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce((F.col("q") - (F.col("k") - 1)) / F.nullif(c, F.lit(0.0)), F.lit(0.0))))
    r = v.join(q, list(by)).withColumn("wr", 1 / (F.col("se") ** 2 + F.col("tau2")))
    out = r.groupBy(*by, "k", "q", "tau2").agg((F.sum(F.col("wr") * F.col("value")) / F.sum("wr")).alias("re_mean"), (1 / F.sqrt(F.sum("wr"))).alias("re_se"))
    return out.select(*by, "k", "q", F.sqrt("tau2").alias("tau"), F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q"))).otherwise(0.0).alias("i2"), "re_mean", "re_se", (F.col("re_mean") - Z95 * F.col("re_se")).alias("re_low"), (F.col("re_mean") + Z95 * F.col("re_se")).alias("re_high"))


def param_uncertainty(low: str = "ci_low", high: str = "ci_high", stderr: str = "stderr"):
    """Half the bootstrap interval in standard errors, else the fit's."""
    return F.coalesce((F.col(high) - F.col(low)) / (2 * Z95), F.col(stderr))


def condition_pairs(conditions: DataFrame, reference: str | None = None) -> DataFrame:
    """a, b: every other condition against the reference, or all unordered pairs in order of pos. conditions(condition,
    pos): a settings-sized table."""
    left, right = conditions.select(F.col("condition").alias("a"), F.col("pos").alias("pa")), conditions.select(F.col("condition").alias("b"), F.col("pos").alias("pb"))
    if reference is not None:
        return right.where(F.col("b") != reference).select(F.lit(reference).alias("a"), "b")
    return left.join(F.broadcast(right), F.col("pa") < F.col("pb")).select("a", "b")


def welch_compare(stats: DataFrame, pairs: DataFrame, by: Sequence[str] = ("param",)) -> DataFrame:
    """Differences b - a of condition means: se, Welch's degrees of freedom, t, p, 95 % interval and Hedges' g. Under 2
    values on a side the difference alone; nothing but it if the se is 0. stats(by, condition, n, mean, sd)."""
    one = lambda k: stats.select(*by, F.col("condition").alias(k), F.col("n").alias(f"n{k}"), F.col("mean").alias(f"m{k}"), F.col("sd").alias(f"s{k}"))
    j = pairs.join(one("a"), "a").join(one("b"), [*by, "b"])
    va, vb = F.col("sa") ** 2 / F.col("na"), F.col("sb") ** 2 / F.col("nb")
    j = j.withColumn("diff", F.col("mb") - F.col("ma")).withColumn("se", F.when((F.col("na") > 1) & (F.col("nb") > 1) & (va + vb > 0), F.sqrt(va + vb)))
    j = j.withColumn("df", F.when(F.col("se").isNotNull(), (va + vb) ** 2 / (va**2 / (F.col("na") - 1) + vb**2 / (F.col("nb") - 1)))).withColumn("t", F.col("diff") / F.col("se"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("sa") ** 2 + (F.col("nb") - 1) * F.col("sb") ** 2) / (F.col("na") + F.col("nb") - 2))
    j = j.withColumn("hedges_g", F.when(F.col("se").isNotNull(), F.col("diff") / pooled * (1 - 3 / (4 * (F.col("na") + F.col("nb") - 2) - 1))))

    @F.pandas_udf("p double, half double")
    def tail(t: pd.Series, df: pd.Series, se: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if pd.isna(a) or pd.isna(d) else (2 * (1 - t_cdf(abs(a), d)), t_quantile(0.975, d) * s) for a, d, s in zip(t, df, se, strict=True)]
        return pd.DataFrame(rows, columns=["p", "half"], dtype=float)

    j = j.withColumn("x", tail("t", "df", "se"))
    clean = lambda c: F.when(~F.isnan(c), c)
    return j.select(*by, "a", "b", "diff", "se", "df", "t", clean(F.col("x.p")).alias("p"), clean(F.col("diff") - F.col("x.half")).alias("ci_low"), clean(F.col("diff") + F.col("x.half")).alias("ci_high"), "hedges_g")


def holm_adjust(tests: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """tests with p_holm within each group; null p stay null."""
    some = tests.where("p is not null")
    w = Window.partitionBy(*by)
    r = some.withColumn("__r", F.row_number().over(w.orderBy("p", *order))).withColumn("__m", F.count(F.lit(1)).over(w))
    r = r.withColumn("p_holm", F.max(F.least(F.lit(1.0), (F.col("__m") - F.col("__r") + 1) * F.col("p"))).over(w.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))).drop("__r", "__m")
    return r.unionByName(tests.where("p is null").withColumn("p_holm", F.lit(None).cast("double")))


def missing_quantity_warnings(values: DataFrame, by: Sequence[str] = ("param", "condition")) -> DataFrame:
    g = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("usable"))
    return g.where("usable < n or usable < 2").withColumn("warning", F.when(F.col("usable") < 2, "fewer than 2 usable").otherwise("missing in some replicates"))


def settings_mismatch(settings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """replicate, differs (sorted keys) and unknown: settings(replicate, pos, values map) against the first replicate with
    settings."""
    pairs = settings.where("values is not null").select("replicate", "pos", F.explode(F.array(*map(F.lit, keys))).alias("key"), "values").select("replicate", "pos", "key", F.try_element_at("values", F.col("key")).alias("v"))
    first = settings.where("values is not null").agg(F.min("pos").alias("pos"))
    ref = pairs.join(F.broadcast(first), "pos").select("key", F.col("v").alias("v0"))
    bad = pairs.join(F.broadcast(ref), "key").where(~F.col("v").eqNullSafe(F.col("v0"))).groupBy("replicate").agg(F.array_sort(F.collect_set("key")).alias("differs"))
    return bad.withColumn("unknown", F.lit(False)).unionByName(settings.where("values is null").select("replicate", F.array().cast("array<string>").alias("differs"), F.lit(True).alias("unknown")))


def model_selection(fits: DataFrame, by: Sequence[str] = ("condition", "replicate")) -> DataFrame:
    """AICc and weight per replicate, and over all replicates (null keys) where every model converged: sums of AICc."""
    good = fits.where("aicc is not null")
    each = akaike_weights(good.select(*by, "model", "aicc"), by)
    models = fits.select("model").distinct().agg(F.count(F.lit(1)).alias("m"))
    full = good.groupBy(*by).agg(F.countDistinct("model").alias("m")).join(F.broadcast(models), "m").drop("m")
    total = good.join(full, list(by), "left_semi").groupBy("model").agg(F.sum("aicc").alias("aicc"))
    alls = akaike_weights(total.withColumns({b: F.lit(None).cast(dict(fits.dtypes)[b]) for b in by}), by)
    return each.select(*by, "model", "aicc", "weight").unionByName(alls.select(*by, "model", "aicc", "weight"))


def replicate_table(values: DataFrame, params: Sequence[str], by: Sequence[str] = ("condition", "replicate")) -> DataFrame:
    """A wide row per replicate: each parameter and its standard error."""
    return values.groupBy(*by).pivot("param", list(params)).agg(F.first("value").alias("value"), F.first("se").alias("se"))


def pilot_spread(stats: DataFrame, param: str, reference: str) -> DataFrame:
    """n, mean and sd of the reference and of each other condition for one parameter."""
    s = stats.where(F.col("param") == param)
    ref = s.where(F.col("condition") == reference).select(F.col("n").alias("ref_n"), F.col("mean").alias("ref_mean"), F.col("sd").alias("ref_sd"))
    return s.where(F.col("condition") != reference).select("condition", "n", "mean", "sd").crossJoin(F.broadcast(ref))


def run_study(points: DataFrame, models: Sequence[str], model: str, param: str, reference: str, errors: str = "iid") -> dict[str, DataFrame]:
    """points(condition, replicate, t, y, unc, excluded) to fits, values of one parameter, conditions, comparisons and model
    selection, all lazy."""
    from .growth import fit_growth

    by = ["condition", "replicate"]
    fits = fit_growth(points.where("not excluded"), by, models, errors)
    values = fits.where((F.col("model") == model) & F.col("ok")).select(*by, F.lit(param).alias("param"), F.try_element_at("params", F.lit(param)).alias("value"), F.try_element_at("stderr", F.lit(param)).alias("se"))
    stats = describe_condition(values, ["param", "condition"])
    order = points.select("condition").distinct().withColumn("pos", F.col("condition"))
    tests = holm_adjust(welch_compare(stats, condition_pairs(order, reference)), ["param"], ["a", "b"])
    return {"fits": fits, "values": values, "conditions": stats, "random": random_effects(values, ["param", "condition"]), "comparisons": tests, "selection": model_selection(fits.where("ok"))}
