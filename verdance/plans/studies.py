"""Queries over fits, studies, agreement, health."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..operators import checks, covariates, growth, series, study
from .rows import AXIS
from .sample import FR, P, S, frames, points, query, study_points, table

BY = ["condition", "replicate"]


def _user_points(spark, d):
    return series.build_series(points(spark, d), ["series_id"], unit=86400.0)


LIN = """ln as (select {by}, count(*) n, sum(t) st, sum(y) sy, sum(t * t) stt, sum(t * y) sty, sum(y * y) syy, sum(greatest(t, 0)) sxx, sum(sqrt(greatest(t, 0)) * y) sxy from {src} where y is not null group by all),
pr as (select *, (n * sty - st * sy) / nullif(n * stt - st * st, 0) b, sxy / nullif(sxx, 0) k from ln),
fl as (select {by}, n, 'linear' model, syy - (sy - b * st) / n * sy - b * sty rss, 2 np, syy - sy * sy / n tss, (sy - b * st) / n a, b, null::double k from pr where n >= 4 union all select {by}, n, 'sqrt', syy - k * sxy, 1, syy - sy * sy / n, null, null, k from pr where n >= 3),
ft as (select {by}, n, model, greatest(rss, 0) rss, np, tss, a, b, k, case when n - np - 2 > 0 then n * ln(greatest(rss, 1e-300) / n) + 2 * (np + 1) + 2.0 * (np + 1) * (np + 2) / (n - np - 2) end aicc from fl where rss is not null)"""
UA = f"{AXIS.replace('case when span < 7200 then 60.0 when span < 259200 then 3600.0 else 86400.0 end', '86400.0')}, us as (select series_id, t, y, unc, event_id from a where not excluded)"
UFIT = f"{UA}, {LIN.format(by='series_id', src='us')}"
SFIT = f"with {S}, {LIN.format(by='condition, replicate', src='sp')}"


def growth_by_user(spark: SparkSession, d: str) -> DataFrame:
    """Which users' metric grows, how fast, and by which law: series, flags, time axis, retreats, two closed-form laws and
    their Akaike weights in one plan."""
    p = series.mark_retreats(_user_points(spark, d), ["series_id"])
    retreats = p.groupBy("series_id").agg(F.count_if("retreat").alias("retreats"), F.count_if("excluded").alias("excluded"))
    fits = growth.akaike_weights(growth.fit_linear_closed(p.where("not excluded"), ["series_id"]), ["series_id"])
    best = fits.where("best").select("series_id", "model", "n", "r2", "rmse", "weight", F.coalesce(F.try_element_at("params", F.lit("b")), F.try_element_at("params", F.lit("k"))).alias("rate"))
    return best.join(retreats, "series_id")


WEIGHT = "wt as (select *, exp(-(aicc - min(aicc) over w) / 2) / sum(exp(-(aicc - m) / 2)) over w weight, row_number() over (partition by {by} order by aicc nulls last, model) = 1 best from (select *, min(aicc) over (partition by {by}) m from ft) window w as (partition by {by}))"


@query("growth_by_user", f"{UFIT}, {WEIGHT.format(by='series_id')}, rt as (select series_id, count(*) filter (r) retreats, count(*) filter (excluded) excluded from (select series_id, excluded, coalesce(not excluded and max(case when not excluded then y end) over (partition by series_id order by t) - y > greatest(3 * unc, 1e-9), false) r from a) group by 1)\n;;\nselect series_id, model, n, case when tss > 0 then 1 - rss / tss end r2, sqrt(rss / n) rmse, weight, coalesce(b, k) rate, retreats, excluded from wt join rt using (series_id) where best", "r2 rmse weight rate", "series_id model n retreats excluded")
def _(spark, d):
    return growth_by_user(spark, d)


@query("fit_linear_closed", f"{SFIT}\n;;\nselect condition, replicate, model, n, a, b, k, sqrt(rss / n) rmse, case when tss > 0 then 1 - rss / tss end r2 from ft", "a b k rmse r2", "condition replicate model n")
def _(spark, d):
    f = growth.fit_linear_closed(study_points(spark, d), BY)
    v = lambda k: F.try_element_at("params", F.lit(k)).alias(k)
    return f.select(*BY, "model", "n", v("a"), v("b"), v("k"), "rmse", "r2")


@query("akaike_weights", f"{SFIT}, {WEIGHT.format(by='condition, replicate')}\n;;\nselect condition, replicate, model, aicc, weight, best from wt", "aicc weight", "condition replicate model best")
def _(spark, d):
    return growth.akaike_weights(growth.fit_linear_closed(study_points(spark, d), BY), BY).select(*BY, "model", "aicc", "weight", "best")


PCL = "with q as (select l_partkey, datediff('day', timestamp '1992-01-01', l_shipdate)::double t, l_quantity from lineitem), c as (select l_partkey, t, sum(l_quantity) over (partition by l_partkey order by t) y from (select l_partkey, t, sum(l_quantity) l_quantity from q group by all))"


def _part_points(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("t"), "l_quantity").groupBy("l_partkey", "t").agg(F.sum("l_quantity").alias("q"))
    return li.select("l_partkey", "t", F.sum("q").over(Window.partitionBy("l_partkey").orderBy("t")).alias("y"))


@query("fit_linear_closed_parts", f"{PCL}, {LIN.format(by='l_partkey', src='c')}\n;;\nselect l_partkey, model, n, coalesce(b, k) rate, case when tss > 0 then 1 - rss / tss end r2 from ft", "rate r2", "l_partkey model n")
def _(spark, d):
    f = growth.fit_linear_closed(_part_points(spark, d), ["l_partkey"])
    return f.select("l_partkey", "model", "n", F.coalesce(F.try_element_at("params", F.lit("b")), F.try_element_at("params", F.lit("k"))).alias("rate"), "r2")


@query("predict_curve", f"{SFIT}, sp2 as (select condition, replicate, min(t) t0, max(t) t1 from sp group by all), gr as (select condition, replicate, model, i, t0 + (t1 - t0) * i / 9 t, a, b, k from ft join sp2 using (condition, replicate), range(10) r(i))\n;;\nselect condition, replicate, model, i, t, case model when 'linear' then a + b * t else k * sqrt(greatest(t, 0)) end y from gr", "t y", "condition replicate model i")
def _(spark, d):
    p = study_points(spark, d)
    span = p.groupBy(*BY).agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    f = growth.fit_linear_closed(p, BY).join(span, BY)
    return growth.predict_curve(f, 10).select(*BY, "model", F.col("i").cast("long").alias("i"), "t", "y")


RES = f"{UFIT}, {WEIGHT.format(by='series_id')}, rs as (select us.series_id, event_id, t, us.y, us.unc, us.y - case model when 'linear' then a + b * t else k * sqrt(greatest(t, 0)) end residual from us join wt using (series_id) where best)"


def _best_users(spark, d):
    p = _user_points(spark, d).where("not excluded")
    return p, growth.akaike_weights(growth.fit_linear_closed(p, ["series_id"]), ["series_id"]).where("best")


@query("residual_table", f"{RES}\n;;\nselect event_id, residual, residual / unc scaled from rs", "residual scaled", "event_id")
def _(spark, d):
    p, best = _best_users(spark, d)
    return growth.residual_table(p, best, ["series_id"]).select("event_id", "residual", "scaled")


@query("residual_statistics", f"{RES}, dd as (select *, residual - lag(residual) over (partition by series_id order by t) dr from rs)\n;;\nselect series_id, count(*) n, sqrt(sum(residual ** 2) / count(*)) rmse, sum(dr ** 2) / sum(residual ** 2) durbin_watson from dd group by 1", "rmse durbin_watson", "series_id n")
def _(spark, d):
    p, best = _best_users(spark, d)
    return growth.residual_statistics(growth.residual_table(p, best, ["series_id"]), ["series_id"])


@query("fit_growth")
def _(spark, d):
    f = growth.fit_growth(study_points(spark, d), BY, ("linear", "sqrt", "power", "logistic", "gompertz", "richards", "sqrt_lag"), "iid")
    return f.select(*BY, "model", "ok", "n", "r2", "rmse", "aicc", "error_model")


@query("ar1_errors")
def _(spark, d):
    f = growth.fit_growth(study_points(spark, d), BY, ("linear", "sqrt"), "auto")
    return f.select(*BY, "model", "ok", "error_model", "ar1_phi", "durbin_watson", "aicc")


def _fits(spark, d, models=("linear", "logistic")):
    return growth.fit_growth(study_points(spark, d), BY, models, "iid")


@query("fit_statistics")
def _(spark, d):
    return _fits(spark, d).select(*BY, "model", "n", "r2", "rmse", "aic", "aicc", "bic", "durbin_watson", F.array_join("warnings", ";").alias("warnings"))


@query("derived_quantities", f"{SFIT}, sp2 as (select condition, replicate, min(t) t0, max(t) t1 from sp group by all)\n;;\nselect condition, replicate, b max_rate, null::double t_max_rate, null::double lag, case when a + b * t0 >= 20 then t0 when b > 0 and (20 - a) / b <= t1 then (20 - a) / b end time_to_20 from ft join sp2 using (condition, replicate) where model = 'linear'", "max_rate t_max_rate lag time_to_20", "condition replicate")
def _(spark, d):
    p = study_points(spark, d)
    span = p.groupBy(*BY).agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    f = growth.fit_linear_closed(p, BY).where("model = 'linear'").join(span, BY)
    return growth.derived_quantities(f, BY, [20.0]).drop("model")


DRAWS = 500


def _draws(spark, d):
    fits = _fits(spark, d)
    return growth.bootstrap_draws(study_points(spark, d), fits, BY, DRAWS, 125), fits


@query("bootstrap_fit")
def _(spark, d):
    return growth.bootstrap_fit(_draws(spark, d)[0], BY, DRAWS)


@query("confidence_band")
def _(spark, d):
    drawn, fits = _draws(spark, d)
    return growth.confidence_band(drawn, fits, BY, 12)


@query("bootstrap_derived")
def _(spark, d):
    drawn, fits = _draws(spark, d)
    return growth.bootstrap_derived(drawn, fits, BY, [20.0], 100)


@query("report_fits")
def _(spark, d):
    p = series.mark_retreats(series.detect_jumps(_user_points(spark, d), ["series_id"]), ["series_id"])
    return growth.report_fits(p, ["series_id"], ("linear", "sqrt", "power"), "iid").select("series_id", "model", "weight", "best", "n_used", "n_excluded", "jumps", "retreats", "outside")


# --- studies ---------------------------------------------------------------------------------------------------------

VAL = f"{SFIT}, va as (select condition, replicate, 'b' param, b as value, sqrt(rss / (n - 2) / sxx2) se from ft join (select condition, replicate, sum(t * t) - sum(t) * sum(t) / count(*) sxx2 from sp group by all) using (condition, replicate) where model = 'linear')"


def _values(spark, d):
    p = study_points(spark, d)
    sxx = p.groupBy(*BY).agg(F.regr_sxx("y", "t").alias("sxx"))
    f = growth.fit_linear_closed(p, BY).where("model = 'linear'").join(sxx, BY)
    return f.select(*BY, F.lit("b").alias("param"), F.try_element_at("params", F.lit("b")).alias("value"), F.sqrt(F.col("rss") / (F.col("n") - 2) / F.col("sxx")).alias("se"))


@query("number_replicates", "select conv_id, turn, case when turn % 3 = 0 then role else (row_number() over (partition by conv_id order by turn, role, text))::varchar end replicate from conversations")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("replicate", F.when(F.col("turn") % 3 == 0, F.col("role")))
    return study.number_replicates(c, ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "replicate")


@query("study_spec_checks", "select 'replicate used twice' problem, conv_id || '/' || role detail from conversations group by conv_id, role having count(*) > 1 union all select distinct 'unknown parameter', role from conversations where role not in ('user', 'assistant') union all select 'unknown reference', 'nobody'")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("condition"), F.col("role").alias("replicate"))
    known = spark.createDataFrame([("user",), ("assistant",)], "param string")
    return study.study_spec_checks(c, c, "nobody", c.select(F.col("replicate").alias("param")).distinct(), known)


@query("study_time_unit", f"with {P}\n;;\nselect max(x) longest, case when max(x) < 7200 then 'min' when max(x) < 259200 then 'h' else 'd' end unit from (select s - min(s) over (partition by series_id) x from p)", "longest", "unit")
def _(spark, d):
    p = points(spark, d).withColumn("s", F.col("ts").cast("double"))
    return study.study_time_unit(p.withColumn("t", F.col("s") - F.min("s").over(Window.partitionBy("series_id"))).withColumn("excluded", F.lit(False)))


@query("describe_condition", f"{VAL}\n;;\nselect condition, count(*) n, avg(value) mean, stddev_samp(value) sd, stddev_samp(value) / sqrt(count(*)) se, median(value) median, min(value) min, max(value) max from va group by 1", "mean sd se median min max", "condition n")
def _(spark, d):
    return study.describe_condition(_values(spark, d), ["condition"]).drop("ci_low", "ci_high")


@query("describe_condition_ci")
def _(spark, d):
    return study.describe_condition(_values(spark, d), ["param", "condition"])


@query("random_effects", f"""{VAL}, w as (select *, 1 / se ** 2 w from va where se > 0), f as (select condition, count(*) n, sum(w) w1, sum(w * w) w2, sum(w * value) / sum(w) fx from w group by 1 having count(*) >= 2),
q as (select condition, n, w1, w2, sum(w * (value - fx) ** 2) q from w join f using (condition) group by all), t as (select *, greatest(0, (q - (n - 1)) / (w1 - w2 / w1)) tau2 from q)
;;
select condition, n as k, q, sqrt(tau2) tau, greatest(0, (q - (n - 1)) / q) i2, sum(value / (se ** 2 + tau2)) / sum(1 / (se ** 2 + tau2)) re_mean, 1 / sqrt(sum(1 / (se ** 2 + tau2))) re_se from w join t using (condition) group by condition, n, q, tau2""", "q tau i2 re_mean re_se", "condition k")
def _(spark, d):
    return study.random_effects(_values(spark, d), ["condition"]).drop("re_low", "re_high")


@query("param_uncertainty", f"with {P}\n;;\nselect event_id, coalesce((case when k % 2 = 0 then y + k end - case when k % 2 = 0 then y end) / (2 * 1.959964), unc) se from p", "se", "event_id")
def _(spark, d):
    p = points(spark, d).withColumns({"ci_low": F.when(F.col("k") % 2 == 0, F.col("y")), "ci_high": F.when(F.col("k") % 2 == 0, F.col("y") + F.col("k")), "stderr": F.col("unc")})
    return p.select("event_id", study.param_uncertainty().alias("se"))


PAIRS = "cp as (select x.c a, y.c b from (select distinct c_mktsegment c from customer) x join (select distinct c_mktsegment c from customer) y on x.c < y.c)"


def _conditions(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("condition"), F.col("c_mktsegment").alias("pos")).distinct()


@query("condition_pairs", f"with {PAIRS}\n;;\nselect * from cp")
def _(spark, d):
    return study.condition_pairs(_conditions(spark, d))


WELCH = f"""{VAL}, {PAIRS}, st as (select condition, count(*) n, avg(value) m, var_samp(value) v from va group by 1),
we as (select a, b, y.m - x.m diff, sqrt(x.v / x.n + y.v / y.n) se, (x.v / x.n + y.v / y.n) ** 2 / ((x.v / x.n) ** 2 / (x.n - 1) + (y.v / y.n) ** 2 / (y.n - 1)) df, (y.m - x.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)) * (1 - 3.0 / (4 * (x.n + y.n - 2) - 1)) hedges_g from cp join st x on x.condition = a join st y on y.condition = b)"""


@query("welch_compare", f"{WELCH}\n;;\nselect a, b, diff, se, df, diff / se t, hedges_g from we", "diff se df t hedges_g", "a b")
def _(spark, d):
    s = study.describe_condition(_values(spark, d), ["param", "condition"])
    return study.welch_compare(s, study.condition_pairs(_conditions(spark, d))).select("a", "b", "diff", "se", "df", "t", "hedges_g")


@query("holm_adjust", f"with {P}, t as (select series_id, event_id, case when k % 10 <> 3 then (k + event_id % 7) / 2000.0 end pv from p), r as (select *, row_number() over (partition by series_id order by pv, event_id) r, count(*) over (partition by series_id) m from t where pv is not null)\n;;\nselect event_id, max(least(1, (m - r + 1) * pv)) over (partition by series_id order by r) p_holm from r union all select event_id, null from t where pv is null", "p_holm", "event_id")
def _(spark, d):
    t = points(spark, d).select("series_id", "event_id", F.when(F.col("k") % 10 != 3, (F.col("k") + F.col("event_id") % 7) / 2000.0).alias("p"))
    return study.holm_adjust(t, ["series_id"], ["event_id"]).select("event_id", "p_holm")


@query("missing_quantity_warnings", f"with {P}, m as (select series_id, event_type, case when k % 3 = 0 then y end v from p)\n;;\nselect series_id, event_type condition, count(*) n, count(v) usable, case when count(v) < 2 then 'fewer than 2 usable' else 'missing in some replicates' end warning from m group by all having count(v) < count(*) or count(v) < 2")
def _(spark, d):
    m = points(spark, d).select("series_id", F.col("event_type").alias("condition"), F.when(F.col("k") % 3 == 0, F.col("y")).alias("value"))
    return study.missing_quantity_warnings(m, ["series_id", "condition"])


@query("settings_mismatch", "with r as (select p_brand b, p_type t, p_size z from part where p_partkey = (select min(p_partkey) from part where p_size % 13 <> 0)), s as (select p_partkey replicate, list_filter([case when p_brand <> b then 'brand' end, case when p_size <> z then 'size' end, case when p_type <> t then 'type' end], lambda x: x is not null) differs from part, r where p_size % 13 <> 0)\n;;\nselect replicate, differs, false as unknown from s where len(differs) > 0 union all select p_partkey, [], true from part where p_size % 13 = 0")
def _(spark, d):
    p = table(spark, d, "part")
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    return study.settings_mismatch(p.select(F.col("p_partkey").alias("replicate"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 13 != 0, m).alias("values")), ["brand", "size", "type"])


@query("model_selection", f"{SFIT}, ok as (select * from ft where aicc is not null), e as (select condition, replicate, model, aicc from ok union all select null, null, model, sum(aicc) from ok where (condition, replicate) in (select (condition, replicate) from ok group by condition, replicate having count(*) = 2) group by model)\n;;\nselect condition, replicate, model, aicc, exp(-(aicc - m) / 2) / sum(exp(-(aicc - m) / 2)) over (partition by condition, replicate) weight from (select *, min(aicc) over (partition by condition, replicate) m from e)", "aicc weight", "condition replicate model")
def _(spark, d):
    return study.model_selection(growth.fit_linear_closed(study_points(spark, d), BY), BY)


@query("replicate_table", f"{VAL}\n;;\nselect condition, replicate, value b_value, se b_se from va", "b_value b_se", "condition replicate")
def _(spark, d):
    return study.replicate_table(_values(spark, d), ["b", "c"]).select(*BY, "b_value", "b_se")


@query("data_long", f"with {S}\n;;\nselect condition, replicate, t, y * 1000000 y, not (t > 80) used from sp", "t y", "condition replicate used")
def _(spark, d):
    return study_points(spark, d).withColumn("excluded", F.col("t") > 80).select(*BY, "t", (F.col("y") * 1000000).alias("y"), (~F.col("excluded")).alias("used"))


@query("run_study")
def _(spark, d):
    return study.run_study(study_points(spark, d), ("linear", "sqrt"), "linear", "b", "BUILDING")["comparisons"]


@query("pilot_spread", f"{VAL}, st as (select condition, count(*) n, avg(value) m, stddev_samp(value) sd from va group by 1)\n;;\nselect x.condition, x.n, x.m mean, x.sd, r.n ref_n, r.m ref_mean, r.sd ref_sd from st x, st r where r.condition = 'BUILDING' and x.condition <> 'BUILDING'", "mean sd ref_mean ref_sd", "condition n ref_n")
def _(spark, d):
    return study.pilot_spread(study.describe_condition(_values(spark, d), ["param", "condition"]), "b", "BUILDING")


def _covariates(spark, d):
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    g = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("condition"), F.col("n_name").alias("replicate")).agg(F.avg("c_acctbal").alias("balance"), F.count(F.lit(1)).cast("double").alias("customers"))
    return g.unpivot(BY, ["balance", "customers"], "name", "x")


@query("meta_regression")
def _(spark, d):
    return covariates.meta_regression(_values(spark, d).join(_covariates(spark, d), BY), ["param", "name"])


@query("covariate_effects")
def _(spark, d):
    return covariates.covariate_effects(_values(spark, d), _covariates(spark, d))


# --- agreement, bounds, health ---------------------------------------------------------------------------------------

AG = "ag as (select l_suppkey, l_orderkey * 10 + l_linenumber id, l_extendedprice auto, l_quantity * p_retailprice hand from lineitem join part on l_partkey = p_partkey)"


def _agree(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("auto"), (F.col("l_quantity") * F.col("p_retailprice")).alias("hand"))


@query("agreement", f"with {AG}\n;;\nselect l_suppkey, count(*) n, avg(auto - hand) bias, stddev_samp(auto - hand) sd, avg(abs(auto - hand)) mae, sqrt(avg((auto - hand) ** 2)) rmse, corr(auto, hand) r, regr_slope(auto, hand) slope, avg(auto - hand) - 1.96 * stddev_samp(auto - hand) limit_low, avg(auto - hand) + 1.96 * stddev_samp(auto - hand) limit_high from ag group by 1 having count(*) >= 3", "bias sd mae rmse r slope limit_low limit_high", "l_suppkey n")
def _(spark, d):
    return checks.agreement(_agree(spark, d), ["l_suppkey"]).select("l_suppkey", "n", "bias", "sd", "mae", "rmse", "r", "slope", "limit_low", "limit_high")


@query("uncertainty_honesty", f"with {AG}, z as (select l_suppkey, (auto - hand) / sqrt((auto * 0.3) ** 2 + (hand * 0.4) ** 2) z from ag)\n;;\nselect l_suppkey, avg(case when abs(z) <= 2 then 1.0 else 0.0 end) within_2u, sqrt(avg(z * z)) rms_z from z group by 1", "within_2u rms_z", "l_suppkey")
def _(spark, d):
    return checks.uncertainty_honesty(_agree(spark, d).withColumns({"auto_unc": F.col("auto") * 0.3, "hand_unc": F.col("hand") * 0.4}), ["l_suppkey"])


EB = """v as (select p_brand "case", p_type "check", p_name metric, avg(p_retailprice) as value from part where p_size > 10 group by all), b as (select p_brand "case", p_type "check", p_name metric, 1000.0 mn, case when p_name < 'm' then 2000.0 end mx, 5.0 dr from part where p_size between 5 and 30 group by all), bl as (select p_brand "case", p_type "check", p_name metric, avg(p_retailprice) as value from part where p_size > 12 group by all),
eb as (select coalesce(v."case", b."case") cs, coalesce(v."check", b."check") ck, coalesce(v.metric, b.metric) metric, v.value, mn is null nob, coalesce(v.value is null or v.value < mn or coalesce(v.value > mx, false) or bl.value is null or abs(v.value - bl.value) > dr, true) bad from v full join b using ("case", "check", metric) left join bl using ("case", "check", metric)),
st as (select cs, ck, metric, value, case when nob then 'info' when bad then 'fail' else 'pass' end status from eb)"""


def _runs(spark, d):
    """Values of a run, bounds, and values of an earlier run."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("case"), F.col("p_type").alias("check"), F.col("p_name").alias("metric"), "p_size", "p_retailprice")
    k = ["case", "check", "metric"]
    mean = lambda x: x.groupBy(*k).agg(F.avg("p_retailprice").alias("value"))
    b = p.where("p_size between 5 and 30").select(*k).distinct().withColumns({"min": F.lit(1000.0), "max": F.when(F.col("metric") < "m", 2000.0), "abs_max": F.lit(None).cast("double"), "max_drift": F.lit(5.0)})
    return mean(p.where("p_size > 10")), b, mean(p.where("p_size > 12"))


def _bounds(spark, d):
    return checks.evaluate_bounds(*_runs(spark, d))


@query("evaluate_bounds", f"with {EB}\n;;\nselect cs, ck, metric, value as v, status from st", "v", "cs ck metric status")
def _(spark, d):
    return _bounds(spark, d).select(F.col("case").alias("cs"), F.col("check").alias("ck"), "metric", F.col("value").alias("v"), "status")


@query("save_baseline", f"with {EB}\n;;\nselect cs, ck, metric, value as v, status from st", "v", "cs ck metric status")
def _(spark, d):
    """The earlier run's values are saved, and the present run is held against what was saved."""
    path = f"{shared_dir(spark)}/verdance-baseline-{uuid.uuid4().hex}"
    values, bounds, before = _runs(spark, d)
    checks.save_baseline(before, path)
    held = checks.evaluate_bounds(values, bounds, spark.read.parquet(path).drop("saved"))
    return held.select(F.col("case").alias("cs"), F.col("check").alias("ck"), "metric", F.col("value").alias("v"), "status")


@query("suite_rollup", f"with {EB}, e as (select cs, ck, count(*) filter (status = 'fail') failing, count(*) filter (status = 'fail') = 0 and ck <> 'ECONOMY' passed from st group by cs, ck)\n;;\nselect cs, ck, failing::bigint failing, passed from e union all select null, null, sum(failing)::bigint, bool_and(passed) from e")
def _(spark, d):
    r = _bounds(spark, d)
    return checks.suite_rollup(r, r.where(F.col("check") == "ECONOMY")).select(F.col("case").alias("cs"), F.col("check").alias("ck"), F.col("failing").cast("long").alias("failing"), "passed")


NOW = "2024-01-30 23:00:00"
HC = f"""with {FR}, b as (select experiment, 600.0 iv, max(ts) - to_seconds((min(k) + 1) * 900 * (1 + substr(experiment, 2)::int)) up, substr(experiment, 2)::int i from fr group by 1),
f as (select fr.experiment, max(s) filter (status = 'ok') lst, count(*) filter (status = 'failed' and s >= epoch(timestamp '{NOW}') - 12000 and s <= epoch(timestamp '{NOW}')) failed, arg_min(mean_brightness, s) filter (status = 'ok') b0, arg_max(mean_brightness, s) filter (status = 'ok') b1, arg_min(k, s) filter (status = 'ok') s0, arg_max(k, s) filter (status = 'ok') s1 from fr group by 1),
j as (select *, epoch(timestamp '{NOW}') n from b join f using (experiment)),
hc as (select experiment, 'capture' ck, case when i = 4 then 'ok' when n - epoch(up) > 3000 then 'problem' when n - epoch(up) > 1200 then 'warning' else 'ok' end lv from j union all select experiment, 'frames', case when i = 4 then 'ok' when n - lst > 3000 then 'problem' when n - lst > 1200 then 'warning' else 'ok' end from j
 union all select experiment, 'failures', case when failed >= 3 then 'problem' when failed >= 1 then 'warning' else 'ok' end from j union all select experiment, 'skipped', case when i % 2 = 1 then 'warning' else 'ok' end from j
 union all select experiment, 'image', case when b1 < 15 or abs(b1 - b0) > 0.4 * b0 or s1 < 0.4 * s0 then 'warning' else 'ok' end from j union all select experiment, 'disk', case when 400 + i * 200 < 500 then 'problem' when 400 + i * 200 - 500 < 50 * 5 then 'warning' else 'ok' end from j)"""


def _health(spark, d):
    f = frames(spark, d).withColumn("sharpness", F.col("k").cast("double"))
    i = F.substring("experiment", 2, 9).cast("int")
    b = f.groupBy("experiment").agg(F.max("ts").alias("t"), F.min("k").alias("k")).select("experiment", F.lit(600.0).alias("config_interval_s"), F.lit(None).cast("double").alias("interval_s"), F.timestamp_micros(F.unix_micros("t") - (F.col("k").cast("long") + 1) * 900_000_000 * (1 + i)).alias("updated"), F.when(i == 4, "finished").otherwise("running").alias("state"), (i % 2).alias("skipped_slots"), (400.0 + i * 200).alias("free_disk_mb"), F.lit(5.0).alias("frame_mb"))
    return checks.health_checks(b, f, NOW)


@query("health_checks", f"{HC}\n;;\nselect experiment, ck, lv from hc", "", "experiment ck lv")
def _(spark, d):
    return _health(spark, d).select("experiment", F.col("check").alias("ck"), F.col("level").alias("lv"))


@query("overall_health", f"{HC}\n;;\nselect experiment, arg_max(lv, case lv when 'ok' then 1 when 'warning' then 2 else 3 end) lv from hc group by 1", "", "experiment lv")
def _(spark, d):
    return checks.overall_health(_health(spark, d)).select("experiment", F.col("level").alias("lv"))


@query("alert_transitions", f"with {P}, l as (select series_id, event_id, ts, case when k < 60 then 'ok' when k < 90 then 'warning' else 'problem' end lv from p), b as (select *, lag(lv) over (partition by series_id order by ts) bf from l)\n;;\nselect event_id, case when lv <> 'ok' then 'problem' else 'recovered' end event from b where lv is distinct from bf and (lv <> 'ok' or bf is not null)")
def _(spark, d):
    p = points(spark, d)
    level = F.when(F.col("k") < 60, "ok").when(F.col("k") < 90, "warning").otherwise("problem")
    return checks.alert_transitions(p.withColumn("level", level), ["series_id"]).select("event_id", "event")
