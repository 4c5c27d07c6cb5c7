"""Irregular sensor logs: values at given times, time-weighted summaries, and their effect on fitted parameters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tdist import t_cdf, t_quantile


def _sec(c: str):
    return F.col(c).cast("timestamp").cast("double")


def covariate_max_gap(readings: DataFrame, by: Sequence[str] = ("name",), factor: float = 3.0) -> DataFrame:
    """by and max_gap: factor x the median step between the readings (null values left out); null with under two."""
    r = readings.where("value is not null").select(*by, _sec("ts").alias("s"))
    gaps = r.withColumn("gap", F.col("s") - F.lag("s").over(Window.partitionBy(*by).orderBy("s")))
    return gaps.groupBy(*by).agg((factor * F.percentile("gap", 0.5)).alias("max_gap"))


def covariate_at(times: DataFrame, readings: DataFrame, by: Sequence[str] = ("name",), bucket: float = 86400.0) -> DataFrame:
    """times(by, ts, ...) with value: linear between the readings before and after; null outside the log and inside a
    gap of more than max_gap, but for times that are a reading's own. Neighbours are looked for in time buckets, so that a
    long log is not one task; what lies beyond a bucket comes from one row a bucket."""
    r = readings.where("value is not null").groupBy(*by, _sec("ts").alias("s")).agg(F.avg("value").alias("v"))
    both = times.select(*by, _sec("ts").alias("s"), F.lit(None).cast("double").alias("v")).distinct().unionByName(r)
    both = both.withColumn("bk", F.floor(F.col("s") / bucket))
    known = F.when(F.col("v").isNotNull(), F.struct("s", "v"))
    edges = both.groupBy(*by, "bk").agg(F.min(known).alias("first"), F.max(known).alias("last"))
    near = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(*by, "bk", near("last", F.asc("bk")).alias("before"), near("first", F.desc("bk")).alias("after"))
    here = lambda order: F.last(known, ignorenulls=True).over(Window.partitionBy(*by, "bk").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    at = both.join(edges, [*by, "bk"]).withColumn("lo", F.coalesce(here(F.asc("s")), "before")).withColumn("hi", F.coalesce(here(F.desc("s")), "after"))
    at = at.where("v is null").join(covariate_max_gap(readings, by), list(by), "left")
    gap = F.col("hi.s") - F.col("lo.s")
    value = F.when(F.col("lo.s") == F.col("s"), F.col("lo.v")).when(F.col("hi.s") == F.col("s"), F.col("hi.v")).when(gap <= F.col("max_gap"), F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * (F.col("s") - F.col("lo.s")) / gap)
    return times.withColumn("__s", _sec("ts")).join(at.select(*by, F.col("s").alias("__s"), value.alias("value")), [*by, "__s"], "left").drop("__s")


def covariate_summary(windows: DataFrame, readings: DataFrame, by: Sequence[str] = ("name",), bucket: float = 86400.0) -> DataFrame:
    """windows(by, window, start, end) with the time-weighted mean (trapezoids over the covered stretches), min, max, and
    the share of the window that is covered. Readings meet windows in time buckets, so a long log is not paired with
    every window."""
    ends = windows.select(*by, "window", F.explode(F.array("start", "end")).alias("ts"))
    inner = windows.select(*by, "window", _sec("start").alias("a"), _sec("end").alias("b"))
    inner = inner.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor(F.col("b") / bucket))))
    r = readings.where("value is not null").groupBy(*by, _sec("ts").alias("s")).agg(F.avg("value").alias("v")).withColumn("bucket", F.floor(F.col("s") / bucket))
    inside = inner.join(r, [*by, "bucket"]).where("s between a and b").select(*by, "window", "s", "v")
    edge = covariate_at(ends, readings, by).where("value is not null").select(*by, "window", _sec("ts").alias("s"), F.col("value").alias("v"))
    pts = inside.unionByName(edge).groupBy(*by, "window", "s").agg(F.avg("v").alias("v"))
    w = Window.partitionBy(*by, "window").orderBy("s")
    pts = pts.withColumn("s2", F.lead("s").over(w)).withColumn("v2", F.lead("v").over(w)).join(covariate_max_gap(readings, by), list(by), "left")
    width = F.when(F.col("s2") - F.col("s") <= F.col("max_gap"), F.col("s2") - F.col("s"))
    out = pts.groupBy(*by, "window").agg(F.sum(width).alias("covered"), (F.sum(width * (F.col("v") + F.col("v2")) / 2) / F.sum(width)).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    span = F.nullif(_sec("end") - _sec("start"), F.lit(0.0))
    return windows.join(out, [*by, "window"], "left").withColumn("coverage", F.coalesce(F.col("covered") / span, F.lit(0.0))).drop("covered")


def covariate_inventory(readings: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    r = readings.where("value is not null").select(*by, "value", _sec("ts").alias("s"))
    gaps = r.withColumn("gap", F.col("s") - F.lag("s").over(Window.partitionBy(*by).orderBy("s")))
    return gaps.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.percentile("gap", 0.5).alias("interval_s"))


def covariate_over_fit(points: DataFrame, readings: DataFrame, series: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Summary of each named covariate over each series' usable time, with a warning under 0.8 coverage or without
    readings. readings(series..., name, ts, value)."""
    span = points.where(~F.col("excluded")).groupBy(*series).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    windows = span.withColumn("name", F.explode(F.array(*map(F.lit, names)))).withColumn("window", F.lit(0))
    out = covariate_summary(windows, readings, [*series, "name"]).drop("window")
    return out.withColumn("warning", F.when(F.col("mean").isNull(), "no readings").when(F.col("coverage") < 0.8, "low coverage"))


def meta_regression(rows: DataFrame, by: Sequence[str], adjust: bool = False) -> DataFrame:
    """Random-effects slope of value on x in each group (a handful of replicates): rows(by, condition, x, value, se).
    Method-of-moments between-replicate variance, Knapp-Hartung scale (1 at least), t with k - p degrees of freedom;
    ordinary least squares if a standard error is missing or not above 0. Nothing for too few rows, equal x or
    dependent columns."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {c: pdf[c].iloc[0] for c in by}
        pdf = pdf[np.isfinite(pdf["x"]) & np.isfinite(pdf["value"])].sort_values(["condition", "x", "value"])
        k = len(pdf)
        cols = [np.ones(k), pdf["x"].to_numpy(float)]
        if adjust:
            cols += [(pdf["condition"] == c).to_numpy(float) for c in sorted(pdf["condition"].unique())[1:]]
        x, y = np.column_stack(cols), pdf["value"].to_numpy(float)
        p = x.shape[1]
        out = head | {"k": k, "slope": np.nan, "se": np.nan, "tau2": np.nan, "low": np.nan, "high": np.nan, "p": np.nan}
        if k - p >= 1 and np.ptp(cols[1]) > 0 and np.linalg.matrix_rank(x) == p:
            se = pdf["se"].to_numpy(float)
            tau2 = 0.0
            w = np.ones(k)
            weighted = bool(np.all(np.isfinite(se) & (se > 0)))
            if weighted:
                w = 1 / se**2
                inv = np.linalg.inv(x.T @ (w[:, None] * x))
                r = y - x @ (inv @ x.T @ (w * y))
                trace = w.sum() - np.trace(inv @ (x.T @ (w[:, None] ** 2 * x)))
                tau2 = max(0.0, (float(w @ r**2) - (k - p)) / trace)
                w = 1 / (se**2 + tau2)
            inv = np.linalg.inv(x.T @ (w[:, None] * x))
            b = inv @ x.T @ (w * y)
            scale = float(w @ (y - x @ b) ** 2) / (k - p)
            s = float(np.sqrt(inv[1, 1] * (max(1.0, scale) if weighted else scale)))
            half = t_quantile(0.975, k - p) * s
            out |= {"slope": b[1], "se": s, "tau2": tau2, "low": b[1] - half, "high": b[1] + half, "p": 2 * (1 - t_cdf(abs(b[1]) / s, k - p)) if s > 0 else np.nan}
        return pd.DataFrame([out]).astype({"k": "int64"})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema) + ", k long, slope double, se double, tau2 double, low double, high double, p double"
    got = rows.groupBy(*by).applyInPandas(solve, schema)
    return got.select(*by, "k", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("slope", "se", "tau2", "low", "high", "p")))


def covariate_effects(params: DataFrame, covariates: DataFrame) -> DataFrame:
    """Slope of every parameter on every covariate, plain and with a level for each condition.
    params(condition, replicate, param, value, se), covariates(condition, replicate, name, x)."""
    rows = params.join(covariates, ["condition", "replicate"])
    by = ["param", "name"]
    return meta_regression(rows, by).withColumn("adjusted", F.lit(False)).unionByName(meta_regression(rows, by, True).withColumn("adjusted", F.lit(True)))
