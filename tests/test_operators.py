"""Small cases worked out by hand."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdance.functions.tdist import t_cdf, t_quantile
from verdance.operators import checks, covariates, frames, growth, masks, pixels, series, study
from verdance.sources import tables


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


def test_covariate_at(spark):
    r = spark.createDataFrame([("a", at(t), float(v)) for t, v in zip([0, 60, 120, 180, 1000, 1060], [10, 11, 12, 13, 20, 21], strict=True)], "name string, ts timestamp, value double")
    q = spark.createDataFrame([("a", at(t), t) for t in (30, 150, 500, -10, 2000, 1000)], "name string, ts timestamp, k int")
    got = dict(rows(covariates.covariate_at(q, r), "k", "value"))
    assert got == {30: 10.5, 150: 12.5, 500: None, -10: None, 2000: None, 1000: 20.0}


def test_covariate_summary(spark):
    r = spark.createDataFrame([("a", at(t), float(v)) for t, v in zip([0, 3599, 3600, 5400, 7200, 10800], [10, 10, 30, 30, 30, 30], strict=True)], "name string, ts timestamp, value double")
    w = spark.createDataFrame([("a", 0, at(0), at(10800)), ("a", 1, at(-10800), at(10800))], "name string, window int, start timestamp, end timestamp")
    got = {x["window"]: x for x in covariates.covariate_summary(w, r).collect()}
    assert got[0]["mean"] == pytest.approx((10 * 3600 + 30 * 7200) / 10800, rel=0.01)
    assert (got[0]["min"], got[0]["max"], got[0]["coverage"], got[1]["coverage"]) == (10, 30, 1, 0.5)


def test_merge_covariates(spark):
    s = "name string, ts timestamp, value double"
    old = spark.createDataFrame([("temp", at(0), 1.0), ("temp", at(60), 2.0)], s)
    new = spark.createDataFrame([("temp", at(60), None), ("lux", at(60), 5.0), ("temp", at(0), 9.0)], s)
    assert set(rows(tables.merge_covariates(old, new), "name", "value")) == {("temp", 9.0), ("temp", 2.0), ("lux", 5.0)}


def test_read_logger(spark, tmp_path):
    (tmp_path / "a.csv").write_text("My logger\nDate;Time;Temp\n" + "".join(f"{d}.06.2026;14:00;21,5\n" for d in range(10, 20)))
    got = rows(tables.read_logger(spark, str(tmp_path), "Europe/Berlin").orderBy("ts"), "ts", "name", "value")
    assert got[3] == (dt.datetime(2026, 6, 13, 12), "temp", 21.5) and len(got) == 10


def test_choose_time_format_refuses(spark):
    s = spark.createDataFrame([("f", "01/02/2024 10:00")], "file string, sample string")
    with pytest.raises(Exception, match="day or month first"):
        tables.choose_time_format(s, ["file"]).collect()
    assert rows(tables.choose_time_format(s, ["file"], True), "format") == [("MM/dd/yyyy HH:mm",)]


def test_safe_name(spark):
    df = spark.createDataFrame([("Temperature (°C)",), ("RH %",), ("",)], "t string")
    assert [x[0] for x in rows(df.select(tables.safe_name(F.col("t")).alias("n")), "n")] == ["temperature_c", "rh_pct", "value"]


def test_durations(spark):
    df = spark.createDataFrame([(x,) for x in ("90", "30s", "1h30m", "2 days", "", "5 parsecs", "0s", "3m4")], "t string")
    assert [x[0] for x in rows(df.select(frames.parse_duration(F.col("t")).alias("s")), "s")] == [90, 30, 5400, 172800, None, None, None, None]


def test_pick_evenly(spark):
    df = spark.range(10).withColumn("g", F.lit(0))
    pick = lambda n, k: sorted(x[0] for x in rows(frames.pick_evenly(df.where(F.col("id") < n), ["g"], ["id"], k), "id"))
    assert pick(10, 3) == [0, 4, 9] and pick(3, 10) == [0, 1, 2] and pick(5, 1) == [4]


def test_frame_key_match(spark):
    frames_ = spark.range(3000).select(F.col("id").alias("frame_id"), F.concat(F.lit("a/f"), "id", F.lit(".png")).alias("file"), F.concat(F.lit("2024-01-01 10:"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("id") / 60).cast("int").cast("string"), 2, "0")).alias("ts_text"))
    hand = spark.range(3000).select(F.col("id").alias("hand_id"), F.when(F.col("id") < 2990, "2024-01-01 10").when(F.col("id") == 2990, "f7").when(F.col("id") == 2991, "2024-01-01 10:05:03").otherwise(F.lit(None)).alias("key"))
    out = frames.frame_key_match(hand, frames_)
    got = {r.hand_id: r.frame_id for r in out.collect()}
    assert len(got) == 3000 and {i: v for i, v in got.items() if v is not None} == {2990: 7, 2991: 185}
    # one row a key goes into the join: a hot prefix makes no pairs
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("by_time")
    assert "count(1) AS n" in "".join(plan) and "Aggregate [hand_id" not in "".join(plan)


def test_pick_diverse_in_a_long_group(spark):
    # the 303 best rows stand within 101 positions, the next ones far away
    d = spark.createDataFrame([(1, p, 1000.0 - p - i / 10) for p in range(101) for i in range(3)] + [(1, 5000, 5.0), (1, 9000, 4.0), (1, 9001, 3.0)], "g int, pos int, score double")
    assert sorted((r.pick, r.pos) for r in masks.pick_diverse(d, ["g"], 3, 150).collect()) == [(1, 0), (2, 5000), (3, 9000)]
    assert sorted((r.pick, r.pos) for r in masks.pick_diverse(d.where("pos < 101"), ["g"], 3, 150).collect()) == [(1, 0), (2, 0), (3, 0)]


def test_hours_refused():
    with pytest.raises(ValueError, match="empty"):
        frames.parse_hours("9-9")
    assert frames.parse_hours("9:30-15") == (9.5, 15)


def test_jumps_and_retreats(spark):
    rng = np.random.default_rng(1)
    y = 10 * np.sqrt(np.arange(30) + 1) + rng.normal(0, 0.1, 30)
    data = [(k, float(t), float(v + (5 if k and t == 14 else 0)), 0.1, False) for k in (0, 1) for t, v in enumerate(y)]
    p = spark.createDataFrame(data, "s int, t double, y double, unc double, excluded boolean")
    got = series.detect_jumps(p, ["s"]).where("jump")
    assert rows(got, "s", "t") == [(1, 14.0)]
    r = spark.createDataFrame([(0, float(t), v, None, x) for t, (v, x) in enumerate([(1.0, False), (9.0, True), (3.0, False), (2.0, False), (None, False)])], "s int, t double, y double, unc double, excluded boolean")
    assert rows(series.mark_retreats(r, ["s"]).where("retreat"), "t") == [(3.0,)]


def test_daily_uncertainty(spark):
    p = spark.createDataFrame([(0, at(3600 * h), float(v), 0.5, False) for h, v in enumerate([1, 2, 3, 4])] + [(0, at(86400), 2.0, None, False), (0, at(90000), 4.0, None, False), (0, at(180000), 4.0, None, False)], "s int, ts timestamp, y double, unc double, excluded boolean")
    got = {r["day"].day: r["unc"] for r in series.daily_uncertainty(p, ["s"], how="mean").collect()}
    assert 0.5 < got[1] < 1.2 and got[2] == pytest.approx(1.0) and got[3] == 0


@pytest.mark.parametrize("how", ["median", "mean"])
def test_daily_uncertainty_draws_by_hash_in_blocks(spark, monkeypatch, how):
    """Draw d takes the values at xxhash64(seed, day, by, d, i) modulo n; blocks of any size give the same."""
    n = {"a": 3, "b": 7, "c": 40, "d": 3, "e": 2}
    data = [(s, at(60 * i), float((i * 37 + ord(s)) % 101) / 7 if i else None, False) for s in n for i in range(n[s] + 1)]
    p = spark.createDataFrame(data, "s string, ts timestamp, y double, excluded boolean").withColumn("unc", F.lit(None).cast("double"))
    places = spark.createDataFrame([(s, d, i) for s in n for d in range(30) for i in range(n[s])], "s string, d int, i int")
    day = F.to_date(F.lit(str(at(0))[:10]))
    hashed = {(r.s, r.d, r.i): r.h for r in places.select("s", "d", "i", F.xxhash64(F.lit(5), day, "s", "d", "i").alias("h")).collect()}
    want = {}
    for s in n:
        ys = sorted(r[2] for r in data if r[0] == s and r[2] is not None)
        boot = [getattr(np, how)([ys[hashed[s, d, i] % n[s]] for i in range(n[s])]) for d in range(30)]
        want[s] = np.std(boot, ddof=1) if n[s] > 2 else np.std(ys, ddof=1) / 2**0.5
    run = lambda: {r.s: r.unc for r in series.daily_uncertainty(p, ["s"], how=how, draws=30, seed=5).collect()}
    first = run()
    assert first == pytest.approx(want)
    ys, base = pa.array([[1.0, 2.0, 4.0], None, [0.5] * 3, [1.0, 3.0, 3.5, 9.0], [2.0, 2.5, 8.0]]), pa.array([7, 8, -9, 2**62, 3])
    whole = series._resampled(ys, base, 30, how).to_pylist()
    monkeypatch.setattr(series, "DRAWN", 16)
    assert series._resampled(ys, base, 30, how).to_pylist() == whole and whole[1] is None and whole[2] == 0


def test_combine_views(spark):
    v = [25.0, 50.0, 75.0, 100.0]
    data = [("p", "a", at(600 * i), x) for i, x in enumerate(v)] + [("p", "b", at(600 * i + 5), 0.8 * x) for i, x in enumerate(v)]
    df = spark.createDataFrame(data, "plot string, camera string, ts timestamp, y double")
    got = sorted(rows(series.combine_views(df, ["plot"], "a"), "y", "n_views", "best", "spread"))
    assert [x[:3] for x in got] == [(x, 2, "a") for x in v] and got[3][3] == pytest.approx(20)
    assert {x[0] for x in rows(series.combine_views(df, ["plot"], "a", tolerance=1.0), "n_views")} == {1}


def test_arrivals(spark):
    m = [(0, f, x, 0) for x, on in enumerate(([1, 2, 3, 4], [2], [3, 4], [])) for f in on]
    mask = spark.createDataFrame(m, "g int, frame int, x int, y int")
    fr = spark.createDataFrame([(0, f, float(f)) for f in range(5)], "g int, frame int, t double")
    assert dict(rows(pixels.arrival_times(mask, fr, ["g"], 2), "x", "arrival")) == {0: 1.0, 2: 3.0}
    assert dict(rows(pixels.arrival_times(mask, fr, ["g"], 1), "x", "arrival")) == {0: 1.0, 1: 2.0, 2: 3.0}


def test_sector_speeds(spark):
    xs, ys = np.meshgrid(np.arange(60, 141), np.arange(60, 141))
    data = []
    for x, y in zip(xs.ravel(), ys.ravel(), strict=True):
        for i in range(10):
            if ((x - 100) / (5 + 3 * i)) ** 2 + ((y - 100) / (4 + i)) ** 2 <= 1:
                data.append((0, int(x), int(y), float(i)))
                break
    got = {r["sector"]: r for r in pixels.sector_speeds(spark.createDataFrame(data, "g int, x int, y int, arrival double"), ["g"], 0.5).collect()}
    assert got[0]["speed"] == pytest.approx(1.5, rel=0.1) and got[2]["speed"] == pytest.approx(0.5, rel=0.15)


def test_sector_speeds_on_lines_between_sectors(spark):
    """Origins between pixels, so that others lie on the diagonals but for the last digits: the sides are the SQL's."""
    import duckdb
    import pandas as pd

    from verdance.plans import images

    rng = np.random.default_rng(5)
    ar = pd.concat([pd.DataFrame({"grp": g, "x": np.arange(64) % 8, "y": np.arange(64) // 8, "arrival": rng.permutation(np.minimum(np.arange(64) // rng.integers(3, 16), 6)).astype(float)}) for g in range(400)])
    duck = duckdb.connect()
    duck.register("ar", ar)
    want = {r[:2]: r[2:] for r in duck.sql(f"with {images.SEC.removeprefix(images.ARR + ', ')} select grp, sector, n, speed, se from ss").fetchall()}
    got = {(r.grp, r.sector): (r.n, r.speed, r.se) for r in pixels.sector_speeds(spark.createDataFrame(ar), ["grp"], 1.0, 4, 45.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_colours(spark):
    px = spark.createDataFrame([(0, 0, 0, 0, 200, 0), (1, 0, 0, 20, 10, 255)], "frame int, x int, y int, b int, g int, r int")
    got = {r["frame"]: r for r in pixels.color_indices(px).collect()}
    assert got[0]["gcc"] == 1 and got[0]["exg"] == 2
    h, s, v = pixels.bgr_to_hsv()
    assert rows(px.select("frame", h.alias("h"), s.alias("s"), v.alias("v")), "h", "s", "v")[0] == (60, 255, 200)
    assert pixels.shift_ranges([((0, 10, 10), (18, 255, 30))], -1) == [((0, 30, 20), (14, 255, 20))]


def test_masks(spark):
    sq = lambda dx: [(0, x + dx, y) for x in range(40) for y in range(40)]
    a, b = (spark.createDataFrame(sq(d), "frame int, x int, y int") for d in (10, 20))
    f = spark.createDataFrame([(0,), (1,)], "frame int")
    got = {r["frame"]: r["iou"] for r in masks.compare_runs(a, b, f, f).collect()}
    assert got == {0: 0.6, 1: 1.0}
    shift = spark.createDataFrame(sq(11), "frame int, x int, y int")
    f1 = lambda m, r: dict(rows(masks.boundary_f1(a, m, f, ["frame"], r), "frame", "boundary_f1"))
    assert f1(shift, 2)[0] > 0.9 > f1(b, 2)[0] and f1(shift, 2)[1] == 1


def test_cleanup_and_blobs(spark):
    m = [(0, x, y) for x in range(2, 7) for y in range(2, 7)] + [(0, 12, 12), (0, 9, 2), (0, 9, 3)]
    mask = spark.createDataFrame(m, "frame int, x int, y int")
    assert sorted(rows(pixels.mask_cleanup(mask, 20, 20, 1, 4), "x", "y")) == sorted((x, y) for _, x, y in m[:25] if (x, y) not in ((2, 2), (2, 6), (6, 2), (6, 6)))
    assert pixels.label_blobs(mask).select("blob").distinct().count() == 3


def test_runs(spark):
    m = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 1, 1)], "frame int, x int, y int")
    counts = masks.rle_counts(masks.rle_runs(m, 2, ["frame"]), 4, ["frame"])
    assert rows(counts, "counts") == [([1, 3],)]
    assert sorted(rows(masks.rle_to_pixels(counts, 2, ["frame"]), "x", "y")) == [(0, 1), (1, 0), (1, 1)]


def test_split(spark):
    items = spark.createDataFrame([(i, g, i) for i, g in enumerate("a" * 10 + "b" * 3 + "c" * 4)], "id int, grp string, ts int")
    assert {x[0] for x in rows(masks.split_items(items, 0.2).where("validation"), "grp")} == {"b"}
    one = masks.split_items(items.where("grp = 'a'"), 0.3).where("validation")
    assert sorted(x[0] for x in rows(one, "id")) == [7, 8, 9]


def test_extent(spark):
    m = spark.createDataFrame([(0, x, y) for x in range(40, 60) for y in range(70, 100)] + [(0, x, y) for x in range(45, 47) for y in range(50, 70)], "frame int, x int, y int")
    got = pixels.extent_along_axis(m, (50.0, 99.5), (50.0, 0.5)).first()
    assert got["extent_px"] == 30 and got["extent_max_px"] == 50 and got["width_px"] == 20
    path = pixels.extent_along_path(m, [(50.0, 99.5), (50.0, 0.5)]).first()
    assert path["extent_px"] == pytest.approx(30, abs=0.3)


def test_bounds(spark):
    k = "case string, check string, metric string, "
    v = spark.createDataFrame([("c", "k", m, x) for m, x in (("a", 0.9), ("b", -0.7), ("c", 0.5), ("d", 0.5), ("e", None))], k + "value double")
    b = spark.createDataFrame([("c", "k", "a", 0.8, 1.0, None, None), ("c", "k", "b", None, None, 0.5, None), ("c", "k", "c", None, None, None, 0.01), ("c", "k", "d", None, None, None, 0.01), ("c", "k", "e", 0.0, None, None, None), ("c", "k", "f", 0.0, None, None, None)], k + "min double, max double, abs_max double, max_drift double")
    base = spark.createDataFrame([("c", "k", "c", 0.52)], k + "value double")
    res = checks.evaluate_bounds(v, b, base)
    assert dict(rows(res, "metric", "status")) == {"a": "pass", "b": "fail", "c": "fail", "d": "fail", "e": "fail", "f": "fail"}
    roll = checks.suite_rollup(res, v.limit(0))
    assert {(r["case"], r["passed"]) for r in roll.collect()} == {("c", False), (None, False)}


def test_t_distribution():
    assert t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert t_quantile(0.975, 4.5) == pytest.approx(2.66, abs=0.01)
    assert 2 * (1 - t_cdf(2.228139, 10)) == pytest.approx(0.05, abs=1e-6)


def test_fits_recover(spark):
    rng = np.random.default_rng(3)
    t = np.linspace(0, 20, 60)
    data = [("log", float(a), float(80 / (1 + math.exp(-0.6 * (a - 9))) + rng.normal()), None) for a in t] + [("pow", float(a), float(12 * math.sqrt(a) + rng.normal(0, 0.1)), None) for a in t]
    p = spark.createDataFrame(data, "s string, t double, y double, unc double")
    fits = growth.akaike_weights(growth.fit_growth(p, ["s"], ("linear", "sqrt", "power", "logistic"), "iid").where("ok"), ["s"]).collect()
    best = {r["s"]: r for r in fits if r["best"]}
    assert best["log"]["model"] == "logistic" and best["log"]["params"]["t_mid"] == pytest.approx(9, abs=0.2)
    assert sum(r["weight"] for r in fits if r["s"] == "log") == pytest.approx(1)
    power = next(r for r in fits if r["s"] == "pow" and r["model"] == "power")
    assert power["params"]["n"] == pytest.approx(0.5, abs=0.02)


def test_derived(spark):
    f = spark.createDataFrame([("a", "logistic", {"K": 80.0, "r": 0.6, "t_mid": 9.0}, 0.0, 20.0), ("b", "linear", {"a": 1.0, "b": 2.0}, 0.0, 10.0), ("c", "sqrt", {"k": 12.0}, 0.0, 20.0)], "s string, model string, params map<string,double>, t_first double, t_last double")
    got = {r["s"]: r for r in growth.derived_quantities(f, ["s"], [5.0, 40.0, 500.0]).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert a["max_rate"] == pytest.approx(12, rel=0.01) and a["t_max_rate"] == pytest.approx(9, abs=0.1) and a["lag"] == pytest.approx(9 - 2 / 0.6, abs=0.2)
    assert a["time_to_40"] == pytest.approx(9, abs=0.01) and a["time_to_500"] is None
    assert b["max_rate"] == pytest.approx(2) and b["lag"] is None and b["time_to_5"] == pytest.approx(2)
    assert c["max_rate"] is None and c["lag"] is None and c["time_to_40"] is not None


def test_ar1_and_bootstrap(spark):
    rng = np.random.default_rng(5)
    e = np.zeros(80)
    for i in range(1, 80):
        e[i] = 0.8 * e[i - 1] + rng.normal()
    p = spark.createDataFrame([("s", float(i), float(2 + 0.5 * i + e[i]), None) for i in range(80)], "s string, t double, y double, unc double")
    fit = growth.fit_growth(p, ["s"], ("linear",), "auto")
    r = fit.first()
    assert r["error_model"] == "ar1" and 0.5 < r["ar1_phi"] < 0.95
    drawn = growth.bootstrap_draws(p, fit, ["s"], 40, 20)
    ci = {x["param"]: x for x in growth.bootstrap_fit(drawn, ["s"], 40).collect()}
    assert ci["b"]["low"] < 0.5 < ci["b"]["high"]
    assert growth.confidence_band(drawn, fit, ["s"], 5).where("low <= high").count() == 5


def test_welch_holm(spark):
    v = spark.createDataFrame([("k", "c", float(x)) for x in (1, 2, 3, 4)] + [("k", "t", float(x)) for x in (3, 5, 6, 9)], "param string, condition string, value double")
    s = study.describe_condition(v, ["param", "condition"])
    w = study.welch_compare(s, spark.createDataFrame([("c", "t")], "a string, b string")).first()
    assert w["diff"] == 3.25 and w["t"] == pytest.approx(3.25 / math.sqrt((5 / 3 + 6.25) / 4)) and 0.05 < w["p"] < 0.1 and w["ci_low"] < 0 < w["ci_high"]
    t = spark.createDataFrame([("x", i, p) for i, p in enumerate((0.01, 0.04, 0.03, None))], "param string, i int, p double")
    assert dict(rows(study.holm_adjust(t, ["param"], ["i"]), "i", "p_holm")) == {0: pytest.approx(0.03), 2: pytest.approx(0.06), 1: pytest.approx(0.06), 3: None}


def test_run_study(spark):
    rng = np.random.default_rng(9)
    data = [(c, f"r{i}", float(t), float((71 + i) / (1 + math.exp(-(r0 + 0.01 * i) * (t - 24))) + rng.normal()), None, False) for c, r0 in (("control", 0.2), ("treated", 0.4)) for i in range(3) for t in range(48)]
    p = spark.createDataFrame(data, "condition string, replicate string, t double, y double, unc double, excluded boolean")
    out = study.run_study(p, ("linear", "logistic"), "logistic", "r", "control")
    d = out["comparisons"].first()
    assert d["diff"] == pytest.approx(0.2, abs=0.03) and d["p_holm"] < 0.05


def test_meta_regression_covers(spark):
    rng = np.random.default_rng(2)
    data = [(str(k), "c", float(x), 1 + 0.05 * x + rng.normal(0, 0.08) + rng.normal(0, 0.05), 0.05) for k in range(100) for x in range(6)]
    got = covariates.meta_regression(spark.createDataFrame(data, "s string, condition string, x double, value double, se double"), ["s"]).collect()
    assert 0.85 <= np.mean([r["low"] <= 0.05 <= r["high"] for r in got]) <= 1


def test_health(spark):
    now = at(10_000)
    b = spark.createDataFrame([("a", 30.0, None, at(9_990), "running", 3, 900.0, 1.0), ("b", 30.0, None, at(0), "running", 0, 100.0, 1.0)], "experiment string, config_interval_s double, interval_s double, updated timestamp, state string, skipped_slots int, free_disk_mb double, frame_mb double")
    f = spark.createDataFrame([(e, at(9_880 + 30 * i), "ok", 5.0 if i == 3 and e == "a" else 200.0, 500.0) for e in "ab" for i in range(4)], "experiment string, ts timestamp, status string, mean_brightness double, sharpness double")
    got = {(r["experiment"], r["check"]): r["level"] for r in checks.health_checks(b, f, str(now)).collect()}
    assert got["a", "image"] == "warning" and got["a", "skipped"] == "warning" and got["b", "capture"] == "problem" and got["b", "disk"] == "problem" and got["a", "capture"] == "ok"


def test_input_profile(spark):
    rng = np.random.default_rng(0)
    f = spark.createDataFrame([(i, *map(float, rng.normal(0, 1, 2))) for i in range(200)], "i int, a double, b double")
    prof = masks.input_profile(f, ["a", "b"])
    far = spark.createDataFrame([(0, 0.0, 0.0), (1, 30.0, 0.0)], "i int, a double, b double")
    assert dict(rows(masks.input_distance(far, ["a", "b"], prof), "i", "flag")) == {0: None, 1: "unfamiliar_input"}


def test_nulls_and_empty(spark):
    p = spark.createDataFrame([], "s int, t double, y double, unc double, excluded boolean")
    assert series.detect_jumps(p, ["s"]).count() == 0 and growth.fit_linear_closed(p, ["s"]).count() == 0
    f = spark.createDataFrame([(1, None), (2, ["blurry"]), (3, [])], "i int, flags array<string>")
    assert dict(rows(frames.flag_filter(f), "i", "excluded_by_flag")) == {1: False, 2: True, 3: False}


def test_dilate_at_size(spark):
    rng = np.random.default_rng(2)
    w, h, radius = 1000, 700, 20
    on = {(int(x), int(y)) for x, y in zip(rng.integers(0, w, 40), rng.integers(0, h, 40), strict=True)} | {(300 + i, 300) for i in range(200)}
    want = np.zeros((w, h), bool)
    gx, gy = np.ogrid[:w, :h]
    for x, y in on:
        want |= (gx - x) ** 2 + (gy - y) ** 2 <= radius**2
    mask = spark.createDataFrame([(0, x, y) for x, y in on], "frame int, x int, y int")
    got = pixels.dilate(mask, radius, w, h)
    assert got.dtypes == mask.dtypes and {(r.x, r.y) for r in got.collect()} == set(zip(*(a.tolist() for a in np.nonzero(want)), strict=True))
    assert pixels.dilate(mask, 0, w, h).count() == len(on) and pixels.dilate(mask.limit(0), 5, w, h).count() == 0
    px = spark.range(w * 4).select(F.lit(0).cast("int").alias("frame"), (F.col("id") % w).cast("int").alias("x"), (300 + F.floor(F.col("id") / w)).cast("int").alias("y"))
    left = pixels.lighting_region(px, mask, w, h)  # grown by 20, 2 % of the longer side
    assert {(r.x, r.y) for r in left.collect()} == {(x, y) for x in range(w) for y in range(300, 304) if not want[x, y]}


def test_each_experiment_has_its_own_reference(spark):
    rows = [(e, f, i, v) for e, light in ((0, 100), (1, 200)) for f, v in ((0, light), (1, light // 2)) for i in range(60)]
    px = spark.createDataFrame(rows, "exp int, frame int, x int, b int").selectExpr("exp", "frame", "x", "0 as y", "b", "b as g", "b as r")
    got = {(r.exp, r.frame): r.gain_g for r in pixels.lighting_gains(px, F.col("frame") == 0, ["exp", "frame"], by=["exp"]).collect()}
    assert got == {(0, 0): 1.0, (1, 0): 1.0, (0, 1): 2.0, (1, 1): 2.0}
    none = pixels.lighting_gains(px, F.col("frame") == 9, ["exp", "frame"], by=["exp"]).collect()
    assert len(none) == 4 and all(r.gain_b is None and r.saturated_rise is None for r in none)
    q = spark.createDataFrame([(0, 0, 100.0), (0, 1, 100.0), (1, 0, 200.0), (1, 1, 100.0)], "exp int, frame int, brightness double").selectExpr("*", "1d as norm_sharpness", "true as align_ok", "0d as align_rms", "1d as align_ecc", "false as lighting_changed", "0d as saturated_rise", "5 as target_px")
    assert {(r.exp, r.frame): r.flags for r in pixels.frame_flags(q, F.col("frame") == 0, ["exp"]).collect()} == {(0, 0): [], (0, 1): [], (1, 0): [], (1, 1): ["brightness_changed"]}
    c = spark.createDataFrame([(e, f, 0, k, 10.0 * x + 5 * f + 100 * e, 10.0 * y) for e in (0, 1) for f in (0, 1) for k, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], "exp int, frame int, marker int, corner int, x double, y double")
    drift = {(r.exp, r.frame): round(r.shift_x, 6) for r in pixels.drift_from_corners(c, c.where("frame = 0"), ["exp", "frame"], ["exp"]).collect()}
    assert drift == {(0, 0): 0, (1, 0): 0, (0, 1): -5, (1, 1): -5}


def test_covariate_at_over_buckets(spark):
    t0 = 1_700_000_000
    readings = spark.createDataFrame([("a", t0 + 100 * i, float(i)) for i in range(50) if i % 7] + [("a", t0 + 50_000, 9.0), ("b", t0, None)], "name string, s long, value double").selectExpr("name", "timestamp_seconds(s) ts", "value")
    asked = [t0 + 37 * i for i in range(150)] + [t0 - 5, t0 + 50_000, t0 + 90_000]
    times = spark.createDataFrame([("a", s) for s in asked] + [("b", t0)], "name string, s long").selectExpr("name", "timestamp_seconds(s) ts", "s")
    wide, narrow = ({(r.name, r.s): r.value for r in covariates.covariate_at(times, readings, bucket=b).collect()} for b in (1e9, 130.0))
    assert wide == narrow and wide["b", t0] is None and wide["a", t0 - 5] is None and wide["a", t0 + 50_000] == 9
    known = {t0 + 100 * i: float(i) for i in range(50) if i % 7}
    for s in asked[:120]:
        lo, hi = max((k for k in known if k <= s), default=None), min((k for k in known if k >= s), default=None)
        want = None if lo is None or hi is None else known[lo] if lo == hi else known[lo] + (known[hi] - known[lo]) * (s - lo) / (hi - lo)
        assert wide["a", s] == (want if want is None else pytest.approx(want))


def test_falling_logistic_and_singular_covariance():
    t = np.linspace(0, 20, 40)
    fall = growth.fit_one(t, 10 / (1 + np.exp(0.5 * (t - 8))), None, "logistic", start=np.array([10, -0.3, 8]))
    assert fall["ok"] and fall["params"]["r"] < 0 and fall["rmse"] < 1e-3
    flat = growth.fit_one(t, np.zeros(40), None, "power", start=np.array([0.0, 1.0]))
    assert "no covariance" in flat["warnings"] and all(np.isinf(x) for x in flat["stderr"].values())


def test_models_of_the_user(spark):
    growth.register_model("square", growth.Model(("c",), lambda t, c: c * t**2, lambda t, y: [1.0], (-np.inf,), (np.inf,), lambda v, t: v("c") * t * t))
    try:
        p = spark.createDataFrame([(0, float(t), 3.0 * t * t, None) for t in range(10)], "s int, t double, y double, unc double")
        fit = growth.fit_growth(p, ["s"], ["square"], "iid")
        assert fit.first().params["c"] == pytest.approx(3) and growth.predict_curve(fit, 2).orderBy("t").collect()[1].y == pytest.approx(243)
        drawn = growth.bootstrap_draws(p, fit, ["s"], 30, 10)
        derived = growth.bootstrap_derived(drawn, fit, ["s"], [12.0, 1e6])
        assert {r.quantity for r in derived.collect()} == {"time_to_12"} and drawn.count() == 30
    finally:
        del growth.MODELS["square"]
