"""Growth curves: closed-form lines in SQL, non-linear fits of many series at once, correlated errors, bootstrap.

A series is one row of some hundred points; a batch of rows is fitted side by side (fitting.py). Bootstrap draws are spread
over blocks of draws, so one series never keeps a task busy for long."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fitting import Law, Series, aicc, covariance, solve, with_errors


@dataclass(frozen=True)
class Model:
    """A growth law: value(t, *params), first guesses from (t, y), bounds of the parameters, the law as a column of the map
    of its parameters and t, for laws that are linear in their parameters the columns that these weigh, and for others the
    parameter, if any, that scales the rest. value takes a row of times for each set of parameters."""

    params: tuple[str, ...]
    value: Callable[..., np.ndarray]
    start: Callable[[np.ndarray, np.ndarray], list[float]]
    low: tuple[float, ...]
    high: tuple[float, ...]
    column: Callable[[Callable[[str], Column], Column], Column] | None = None
    design: Callable[[np.ndarray], np.ndarray] | None = None
    scale: str | None = None

    def law(self) -> Law:
        return Law(self.value, np.array(self.low, float), np.array(self.high, float), self.params.index(self.scale) if self.scale else None, self.design)


def _logistic(t, K, r, t_mid):  # noqa: N803
    return K / (1 + np.exp(-np.clip(r * (t - t_mid), -500, 500)))


def _gompertz(t, A, mu, lag):  # noqa: N803
    return A * np.exp(-np.exp(np.clip(mu * np.e / A * (lag - t) + 1, -500, 500)))


def _richards(t, K, r, t_mid, nu):  # noqa: N803
    return K * (1 + nu * np.exp(-np.clip(r * (t - t_mid), -500, 500))) ** (-1 / nu)


def _rise(t: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Top, time of half the top, and overall rate."""
    top = max(float(np.max(y)) * 1.05, 1e-6)
    half = float(np.interp(top / 2, np.maximum.accumulate(y), t)) if len(t) > 1 else float(t[0])
    span = max(float(np.ptp(t)), 1e-9)
    return top, half, 4 / span


_INF = float("inf")
MODELS: dict[str, Model] = {
    "linear": Model(("a", "b"), lambda t, a, b: a + b * t, lambda t, y: [float(y[0]), float((y[-1] - y[0]) / max(np.ptp(t), 1e-9))], (-_INF, -_INF), (_INF, _INF)),
    "sqrt": Model(("k",), lambda t, k: k * np.sqrt(np.maximum(t, 0)), lambda t, y: [float(np.max(y) / max(np.sqrt(max(np.max(t), 0)), 1e-9))], (-_INF,), (_INF,)),
    "sqrt_lag": Model(("k", "t0"), lambda t, k, t0: k * np.sqrt(np.maximum(t - t0, 0)), lambda t, y: [float(np.max(y) / max(np.sqrt(max(np.ptp(t), 0)), 1e-9)), float(t[0])], (-_INF, -_INF), (_INF, _INF)),
    "power": Model(("k", "n"), lambda t, k, n: k * np.maximum(t, 1e-12) ** n, lambda t, y: [float(np.max(y) / max(np.max(t), 1e-9) ** 0.7), 0.7], (-_INF, -_INF), (_INF, _INF)),
    "logistic": Model(("K", "r", "t_mid"), _logistic, lambda t, y: [_rise(t, y)[0], _rise(t, y)[2], _rise(t, y)[1]], (-_INF, -_INF, -_INF), (_INF, _INF, _INF)),
    "gompertz": Model(("A", "mu", "lag"), _gompertz, lambda t, y: [_rise(t, y)[0], _rise(t, y)[0] * _rise(t, y)[2] / 4, max(_rise(t, y)[1] - np.ptp(t) / 4, float(t[0]))], (-_INF, -_INF, -_INF), (_INF, _INF, _INF)),
    "richards": Model(("K", "r", "t_mid", "nu"), _richards, lambda t, y: [_rise(t, y)[0], _rise(t, y)[2], _rise(t, y)[1], 1.0], (-_INF, -_INF, -_INF, 1e-3), (_INF, _INF, _INF, 50.0)),
}
DEFAULT_MODELS = ("linear", "sqrt", "power", "logistic")


def _root(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


_COLUMNS: dict[str, Callable[[Callable[[str], Column], Column], Column]] = {
    "linear": lambda v, t: v("a") + v("b") * t,
    "sqrt": lambda v, t: v("k") * _root(t),
    "sqrt_lag": lambda v, t: v("k") * _root(t - v("t0")),
    "power": lambda v, t: v("k") * F.pow(F.greatest(t, F.lit(1e-12)), v("n")),
    "logistic": lambda v, t: v("K") / (1 + F.exp(-v("r") * (t - v("t_mid")))),
    "gompertz": lambda v, t: v("A") * F.exp(-F.exp(v("mu") * float(np.e) / v("A") * (v("lag") - t) + 1)),
    "richards": lambda v, t: v("K") * F.pow(1 + v("nu") * F.exp(-v("r") * (t - v("t_mid"))), -1 / v("nu")),
}
_DESIGNS = {"linear": lambda t: np.stack([np.ones(len(t)), t], axis=1), "sqrt": lambda t: np.sqrt(np.maximum(t, 0))[:, None]}
_SCALES = {"sqrt_lag": "k", "power": "k", "logistic": "K", "richards": "K"}
MODELS = {name: replace(m, column=_COLUMNS[name], design=_DESIGNS.get(name), scale=_SCALES.get(name)) for name, m in MODELS.items()}


def register_model(name: str, model: Model) -> None:
    """Adds a law of the user's: fits know it by value, predictions by its column. Executors get it with the function, so
    it is registered before the fit is declared."""
    MODELS[name] = model


def curve(model: Column, p: Column, t: Column) -> Column:
    """Value of the named model at t; p is the map of its parameters. Null for a model without a column."""
    out = F.lit(None).cast("double")
    for name, m in MODELS.items():
        if m.column is not None:
            out = F.when(model == name, m.column(lambda k: F.try_element_at(p, F.lit(k)), t)).otherwise(out)
    return out


def predict_curve(fits: DataFrame, points: int = 50) -> DataFrame:
    """fits(..., model, params, t_first, t_last) on an even grid."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    grid = fits.withColumn("i", i).withColumn("t", F.col("t_first") + (F.col("t_last") - F.col("t_first")) * F.col("i") / (points - 1))
    return grid.withColumn("y", curve(F.col("model"), F.col("params"), F.col("t")))


def fit_linear_closed(points: DataFrame, by: Sequence[str], unc: str | None = None) -> DataFrame:
    """Weighted line and k sqrt(t) of each series by sums alone: by, model, n, params, rmse, r2, aicc. points(by, t, y)."""
    w = 1 / F.col(unc) ** 2 if unc else F.lit(1.0)
    p = points.where("y is not null and t is not null").withColumn("w", w).withColumn("x", F.sqrt(F.greatest("t", F.lit(0.0))))
    s = lambda e: F.sum(F.col("w") * e)
    t, y, x = F.col("t"), F.col("y"), F.col("x")
    g = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), s(t).alias("st"), s(y).alias("sy"), s(t * t).alias("stt"), s(t * y).alias("sty"), s(y * y).alias("syy"), s(x * x).alias("sxx"), s(x * y).alias("sxy"))
    det = F.nullif(F.col("sw") * F.col("stt") - F.col("st") ** 2, F.lit(0.0))
    b = (F.col("sw") * F.col("sty") - F.col("st") * F.col("sy")) / det
    a = (F.col("sy") - b * F.col("st")) / F.col("sw")
    k = F.col("sxy") / F.nullif("sxx", F.lit(0.0))
    g = g.withColumns({"b": b, "a": a, "k": k})
    line = F.col("syy") - F.col("a") * F.col("sy") - F.col("b") * F.col("sty")
    root = F.col("syy") - F.col("k") * F.col("sxy")
    one = lambda name, params, rss, q: F.struct(F.lit(name).alias("model"), params.alias("params"), F.greatest(rss, F.lit(0.0)).alias("rss"), F.lit(q).alias("p"))
    both = g.select(*by, "n", "sw", "sy", "syy", F.explode(F.array(one("linear", F.create_map(F.lit("a"), "a", F.lit("b"), "b"), line, 2), one("sqrt", F.create_map(F.lit("k"), "k"), root, 1))).alias("f"))
    out = both.select(*by, "f.model", "n", "f.params", "f.rss", "f.p", (F.col("syy") - F.col("sy") ** 2 / F.col("sw")).alias("tss")).where("n >= p + 2 and rss is not null")
    k1 = F.col("p") + 1
    aic = F.col("n") * F.log(F.greatest(F.col("rss"), F.lit(1e-300)) / F.col("n")) + 2 * k1
    return out.withColumns({"r2": F.when(F.col("tss") > 0, 1 - F.col("rss") / F.col("tss")), "rmse": F.sqrt(F.col("rss") / F.col("n")), "aicc": F.when(F.col("n") - k1 - 1 > 0, aic + 2 * k1 * (k1 + 1) / (F.col("n") - k1 - 1))}).drop("tss")


def akaike_weights(fits: DataFrame, by: Sequence[str], value: str = "aicc") -> DataFrame:
    """fits with weight, normalised over the models of a series, and best: the highest weight, by name on ties."""
    w = Window.partitionBy(*by)
    e = fits.withColumn("__e", F.exp(-(F.col(value) - F.min(value).over(w)) / 2))
    e = e.withColumn("weight", F.col("__e") / F.sum("__e").over(w)).drop("__e")
    return e.withColumn("best", F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), "model")) == 1)


# --- non-linear fits -------------------------------------------------------------------------------------------------


def fit_many(series: Series, law: Law, names: Sequence[str], starts: np.ndarray, weighted: np.ndarray, errors: str = "iid") -> list[dict]:
    """Parameters and statistics of one law for many series, one FIT record each."""
    n, p = series.used.sum(axis=1), len(names)
    out: list[dict] = [{"ok": False, "n": int(k), "message": f"too few points: {k}"} for k in n]
    rows = np.flatnonzero(n >= p + 2)
    if not len(rows):
        return out
    s, n, weighted = series.rows(rows), n[rows], weighted[rows]
    fit, k = with_errors(s, law, starts[rows], errors)
    squares = (fit.z**2).sum(axis=1)
    chi2 = squares / np.maximum(n - p, 1)
    with np.errstate(all="ignore"):
        spread = covariance(s, law, fit) * np.where(weighted, 1.0, chi2)[:, None, None]
        err = np.sqrt(np.maximum(np.einsum("mpp->mp", spread), 0))
        err = np.where(np.isfinite(spread).all(axis=(1, 2))[:, None], err, np.inf)
        e = np.where(s.used, s.y - law.at(s.t, fit.q), 0.0)
        mean = np.where(s.used, s.y, 0.0).sum(axis=1) / n
        total = (np.where(s.used, s.y - mean[:, None], 0.0) ** 2).sum(axis=1)
        rest = (e * e).sum(axis=1)
        watson = (np.where(s.used[:, 1:], np.diff(fit.z, axis=1), 0.0) ** 2).sum(axis=1) / np.maximum(squares, 1e-300)
    aic, small = fit.deviance + 2 * k, aicc(fit.deviance, n, k)
    for i, row in enumerate(rows.tolist()):
        if not fit.good[i]:
            out[row]["message"] = "no convergence"
            continue
        phi = float(fit.phi[i])
        notes = [m for m, on in (("chi2 over 3", weighted[i] and chi2[i] > 3), ("durbin-watson under 1", phi == 0 and watson[i] < 1), ("strongly correlated", phi > 0.7), ("no covariance", not np.isfinite(err[i]).all())) if on]
        out[row] = {
            "ok": True, "n": int(n[i]), "message": None, "params": dict(zip(names, fit.q[i].tolist(), strict=True)), "stderr": dict(zip(names, err[i].tolist(), strict=True)), "r2": float(1 - rest[i] / total[i]) if total[i] > 0 else None, "rmse": float(np.sqrt(rest[i] / n[i])),
            "aic": float(aic[i]), "aicc": None if np.isnan(small[i]) else float(small[i]), "bic": float(fit.deviance[i] + k[i] * np.log(n[i])), "weighted": bool(weighted[i]), "reduced_chi2": float(chi2[i]) if weighted[i] else None, "durbin_watson": float(watson[i]),
            "error_model": "ar1" if phi > 0 else "iid", "ar1_phi": phi, "warnings": notes,
        }
    return out


def _weights(unc: np.ndarray | None) -> np.ndarray | None:
    """Uncertainties, if every point has one above 0."""
    return unc if unc is not None and len(unc) and bool(np.all(np.isfinite(unc) & (unc > 0))) else None


def fit_one(t: np.ndarray, y: np.ndarray, unc: np.ndarray | None, name: str | Model, errors: str = "iid", start: np.ndarray | None = None) -> dict:
    """One series and one model, as fit_growth has them."""
    model, w = name if isinstance(name, Model) else MODELS[name], _weights(unc)
    begin = model.start(t, y) if start is None else start
    return fit_many(Series.of([t], [y], [w]), model.law(), model.params, np.array([begin], float), np.array([w is not None]), errors)[0]


FIT = "ok boolean, n long, message string, params map<string,double>, stderr map<string,double>, r2 double, rmse double, aic double, aicc double, bic double, weighted boolean, reduced_chi2 double, durbin_watson double, error_model string, ar1_phi double, warnings array<string>, t_first double, t_last double"
_FIT_COLUMNS = [x.strip().split()[0] for x in FIT.replace("map<string,double>", "map").split(", ")]


def _head(df: DataFrame, by: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)


#: Points, with padding, that are fitted side by side.
CELLS = 1 << 17


def _series(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and pts, the points of each series in order (some hundred); null t or y are left out. Series are dealt out over as
    many tasks as shuffles have, however few bytes they are: fits are work, not data."""
    used = points.where("t is not null and y is not null and not isnan(y)").select(*by, F.struct(F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"), F.col("unc").cast("double").alias("unc")).alias("p"))
    return used.groupBy(*by).agg(F.array_sort(F.collect_list("p")).alias("pts")).where(F.size("pts") > 0)


def _dealt(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by) if by else df


def _points_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """t, y and uncertainties (where all are above 0) of each row's pts."""
    pts = batch.column("pts")
    flat, at = pts.flatten(), np.concatenate([[0], np.cumsum(pts.value_lengths().to_numpy(zero_copy_only=False))])
    t, y, u = (flat.field(i).fill_null(float("nan")).to_numpy(zero_copy_only=False) for i in range(3))
    return [(t[a:b], y[a:b], _weights(u[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]


def _side_by_side(sizes: list[int]) -> Iterator[list[int]]:
    """Rows, by length, in groups of about CELLS points with their padding."""
    group: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        if group and (len(group) + 1) * sizes[i] > CELLS:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def fit_growth(points: DataFrame, by: Sequence[str], models: Sequence[str] = DEFAULT_MODELS, errors: str = "auto") -> DataFrame:
    """by, model and FIT columns: every model for every series of points(by, t, y, unc); null t or y are left out. Failures
    are rows with ok false and a message. Series that lie in one Arrow batch are fitted side by side."""
    chosen = {name: MODELS[name] for name in models}
    head = _head(points, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = _points_of(batch)
            row, found = [], []
            for group in _side_by_side([len(t) for t, _, _ in each]):
                part = [each[i] for i in group]
                s, weighted = Series.of(*zip(*part, strict=True)), np.array([w is not None for _, _, w in part])
                for name, model in chosen.items():
                    starts = np.array([model.start(t, y) for t, y, _ in part], float)
                    fits = fit_many(s, model.law(), model.params, starts, weighted, errors)
                    found += [f | {"model": name, "t_first": float(t[0]), "t_last": float(t[-1])} for f, (t, _, _) in zip(fits, part, strict=True)]
                    row += group
            own = [batch.column(c).take(pa.array(row, pa.int64())) for c in by]
            texts, maps = pa.string(), pa.map_(pa.string(), pa.float64())
            kinds = {"ok": pa.bool_(), "n": pa.int64(), "message": texts, "params": maps, "stderr": maps, "weighted": pa.bool_(), "error_model": texts, "warnings": pa.list_(texts)}
            put = lambda c: [list(v.items()) if isinstance(v := f.get(c), dict) else v for f in found]
            yield pa.RecordBatch.from_arrays([*own, pa.array([f["model"] for f in found], texts), *(pa.array(put(c), kinds.get(c, pa.float64())) for c in _FIT_COLUMNS)], [*by, "model", *_FIT_COLUMNS])

    return _dealt(_series(points, by), by).mapInArrow(run, f"{head}, model string, {FIT}" if by else f"model string, {FIT}")


def derived_quantities(fits: DataFrame, by: Sequence[str], levels: Sequence[float] = (), points: int = 400) -> DataFrame:
    """fits(by, model, params, t_first, t_last) with max_rate, t_max_rate, lag and time_to_<level>, from a grid. The rate is
    the central difference, one-sided at the ends. A peak at an end or a spike (both neighbours under 0.8 of it) is none; a
    constant slope gives the rate alone. Levels beyond the curve are null."""
    grid = predict_curve(fits.select(*by, "model", "params", "t_first", "t_last"), points)
    w = Window.partitionBy(*by, "model").orderBy("i")
    up, down = F.lead("y").over(w), F.lag("y").over(w)
    h = F.nullif(F.lead("t").over(w) - F.lag("t").over(w), F.lit(0.0))
    step = F.nullif((F.col("t_last") - F.col("t_first")) / (points - 1), F.lit(0.0))
    g = grid.withColumn("rate", F.when(down.isNull(), (up - F.col("y")) / step).when(up.isNull(), (F.col("y") - down) / step).otherwise((up - down) / h))
    g = g.withColumns({"r0": F.lag("rate").over(w), "r1": F.lead("rate").over(w), "y0": F.lag("y").over(w), "t0": F.lag("t").over(w)})
    reach = lambda level: F.min(F.when((F.col("y0") < level) & (F.col("y") >= level), F.col("t0") + (F.lit(level) - F.col("y0")) * (F.col("t") - F.col("t0")) / (F.col("y") - F.col("y0"))).when((F.col("i") == 0) & (F.col("y") >= level), F.col("t")))
    top = F.max(F.struct("rate", (-F.col("i")).alias("k"), "t", "y", "r0", "r1"))
    a = g.groupBy(*by, "model").agg(top.alias("m"), F.min("rate").alias("low"), F.min("y").alias("base"), *(reach(x).alias(f"time_to_{x:g}") for x in levels))
    flat = F.col("m.rate") - F.col("low") <= 1e-6 * F.abs("m.rate")
    peak = F.col("m.r0").isNotNull() & F.col("m.r1").isNotNull() & (F.col("m.k") < 0) & (F.col("m.r0") >= 0.8 * F.col("m.rate")) & (F.col("m.r1") >= 0.8 * F.col("m.rate"))
    lag = F.col("m.t") - F.col("m.y") / F.nullif("m.rate", F.lit(0.0))
    return a.select(*by, "model", F.when(flat | peak, F.col("m.rate")).alias("max_rate"), F.when(~flat & peak, F.col("m.t")).alias("t_max_rate"), F.when(~flat & peak, lag).alias("lag"), *(f"`time_to_{x:g}`" for x in levels))


def simulate(s: Series, law: Law, q: np.ndarray, phi: float, draws: int, rng: np.random.Generator) -> np.ndarray:
    """[draws, n] values made from the fit of one series and its white residuals, drawn anew with replacement: centred, scaled
    by sqrt(n / (n - p)), and correlated again as the errors are."""
    rho = s.correlation(np.array([phi]))
    z = s.white(s.y - law.at(s.t, q[None, :]), rho)[0]
    n, p = len(z), len(q)
    e = rng.choice((z - z.mean()) * np.sqrt(n / max(n - p, 1)), (draws, n))
    for i in range(1, n) if phi else ():
        e[:, i] = rho[0, i] * e[:, i - 1] + np.sqrt(1 - rho[0, i] ** 2) * e[:, i]
    return law.at(s.t, q[None, :]) + e * s.sigma


def bootstrap_draws(points: DataFrame, fits: DataFrame, by: Sequence[str], draws: int = 200, block: int = 128, seed: int = 1) -> DataFrame:
    """by, model, draw, params: refits of series made from the fit and resampled residuals (for correlated errors their
    innovations, rebuilt). Draws come in blocks, one row each, so that one series does not hold a task; the draws of a block
    are refitted side by side. Random numbers depend on the seed, series, model and block alone."""
    ok = fits.where("ok").select(*by, "model", "params", "ar1_phi", "weighted", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // block))).alias("blk"))
    each = _series(points, by).join(ok, list(by)).withColumn("key", F.xxhash64(F.lit(seed), *by, "model", "blk"))
    own = {name: m for name, m in MODELS.items() if name not in _COLUMNS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            info = {c: batch.column(c).to_pylist() for c in ("model", "params", "ar1_phi", "weighted", "blk", "key")}
            for i, (t, y, w) in enumerate(_points_of(batch)):
                name, phi, first = info["model"][i], float(info["ar1_phi"][i]), info["blk"][i] * block
                model = own.get(name) or MODELS[name]
                law, q = model.law(), np.array([dict(info["params"][i])[k] for k in model.params])
                s = Series.of([t], [y], [w if info["weighted"][i] else None])
                many = s.drawn(simulate(s, law, q, phi, min(block, draws - first), np.random.default_rng(abs(info["key"][i]))))
                found, good = solve(many, law, np.tile(q, (len(many.y), 1)), np.full(len(many.y), phi), rounds=100, fine=1e-9)
                which = np.flatnonzero(good).tolist()
                keep = pa.array([i] * len(which), pa.int64())
                params = pa.array([list(zip(model.params, found[d].tolist(), strict=True)) for d in which], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in by), pa.array([name] * len(which), pa.string()), pa.array([first + d for d in which], pa.int32()), params], [*by, "model", "draw", "params"])

    return _dealt(each, [*by, "model", "blk"]).mapInArrow(run, f"{_head(points, by)}, model string, draw int, params map<string,double>")


def bootstrap_fit(drawn: DataFrame, by: Sequence[str], draws: int = 200) -> DataFrame:
    """by, model, param, low, high, converged: percentile 95 % intervals, with at least max(20, draws/2) converged refits."""
    both = drawn.select(*by, "model", F.explode("params").alias("param", "v")).groupBy(*by, "model", "param").agg(F.percentile("v", [0.025, 0.975]).alias("p"), F.count(F.lit(1)).alias("converged"))
    return both.where(F.col("converged") >= max(20, draws // 2)).select(*by, "model", "param", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "converged")


def bootstrap_derived(drawn: DataFrame, fits: DataFrame, by: Sequence[str], levels: Sequence[float] = (), points: int = 400) -> DataFrame:
    """by, model, quantity, low, high, finite, n: percentile 95 % intervals of the derived quantities of the bootstrap
    curves; none for a quantity that under 80 % of the curves have."""
    each = derived_quantities(drawn.join(fits.select(*by, "model", "t_first", "t_last"), [*by, "model"]), [*by, "draw"], levels, points)
    names = [c for c in each.columns if c not in {*by, "draw", "model"}]
    long = each.select(*by, "model", F.explode(F.array(*(F.struct(F.lit(c).alias("quantity"), F.col(f"`{c}`").alias("v")) for c in names))).alias("q")).select(*by, "model", "q.quantity", F.when(~F.isnan("q.v") & (F.abs("q.v") < float("inf")), F.col("q.v")).alias("v"))
    got = long.groupBy(*by, "model", "quantity").agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"), F.count("v").alias("finite"), F.count(F.lit(1)).alias("n"))
    return got.where("finite >= 0.8 * n")


def confidence_band(drawn: DataFrame, fits: DataFrame, by: Sequence[str], points: int = 50) -> DataFrame:
    """by, model, t, low, high: pointwise 95 % band of at least 20 bootstrap curves."""
    grid = predict_curve(drawn.join(fits.select(*by, "model", "t_first", "t_last"), [*by, "model"]), points)
    return grid.groupBy(*by, "model", "i", "t").agg(F.percentile("y", 0.025).alias("low"), F.percentile("y", 0.975).alias("high"), F.count(F.lit(1)).alias("n")).where("n >= 20").drop("n", "i")


def residual_table(points: DataFrame, best: DataFrame, by: Sequence[str]) -> DataFrame:
    """points with the best model's value, the residual and residual / unc. best(by, model, params)."""
    j = points.join(best.select(*by, "model", "params"), list(by)).withColumn("fitted", curve(F.col("model"), F.col("params"), F.col("t")))
    return j.withColumn("residual", F.col("y") - F.col("fitted")).withColumn("scaled", F.when(F.col("unc") > 0, F.col("residual") / F.col("unc"))).drop("params")


def residual_statistics(residuals: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, rmse and Durbin-Watson of residuals(by, t, residual)."""
    d = residuals.withColumn("d", F.col("residual") - F.lag("residual").over(Window.partitionBy(*by).orderBy("t", "y")))
    ss = F.sum(F.col("residual") ** 2)
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(ss / F.count(F.lit(1))).alias("rmse"), (F.sum(F.col("d") ** 2) / F.nullif(ss, F.lit(0.0))).alias("durbin_watson"))


def report_fits(points: DataFrame, by: Sequence[str], models: Sequence[str] = DEFAULT_MODELS, errors: str = "auto") -> DataFrame:
    """Fits of every series with its counts of used, excluded, jumping, retreating and out-of-hours rows."""
    counts = points.groupBy(*by).agg(F.count_if(~F.col("excluded")).alias("n_used"), F.count_if("excluded").alias("n_excluded"), F.count_if("jump").alias("jumps"), F.count_if("retreat").alias("retreats"), F.count_if("outside_hours").alias("outside"))
    return akaike_weights(fit_growth(points.where(~F.col("excluded")), by, models, errors).where("ok"), by).join(counts, list(by))


