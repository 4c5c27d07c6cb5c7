"""One least-squares solver for many series at once: padded arrays, a damping of each series' own, parameters that enter
linearly solved inside, and correlated errors as one more parameter. numpy alone; growth.py deals series out to tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True)
class Series:
    """m series side by side, in time order; rows shorter than the longest are padded, and `used` is false there."""

    t: np.ndarray
    y: np.ndarray
    sigma: np.ndarray
    used: np.ndarray
    lag: np.ndarray = field(default_factory=lambda: np.zeros(0))  # gaps in units of each series' typical one

    @staticmethod
    def of(ts: Sequence[np.ndarray], ys: Sequence[np.ndarray], sigmas: Sequence[np.ndarray | None]) -> Series:
        n = np.array([len(t) for t in ts])
        used = np.arange(max(n.max(initial=1), 2)) < n[:, None]
        t, y, sigma = np.zeros(used.shape), np.zeros(used.shape), np.ones(used.shape)
        for i, (a, b, c) in enumerate(zip(ts, ys, sigmas, strict=True)):
            t[i, : n[i]], t[i, n[i] :] = a, a[-1] if len(a) else 0.0
            y[i, : n[i]] = b
            if c is not None:
                sigma[i, : n[i]] = c
        gap = np.diff(t, axis=1)
        typical = np.array([np.median(g[: k - 1]) if k > 1 else 1.0 for g, k in zip(gap, n, strict=True)])
        return Series(t, y, sigma, used, np.maximum(gap / np.where(typical > 0, typical, 1.0)[:, None], 1e-6))

    def rows(self, which: np.ndarray) -> Series:
        return Series(self.t[which], self.y[which], self.sigma[which], self.used[which], self.lag[which])

    def drawn(self, y: np.ndarray) -> Series:
        """This one series once for each row of y."""
        wide = lambda a: np.broadcast_to(a, (len(y), a.shape[1]))
        return Series(wide(self.t), y, wide(self.sigma), wide(self.used), wide(self.lag))

    def correlation(self, phi: np.ndarray) -> np.ndarray:
        """Of each point with the one before it, where phi is the correlation over a typical gap; 0 at the start and in the
        padding."""
        rho = np.zeros(self.t.shape)
        on = phi > 0
        rho[on, 1:] = np.minimum(np.maximum(phi[on, None], 1e-300) ** self.lag[on], 1 - 1e-9) * self.used[on, 1:]
        return rho

    def white(self, e: np.ndarray, rho: np.ndarray | None) -> np.ndarray:
        """Rows of residuals as independent ones of one variance: each less what the one before it foretells."""
        e = np.where(self.used, e / self.sigma, 0.0)
        if rho is None:
            return e
        before = np.zeros_like(e)
        before[:, 1:] = e[:, :-1]
        return np.where(self.used, (e - rho * before) / np.sqrt(1 - rho * rho), 0.0)


@dataclass(frozen=True)
class Law:
    """A growth law for the solver: value(t, *params), bounds, and which parameters enter linearly: all (design gives their
    columns), one (`scale` names its place: the law is that parameter times a shape), or none."""

    value: Callable[..., np.ndarray]
    low: np.ndarray
    high: np.ndarray
    scale: int | None = None
    design: Callable[[np.ndarray], np.ndarray] | None = None

    @property
    def inner(self) -> list[int]:
        """Places of the parameters that are searched; the others follow from them."""
        return [] if self.design is not None else [i for i in range(len(self.low)) if i != self.scale]

    def at(self, t: np.ndarray, q: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.broadcast_to(self.value(t, *(q[:, i : i + 1] for i in range(q.shape[1]))), t.shape)

    def project(self, s: Series, inner: np.ndarray, rho: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """White residuals for given inner parameters with the best linear ones, and all parameters."""
        m, p = len(s.t), len(self.low)
        q = np.ones((m, p))
        q[:, self.inner] = inner
        if self.design is not None:
            x = self.design(s.t.ravel()).reshape(*s.t.shape, p)
            x = np.stack([s.white(x[:, :, i], rho) for i in range(p)], axis=2)
            z = s.white(s.y, rho)
            base, upper = np.linalg.qr(x)
            part = np.einsum("mnp,mn->mp", base, z)
            flat = np.abs(np.einsum("mpp->mp", upper)) <= 1e-12 * np.abs(upper).max(axis=(1, 2))[:, None] + 1e-300
            q = np.linalg.solve(upper + np.eye(p) * flat[:, None, :], np.where(flat, 0.0, part)[:, :, None])[:, :, 0]
            return z - np.einsum("mnp,mp->mn", x, q), q
        if self.scale is None:
            return s.white(s.y - self.at(s.t, q), rho), q
        shape, z = s.white(self.at(s.t, q), rho), s.white(s.y, rho)
        size = (shape * shape).sum(axis=1)
        k = np.where(size > 0, (shape * z).sum(axis=1) / np.where(size > 0, size, 1.0), 0.0)
        q[:, self.scale] = k
        return z - k[:, None] * shape, q


def descend(residual: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 300, fine: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Parameters [m, p] that make each row's sum of squares least, and which rows came to rest. residual(q, rows) gives
    residual rows. All rows take damped Gauss-Newton steps together; a row that gains too little, or finds no better place at
    any damping, leaves the batch."""
    m, p = start.shape
    out, good, live = np.clip(start, low, high), np.zeros(m, bool), np.arange(m)
    if not p or not m:
        return out, np.ones(m, bool)
    at, damp = out.copy(), np.full(m, 1e-3)
    r = residual(at, live)
    cost = (r * r).sum(axis=1)
    good_start = np.isfinite(cost)
    live, at, r, cost, damp = live[good_start], at[good_start], r[good_start], cost[good_start], damp[good_start]
    small = np.zeros(len(live), np.int64)
    for _ in range(rounds):
        if not len(live):
            break
        slope = np.empty((p, *r.shape))
        for i in range(p):
            h = 1e-7 * np.maximum(np.abs(at[:, i]), 1e-3)
            h = np.where(at[:, i] + h <= high[i], h, -h)
            near = at.copy()
            near[:, i] += h
            slope[i] = (residual(near, live) - r) / h[:, None]
        normal, pull = np.einsum("imn,jmn->mij", slope, slope), np.einsum("imn,mn->mi", slope, r)
        sound = np.isfinite(normal).all(axis=(1, 2)) & np.isfinite(pull).all(axis=1)
        normal[~sound], pull[~sound] = np.eye(p), 0
        # parameters that lie on a bound and are pulled beyond it stay there
        stuck = ((at <= low) & (pull > 0)) | ((at >= high) & (pull < 0))
        free = ~stuck
        normal = normal * (free[:, :, None] & free[:, None, :]) + np.eye(p) * stuck[:, None, :]
        pull = np.where(stuck, 0.0, pull)
        size = np.einsum("mpp->mp", normal)
        ridge = damp[:, None] * size + 1e-12 * size.max(axis=1, keepdims=True) + 1e-300
        there = np.clip(at - np.linalg.solve(normal + np.eye(p) * ridge[:, None, :], pull[:, :, None])[:, :, 0], low, high)
        r2 = residual(there, live)
        c2 = (r2 * r2).sum(axis=1)
        better = sound & np.isfinite(c2) & (c2 <= cost)
        small = np.where(better & (cost - c2 <= fine * cost), small + 1, np.where(better, 0, small))
        done = (small >= 2) | (damp > 1e10) | ~sound
        at[better], r[better], cost[better] = there[better], r2[better], c2[better]
        damp = np.where(better, damp / 8, damp * 6)
        out[live[done]], good[live[done]] = at[done], sound[done]
        keep = ~done
        live, at, r, cost, damp, small = live[keep], at[keep], r[keep], cost[keep], damp[keep], small[keep]
    out[live] = at  # these did not come to rest
    return out, good


def solve(s: Series, law: Law, start: np.ndarray, phi: np.ndarray | None = None, rounds: int = 300, fine: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Parameters [m, p] of all rows for fixed correlations phi (none: independent errors), and which came to rest."""
    rho = s.correlation(phi) if phi is not None and (phi > 0).any() else None
    part = lambda rows: rho[rows] if rho is not None else None
    inner = law.inner
    with np.errstate(all="ignore"):
        found, good = descend(lambda q, rows: law.project(s.rows(rows), q, part(rows))[0], start[:, inner], law.low[inner], law.high[inner], rounds, fine)
        z, q = law.project(s, found, rho)
    return q, good & np.isfinite(z).all(axis=1) & np.isfinite(q).all(axis=1)


#: Correlations from which the search for the best one starts.
_PHI = np.array([0.02, 0.15, 0.3, 0.45, 0.6, 0.75, 0.88, 0.96])


def solve_correlated(s: Series, law: Law, q: np.ndarray, least: float = 1e-3, most: float = 0.98) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, correlations and success of the likelihood's maximum over both. Its logarithm is -n/2 times that of the
    white residuals' squared sum times the product of (1 - rho^2)^(1/n), so with the residuals scaled by that product's root
    it is a least-squares problem in the parameters and phi, and needs no search within a search."""
    n = s.used.sum(axis=1)

    def scaled(part: Series, inner: np.ndarray, phi: np.ndarray) -> np.ndarray:
        rho = part.correlation(phi)
        count = part.used.sum(axis=1)
        return law.project(part, inner, rho)[0] * np.exp(np.log1p(-rho * rho).sum(axis=1) / (2 * count))[:, None]

    inner = law.inner
    with np.errstate(all="ignore"):
        trial = np.stack([(scaled(s, q[:, inner], np.full(len(n), f)) ** 2).sum(axis=1) for f in _PHI])
        phi = _PHI[np.argmin(np.where(np.isfinite(trial), trial, np.inf), axis=0)]
        low, high = np.append(law.low[inner], least), np.append(law.high[inner], most)
        found, good = descend(lambda x, rows: scaled(s.rows(rows), x[:, :-1], x[:, -1]), np.column_stack([q[:, inner], phi]), low, high, fine=1e-10)
        phi = found[:, -1]
        z, q = law.project(s, found[:, :-1], s.correlation(phi))
    return q, phi, good & np.isfinite(z).all(axis=1) & np.isfinite(q).all(axis=1)


@dataclass
class Fit:
    """What a solution says of each row: white residuals z, -2 log likelihood up to a constant, and standard errors."""

    q: np.ndarray
    phi: np.ndarray
    good: np.ndarray
    z: np.ndarray
    deviance: np.ndarray


def assess(s: Series, law: Law, q: np.ndarray, phi: np.ndarray, good: np.ndarray) -> Fit:
    rho = s.correlation(phi)
    z = s.white(s.y - law.at(s.t, q), rho)
    n = s.used.sum(axis=1)
    return Fit(q, phi, good, z, n * np.log(np.maximum((z * z).sum(axis=1), 1e-300) / n) + np.log1p(-rho * rho).sum(axis=1))


def covariance(s: Series, law: Law, fit: Fit) -> np.ndarray:
    """Inverse normal matrix [m, p, p] of the white residuals, infinite where it can't be told."""
    m, p = fit.q.shape
    rho = s.correlation(fit.phi)
    slope = np.empty((*s.t.shape, p))
    with np.errstate(all="ignore"):
        for i in range(p):
            h = 1e-6 * np.maximum(np.abs(fit.q[:, i]), 1e-3)
            up, down = fit.q.copy(), fit.q.copy()
            up[:, i], down[:, i] = np.minimum(up[:, i] + h, law.high[i]), np.maximum(down[:, i] - h, law.low[i])
            slope[:, :, i] = s.white(law.at(s.t, up) - law.at(s.t, down), rho) / (up[:, i] - down[:, i])[:, None]
        normal = slope.transpose(0, 2, 1) @ slope
        out = np.full((m, p, p), np.inf)
        sound = np.isfinite(normal).all(axis=(1, 2))
        sound[sound] = np.linalg.cond(normal[sound]) <= 1e14
        out[sound] = np.linalg.inv(normal[sound])
    return out


def with_errors(s: Series, law: Law, start: np.ndarray, errors: str) -> tuple[Fit, np.ndarray]:
    """The fit of every row and its number of parameters in the information criteria (with the variance, and phi): errors
    iid, ar1, or auto (lower AICc, the simpler on ties). Correlated errors need five points more than parameters."""
    m, p = len(s.t), len(law.low)
    n = s.used.sum(axis=1)
    q, good = solve(s, law, start)
    fit, k = assess(s, law, q, np.zeros(m), good), np.full(m, p + 1)
    rows = np.flatnonzero(good & (n >= p + 5)) if errors != "iid" else np.zeros(0, np.int64)
    if len(rows):
        part = s.rows(rows)
        q2, phi, good2 = solve_correlated(part, law, q[rows])
        other = assess(part, law, q2, phi, good2)
        better = good2 if errors == "ar1" else good2 & (aicc(other.deviance, n[rows], p + 2) < aicc(fit.deviance[rows], n[rows], p + 1))
        to, of = rows[better], np.flatnonzero(better)
        fit.q[to], fit.phi[to], fit.z[to], fit.deviance[to], k[to] = other.q[of], other.phi[of], other.z[of], other.deviance[of], p + 2
    return replace(fit), k


def aicc(deviance: np.ndarray, n: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """Small-sample AIC; NaN where points are too few for it."""
    spare = n - k - 1
    return np.where(spare > 0, deviance + 2 * k + 2 * k * (k + 1) / np.where(spare > 0, spare, 1), np.nan)
