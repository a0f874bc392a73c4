"""Target weights under hard limits: one convex problem per date and variant, solved in grouped maps.

A group is one date's universe. Risk stays factored in the tables and in the
solver, which takes ``loadings`` and ``half_loadings`` as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.errors import ConfigError, SolverError

_RELAX, _GAP = 1e-9, 1e-9


@dataclass(frozen=True)
class Covariance:
    """A covariance in factored form, diag(own) + vectors diag(weights) vectors', which grows with the names and not with their square."""

    own: np.ndarray
    vectors: np.ndarray
    weights: np.ndarray

    @classmethod
    def factored(cls, specific: np.ndarray, loadings: np.ndarray, half_loadings: np.ndarray) -> Covariance:
        """The symmetric part of half_loadings loadings' plus the specific variances, by an orthogonal base of both."""
        base, r = np.linalg.qr(np.hstack([half_loadings, loadings]))
        k = loadings.shape[1]
        values, turned = np.linalg.eigh((r[:, :k] @ r[:, k:].T + r[:, k:] @ r[:, :k].T) / 2)
        kept = np.abs(values) > 1e-14 * np.abs(values).max(initial=0.0)
        return cls(specific, base @ turned[:, kept], values[kept])

    @classmethod
    def dense(cls, matrix: np.ndarray) -> Covariance:
        values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
        least = max(values[0], 0.0) if len(values) else 0.0
        kept = np.abs(values - least) > 1e-14 * np.abs(values).max(initial=0.0)
        return cls(np.full(len(matrix), least), vectors[:, kept], values[kept] - least)

    def times(self, v: np.ndarray) -> np.ndarray:
        return self.own * v + self.vectors @ (self.weights * (self.vectors.T @ v))

    def among(self, names: np.ndarray) -> Covariance:
        return Covariance(self.own[names], self.vectors[names], self.weights)


@dataclass(frozen=True)
class Limits:
    """Hard limits and objective. ``ranges`` bound active exposures, in the order of the ``exposures`` arrays.

    Without ``risk_aversion`` the score is maximised (and a tracking-error limit
    is needed); with it, score less half the risk-weighted active variance.
    ``cost`` is charged on every unit of absolute change from current weights.
    """

    max_weight: float
    max_active: float
    tracking_error: float | None = None
    turnover: float | None = None
    candidate_floor: float | None = None
    ranges: tuple[tuple[float, float], ...] = ()
    risk_aversion: float | None = None
    cost: float = 0.0

    def __post_init__(self) -> None:
        if self.risk_aversion is None and self.tracking_error is None:
            raise ConfigError("maximising the score needs a tracking-error limit")
        if self.tracking_error is not None and not self.tracking_error > 0:
            raise ConfigError("the tracking-error limit must be positive")


def with_risk(names: DataFrame, exposure: DataFrame, factor_cov: DataFrame) -> DataFrame:
    """``names`` with ``loadings`` (exposures in order of factor) and ``half_loadings`` (exposures times factor covariance); null for names without exposures."""
    x = exposure.select("ticker", "factor", "exposure")
    half = x.withColumnRenamed("factor", "factor_a").join(F.broadcast(factor_cov), "factor_a").groupBy("ticker", F.col("factor_b").alias("factor")).agg(F.sum(F.col("exposure") * F.col("covariance")).alias("h"))
    both = half.join(x, ["ticker", "factor"], "left").groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("factor", F.coalesce("exposure", F.lit(0.0)).alias("x"), "h"))).alias("r"))
    return names.join(both.select("ticker", F.col("r.x").alias("loadings"), F.col("r.h").alias("half_loadings")), "ticker", "left")


@dataclass(frozen=True)
class _Problem:
    """Limits on z = (x, u, lift): x are the free weights, u (if ``moving``) bounds of their changes, lift (if ``lifted``) loosens every limit.

    ``pairs`` are limits a.x_i + b.u_i <= bound_i of every name, ``lines`` the few rows that join
    names, and the quadratic limit is scale * risk(x - centre) + slope.x <= most.
    """

    n: int
    moving: bool
    pairs: list[tuple[float, float, np.ndarray]]
    lines: np.ndarray
    bounds: np.ndarray
    risk: Covariance
    scale: float | None
    centre: np.ndarray
    slope: np.ndarray
    most: float
    lifted: bool = False

    def parts(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray | float, float]:
        return z[: self.n], z[self.n : 2 * self.n] if self.moving else 0.0, z[-1] if self.lifted else 0.0

    def linear(self, z: np.ndarray) -> np.ndarray:
        """What the linear limits take up of their bounds."""
        x, u, lift = self.parts(z)
        return np.concatenate([*(a * x + b * u - lift for a, b, _ in self.pairs), self.lines @ z[: self.lines.shape[1]] - lift])

    def slacks(self, z: np.ndarray) -> np.ndarray:
        s = np.concatenate([*(bound for _, _, bound in self.pairs), self.bounds]) - self.linear(z)
        if self.scale is None:
            return s
        x, _, lift = self.parts(z)
        d = x - self.centre
        return np.append(s, self.most - self.scale * (d @ self.risk.times(d)) - self.slope @ x + lift)


def _minimize(z: np.ndarray, c: np.ndarray, aversion: float, p: _Problem, enough: float = -np.inf) -> np.ndarray:
    """Log-barrier Newton for c.z + aversion x'Sx/2 under the limits of ``p`` and a constant sum of x, from an interior ``z``; ends early once c.z < ``enough``.

    The Hessian is a block of one or two rows a name plus a few dense columns
    (factors, limits that join names, the lift), so a step solves a system in
    those columns only: time and memory grow with the names.
    """
    n, width, k = p.n, p.n * (1 + p.moving), len(p.risk.weights)
    m = len(p.pairs) * n + len(p.bounds) + (p.scale is not None)
    ones = np.concatenate([np.ones(n), np.zeros(width - n)])
    grown = lambda v: np.concatenate([v, np.zeros(width - n)])
    factors = np.vstack([p.risk.vectors, np.zeros((width - n, k))])
    t = 1.0
    while m / t > _GAP / 8:
        for _ in range(50):
            s = p.slacks(z)
            inverse = 1 / s
            x = z[:n]
            gradient, own = t * c, np.zeros(n)
            if aversion:
                gradient[:n] += t * aversion * p.risk.times(x)
                own = own + t * aversion * p.risk.own
            xx, xu, uu, side, corner = own, np.zeros(n), np.zeros(n), np.zeros(width), 0.0
            for i, (a, b, _) in enumerate(p.pairs):
                r = inverse[i * n : (i + 1) * n]
                r2 = r * r
                gradient[:n] += a * r
                xx, corner = xx + a * a * r2, corner + r2.sum()
                side[:n] -= a * r2
                if p.moving:
                    gradient[n:width] += b * r
                    xu, uu = xu + a * b * r2, uu + b * b * r2
                    side[n:] -= b * r2
            r = inverse[len(p.pairs) * n :][: len(p.bounds)]
            gradient[:width] += p.lines.T @ r
            if p.lifted:
                gradient[-1] -= inverse[: len(p.pairs) * n].sum() + r.sum()
            columns, lifts, inverses = [p.lines.T], [np.full(len(r), -1.0)], [s[len(p.pairs) * n :][: len(p.bounds)] ** 2]
            strength = t * aversion * p.risk.weights
            if p.scale is not None:
                d = x - p.centre
                tilt = 2 * p.scale * p.risk.times(d) + p.slope
                gradient[:n] += tilt * inverse[-1]
                if p.lifted:
                    gradient[-1] -= inverse[-1]
                xx = xx + 2 * p.scale * inverse[-1] * p.risk.own
                strength = strength + 2 * p.scale * inverse[-1] * p.risk.weights
                columns, lifts, inverses = [*columns, grown(tilt)[:, None]], [*lifts, np.array([-1.0])], [*inverses, s[-1:] ** 2]
            if strength.any():
                columns, lifts, inverses = [*columns, factors], [*lifts, np.zeros(k)], [*inverses, 1 / strength]
            lifts, inverses = np.concatenate(lifts), np.concatenate(inverses)
            xx = xx + 1e-13 * xx.mean()
            border = np.column_stack([*columns, *([side] if p.lifted else []), ones])
            small = np.zeros((border.shape[1],) * 2)
            q = len(inverses)
            small[range(q), range(q)] = -inverses
            if p.lifted:
                small[q, :q] = small[:q, q] = lifts
                small[q, q] = corner

            def by_name(v: np.ndarray) -> np.ndarray:
                if not p.moving:
                    return (v.T / xx).T  # noqa: B023
                top, low = v[:n].T, v[n:].T
                det = xx * uu - xu * xu  # noqa: B023
                return np.concatenate([(uu * top - xu * low) / det, (xx * low - xu * top) / det], axis=-1).T  # noqa: B023

            def product(v: np.ndarray) -> np.ndarray:
                return xx * v if not p.moving else np.concatenate([xx * v[:n] + xu * v[n:], xu * v[:n] + uu * v[n:]])  # noqa: B023

            schur = small - border.T @ by_name(border)
            size = np.sqrt(np.abs(np.diag(schur)))
            size[size == 0] = 1.0
            want, rest = -gradient[:width], np.zeros(border.shape[1])
            if p.lifted:
                rest[q] = -gradient[-1]
            move, few = np.zeros(width), np.zeros(border.shape[1])
            try:
                for _ in range(2):  # solution and one refinement
                    left, right = want - product(move) - border @ few, rest - border.T @ move - small @ few
                    step = np.linalg.solve(schur / np.outer(size, size), (right - border.T @ by_name(left)) / size) / size
                    few, move = few + step, move + by_name(left - border @ step)
            except np.linalg.LinAlgError:
                break
            move = np.append(move, few[q]) if p.lifted else move
            fall, step = -gradient @ move, 1.0
            if not fall >= 1e-9:
                break
            change = np.concatenate([-p.linear(move), [0.0] if p.scale is not None else []])
            bend, curve = 0.0, aversion * (move[:n] @ p.risk.times(move[:n])) / 2 if aversion else 0.0
            straight = c @ move + (aversion * (p.risk.times(x) @ move[:n]) if aversion else 0.0)
            if p.scale is not None:
                bend, change[-1] = p.scale * (move[:n] @ p.risk.times(move[:n])), -(tilt @ move[:n]) + (move[-1] if p.lifted else 0.0)
            while step > 1e-10:
                ratio = step * change * inverse
                if p.scale is not None:
                    ratio[-1] -= step * step * bend * inverse[-1]
                if ratio.min() > -1 and t * (step * straight + step * step * curve) - np.log1p(ratio).sum() <= -0.01 * step * fall and p.slacks(z + step * move).min() > 0:
                    break
                step /= 2
            if step <= 1e-10:
                break
            z = z + step * move
            if c @ z < enough:
                return z
        t *= 8
    return z


def solve(score: np.ndarray, benchmark: np.ndarray, current: np.ndarray | None, frozen: np.ndarray, candidate: np.ndarray, covariance: np.ndarray | Covariance, exposures: np.ndarray, limits: Limits) -> np.ndarray:
    """Weights of one problem; ``SolverError`` where no weights satisfy every limit."""
    risk = covariance if isinstance(covariance, Covariance) else Covariance.dense(covariance)
    low, high = np.maximum(0, benchmark - limits.max_active), np.minimum(limits.max_weight, benchmark + limits.max_active)
    if current is not None:
        low, high = np.where(frozen, current, low), np.where(frozen, current, high)
    if np.any(low > high + _RELAX) or low.sum() > 1 + 1e-8 or high.sum() < 1 - 1e-8:
        raise SolverError("weight bounds allow no portfolio")
    free = high - low > 1e-12
    w = low.copy()
    if not free.any():
        return w
    n, base = int(free.sum()), np.where(free, 0.0, low)
    moving = current is not None and (limits.turnover is not None or limits.cost > 0)
    width = n * (1 + moving)
    pairs = [(1.0, 0.0, high[free] + _RELAX), (-1.0, 0.0, _RELAX - low[free])]
    rows, bounds = [np.zeros((0, width))], []

    def limit(line: np.ndarray, most: float) -> None:
        """line.w <= most over all names."""
        rows.append(np.concatenate([line[free], np.zeros(width - n)])[None, :])
        bounds.append(most - line @ base)

    for j, (least, most) in enumerate(limits.ranges):
        at = exposures[:, j] @ benchmark
        limit(exposures[:, j], at + most)
        limit(-exposures[:, j], -at - least)
    if limits.candidate_floor is not None:
        limit(-candidate.astype(float), -limits.candidate_floor)
    if moving:
        pairs += [(1.0, -1.0, current[free] + _RELAX), (-1.0, -1.0, _RELAX - current[free])]
        if limits.turnover is not None:
            rows.append(np.concatenate([np.zeros(n), np.ones(n)])[None, :])
            bounds.append(2 * limits.turnover - np.abs(base - current)[~free].sum())

    rest, centre = np.where(free, 0.0, low - benchmark), benchmark[free]
    cross, scale, most = 2 * risk.times(rest)[free], None, 0.0
    if limits.tracking_error is not None:
        scale = 1 / limits.tracking_error**2
        most = 1 - scale * (rest @ risk.times(rest)) + scale * (cross @ centre)
    own = risk.among(free)
    problem = _Problem(n, moving, pairs, np.vstack(rows), np.array(bounds, dtype=float) + _RELAX, own, scale, centre, cross * (scale or 0.0), most)

    x = np.concatenate([np.clip(centre, low[free], high[free]), np.zeros(width - n)])
    x[:n] += (1 - base.sum() - x[:n].sum()) / n
    if moving:
        x[n:] = np.abs(x[:n] - current[free]) + 0.01
    widest = -problem.slacks(x).min()
    if widest >= -_RELAX:
        lifted = _minimize(np.append(x, widest + 1), np.append(np.zeros(width), 1.0), 0.0, replace(problem, lifted=True), enough=-min(1e-5, 0.1 / n))
        if lifted[-1] >= -_RELAX / 10:
            raise SolverError("no weights satisfy every limit")
        x = lifted[:-1]
    c = np.concatenate([-score[free], np.full(width - n, limits.cost)])
    aversion = limits.risk_aversion or 0.0
    c[:n] += aversion * (cross / 2 - own.times(centre))
    w[free] = _minimize(x, c, aversion, problem)[:n]
    recheck(w, benchmark, current, low, high, candidate, risk, exposures, limits)
    return w


def recheck(w: np.ndarray, benchmark: np.ndarray, current: np.ndarray | None, low: np.ndarray, high: np.ndarray, candidate: np.ndarray, covariance: Covariance, exposures: np.ndarray, limits: Limits, tolerance: float = 1e-6) -> None:
    """``SolverError`` naming the limits that weights break, worked out from the weights alone."""
    active = w - benchmark
    excess = {"fully invested": abs(w.sum() - 1), "bounds": max((low - w).max(), (w - high).max())}
    if limits.tracking_error is not None:
        excess["tracking error"] = float(np.sqrt(max(active @ covariance.times(active), 0.0))) - limits.tracking_error
    for j, (least, most) in enumerate(limits.ranges):
        at = exposures[:, j] @ active
        excess[f"range {j}"] = max(least - at, at - most)
    if limits.candidate_floor is not None:
        excess["candidate floor"] = limits.candidate_floor - w[candidate].sum()
    if limits.turnover is not None and current is not None:
        excess["turnover"] = np.abs(w - current).sum() / 2 - limits.turnover
    if broken := [f"{name} by {x:.2g}" for name, x in excess.items() if not x <= tolerance]:
        raise SolverError(f"the solution fails the recheck: {', '.join(broken)}")


def optimize(names: DataFrame, limits: Limits) -> DataFrame:
    """``date, variant, ticker, target_weight`` of every name.

    ``names`` has ``date, variant, ticker, score, benchmark_weight,
    current_weight`` (null throughout a group: none held yet; null beside others:
    0), ``tradable, is_candidate, specific_var, loadings, half_loadings`` and
    ``exposures`` (arrays of double, of one length). A name that is not tradable
    stays at its current weight. The job stops at the first group without a
    solution, naming it; an empty table gives an empty result.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ticker")
        group, needed = f"{frame['date'].iloc[0]}, {frame['variant'].iloc[0]}", frame[["score", "benchmark_weight", "specific_var", "loadings", "half_loadings", "exposures"]]
        if needed.isna().any(axis=None):
            raise SolverError(f"{group}: no score, benchmark weight or risk for {frame['ticker'][needed.isna().any(axis=1)].iloc[0]}")
        column = lambda c: frame[c].to_numpy(dtype=float)
        matrix = lambda c: np.array(frame[c].tolist(), dtype=float).reshape(len(frame), -1)
        covariance = Covariance.factored(column("specific_var"), matrix("loadings"), matrix("half_loadings"))
        current = None if frame["current_weight"].isna().all() else np.nan_to_num(column("current_weight"))
        try:
            w = solve(column("score"), column("benchmark_weight"), current, ~frame["tradable"].to_numpy(dtype=bool), frame["is_candidate"].to_numpy(dtype=bool), covariance, matrix("exposures"), limits)
        except SolverError as error:
            raise SolverError(f"{group}: {error}") from error
        return frame[["date", "variant", "ticker"]].assign(target_weight=w)

    return names.groupBy("date", "variant").applyInPandas(one, "date string, variant string, ticker string, target_weight double")
