"""Structural factor risk model: exposures, factor returns, factor covariance and specific risk, in long form.

Each regression date is estimated once for all as-of dates that need it; windows
over as-of dates only slice what is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.errors import RiskError
from alphaloom.functions.expressions import clipped
from alphaloom.operators.calendar import calendar, common_calendar
from alphaloom.operators.covariance import asset_cells
from alphaloom.operators.guards import require_covered, require_finite
from alphaloom.operators.signal import day, with_mad
from alphaloom.sources.publish import settled


#: Names that one task of ``return_styles`` holds, about.
SLICE_NAMES = 4096


@dataclass(frozen=True)
class RiskSettings:
    """Parameters of the risk model; the defaults are for daily data."""

    styles: tuple[str, ...] = ("SIZE",)
    style_lookback: int = 252
    style_minimum: int = 126
    momentum_skip: int = 21
    lookback: int = 300
    minimum_periods: int = 120
    minimum_assets: int = 200
    minimum_specific: int = 60
    return_mad: float = 8.0
    size_mad: float = 5.0
    weight_power: float = 0.5
    factor_halflife: float = 90.0
    specific_halflife: float = 60.0
    factor_shrinkage: float = 0.10
    specific_shrinkage: float = 0.10
    periods: int = 252
    eigenvalue_floor: float = 1e-8
    specific_floor: float = 1e-6
    max_imputed: float = 0.20

    def __post_init__(self) -> None:
        known = {"SIZE", "BETA", "MOMENTUM", "RESVOL", "NLSIZE"}
        if not set(self.styles) <= known or len(set(self.styles)) != len(self.styles):
            raise RiskError(f"style factors must be distinct and among {sorted(known)}")
        if min(self.style_lookback, self.lookback, self.minimum_periods, self.minimum_assets, self.periods) < 1 or self.momentum_skip < 0:
            raise RiskError("lookbacks and minimums must be positive")
        if not 0 <= self.factor_shrinkage <= 1 or not 0 <= self.specific_shrinkage <= 1 or not 0 <= self.max_imputed <= 1:
            raise RiskError("shrinkages and the imputed share must lie in [0, 1]")


def cross_sections(returns: DataFrame, caps: DataFrame, settings: RiskSettings, industries: DataFrame | None = None) -> DataFrame:
    """``date, exposure_date, ticker, return, cap[, industry]`` of every regression date.

    The exposure date is the previous date on which both panels have rows. A
    name needs a return on the date, a positive capitalisation (and, if asked
    for, an industry) on the exposure date; dates with fewer than the minimum of
    names are left out. As in the model's definition, that a return exists on
    the date decides which names the earlier exposures are standardised over.
    """
    common = common_calendar(returns, caps).where("prev_date is not null")
    days = F.broadcast(common.select("date", F.col("prev_date").alias("exposure_date")))
    rows = returns.join(days, "date").join(caps.where("cap > 0").select(F.col("date").alias("exposure_date"), "ticker", "cap"), ["exposure_date", "ticker"])
    if industries is not None:
        rows = rows.join(industries.select(F.col("date").alias("exposure_date"), "ticker", "industry"), ["exposure_date", "ticker"])
    return rows.withColumn("_n", F.count("*").over(day())).where(F.col("_n") >= settings.minimum_assets).drop("_n")


def _standardized(value: str, weight: str) -> Column:
    mean = F.sum(F.col(value) * F.col(weight)).over(day()) / F.sum(weight).over(day())
    variance = F.sum(F.col(weight) * F.pow(F.col(value), 2)).over(day()) / F.sum(weight).over(day()) - mean * mean
    return F.when(variance > 1e-18, (F.col(value) - mean) / F.sqrt(variance))


def size_exposure(sections: DataFrame, settings: RiskSettings) -> DataFrame:
    """``sections`` with regression ``weight`` and ``SIZE``, the weighted standard score of the clipped log capitalisation."""
    rows = sections.withColumn("weight", F.pow("cap", F.lit(settings.weight_power))).withColumn("_log", F.log("cap"))
    cut = with_mad(rows, "_log", "_median", "_mad").withColumn("_cut", clipped("_log", "_median", "_mad", settings.size_mad))
    return cut.withColumn("SIZE", _standardized("_cut", "weight")).drop("_log", "_median", "_mad", "_cut")


def standardize_style(rows: DataFrame, value: str, name: str, multiple: float) -> DataFrame:
    """``rows`` with ``name``: missing values take the date's median, then MAD clip and weighted standard score; null on a date with fewer than two values."""
    filled = rows.withColumn("_n", F.count(value).over(day())).withColumn("_fill", F.coalesce(F.col(value), F.median(value).over(day())))
    cut = with_mad(filled, "_fill", "_median", "_mad").withColumn("_cut", clipped("_fill", "_median", "_mad", multiple))
    return cut.withColumn(name, F.when(F.col("_n") >= 2, _standardized("_cut", "weight"))).drop("_n", "_fill", "_median", "_mad", "_cut")


def nlsize_exposure(sized: DataFrame, settings: RiskSettings) -> DataFrame:
    """``sized`` with ``NLSIZE``: the residual of SIZE cubed on a constant and SIZE (closed form), clipped and standardised."""
    w, x = F.col("weight"), F.col("SIZE")
    total, mean_x, mean_y = F.sum(w).over(day()), F.sum(w * x).over(day()) / F.sum(w).over(day()), F.sum(w * F.pow(x, 3)).over(day()) / F.sum(w).over(day())
    moments = sized.withColumn("_mx", mean_x).withColumn("_my", mean_y)
    dx, dy = F.col("SIZE") - F.col("_mx"), F.pow("SIZE", 3) - F.col("_my")
    slope = F.sum(w * dx * dy).over(day()) / F.sum(w * dx * dx).over(day())
    return standardize_style(moments.withColumn("_res", dy - slope * dx), "_res", "NLSIZE", settings.size_mad).drop("_mx", "_my", "_res")


def return_styles(sections: DataFrame, returns: DataFrame, settings: RiskSettings, slice_names: int = SLICE_NAMES) -> DataFrame:
    """``date, ticker, beta, resvol, momentum`` (raw, null where a name has too few days) over trailing return-panel dates.

    The market is the equal-weight mean of the names selected on the date, so
    dates are taken in blocks as long as the lookback, so that a return is copied
    twice at most, and names in slices of about ``slice_names``. A slice of a block is
    one task: a matrix of two lookbacks of days by the slice's names, and all
    moments as products with it. A first pass sums the market over slices, a
    second has it as a row a date and day. Dates without the minimum of
    earlier rows are left out. Residual volatility follows from the moments of
    return and market without a second pass.
    """
    span = settings.style_lookback
    slices = max(1, -(-(returns.agg(F.approx_count_distinct("ticker")).first()[0] or 0) // slice_names))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(slices)).cast("int").alias("slice")
    days = calendar(returns).select("date", "ix")
    keyed = sections.join(F.broadcast(days.select(F.col("date").alias("exposure_date"), F.col("ix").cast("long").alias("k"))), "exposure_date")
    keyed = keyed.where(F.col("k") + 1 >= settings.style_minimum).select("date", "ticker", "k", F.expr(f"k div {span}").alias("block"), part("ticker"))
    numbered = returns.join(F.broadcast(days), "date").select(F.col("ticker").alias("name"), F.col("ix").cast("long").alias("ix"), F.col("return").cast("double").alias("r"), part("ticker"))
    spread = numbered.withColumn("block", F.explode(F.sequence(F.expr(f"ix div {span}"), F.expr(f"(ix + {span - 1}) div {span}"))))

    def sums(key: tuple[pa.Scalar, pa.Scalar], members: pa.Table, history: pa.Table) -> pa.Table:
        s = _Slice(key[0].as_py() * span - (span - 1), members, history, settings)
        count, total = (s.inside @ s.seen.T) * s.window, (s.inside @ s.raw.T) * s.window
        at, time = np.nonzero(count)
        return pa.table([pa.array(np.full(len(at), key[0].as_py())), pa.array(s.dates[at], pa.string()), pa.array(time + s.start), pa.array(count[at, time]), pa.array(total[at, time])], ["block", "date", "ix", "n", "total"])

    def styles(key: tuple[pa.Scalar, pa.Scalar], members: pa.Table, history: pa.Table) -> pa.Table:
        return _slice_styles(key[0].as_py() * span - (span - 1), members, history, settings)

    grouped = keyed.groupBy("block", "slice")
    market = grouped.cogroup(spread.groupBy("block", "slice")).applyInArrow(sums, "block long, date string, ix long, n double, total double")
    means = market.groupBy("block", "date", "ix").agg((F.sum("total") / F.sum("n")).alias("r"))
    to_all = means.select(F.lit(None).cast("string").alias("name"), "ix", "r", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "block", "date")
    history = spread.select("name", "ix", "r", "slice", "block", F.lit(None).cast("string").alias("date")).union(to_all)
    return grouped.cogroup(history.groupBy("block", "slice")).applyInArrow(styles, "date string, ticker string, beta double, resvol double, momentum double")


class _Slice:
    """Matrices of one block of dates and slice of names, whose history begins at ordinal ``start``: days by names, and dates by names or days."""

    def __init__(self, start: int, members: pa.Table, history: pa.Table, settings: RiskSettings) -> None:
        names = np.intersect1d(members.column("ticker").to_numpy(), history.column("name").to_numpy())
        history = history.filter(pc.is_in(history.column("name"), pa.array(names, pa.string())))
        self.members = members = members.filter(pc.is_in(members.column("ticker"), pa.array(names, pa.string())))
        self.start = start
        self.dates, first, self.day = np.unique(members.column("date").to_numpy(), return_index=True, return_inverse=True)
        self.last = members.column("k").to_numpy()[first] - start
        self.name, at = np.searchsorted(names, members.column("ticker").to_numpy()), np.searchsorted(names, history.column("name").to_numpy())
        when = history.column("ix").to_numpy() - start
        self.raw, self.seen = np.zeros((2 * settings.style_lookback - 1, len(names))), np.zeros((2 * settings.style_lookback - 1, len(names)))
        self.raw[when, at], self.seen[when, at] = history.column("r").to_numpy(), 1.0
        self.inside = np.zeros((len(self.dates), len(names)))
        self.inside[self.day, self.name] = 1.0
        self.time = np.arange(len(self.raw))
        self.window = ((self.time <= self.last[:, None]) & (self.time > self.last[:, None] - settings.style_lookback)).astype(float)


def _slice_styles(start: int, members: pa.Table, history: pa.Table, settings: RiskSettings) -> pa.Table:
    """``return_styles`` of one slice; rows of ``history`` without a name are the market by date and day."""
    means = history.filter(pc.is_null(history.column("name")))
    s = _Slice(start, members, history.filter(pc.is_valid(history.column("name"))), settings)
    members, day, name, raw, seen, window, time, last = s.members, s.day, s.name, s.raw, s.seen, s.window, s.time, s.last
    r = (raw - raw.sum(axis=0) / seen.sum(axis=0)) * seen
    means = means.filter(pc.is_in(means.column("date"), pa.array(s.dates, pa.string())))
    at, when = np.searchsorted(s.dates, means.column("date").to_numpy()), means.column("ix").to_numpy() - start
    market, held = np.zeros(window.shape), np.zeros(window.shape)
    market[at, when], held[at, when] = means.column("r").to_numpy(), 1.0
    c = (market - market.sum(axis=1, keepdims=True) / np.maximum(held.sum(axis=1, keepdims=True), 1)) * held
    usable = seen * (raw > -1)
    recent = window * (time <= last[:, None] - settings.momentum_skip)
    pick = lambda product: product[day, name]
    n, sr, srr = pick(window @ seen), pick(window @ r), pick(window @ (r * r))
    sc, scc, src = pick(c @ seen), pick((c * c) @ seen), pick(c @ r)
    nm, mom = pick(recent @ usable), pick(recent @ np.log1p(np.where(usable > 0, raw, 0.0)))

    enough = n >= settings.style_minimum
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = src - sr * sc / n
        beta = np.where(enough & (scc > 0), cov / scc, np.nan)
        spread = (srr - sr * sr / n + beta**2 * (scc - sc * sc / n) - 2 * beta * cov) / (n - 1)
    resvol = np.where(enough, np.sqrt(np.fmax(spread, 0.0)), np.nan)
    values = [pa.array(x, mask=np.isnan(x)) for x in (beta, resvol, np.where(nm >= settings.style_minimum, mom, np.nan))]
    out = pa.table([members.column("date"), members.column("ticker"), *values], ["date", "ticker", "beta", "resvol", "momentum"])
    return out.filter(pa.array(n > 0))


def exposures(sections: DataFrame, returns: DataFrame, settings: RiskSettings) -> DataFrame:
    """``sections`` with ``weight`` and one column per requested style, without dates on which a style is unusable."""
    out = size_exposure(sections, settings)
    if "NLSIZE" in settings.styles:
        out = nlsize_exposure(out, settings)
    raw = {"BETA": "_raw_beta", "RESVOL": "_raw_resvol", "MOMENTUM": "_raw_momentum"}
    asked = [s for s in settings.styles if s in raw]
    if asked:
        history = return_styles(sections, returns, settings).toDF("date", "ticker", "_raw_beta", "_raw_resvol", "_raw_momentum").persist()
        out = out.join(history, ["date", "ticker"], "left").join(history.select("date").distinct(), "date", "left_semi")
        for style in asked:
            out = standardize_style(out, raw[style], style, settings.return_mad)
        out = out.drop(*raw.values())
    usable = F.lit(True)
    for style in settings.styles:
        usable &= F.col(style).isNotNull()
    keep = [c for c in out.columns if c not in {"SIZE", "NLSIZE"} - set(settings.styles)]
    return out.where(usable).select(keep)


def response(rows: DataFrame, settings: RiskSettings) -> DataFrame:
    """``rows`` with ``y``, the date's MAD-clipped return."""
    return with_mad(rows, "return", "_median", "_mad").withColumn("y", clipped("return", "_median", "_mad", settings.return_mad)).drop("_median", "_mad")


def factor_returns_closed(rows: DataFrame) -> DataFrame:
    """``date, factor, factor_return`` of the MARKET + SIZE model: SIZE has weighted mean 0 and variance 1, so both are weighted means."""
    w = F.col("weight")
    sums = rows.groupBy("date").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("MARKET"), (F.sum(w * F.col("y") * F.col("SIZE")) / F.sum(w)).alias("SIZE"))
    return sums.unpivot("date", ["MARKET", "SIZE"], "factor", "factor_return")


def factor_returns_wls(rows: DataFrame, styles: tuple[str, ...], industries: tuple[str, ...] = ()) -> DataFrame:
    """``date, factor, factor_return`` by weighted least squares, one small regression per date.

    With industries there is no MARKET intercept; a date whose design lacks full
    rank (such as one on which a listed industry has no name) is left out.
    """
    names = [*([] if industries else ["MARKET"]), *styles, *(f"INDUSTRY:{c}" for c in industries)]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        blocks = [] if industries else [np.ones((len(frame), 1))]
        blocks.append(frame[list(styles)].to_numpy(float))
        blocks += [(frame["industry"] == c).to_numpy(float)[:, None] for c in industries]
        root = np.sqrt(frame["weight"].to_numpy() / frame["weight"].mean())
        solution, _, rank, _ = np.linalg.lstsq(np.column_stack(blocks) * root[:, None], frame["y"].to_numpy() * root, rcond=None)
        if rank < len(names):
            return pd.DataFrame({"date": [], "factor": [], "factor_return": []}).astype({"date": str, "factor": str, "factor_return": float})
        return pd.DataFrame({"date": frame["date"].iloc[0], "factor": names, "factor_return": solution})

    used = ["date", "weight", "y", *styles, *(["industry"] if industries else [])]
    return rows.select(used).groupBy("date").applyInPandas(solve, "date string, factor string, factor_return double")


def regression_sums(rows: DataFrame, styles: tuple[str, ...], group: str | None = None) -> DataFrame:
    """``date, code, w, y, x_<i>, xy_<i>, xx_<i>_<j>``: weighted sums by date and industry (``group``; none: one code, MARKET).

    These are all entries of a date's normal equations that are not zero, since a
    name has one industry. They are combined before the shuffle, so what a date
    sends does not grow with its names.
    """
    w, y = F.col("weight"), F.col("y")
    sums = {"w": w, "y": w * y} | {f"x_{i}": w * F.col(a) for i, a in enumerate(styles)} | {f"xy_{i}": w * F.col(a) * y for i, a in enumerate(styles)}
    sums |= {f"xx_{i}_{j}": w * F.col(a) * F.col(b) for i, a in enumerate(styles) for j, b in enumerate(styles) if i <= j}
    code = F.lit("MARKET") if group is None else F.concat(F.lit("INDUSTRY:"), F.col(group))
    return rows.withColumn("code", code).groupBy("date", "code").agg(*(F.sum(c).alias(k) for k, c in sums.items()))


def factor_returns_normal(sums: DataFrame, styles: tuple[str, ...]) -> DataFrame:
    """``date, factor, factor_return, n_codes`` from ``regression_sums``: weighted least squares on the date's own codes and the styles.

    One row a code goes to a date's group. The codes' dummies are eliminated
    first, which leaves a system in the styles alone; a date on which it lacks
    full rank (styles that are equal to each other or constant within every
    industry) is left out.
    """
    k = len(styles)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("code")
        w, y = frame["w"].to_numpy(), frame["y"].to_numpy()
        x = frame[[f"x_{i}" for i in range(k)]].to_numpy().reshape(len(frame), k)
        xx, xy = np.zeros((k, k)), frame[[f"xy_{i}" for i in range(k)]].sum().to_numpy()
        for i in range(k):
            for j in range(i, k):
                xx[i, j] = xx[j, i] = frame[f"xx_{i}_{j}"].sum()
        within = xx - (x / w[:, None]).T @ x
        scale = np.sqrt(np.diag(xx))
        if k and (not (scale > 0).all() or np.linalg.eigvalsh(within / np.outer(scale, scale))[0] <= 1e-10):
            return pd.DataFrame({"date": [], "factor": [], "factor_return": [], "n_codes": []}).astype({"date": str, "factor": str, "factor_return": float, "n_codes": int})
        slopes = np.linalg.solve(within, xy - (x / w[:, None]).T @ y) if k else np.zeros(0)
        levels = (y - x @ slopes) / w
        return pd.DataFrame({"date": frame["date"].iloc[0], "factor": [*styles, *frame["code"]], "factor_return": [*slopes, *levels], "n_codes": len(frame)})

    return sums.groupBy("date").applyInPandas(solve, "date string, factor string, factor_return double, n_codes long")


def long_exposures(rows: DataFrame, styles: tuple[str, ...], market: bool = True, industry: bool = False) -> DataFrame:
    """``date, ticker, factor, exposure``: MARKET (or industry indicators) and styles."""
    pieces = [F.struct(F.lit(s).alias("factor"), F.col(s).alias("exposure")) for s in styles]
    if market:
        pieces.append(F.struct(F.lit("MARKET").alias("factor"), F.lit(1.0).alias("exposure")))
    if industry:
        pieces.append(F.struct(F.concat(F.lit("INDUSTRY:"), "industry").alias("factor"), F.lit(1.0).alias("exposure")))
    return rows.select("date", "ticker", F.explode(F.array(*pieces)).alias("p")).select("date", "ticker", "p.factor", "p.exposure")


def residuals(rows: DataFrame, factor_returns: DataFrame, styles: tuple[str, ...], market: bool = True, industry: bool = False) -> DataFrame:
    """``date, ticker, residual`` on the dates that have factor returns; a name none of whose factors has one is left out.

    A date's factor returns are one row that is broadcast, a calendar's worth, so
    rows are neither copied once a factor nor shuffled.
    """
    by_date = factor_returns.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("factor", "factor_return"))).alias("_returns"))
    held = [(F.lit(s), F.col(s)) for s in styles]
    if market:
        held.append((F.lit("MARKET"), F.lit(1.0)))
    if industry:
        held.append((F.concat(F.lit("INDUSTRY:"), "industry"), F.lit(1.0)))
    parts = [exposure * F.try_element_at("_returns", factor) for factor, exposure in held]
    fit = F.when(F.coalesce(*parts).isNotNull(), sum(F.coalesce(p, F.lit(0.0)) for p in parts))
    known = reduce(Column.__or__, [F.map_contains_key("_returns", factor) for factor, _ in held])
    return rows.join(F.broadcast(by_date), "date").where(known).select("date", "ticker", (F.col("y") - fit).alias("residual"))


def _aged(days: DataFrame, halflife: float, lookback: int) -> DataFrame:
    """The last ``lookback`` dates with ``w = 0.5 ^ (age / halflife)``; the newest has age 0."""
    aged = days.select("date").distinct().withColumn("age", F.row_number().over(Window.orderBy(F.col("date").desc())) - 1)
    return aged.where(F.col("age") < lookback).withColumn("w", F.pow(F.lit(0.5), F.col("age") / halflife))


def ewma_covariance(factor_returns: DataFrame, settings: RiskSettings) -> DataFrame:
    """``factor_a, factor_b, covariance``: annualised, shrunk towards its diagonal; before the eigenvalue floor."""
    days = F.broadcast(_aged(factor_returns, settings.factor_halflife, settings.lookback))
    total = days.agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"))
    weighted = factor_returns.join(days, "date").crossJoin(F.broadcast(total)).withColumn("p", F.col("w") / F.col("sw"))
    means = weighted.groupBy("factor").agg(F.sum(F.col("p") * F.col("factor_return")).alias("mean"))
    centred = weighted.join(F.broadcast(means), "factor").select("date", "factor", "p", (F.col("factor_return") - F.col("mean")).alias("c"), (1 - F.col("sw2") / (F.col("sw") * F.col("sw"))).alias("scale"))
    a = centred.select("date", F.col("factor").alias("factor_a"), "p", F.col("c").alias("ca"), "scale")
    b = centred.select("date", F.col("factor").alias("factor_b"), F.col("c").alias("cb"))
    shrink = F.when(F.col("factor_a") == F.col("factor_b"), 1.0).otherwise(1.0 - settings.factor_shrinkage)
    return a.join(b, "date").groupBy("factor_a", "factor_b").agg((F.sum(F.col("p") * F.col("ca") * F.col("cb")) / F.max("scale") * settings.periods).alias("raw")).select("factor_a", "factor_b", (F.col("raw") * shrink).alias("covariance"))


def floor_eigenvalues(covariance: DataFrame, floor: float) -> DataFrame:
    """The covariance with eigenvalues raised to ``floor``; the matrix has one row per pair of factors, so one task holds it."""

    def repair(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="factor_a", columns="factor_b", values="covariance")
        values, vectors = np.linalg.eigh((wide.to_numpy() + wide.to_numpy().T) / 2)
        fixed = (vectors * np.maximum(values, floor)) @ vectors.T
        out = pd.DataFrame((fixed + fixed.T) / 2, index=wide.index, columns=wide.columns).stack().rename("covariance")
        out.index.names = ["factor_a", "factor_b"]
        return out.reset_index()

    return covariance.groupBy(F.lit("all").alias("matrix")).applyInPandas(repair, "factor_a string, factor_b string, covariance double")


def specific_variance(residual: DataFrame, settings: RiskSettings) -> DataFrame:
    """``ticker, specific_var, observations``: exponentially weighted mean square, floored, shrunk to the cross-section's median, floored again."""
    days = F.broadcast(_aged(residual, settings.specific_halflife, settings.lookback))
    raw = residual.where("residual is not null").join(days, "date").groupBy("ticker").agg((F.sum(F.col("w") * F.pow("residual", 2)) / F.sum("w") * settings.periods).alias("v"), F.count("*").alias("observations"))
    kept = raw.where(F.col("observations") >= settings.minimum_specific).withColumn("v", F.greatest("v", F.lit(settings.specific_floor)))
    middle = F.broadcast(kept.agg(F.median("v").alias("middle")))
    s = settings.specific_shrinkage
    return kept.crossJoin(middle).select("ticker", F.greatest((1 - s) * F.col("v") + s * F.col("middle"), F.lit(settings.specific_floor)).alias("specific_var"), "observations")


def impute_specific(targets: DataFrame, specific: DataFrame, members: DataFrame, settings: RiskSettings) -> DataFrame:
    """``ticker, specific_var, imputed`` for ``targets``: own value, else the industry's median, else the global median.

    The imputed share is worked out at once; beyond ``max_imputed`` it is an error.
    What is read several times, a row a name, is worked out once before.
    """
    specific, members = settled(specific.select("ticker", "specific_var")), settled(members.select("ticker", "industry").distinct())
    rated = members.join(specific, "ticker")
    by_industry = F.broadcast(rated.groupBy("industry").agg(F.median("specific_var").alias("im")))
    overall = F.broadcast(specific.agg(F.median("specific_var").alias("gm")))
    own = targets.select("ticker").distinct().join(members, "ticker", "left").join(specific, "ticker", "left")
    filled = own.join(by_industry, "industry", "left").crossJoin(overall).select("ticker", F.coalesce("specific_var", "im", "gm").alias("specific_var"), F.col("specific_var").isNull().alias("imputed"))
    filled = settled(filled)
    share = filled.agg(F.avg(F.col("imputed").cast("int"))).first()[0] or 0.0
    if share > settings.max_imputed:
        raise RiskError(f"specific variance is imputed for {share:.2%} of the names; the limit is {settings.max_imputed:.2%}")
    return filled


def asset_covariance(exposure: DataFrame, factor_cov: DataFrame, specific: DataFrame) -> DataFrame:
    """``row_ticker, col_ticker, covariance`` of a universe: X F X' + D, for export; risk itself is computed factored."""
    return asset_cells(exposure, factor_cov, specific)


def portfolio_variance(weights: DataFrame, exposure: DataFrame, factor_cov: DataFrame, specific: DataFrame) -> DataFrame:
    """``portfolio, factor_variance, specific_variance, variance, volatility``, factored: z'Fz + sum d w^2 with z = X'w."""
    z = weights.join(exposure.select("ticker", "factor", "exposure"), "ticker").groupBy("portfolio", "factor").agg(F.sum(F.col("weight") * F.col("exposure")).alias("z"))
    za, zb = z.select("portfolio", F.col("factor").alias("factor_a"), F.col("z").alias("za")), z.select("portfolio", F.col("factor").alias("factor_b"), F.col("z").alias("zb"))
    common = za.join(F.broadcast(factor_cov), "factor_a").join(zb, ["portfolio", "factor_b"]).groupBy("portfolio").agg(F.sum(F.col("za") * F.col("covariance") * F.col("zb")).alias("factor_variance"))
    own = weights.join(specific.select("ticker", "specific_var"), "ticker").groupBy("portfolio").agg(F.sum(F.col("specific_var") * F.pow("weight", 2)).alias("specific_variance"))
    total = F.greatest(F.col("factor_variance") + F.col("specific_variance"), F.lit(0.0))
    return common.join(own, "portfolio").select("portfolio", "factor_variance", "specific_variance", total.alias("variance"), F.sqrt(total).alias("volatility"))


def portfolio_metrics(book: DataFrame, exposure: DataFrame, factor_cov: DataFrame, specific: DataFrame) -> DataFrame:
    """``portfolio, expected_return, active_expected_return, variance, volatility, tracking_variance, tracking_error`` of each portfolio.

    ``book`` has ``portfolio, ticker, target_weight, benchmark_weight,
    expected_return``. Risk is factored, for weights and active weights in one
    pass; no asset covariance is formed. A name of non-zero weight or active weight
    that the model lacks, or without an expected return, is refused.
    """
    moved = book.where("target_weight <> 0 or benchmark_weight <> 0")
    require_covered(moved, specific.join(exposure.select("ticker"), "ticker", "left_semi"), ["ticker"], "risk model")
    require_finite(moved, ["target_weight", "benchmark_weight", "expected_return"], "portfolio")
    checked = moved.select("portfolio", "ticker", "target_weight", (F.col("target_weight") - F.col("benchmark_weight")).alias("active"), "expected_return")
    expected = checked.groupBy("portfolio").agg(F.sum(F.col("target_weight") * F.col("expected_return")).alias("expected_return"), F.sum(F.col("active") * F.col("expected_return")).alias("active_expected_return"))
    sides = F.explode(F.array(F.struct(F.lit("held").alias("side"), F.col("target_weight").alias("weight")), F.struct(F.lit("active").alias("side"), F.col("active").alias("weight"))))
    both = checked.select("portfolio", "ticker", sides.alias("s")).where("s.weight <> 0").select(F.struct("portfolio", "s.side").alias("portfolio"), "ticker", "s.weight")
    risks = portfolio_variance(both, exposure, factor_cov, specific).groupBy(F.col("portfolio.portfolio").alias("portfolio"))
    of = lambda side: F.coalesce(F.max(F.when(F.col("portfolio.side") == side, F.col("variance"))), F.lit(0.0))
    measured = expected.join(risks.agg(of("held").alias("variance"), of("active").alias("tracking_variance")), "portfolio", "left").na.fill(0.0, ["variance", "tracking_variance"])
    return measured.select("portfolio", "expected_return", "active_expected_return", "variance", F.sqrt("variance").alias("volatility"), "tracking_variance", F.sqrt("tracking_variance").alias("tracking_error"))
