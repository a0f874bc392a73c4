"""The risk model as of many dates in one job.

Regressions depend on their date alone, so each is run once; an as-of date only
selects and weighs the dates of its window. Nothing after an as-of date enters
its window, its target exposures or its specific variances.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.errors import RiskError
from alphaloom.operators import risk
from alphaloom.operators.calendar import common_calendar
from alphaloom.operators.industry import industry_asof
from alphaloom.sources.publish import settled


@dataclass(frozen=True)
class AsOfModel:
    """Long tables of the model, each with ``as_of``: ``exposures``, ``factor_cov``, ``specific`` and ``periods`` (with the sizes of the regressed dates)."""

    exposures: DataFrame
    factor_cov: DataFrame
    specific: DataFrame
    periods: DataFrame


def last_dates(as_of: DataFrame, days: DataFrame) -> DataFrame:
    """``as_of, date, k``: the last date of ``days`` (``date, k``) on or before each as-of date. Both are calendars, one row a date."""
    marks = days.select(F.col("date").alias("at"), F.struct("date", "k").alias("day"), F.lit(None).cast("string").alias("as_of"))
    asked = as_of.select(F.col("as_of").alias("at"), F.lit(None).cast("struct<date:string,k:int>").alias("day"), "as_of")
    upto = Window.orderBy("at", F.col("as_of").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.union(asked).withColumn("day", F.last("day", ignorenulls=True).over(upto)).where("as_of is not null").select("as_of", "day.date", "day.k")


def windows(as_of: DataFrame, days: DataFrame, regressed: DataFrame, settings: risk.RiskSettings) -> DataFrame:
    """``as_of, date, age``: the regressed dates among the last ``lookback`` of ``days`` (``date, k``), the newest with age 0."""
    last = last_dates(as_of, days)
    back = last.select("as_of", F.explode(F.sequence(F.greatest(F.col("k") - settings.lookback + 1, F.lit(1)), F.col("k"))).alias("k"))
    found = back.join(F.broadcast(days), "k").join(F.broadcast(regressed.select("date").distinct()), "date", "left_semi")
    return found.select("as_of", "date", (F.row_number().over(Window.partitionBy("as_of").orderBy(F.col("date").desc())) - 1).alias("age"))


def complete_windows(window: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``window`` without the dates that lack one of its industries, ages counted anew; and ``as_of, code`` of all that it holds.

    ``codes`` has ``date, code`` of every regression date. The factor list of an
    as-of date is what its window has seen, and a date without one of those
    cannot tell its return.
    """
    seen = window.select("as_of", "date").join(codes, "date")
    listed = seen.select("as_of", "code").distinct()
    wanted = listed.groupBy("as_of").agg(F.count("*").alias("wanted"))
    full = seen.groupBy("as_of", "date").agg(F.count("*").alias("n")).join(wanted, "as_of").where("n = wanted")
    return full.select("as_of", "date", (F.row_number().over(Window.partitionBy("as_of").orderBy(F.col("date").desc())) - 1).alias("age")), listed


def factor_covariance(factor_returns: DataFrame, window: DataFrame, settings: risk.RiskSettings) -> DataFrame:
    """``as_of, factor_a, factor_b, covariance``: exponentially weighted, annualised, shrunk, eigenvalues floored; one task a matrix."""
    weighted = window.select("as_of", "date", F.pow(F.lit(0.5), F.col("age") / settings.factor_halflife).alias("w"))
    a = factor_returns.select("date", F.col("factor").alias("factor_a"), F.col("factor_return").alias("fa"))
    b = factor_returns.select("date", F.col("factor").alias("factor_b"), F.col("factor_return").alias("fb"))
    sums = weighted.join(a.join(b, "date"), "date").groupBy("as_of", "factor_a", "factor_b").agg(
        F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("ss"), F.sum(F.col("w") * F.col("fa")).alias("a"), F.sum(F.col("w") * F.col("fb")).alias("b"), F.sum(F.col("w") * F.col("fa") * F.col("fb")).alias("ab")
    )
    centred = (F.col("ab") / F.col("s") - F.col("a") * F.col("b") / (F.col("s") * F.col("s"))) / (1 - F.col("ss") / (F.col("s") * F.col("s")))
    shrink = F.when(F.col("factor_a") == F.col("factor_b"), 1.0).otherwise(1.0 - settings.factor_shrinkage)
    raw = sums.select("as_of", "factor_a", "factor_b", (centred * settings.periods * shrink).alias("covariance"))

    def repair(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="factor_a", columns="factor_b", values="covariance")
        values, vectors = np.linalg.eigh((wide.to_numpy() + wide.to_numpy().T) / 2)
        fixed = (vectors * np.maximum(values, settings.eigenvalue_floor)) @ vectors.T
        out = pd.DataFrame((fixed + fixed.T) / 2, index=wide.index, columns=wide.columns).rename_axis(columns="factor_b").stack().rename("covariance").reset_index()
        return out.assign(as_of=frame["as_of"].iloc[0])[["as_of", "factor_a", "factor_b", "covariance"]]

    return raw.groupBy("as_of").applyInPandas(repair, "as_of string, factor_a string, factor_b string, covariance double")


def specific_variance(residual: DataFrame, window: DataFrame, settings: risk.RiskSettings) -> DataFrame:
    """``as_of, ticker, specific_var, observations`` of names with enough residuals in the window."""
    w = F.pow(F.lit(0.5), F.col("age") / settings.specific_halflife)
    aged = window.select("as_of", "date", w.alias("w"))
    raw = residual.where("residual is not null").join(F.broadcast(aged), "date").groupBy("as_of", "ticker").agg((F.sum(F.col("w") * F.pow("residual", 2)) / F.sum("w") * settings.periods).alias("v"), F.count("*").alias("observations"))
    kept = raw.where(F.col("observations") >= settings.minimum_specific).withColumn("v", F.greatest("v", F.lit(settings.specific_floor)))
    middle = F.median("v").over(Window.partitionBy("as_of"))
    s = settings.specific_shrinkage
    return kept.select("as_of", "ticker", F.greatest((1 - s) * F.col("v") + s * middle, F.lit(settings.specific_floor)).alias("specific_var"), "observations")


def impute(targets: DataFrame, specific: DataFrame, members: DataFrame | None, settings: risk.RiskSettings) -> DataFrame:
    """``as_of, ticker, specific_var, imputed`` of every target: own, else the median of its industry (``members``: ``as_of, ticker, industry``), else of all; not below the floor."""
    overall = specific.groupBy("as_of").agg(F.median("specific_var").alias("gm"))
    own = targets.join(specific.select("as_of", "ticker", "specific_var"), ["as_of", "ticker"], "left").join(F.broadcast(overall), "as_of", "left")
    if members is None:
        own = own.withColumn("im", F.lit(None).cast("double"))
    else:
        by_industry = specific.join(members, ["as_of", "ticker"]).groupBy("as_of", "industry").agg(F.median("specific_var").alias("im"))
        own = own.join(members, ["as_of", "ticker"], "left").join(F.broadcast(by_industry), ["as_of", "industry"], "left")
    value = F.greatest(F.coalesce("specific_var", "im", "gm"), F.lit(settings.specific_floor))
    return own.select("as_of", "ticker", value.alias("specific_var"), F.col("specific_var").isNull().alias("imputed"))


def estimate(returns: DataFrame, caps: DataFrame, targets: DataFrame, settings: risk.RiskSettings, members: DataFrame | None = None, history: DataFrame | None = None) -> AsOfModel:
    """The model as of each ``as_of`` of ``targets`` (``as_of, ticker``): MARKET and styles, or with ``history`` industries and styles.

    Windows end on the last date on or before the as-of date on which both
    panels have rows; the targets' exposures are standardised over the targets on
    that date. With ``history`` (``ticker, industry, in_date, out_date``) a
    regression uses the industries of its exposure date, a target that of the
    as-of date, and the factor list of an as-of date is what its window has seen.
    Imputation takes the industry's median (of ``members`` without ``history``).

    Refused, naming the dates: too few regressed dates in a window, a target
    without capitalisation, without usable styles, without industry or of one
    that the window has not seen, and more imputed specific variances than
    ``max_imputed``. An as-of date before all history is a date without
    regressions. ``targets`` may repeat rows; an empty table gives an empty model.
    """
    # Kept plans nest and grow long enough that describing them takes longer than running them, so tables are settled.
    targets = settled(targets.select("as_of", "ticker").distinct())
    as_of = targets.select("as_of").distinct()
    days = settled(common_calendar(returns, caps).select("date", F.col("ix").cast("int").alias("k")))
    dated = None if history is None else industry_asof(caps.select("date", "ticker").distinct(), history)
    sections = risk.cross_sections(returns, caps, settings, dated)
    rows = settled(risk.response(risk.exposures(sections, returns, settings), settings))
    market, listed = history is None, None
    if market:
        size_only = settings.styles == ("SIZE",)
        factor_returns = settled(risk.factor_returns_closed(rows) if size_only else risk.factor_returns_wls(rows, settings.styles))
        window = settled(windows(as_of, days, factor_returns, settings))
    else:
        sums = settled(risk.regression_sums(rows, settings.styles, "industry"))
        factor_returns = settled(risk.factor_returns_normal(sums, settings.styles).drop("n_codes"))
        window, listed = complete_windows(windows(as_of, days, sums, settings), sums.select("date", "code"))
        window = window.join(factor_returns.select("date").distinct(), "date", "left_semi")
        window = settled(window.withColumn("age", F.row_number().over(Window.partitionBy("as_of").orderBy("age")) - 1))
    sizes = rows.groupBy("date").agg(F.count("*").alias("n"))
    spans = window.join(sizes, "date").groupBy("as_of").agg(
        F.count("*").alias("periods"), F.min("date").alias("first"), F.max("date").alias("last"), F.min("n").alias("names_min"), F.median("n").alias("names_median"), F.max("n").alias("names_max")
    )
    periods = as_of.join(spans, "as_of", "left").na.fill(0, ["periods"])
    _refuse(periods.where(F.col("periods") < settings.minimum_periods).select("as_of", "periods"), f"fewer than {settings.minimum_periods} regressed dates")

    last = last_dates(as_of, days).select("as_of", F.col("date").alias("exposure_date"))
    asked = F.broadcast(last.select("exposure_date").distinct())
    held = caps.select(F.col("date").alias("exposure_date"), "ticker", "cap").join(asked, "exposure_date", "left_semi")
    valued = settled(targets.join(F.broadcast(last), "as_of").join(held, ["exposure_date", "ticker"], "left"))
    _refuse(valued.where("cap is null or not cap > 0 or cap = double('Infinity')").select("as_of", "ticker"), "targets without capitalisation")
    if not market:
        placed = settled(industry_asof(targets.select(F.col("as_of").alias("date"), "ticker"), history).withColumnRenamed("date", "as_of"))
        _refuse(targets.join(placed, ["as_of", "ticker"], "left_anti"), "targets without industry")
        unseen = placed.select("as_of", F.concat(F.lit("INDUSTRY:"), "industry").alias("code")).distinct().join(listed, ["as_of", "code"], "left_anti")
        _refuse(unseen, "industries of targets that the window has not seen")
        valued = valued.join(placed, ["as_of", "ticker"])
    styled = settled(risk.exposures(valued.drop("date").withColumnRenamed("as_of", "date"), returns, settings))
    _refuse(targets.join(styled.select(F.col("date").alias("as_of"), "ticker"), ["as_of", "ticker"], "left_anti"), "targets without usable styles")
    x = risk.long_exposures(styled, settings.styles, market, not market).withColumnRenamed("date", "as_of")

    own = settled(specific_variance(risk.residuals(rows, factor_returns, settings.styles, market, not market), window, settings))
    if not market:
        members = industry_asof(own.select(F.col("as_of").alias("date"), "ticker").union(targets).distinct(), history).withColumnRenamed("date", "as_of")
    filled = settled(impute(targets, own, members, settings))
    share = filled.groupBy("as_of").agg(F.avg(F.col("imputed").cast("int")).alias("share")).where(F.col("share") > settings.max_imputed)
    _refuse(share, f"more than {settings.max_imputed:.2%} of specific variances are imputed")
    return AsOfModel(x, factor_covariance(factor_returns, window, settings), filled, periods)


def diagnostics(model: AsOfModel) -> DataFrame:
    """One row an as-of date, what a manifest of the model says: window, names regressed, factors, targets, and specific variances.

    Each of the model's tables is combined to one row a date before they meet.
    """
    own = F.col("specific_var")
    specific = model.specific.groupBy("as_of").agg(
        F.count("*").alias("targets"), F.count_if("imputed").alias("imputed"), F.avg(F.col("imputed").cast("int")).alias("imputed_share"), F.min(own).alias("specific_min"), F.median(own).alias("specific_median"), F.max(own).alias("specific_max")
    )
    factors = model.factor_cov.where("factor_a = factor_b").groupBy("as_of").agg(F.count("*").alias("factors"), F.sum(F.sqrt("covariance")).alias("factor_volatility"))
    return model.periods.join(factors, "as_of", "left").join(specific, "as_of", "left")


def _refuse(bad: DataFrame, what: str) -> None:
    if found := bad.orderBy(*bad.columns[:2]).limit(10).collect():
        raise RiskError(f"{what}: {[tuple(r) for r in found]}")
