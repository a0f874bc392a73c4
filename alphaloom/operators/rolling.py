"""Single-date and rolling runs: the optimiser's input with its refusals, and targets along a path of rebalance dates.

A rebalance starts from what the last one has drifted to, so a variant's dates
follow each other; variants do not depend on each other. Universe, policies,
growth between dates and risk are tables for all dates at once, and only the
solves run date by date, each in a grouped map by variant.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.errors import InputError, SolverError
from alphaloom.operators import optimize
from alphaloom.operators.calendar import calendar
from alphaloom.operators.guards import require_covered, require_unique
from alphaloom.operators.signal import optimizer_universe
from alphaloom.sources.publish import shared_folder

TOLERANCE = 1e-8


def problem(calibrated: DataFrame, candidates: DataFrame, benchmark: DataFrame, tradability: DataFrame | None = None, current: DataFrame | None = None, policy: str = "error_except_frozen") -> DataFrame:
    """``date, ticker, score, expected_return, benchmark_weight, current_weight, tradable, is_candidate, was_missing`` of the optimiser's names.

    The universe of a date is its candidates, benchmark names and current
    holdings above the tolerance. A name without a score counts as 0; under
    ``error_except_frozen`` that is refused unless it is held and not tradable.
    Also refused: candidates outside the signal, a name with a null or no
    tradability (if given), names that cannot trade while nothing is held.
    Without ``current`` the current weight is null; a name that is not held has 0.
    """
    if policy not in ("error_except_frozen", "neutral_score"):
        raise InputError(f"unknown policy for missing predictions: {policy!r}")
    require_covered(candidates, calibrated, ["date", "ticker"], "signal of the candidates")
    for table, label in ((calibrated, "signal"), (benchmark, "benchmark"), *(((current, "current weights"),) if current is not None else ())):
        require_unique(table, ["date", "ticker"], label)
    keys = ["date", "ticker"]
    universe = optimizer_universe(candidates, benchmark, current, TOLERANCE)
    scored = calibrated.select(*keys, "signal_score", "expected_return")
    names = universe.join(scored, keys, "left").join(benchmark.select(*keys, "benchmark_weight"), keys, "left").join(candidates.select(*keys).distinct().withColumn("is_candidate", F.lit(True)), keys, "left")
    if tradability is None:
        names = names.withColumn("tradable", F.lit(True))
    else:
        require_covered(universe, tradability.where("tradable is not null"), keys, "tradability")
        names = names.join(tradability.select(*keys, "tradable"), keys)
    held = F.lit(None).cast("double")
    if current is not None:
        names = names.join(current.select(*keys, F.col("current_weight").alias("_held")), keys, "left")
        held = F.coalesce("_held", F.lit(0.0))
    missing = F.col("signal_score").isNull()
    out = names.select(
        *keys, F.coalesce("signal_score", F.lit(0.0)).alias("score"), F.coalesce("expected_return", F.lit(0.0)).alias("expected_return"), F.coalesce("benchmark_weight", F.lit(0.0)).alias("benchmark_weight"),
        held.alias("current_weight"), "tradable", F.coalesce("is_candidate", F.lit(False)).alias("is_candidate"), missing.alias("was_missing"),
    )
    frozen = ~F.col("tradable") & (F.coalesce("current_weight", F.lit(0.0)) > TOLERANCE)
    checks = {"names that cannot trade need current weights": ~F.col("tradable") & F.col("current_weight").isNull()}
    if policy == "error_except_frozen":
        checks["names without a prediction"] = F.col("was_missing") & ~frozen
    bad = out.select(*keys, *[c.alias(f"_{i}") for i, c in enumerate(checks.values())]).where(" or ".join(f"_{i}" for i in range(len(checks)))).orderBy(*keys).limit(10).collect()
    if bad:
        raise InputError("; ".join(f"{what}: {[(r.date, r.ticker) for r in bad if r[f'_{i}']]}" for i, what in enumerate(checks) if any(r[f"_{i}"] for r in bad)))
    return out


def growth_between(returns: DataFrame, dates: DataFrame) -> DataFrame:
    """``date, ticker, growth``: the product of 1 + return after the previous of ``dates`` (one row a date) up to each, inclusive.

    On the first date everything before it counts. A name without a return on one of the days has no row.
    """
    days = calendar(returns).select("date", "ix")
    marked = days.join(dates.select("date", F.col("date").alias("stop")), "date", "left")
    stops = marked.withColumn("stop", F.min("stop").over(Window.orderBy("ix").rowsBetween(Window.currentRow, Window.unboundedFollowing))).where("stop is not null")
    spans = stops.groupBy("stop").agg(F.count("*").alias("days"))
    grown = returns.join(F.broadcast(stops.select("date", "stop")), "date").groupBy("stop", "ticker").agg(F.product(1 + F.col("return")).alias("growth"), F.count("*").alias("n"))
    return grown.join(F.broadcast(spans), "stop").where("n = days").select(F.col("stop").alias("date"), "ticker", "growth")


TARGETS = "date string, variant string, ticker string, current_weight double, target_weight double"


def rolling_targets(names: DataFrame, limits: optimize.Limits, initial: DataFrame | None = None) -> DataFrame:
    """``date, variant, ticker, current_weight, target_weight`` along each variant's dates.

    ``names`` has ``date, variant, ticker, score`` (null: no prediction),
    ``benchmark_weight, tradable, is_candidate, specific_var, loadings,
    half_loadings, exposures`` and ``growth`` for every name that may be held.
    Between dates weights drift by ``growth``. A date's universe is its
    candidates, benchmark names and holdings above the tolerance. ``initial``
    (``variant, ticker, weight``) is held before the first date; without it
    nothing is. The job stops, naming variant and date, at a holding without a row or growth, a
    name without a prediction that is not a frozen holding, and a date without a
    solution. Dates are run one after the other when this is called, from files
    in the shared folder: a task holds one variant's names of one date.
    """
    spark = names.sparkSession
    start = initial if initial is not None else spark.createDataFrame([], "variant string, ticker string, weight double")
    columns = ["date", "variant", "ticker", "score", "benchmark_weight", "tradable", "is_candidate", "specific_var", "loadings", "half_loadings", "exposures", "growth"]
    folder = f"{shared_folder(spark)}/path-{uuid.uuid4().hex}"
    wanted, held = f"{folder}/names", f"{folder}/held"
    given = names.select(columns)
    given.repartition("date", "variant").write.partitionBy("date").parquet(wanted)
    start.select("variant", "ticker", "weight").write.parquet(held)
    given, start = spark.read.schema(given.schema).parquet(wanted), spark.read.parquet(held)

    def step(key: tuple[str], rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        date = rows["date"].iloc[0]
        where, rows = f"{key[0]}, {date}", rows.sort_values("ticker").set_index("ticker")
        if not rows.index.is_unique:
            raise SolverError(f"{where}: repeated names")
        current = pd.Series(held["weight"].to_numpy(float), index=held["ticker"]) if len(held) else None
        if current is not None:
            grown = rows["growth"].reindex(current.index) if held["drifts"].iloc[0] else pd.Series(1.0, index=current.index)
            lost = current.index[(grown.isna() | ~current.index.isin(rows.index)).to_numpy()]
            if len(lost):
                raise SolverError(f"{where}: nothing known of the held {lost[0]}")
            current = current * grown
            if not current.sum() > 0:
                raise SolverError(f"{where}: nothing is left")
            current = current / current.sum()
        holding = np.zeros(len(rows)) if current is None else current.reindex(rows.index).fillna(0.0).to_numpy()
        inside = rows["is_candidate"].to_numpy(bool) | (rows["benchmark_weight"].to_numpy(float) > TOLERANCE) | (holding > TOLERANCE)
        rows, holding = rows[inside], holding[inside]
        frozen, score = ~rows["tradable"].to_numpy(bool), rows["score"].to_numpy(float)
        absent = np.isnan(score)
        if (wrong := absent & ~(frozen & (holding > TOLERANCE))).any():
            raise SolverError(f"{where}: no prediction for {rows.index[wrong][0]}")
        if current is None and frozen.any():
            raise SolverError(f"{where}: {rows.index[frozen][0]} cannot trade and nothing is held")
        matrix = lambda c: np.array(rows[c].tolist(), dtype=float).reshape(len(rows), -1)
        risk = optimize.Covariance.factored(rows["specific_var"].to_numpy(float), matrix("loadings"), matrix("half_loadings"))
        try:
            w = optimize.solve(np.where(absent, 0.0, score), rows["benchmark_weight"].to_numpy(float), None if current is None else holding, frozen, rows["is_candidate"].to_numpy(bool), risk, matrix("exposures"), limits)
        except SolverError as error:
            raise SolverError(f"{where}: {error}") from error
        return pd.DataFrame({"date": date, "variant": key[0], "ticker": rows.index, "current_weight": np.nan if current is None else holding, "target_weight": w})

    last: dict[str, str] = {}
    dates: dict[str, list[str]] = {}
    for r in given.select("date", "variant").distinct().collect():  # dates times variants
        dates.setdefault(r.date, []).append(r.variant)
    written = lambda date: f"{folder}/targets/date={date}"
    for date in sorted(dates):
        today = dates[date]
        holding = start.where(F.col("variant").isin([v for v in today if v not in last])).withColumn("drifts", F.lit(False))
        for before in sorted({last[v] for v in today if v in last}):
            found = spark.read.schema(TARGETS).parquet(written(before)).where(F.col("variant").isin([v for v in today if last.get(v) == before]) & (F.col("target_weight") > TOLERANCE))
            holding = holding.union(found.select("variant", "ticker", F.col("target_weight").alias("weight"), F.lit(True)))
        solved = given.where(F.col("date") == date).groupBy("variant").cogroup(holding.groupBy("variant")).applyInPandas(step, TARGETS)
        solved.write.parquet(written(date))
        last |= dict.fromkeys(today, date)
    return spark.read.schema(TARGETS).parquet(*map(written, sorted(dates))) if dates else spark.createDataFrame([], TARGETS)


def tracking_error(weights: DataFrame, names: DataFrame) -> DataFrame:
    """``date, portfolio, tracking_error`` of ``weights`` (``date, portfolio, ticker, target_weight, benchmark_weight``) by the factored risk of ``names`` (``date, ticker, specific_var, loadings, half_loadings``)."""
    held = weights.select("date", "portfolio", "ticker", (F.col("target_weight") - F.col("benchmark_weight")).alias("a")).join(names.select("date", "ticker", "specific_var", "loadings", "half_loadings"), ["date", "ticker"])
    own = held.groupBy("date", "portfolio").agg(F.sum(F.col("specific_var") * F.col("a") * F.col("a")).alias("own"))
    by_factor = held.select("date", "portfolio", "a", F.posexplode(F.arrays_zip("loadings", "half_loadings")).alias("factor", "x")).groupBy("date", "portfolio", "factor").agg(F.sum(F.col("a") * F.col("x.loadings")).alias("z"), F.sum(F.col("a") * F.col("x.half_loadings")).alias("h"))
    common = by_factor.groupBy("date", "portfolio").agg(F.sum(F.col("z") * F.col("h")).alias("common"))
    return own.join(common, ["date", "portfolio"]).select("date", "portfolio", F.sqrt(F.greatest(F.col("own") + F.col("common"), F.lit(0.0))).alias("tracking_error"))


def constraint_report(weights: DataFrame, limits: optimize.Limits, risk: DataFrame | None = None, tolerance: float = 1e-6, sum_tolerance: float = 1e-8) -> DataFrame:
    """``date, portfolio, constraint, value, bound, excess, status`` of every limit that applies, recomputed from the weights alone.

    ``weights`` has ``date, portfolio, ticker, target_weight, benchmark_weight,
    current_weight`` (null throughout a portfolio's date: nothing held),
    ``tradable`` and ``is_candidate``; ``risk`` has ``date, portfolio,
    tracking_error``. Stock bounds hold for names that can trade, or all if
    nothing is held. ``status`` is violated above the tolerance, binding within
    it and slack below; a limit that does not apply has no row.
    """
    w, b, c = F.col("target_weight"), F.col("benchmark_weight"), F.coalesce("current_weight", F.lit(0.0))
    day = Window.partitionBy("date", "portfolio")
    marked = weights.withColumn("_held", F.max(F.col("current_weight").isNotNull()).over(day)).withColumn("_bound", F.col("tradable") | ~F.col("_held"))
    frozen = F.col("_held") & ~F.col("tradable")
    sums = marked.groupBy("date", "portfolio").agg(
        F.bool_or("_held").alias("held"), F.abs(F.sum(w) - 1).alias("sum_error"), F.min(w).alias("least"), F.max(F.when(F.col("_bound"), w)).alias("most"), F.max(F.when(F.col("_bound"), F.abs(w - b))).alias("active"),
        (F.sum(F.abs(w - c)) / 2).alias("turnover"), F.sum(F.when(F.col("is_candidate"), w).otherwise(0.0)).alias("candidates"), F.max(F.when(frozen, F.abs(w - c))).alias("moved"),
    )
    if risk is not None:
        sums = sums.join(risk.select("date", "portfolio", "tracking_error"), ["date", "portfolio"], "left")

    def line(name: str, value, bound: float, upper: bool = True):
        excess = value - bound if upper else bound - value
        return F.struct(F.lit(name).alias("constraint"), value.alias("value"), F.lit(float(bound)).alias("bound"), excess.alias("excess"))

    lines = [
        line("fully_invested", F.col("sum_error"), sum_tolerance), line("long_only", F.col("least"), 0.0, upper=False), line("max_weight", F.coalesce("most", F.lit(0.0)), limits.max_weight),
        line("max_active_weight", F.coalesce("active", F.lit(0.0)), limits.max_active), line("tradability_freeze", F.col("moved"), 0.0),
    ]
    if limits.turnover is not None:
        lines.append(line("max_turnover", F.when(F.col("held"), F.col("turnover")), limits.turnover))
    if limits.tracking_error is not None and risk is not None:
        lines.append(line("max_tracking_error", F.col("tracking_error"), limits.tracking_error))
    if limits.candidate_floor is not None:
        lines.append(line("candidate_weight_range:lower", F.col("candidates"), limits.candidate_floor, upper=False))
    long = sums.select("date", "portfolio", F.explode(F.array(*lines)).alias("l")).select("date", "portfolio", "l.*").where("value is not null")
    status = F.when(F.col("excess") > tolerance, "violated").when(F.abs("excess") <= tolerance, "binding").otherwise("slack")
    return long.withColumn("status", status)
