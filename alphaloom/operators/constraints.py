"""Independent recheck of portfolio limits, as aggregates over long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exposure_sums(weights: DataFrame, exposures: DataFrame) -> DataFrame:
    """``date, portfolio, factor, portfolio_exposure, benchmark_exposure, active_exposure``.

    ``weights`` has ``date, portfolio, ticker, target_weight, benchmark_weight``
    over the whole universe; ``exposures`` has ``date, ticker, factor, exposure``
    (an industry is a factor with exposure 1).
    """
    x = weights.join(exposures, ["date", "ticker"])
    sums = x.groupBy("date", "portfolio", "factor").agg(F.sum(F.col("target_weight") * F.col("exposure")).alias("portfolio_exposure"), F.sum(F.col("benchmark_weight") * F.col("exposure")).alias("benchmark_exposure"))
    return sums.withColumn("active_exposure", F.col("portfolio_exposure") - F.col("benchmark_exposure"))


def weight_checks(weights: DataFrame, max_weight: float, max_active: float, candidate_floor: float | None = None, tolerance: float = 1e-6) -> DataFrame:
    """One row per ``date, portfolio``: sums, extremes, slacks, and whether every limit holds.

    Names that are not tradable are held at their current weight, so stock
    bounds are checked on tradable names only.
    """
    w, b = F.col("target_weight"), F.col("benchmark_weight")
    free = F.when(F.col("tradable"), w)
    active = F.when(F.col("tradable"), F.abs(w - b))
    candidates = F.sum(F.when(F.col("is_candidate"), w).otherwise(0.0))
    report = weights.groupBy("date", "portfolio").agg(
        F.count("*").alias("n"), F.sum(w).alias("weight_sum"), F.min(w).alias("minimum_weight"), F.max(free).alias("maximum_weight"), F.max(active).alias("maximum_active"),
        (F.sum(F.abs(w - b)) / 2).alias("active_share"), candidates.alias("candidate_weight"), F.count_if(w > tolerance).alias("holdings"),
    )
    floor = F.lit(True) if candidate_floor is None else F.col("candidate_weight") >= candidate_floor - tolerance
    passed = (F.abs(F.col("weight_sum") - 1) <= 1e-8) & (F.col("minimum_weight") >= -tolerance) & (F.col("maximum_weight") <= max_weight + tolerance) & (F.col("maximum_active") <= max_active + tolerance) & floor
    return report.withColumn("weight_slack", max_weight - F.col("maximum_weight")).withColumn("active_slack", max_active - F.col("maximum_active")).withColumn("passed", passed)


def range_checks(sums: DataFrame, lower: float, upper: float, tolerance: float = 1e-6) -> DataFrame:
    """``sums`` with slacks of the active exposure against a range around the benchmark, and ``binding`` and ``passed``."""
    low, high = F.col("active_exposure") - lower, upper - F.col("active_exposure")
    checked = sums.withColumn("lower_slack", low).withColumn("upper_slack", high)
    return checked.withColumn("binding", F.least(low, high) <= tolerance).withColumn("passed", (low >= -tolerance) & (high >= -tolerance))
