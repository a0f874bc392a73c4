"""Active-exposure ranges from a table of limits, and their lines in the constraint report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.errors import ConfigError
from alphaloom.sources.publish import settled

LIMITS = "family string, factor string, date string, lower double, upper double, target double, tolerance double, enabled boolean"
#: Keys of a limit that must be given, from the least specific to the most.
LEVELS = {"family": (False, False), "family on a date": (False, True), "factor": (True, False), "factor on a date": (True, True)}


def _refuse(bad: DataFrame, what: str) -> None:
    if found := bad.distinct().orderBy(*bad.columns).limit(10).collect():
        raise ConfigError(f"{what}: {[tuple(r) for r in found]}")


def resolve_ranges(factors: DataFrame, limits: DataFrame) -> DataFrame:
    """``date, factor, lower, upper, level`` of every ``date, factor`` (with ``family``) that a limit holds for.

    ``limits`` has the columns of ``LIMITS``. A limit without factor holds for
    its family, one without date for all dates; the most specific one decides,
    as a whole. It gives lower and upper bound, or a target and a tolerance
    around it; ``enabled`` false lifts the range. Refused: two limits of one
    key, bounds that are missing, not finite or crossed, factors that no date
    has, and a family with limits of single factors that leave others without.
    """
    enabled, given = F.coalesce("enabled", F.lit(True)), F.coalesce(F.col("lower"), F.col("target") - F.col("tolerance"))
    clean = limits.select("family", "factor", "date", enabled.alias("enabled"), given.alias("lower"), F.coalesce(F.col("upper"), F.col("target") + F.col("tolerance")).alias("upper"))
    clean, factors = settled(clean), settled(factors.select("family", "date", "factor"))  # each refusal below reads both
    keys = ["family", "factor", "date"]
    _refuse(clean.groupBy(*keys).count().where("count > 1").select(*keys), "two limits of one key")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    _refuse(clean.where("enabled").where(~(finite("lower") & finite("upper")) | (F.col("lower") > F.col("upper"))).select(*keys), "limits without a range, or with its bounds crossed")
    _refuse(clean.where("factor is not null").join(factors.select("family", "factor").distinct(), ["family", "factor"], "left_anti").select("family", "factor"), "limits of factors that no date has")

    met = []
    for rank, (level, (by_factor, by_date)) in enumerate(LEVELS.items()):
        own = clean.where(f"factor is {'not ' if by_factor else ''}null and date is {'not ' if by_date else ''}null")
        on = ["family", *["factor"] * by_factor, *["date"] * by_date]
        found = factors.join(F.broadcast(own.select(*on, "enabled", "lower", "upper")), on)
        met.append(found.select("family", "date", "factor", "enabled", "lower", "upper", F.lit(level).alias("level"), F.lit(rank).alias("rank")))
    best = Window.partitionBy("date", "factor").orderBy(F.col("rank").desc())
    chosen = reduce(DataFrame.union, met).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "rank")
    whole = factors.join(F.broadcast(clean.select("family").distinct()), "family", "left_semi")
    _refuse(whole.join(chosen, ["date", "factor"], "left_anti").select("family", "factor"), "factors without a limit in a family that has some")
    return chosen.where("enabled").select("date", "factor", "lower", "upper", "level")


def range_lines(sums: DataFrame, ranges: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Report lines of both ends of every range: ``date, portfolio, constraint, value, bound, excess, status``.

    ``sums`` are active exposures (``constraints.exposure_sums``). A factor with
    a range but without exposure on a date has an active exposure of 0.
    """
    held = sums.select("date", "portfolio").distinct().join(ranges, "date").join(sums.select("date", "portfolio", "factor", "active_exposure"), ["date", "portfolio", "factor"], "left")
    active = F.coalesce("active_exposure", F.lit(0.0))
    ends = [F.struct(F.lit(end).alias("end"), F.col(end).alias("bound"), excess.alias("excess")) for end, excess in (("lower", F.col("lower") - active), ("upper", active - F.col("upper")))]
    lines = held.select("date", "portfolio", "factor", active.alias("value"), F.explode(F.array(*ends)).alias("x"))
    status = F.when(F.col("x.excess") > tolerance, "violated").when(F.abs("x.excess") <= tolerance, "binding").otherwise("slack")
    return lines.select("date", "portfolio", F.concat_ws(":", F.lit("active_exposure_range"), "factor", "x.end").alias("constraint"), "value", "x.bound", "x.excess", status.alias("status"))


def frozen_bounds(weights: DataFrame, max_weight: float, max_active: float) -> DataFrame:
    """``date, portfolio, ticker, held_weight, lower, upper``: names that cannot trade and whose held weight lies outside the bounds it is exempt from."""
    low, high = F.greatest(F.lit(0.0), F.col("benchmark_weight") - max_active), F.least(F.lit(max_weight), F.col("benchmark_weight") + max_active)
    frozen = weights.where("not tradable and current_weight is not null").select("date", "portfolio", "ticker", F.col("current_weight").alias("held_weight"), low.alias("lower"), high.alias("upper"))
    return frozen.where("held_weight < lower or held_weight > upper")
