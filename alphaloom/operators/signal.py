"""Cross-sectional signal calibration and selection, all dates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from alphaloom.errors import InputError
from alphaloom.functions.expressions import average_rank, clipped, finite, inverse_normal_sql


def day() -> WindowSpec:
    """All rows of a date; made when asked for, as a window needs a running session."""
    return Window.partitionBy("date")


def with_mad(table: DataFrame, value: str, median: str = "median", mad: str = "mad") -> DataFrame:
    """``table`` with the date's median of ``value`` and the median absolute deviation from it."""
    return table.withColumn(median, F.median(value).over(day())).withColumn(mad, F.median(F.abs(F.col(value) - F.col(median))).over(day()))


def winsorize(signal: DataFrame, multiple: float, higher_is_better: bool = True) -> DataFrame:
    """``date, ticker, prediction, winsorized, changed``: oriented predictions clipped by date."""
    oriented = signal.withColumn("oriented", F.col("prediction") * (1.0 if higher_is_better else -1.0))
    cut = with_mad(oriented, "oriented").withColumn("winsorized", clipped("oriented", "median", "mad", multiple))
    return cut.select("date", "ticker", "prediction", "winsorized", (F.col("winsorized") != F.col("oriented")).alias("changed"))


def calibrate(signal: DataFrame, transform: str = "uniform", power: float = 1.0, multiple: float = 5.0, zscore: bool = True, scale: float = 0.05, higher_is_better: bool = True) -> DataFrame:
    """``date, ticker, raw_prediction, signal_score, expected_return`` of rank scores over each date's full cross-section.

    ``uniform`` is the average percent rank, ``normal_score`` the normal quantile
    of the plotting position and ``power`` its signed power about one half; each
    is centred by date and, with ``zscore``, divided by its population deviation.
    A date without variation has null scores.
    """
    ranked = winsorize(signal, multiple, higher_is_better).withColumn("rank", average_rank("winsorized", ["date"])).withColumn("n", F.count("*").over(day()))
    position = (F.col("rank") - 0.5) / F.col("n")
    if transform == "uniform":
        raw = F.col("rank") / F.col("n")
    elif transform == "normal_score":
        ranked = ranked.withColumn("position", position)
        raw = F.expr(inverse_normal_sql("position"))
    elif transform == "power":
        raw = F.signum(position - 0.5) * F.pow(F.abs(position - 0.5), F.lit(power))
    else:
        raise ValueError(f"unknown rank transform {transform!r}")
    scored = ranked.withColumn("raw", raw).withColumn("centred", F.col("raw") - F.avg("raw").over(day()))
    deviation = F.stddev_pop("centred").over(day())
    score = F.when(deviation > 1e-12, F.col("centred") / deviation if zscore else F.col("centred"))
    return scored.withColumn("signal_score", score).select("date", "ticker", F.col("prediction").alias("raw_prediction"), "signal_score", (F.col("signal_score") * scale).alias("expected_return"))


def given_returns(signal: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """``date, ticker, raw_prediction, signal_score, expected_return`` of predictions that are expected returns already: oriented, neither clipped nor ranked.

    The score is the date's standard score of the expected return. A date whose
    predictions do not differ tells nothing apart and stops the job, as does one that is missing or not finite.
    """
    oriented = finite("prediction") * (1.0 if higher_is_better else -1.0)
    scored = signal.select("date", "ticker", F.col("prediction").alias("raw_prediction"), oriented.alias("expected_return"))
    deviation = F.stddev_pop("expected_return").over(day())
    stop = lambda what: F.raise_error(F.concat(F.lit(what), F.lit(" on "), "date")).cast("double")
    value = F.when(F.col("expected_return").isNull(), stop("a prediction is missing or not finite")).when(~(deviation > 1e-12), stop("no cross-sectional variation")).otherwise((F.col("expected_return") - F.avg("expected_return").over(day())) / deviation)
    return scored.withColumn("signal_score", value).select("date", "ticker", "raw_prediction", "signal_score", "expected_return")


def require_variation(scored: DataFrame) -> DataFrame:
    """``scored`` if every date has scores; calibration leaves them null on a date without variation."""
    flat = [r.date for r in scored.groupBy("date").agg(F.count("signal_score").alias("n")).where("n = 0").select("date").orderBy("date").limit(10).collect()]
    if flat:
        raise InputError(f"signal has no cross-sectional variation on {flat}")
    return scored


def summarize(table: DataFrame, value: str) -> DataFrame:
    """Count, minimum, maximum, mean, population deviation and median of ``value`` by date."""
    return table.groupBy("date").agg(
        F.count(value).alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.median(value).alias("median")
    )


def top_candidates(signal: DataFrame, count: int, eligible: DataFrame | None = None, higher_is_better: bool = True) -> DataFrame:
    """``date, ticker, prediction, place``: the ``count`` best eligible names a date, ties by ticker."""
    if eligible is not None:
        signal = signal.join(eligible.where("tradable").select("date", "ticker"), ["date", "ticker"], "left_semi")
    best = F.col("prediction").desc() if higher_is_better else F.col("prediction").asc()
    return signal.withColumn("place", F.row_number().over(day().orderBy(best, F.col("ticker").asc()))).where(F.col("place") <= count).select("date", "ticker", "prediction", "place")


def equal_weight_baseline(scores: DataFrame, top_n: int) -> DataFrame:
    """``date, ticker, target_weight``: the ``top_n`` best scores (or all, if fewer) in equal parts, ties by ticker."""
    order = day().orderBy(F.col("signal_score").desc(), F.col("ticker").asc())
    placed = scores.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(day())).where(F.col("place") <= top_n)
    return placed.select("date", "ticker", (1.0 / F.least(F.lit(top_n), F.col("n"))).alias("target_weight"))


def optimizer_universe(candidates: DataFrame, benchmark: DataFrame, current: DataFrame | None = None, tolerance: float = 1e-12) -> DataFrame:
    """Distinct ``date, ticker`` of candidates, benchmark holdings and current holdings above ``tolerance``."""
    parts = candidates.select("date", "ticker").union(benchmark.where(F.abs("benchmark_weight") > tolerance).select("date", "ticker"))
    if current is not None:
        parts = parts.union(current.where(F.abs("current_weight") > tolerance).select("date", "ticker"))
    return parts.distinct()
