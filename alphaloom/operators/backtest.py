"""Next-day execution, drift, cost, net asset value and benchmark-relative measures.

Between rebalances a portfolio is bought and held, so a day's value is the sum
of target weight times the running product of returns: no loop over days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.errors import InputError
from alphaloom.functions.expressions import finite
from alphaloom.operators.calendar import calendar
from alphaloom.operators.guards import require_finite, require_keys, require_unique
from alphaloom.sources.publish import settled


def target_spans(targets: DataFrame, days: DataFrame) -> DataFrame:
    """``portfolio, date, start, stop, _from, _to`` of each date on which a portfolio has targets: they count from the next date (``start``) to before ``stop``.

    ``stop`` is where the portfolio's next targets start counting, null for its last; ``_from`` and ``_to`` are the
    ordinals of the first and the last day. One row a portfolio and target date, settled, as all steps read it.
    """
    ends = days.agg(F.max("ix").alias("_end"))
    starts = targets.select("portfolio", "date").distinct().join(F.broadcast(days.select("date", F.col("next_date").alias("start"), (F.col("ix") + 1).alias("_from"))), "date").where("start is not null")
    order = Window.partitionBy("portfolio").orderBy("start")
    return settled(starts.crossJoin(F.broadcast(ends)).select("portfolio", "date", "start", F.lead("start").over(order).alias("stop"), "_from", F.coalesce(F.lead("_from").over(order) - 1, "_end").alias("_to")))


def holdings(targets: DataFrame, returns: DataFrame, days: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """``portfolio, start, date, ticker, weight, return, value``: weight before and value after each day's return, per unit at ``start``.

    A held name without a return on a date stops the job. ``days`` and ``spans``
    are the returns' calendar and ``target_spans``, if they are there already.
    """
    days = settled(calendar(returns)) if days is None else days
    spans = target_spans(targets, days) if spans is None else spans
    each = spans.select("portfolio", "date", "start", F.explode(F.sequence("_from", "_to")).alias("ix")).join(F.broadcast(days.select("ix", F.col("date").alias("day"))), "ix").drop("ix")
    # one row a portfolio and day, so its table is broadcast; the held names are shuffled once for their returns and once for their running product
    dated = targets.where("target_weight <> 0").select("portfolio", "date", "ticker", "target_weight").join(F.broadcast(each), ["portfolio", "date"]).drop("date").withColumnRenamed("day", "date")
    held = dated.join(returns, ["date", "ticker"], "left")
    run = Window.partitionBy("portfolio", "start", "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    checked = F.coalesce("return", F.when(F.lit(True), F.raise_error(F.concat(F.lit("no return for "), "ticker", F.lit(" on "), "date"))))
    valued = held.withColumn("return", checked.cast("double")).withColumn("value", F.col("target_weight") * F.product(1 + F.col("return")).over(run))
    before = F.coalesce(F.lag("value").over(Window.partitionBy("portfolio", "start", "ticker").orderBy("date")), F.col("target_weight"))
    return valued.select("portfolio", "start", "date", "ticker", before.alias("weight"), "return", "value")


def drifted_weights(held: DataFrame) -> DataFrame:
    """``portfolio, start, date, ticker, weight``: weights after the day's return."""
    total = F.sum("value").over(Window.partitionBy("portfolio", "date"))
    return held.select("portfolio", "start", "date", "ticker", (F.col("value") / total).alias("weight"))


def turnover(targets: DataFrame, held: DataFrame, spans: DataFrame, totals: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """``portfolio, date, turnover``: half the absolute change from drifted to target weights on each effective date.

    The first target of a portfolio is compared with ``initial`` (``portfolio,
    ticker, weight``), or costs nothing without it. ``spans`` are ``target_spans``,
    ``totals`` (``portfolio, date, value``) what each portfolio is worth a day: only the days before effective dates are read of ``held``.
    """
    steps = spans.select("portfolio", F.col("date").alias("prev_date"), F.col("start").alias("date"))
    new = targets.select("portfolio", F.col("date").alias("prev_date"), "ticker", "target_weight").join(F.broadcast(steps), ["portfolio", "prev_date"]).drop("prev_date")
    drifted = steps.join(totals.select("portfolio", F.col("date").alias("prev_date"), F.col("value").alias("_total")), ["portfolio", "prev_date"])
    old = held.select("portfolio", F.col("date").alias("prev_date"), "ticker", "value").join(F.broadcast(drifted), ["portfolio", "prev_date"]).select("portfolio", "date", "ticker", (F.col("value") / F.col("_total")).alias("weight"))
    known = drifted.select("portfolio", "date")
    if initial is not None:
        first = F.broadcast(steps.groupBy("portfolio").agg(F.min("date").alias("date")))
        begun = initial.join(first, "portfolio").select("portfolio", "date", "ticker", "weight")
        old, known = old.unionByName(begun), known.union(begun.select("portfolio", "date")).distinct()
    change = new.join(old, ["portfolio", "date", "ticker"], "full_outer").groupBy("portfolio", "date").agg((F.sum(F.abs(F.coalesce("target_weight", F.lit(0.0)) - F.coalesce("weight", F.lit(0.0)))) / 2).alias("turnover"))
    return change.join(known.withColumn("known", F.lit(True)), ["portfolio", "date"], "left").select("portfolio", "date", F.when(F.col("known"), F.col("turnover")).otherwise(0.0).alias("turnover"))


def backtest(targets: DataFrame, returns: DataFrame, cost_bps: float, initial: DataFrame | None = None) -> DataFrame:
    """``date, portfolio, gross_return, transaction_cost, net_return, turnover, nav, drawdown`` for each day from the first effective date on.

    Cost falls on effective dates and does not reduce the drifted weights;
    drawdown is measured from a peak that starts at 1. The calendar, the target
    dates, each day's sums and the turnover (a row a portfolio and day at most) are
    settled, so the names are held once and what follows reads no names.
    """
    days = settled(calendar(returns))
    spans = target_spans(targets, days)
    held = holdings(targets, returns, days, spans).persist()
    total = F.sum("value")
    lost = F.raise_error(F.concat(F.lit("nothing is left of "), "portfolio", F.lit(" on "), "date")).cast("double")
    gross = settled(held.groupBy("portfolio", "start", "date").agg(total.alias("value"), F.when(total > 0, total / F.sum("weight") - 1).otherwise(F.when(F.lit(True), lost)).alias("gross_return")))
    moved = settled(turnover(targets, held, spans, gross, initial))
    held.unpersist()
    daily = gross.drop("value").join(F.broadcast(moved), ["portfolio", "date"], "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0))).withColumn("transaction_cost", F.col("turnover") * (cost_bps / 10000))
    run = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valued = daily.withColumn("net_return", F.col("gross_return") - F.col("transaction_cost")).withColumn("nav", F.product(1 + F.col("net_return")).over(run))
    peak = F.greatest(F.lit(1.0), F.max("nav").over(run))
    return valued.select("date", "portfolio", "gross_return", "transaction_cost", "net_return", "turnover", "nav", (F.col("nav") / peak - 1).alias("drawdown"))


def _active(joined: DataFrame) -> DataFrame:
    """Active measures of rows that hold ``benchmark_net_return`` and the benchmark's ``_nav``."""
    run = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valued = joined.withColumn("active_return", F.col("net_return") - F.col("benchmark_net_return")).withColumn("active_nav", F.col("nav") / F.col("_nav"))
    return valued.withColumn("active_drawdown", F.col("active_nav") / F.max("active_nav").over(run) - 1).drop("_nav")


def relative_to_benchmark(daily: DataFrame, benchmark: str = "benchmark", required: bool = False) -> DataFrame:
    """``daily`` with ``benchmark_net_return, active_return, active_nav, active_drawdown`` (null where the benchmark has no row).

    A date with two rows of the benchmark stops the job, and so does one without any if it is ``required``.
    """
    day = Window.partitionBy("date")
    own = F.when(F.col("portfolio") == benchmark, F.col("net_return"))
    found = F.count(own).over(day)
    wrong = F.raise_error(F.concat(F.lit(f"{benchmark}: "), found.cast("string"), F.lit(" rows on "), "date")).cast("double")
    once = F.when((found > 1) | (F.lit(required) & (found == 0)), wrong).otherwise(F.max(own).over(day))
    nav = F.max(F.when(F.col("portfolio") == benchmark, F.col("nav"))).over(day)
    return _active(daily.withColumn("benchmark_net_return", once).withColumn("_nav", nav))


def relative_to_series(daily: DataFrame, series: DataFrame) -> DataFrame:
    """``daily`` against an index from elsewhere (``date, benchmark_net_return``): the columns of ``relative_to_benchmark``.

    The index starts at 1 where the backtest does: its value is the product of
    its returns on the backtest's dates. Repeated dates, returns that are not finite
    or at most -1 are refused; a date of the backtest that the index lacks stops
    the job. One row a date is broadcast, a calendar's worth.
    """
    clean = series.select("date", finite("benchmark_net_return").alias("benchmark_net_return"))
    require_unique(require_keys(clean, ["date"], "benchmark series"), ["date"], "benchmark series")
    require_finite(clean, ["benchmark_net_return"], "benchmark series")
    if not clean.where("benchmark_net_return <= -1").isEmpty():
        raise InputError("benchmark series: a return of -1 or less")
    run = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missing = F.raise_error(F.concat(F.lit("benchmark series: nothing for "), "date")).cast("double")
    joined = daily.join(F.broadcast(clean), "date", "left").withColumn("benchmark_net_return", F.coalesce("benchmark_net_return", F.when(F.lit(True), missing)))
    return _active(joined.withColumn("_nav", F.product(1 + F.col("benchmark_net_return")).over(run)))


def summarize(relative: DataFrame, periods: int = 252) -> DataFrame:
    """One row per portfolio of absolute and benchmark-relative measures; ratios are null where the deviation is zero."""
    root = F.sqrt(F.lit(float(periods)))
    deviation, active = F.coalesce(F.stddev_samp("net_return"), F.lit(0.0)), F.coalesce(F.stddev_samp("active_return"), F.lit(0.0))
    sums = relative.groupBy("portfolio").agg(
        F.count("*").alias("observations"), F.min("date").alias("date_start"), F.max("date").alias("date_end"), F.max_by("nav", "date").alias("ending_nav"),
        F.avg("net_return").alias("_mean"), deviation.alias("_dev"), F.min("drawdown").alias("maximum_drawdown"), F.sum("turnover").alias("total_turnover"), F.sum("transaction_cost").alias("total_cost"),
        F.max_by("active_nav", "date").alias("active_ending_nav"), F.avg("active_return").alias("_amean"), active.alias("_adev"), F.min("active_drawdown").alias("maximum_active_drawdown"),
    )
    return sums.select(
        "portfolio", "observations", "date_start", "date_end", "ending_nav", (F.pow("ending_nav", periods / F.col("observations")) - 1).alias("annualized_return"),
        (F.col("_dev") * root).alias("annualized_volatility"), F.when(F.col("_dev") > 1e-15, F.col("_mean") / F.col("_dev") * root).alias("sharpe"),
        "maximum_drawdown", "total_turnover", "total_cost", "active_ending_nav", (F.pow("active_ending_nav", periods / F.col("observations")) - 1).alias("annualized_excess_return"),
        F.when(F.col("active_ending_nav").isNotNull(), F.col("_adev") * root).alias("tracking_error"), F.when(F.col("_adev") > 1e-15, F.col("_amean") / F.col("_adev") * root).alias("information_ratio"), "maximum_active_drawdown",
    )
