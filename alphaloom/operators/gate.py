"""Quality counts gathered in the pass that writes a table, and adapters that publish only what passes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from alphaloom.errors import InputError
from alphaloom.functions.expressions import finite, normal_date, normal_ticker, truth
from alphaloom.operators.adapters import store_returns
from alphaloom.operators.calendar import rebalance_dates
from alphaloom.operators.digest import table_digest
from alphaloom.sources import publish


@dataclass
class Gate:
    """Aggregates that Spark observes while tables pass by; ``zero`` names those that must come out as 0 for anything to be published."""

    zero: dict[str, str] = field(default_factory=dict)
    watched: list[Observation] = field(default_factory=list)

    def watch(self, table: DataFrame, faults: dict[str, tuple[Column, str]], facts: dict[str, Column] | None = None) -> DataFrame:
        """``table`` with its counts observed; ``faults`` have what each means."""
        seen = Observation()
        self.watched.append(seen)
        self.zero |= {name: why for name, (_, why) in faults.items()}
        return table.observe(seen, *(c.alias(n) for n, (c, _) in faults.items()), *(c.alias(n) for n, c in (facts or {}).items()))

    def counts(self) -> dict[str, float]:
        """What was observed; the tables must have been written."""
        return {k: v for seen in self.watched for k, v in seen.get.items()}

    def require(self) -> dict[str, float]:
        found = self.counts()
        if bad := {name: (found[name], why) for name, why in self.zero.items() if found[name]}:
            raise InputError("refused: " + "; ".join(f"{name} = {n} ({why})" for name, (n, why) in sorted(bad.items())))
        return found


@dataclass(frozen=True)
class Gated:
    """Tables of an adapter, written in this order, the gate, and which tables it watches."""

    tables: dict[str, DataFrame]
    gate: Gate
    watched: tuple[str, ...]

    def publish(self, target: str, inputs: dict[str, DataFrame], kinds: dict[str, str] | None = None, notes: dict | None = None) -> dict:
        """Write all tables aside, and put them in place with their manifest if every count passes."""
        digests = {name: table_digest(t) for name, t in inputs.items()}
        return publish.publish(target, self.tables, digests, kinds, notes, passes=lambda: {"quality": self.gate.require()})

    def counts(self) -> dict[str, float]:
        """The gate's counts without publishing: watched tables are computed once and thrown away."""
        for name in self.watched:
            self.tables[name].write.format("noop").mode("overwrite").save()
        return self.gate.counts()


@dataclass(frozen=True)
class SignalRules:
    """What the frozen-signal adapter selects and tolerates."""

    start: str
    end: str
    every: int
    candidates: int
    higher_is_better: bool = True
    weight_tolerance: float = 1e-8
    sum_tolerance: float = 1e-3
    exclusion_tolerance: float = 5e-3

    def __post_init__(self) -> None:
        if self.every < 1 or self.candidates < 1:
            raise InputError("the rebalance step and the number of candidates must be positive")
        if self.start > self.end:
            raise InputError("the start date is after the end date")
        if not all(0 <= t < float("inf") for t in (self.weight_tolerance, self.sum_tolerance, self.exclusion_tolerance)):
            raise InputError("tolerances must be finite and not negative")


def _keyed(table: DataFrame, **values: Column) -> DataFrame:
    """``date, ticker``, the values and ``_n``: normal keys, one row each, with how many rows had the key."""
    clean = table.select(normal_date("date").alias("date"), normal_ticker("ticker").alias("ticker"), *(v.alias(k) for k, v in values.items()))
    return clean.groupBy("date", "ticker").agg(F.count("*").alias("_n"), *(F.min(k).alias(k) for k in values), *(F.count_if(F.col(k).isNull()).alias(f"_bad_{k}") for k in values))


def frozen_signal(signal: DataFrame, benchmark: DataFrame, eligibility: DataFrame, rules: SignalRules) -> Gated:
    """Optimiser inputs on every ``rules.every``-th signal date, and the counts that decide whether they are published.

    ``signal`` (date, ticker, prediction), ``benchmark`` (date, ticker,
    benchmark_weight), ``eligibility`` (date, ticker, tradable). Tables:
    ``signal_full``, the cross-section to calibrate on; ``signal`` and
    ``signal_candidates``, the best tradable names; ``benchmark_weights``, those
    with a market record, renormalised; ``optimizer_universe``, the union of the
    last two; ``rebalance_dates``, counts and weight sums a date; ``excluded``,
    benchmark names without a record. Names on which keys agree after
    normalisation are one key, and counted as repeated.
    """
    gate = Gate()
    dated = _keyed(signal, prediction=finite("prediction"))
    chosen = F.broadcast(rebalance_dates(dated.where("date is not null"), rules.every, rules.start, rules.end))
    held = dated.join(chosen, "date")
    tradable = _keyed(eligibility, tradable=truth("tradable")).join(chosen, "date")
    weights = _keyed(benchmark, benchmark_weight=finite("benchmark_weight")).join(chosen, "date")
    positive = weights.where(F.col("benchmark_weight") > rules.weight_tolerance)

    full = gate.watch(
        held,
        {
            "invalid_tickers": (F.coalesce(F.sum(F.when(F.col("ticker").isNull() | (F.col("ticker") == ""), F.col("_n"))), F.lit(0)), "signal rows without a ticker"),
            "invalid_predictions": (F.coalesce(F.sum("_bad_prediction"), F.lit(0)), "predictions that are missing or not finite"),
            "duplicate_keys": (F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)), "signal rows that repeat a key"),
        },
        {"signal_rows": F.coalesce(F.sum("_n"), F.lit(0))},
    ).select("date", "ticker", "prediction")
    able = gate.watch(
        tradable,
        {
            "eligibility_duplicates": (F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)), "eligibility rows that repeat a key"),
            "eligibility_invalid": (F.coalesce(F.sum("_bad_tradable"), F.lit(0)), "tradable flags that are no booleans"),
        },
        {"eligible_rows": F.count_if("tradable")},
    ).select("date", "ticker", "tradable")
    order = F.col("prediction").desc() if rules.higher_is_better else F.col("prediction").asc()
    ranked = held.join(tradable.where("tradable").select("date", "ticker"), ["date", "ticker"], "left_semi").withColumn("_place", F.row_number().over(Window.partitionBy("date").orderBy(order, "ticker")))
    best = ranked.where(F.col("_place") <= rules.candidates).select("date", "ticker", "prediction")
    record = tradable.select("date", "ticker")
    recorded, excluded = positive.join(record, ["date", "ticker"], "left_semi"), positive.join(record, ["date", "ticker"], "left_anti")
    day = Window.partitionBy("date")
    renormalised = recorded.select("date", "ticker", (F.col("benchmark_weight") / F.sum("benchmark_weight").over(day)).alias("benchmark_weight"))
    universe = best.select("date", "ticker").union(renormalised.select("date", "ticker")).distinct()

    raw = weights.groupBy("date").agg(F.sum("benchmark_weight").alias("raw_sum"), F.sum(F.col("_n") - 1).alias("_twice"), F.sum("_bad_benchmark_weight").alias("_bad"), F.count_if(F.col("benchmark_weight") < 0).alias("_negative"))
    counts = lambda table, name: table.groupBy("date").agg(F.count("*").alias(name))
    dates = chosen.join(counts(held, "calibration_count"), "date", "left").join(counts(best, "signal_count"), "date", "left").join(counts(renormalised, "benchmark_count"), "date", "left")
    dates = dates.join(counts(universe, "universe_count"), "date", "left").join(raw, "date", "left")
    dates = dates.join(excluded.groupBy("date").agg(F.sum("benchmark_weight").alias("excluded_weight"), F.count("*").alias("excluded_count")), "date", "left")
    dates = dates.na.fill(0, ["calibration_count", "signal_count", "benchmark_count", "universe_count", "excluded_weight", "excluded_count", "_twice", "_bad", "_negative"])
    deviation = F.abs(F.col("raw_sum") - 1)
    dates = gate.watch(
        dates.withColumn("ordinal", F.row_number().over(Window.orderBy("date"))),
        {
            "no_dates": ((F.count("*") == 0).cast("int"), "no signal date is within the bounds"),
            "short_dates": (F.count_if(F.col("signal_count") < rules.candidates), f"dates with fewer than {rules.candidates} tradable candidates"),
            "benchmark_missing_dates": (F.count_if(F.col("raw_sum").isNull()), "dates without benchmark weights"),
            "benchmark_duplicates": (F.coalesce(F.sum("_twice"), F.lit(0)), "benchmark rows that repeat a key"),
            "benchmark_invalid": (F.coalesce(F.sum(F.col("_bad") + F.col("_negative")), F.lit(0)), "benchmark weights that are missing, not finite or negative"),
            "benchmark_sum_dates": (F.count_if(deviation > rules.sum_tolerance), f"dates whose weights miss 1 by more than {rules.sum_tolerance:g}"),
            "benchmark_excluded_dates": (F.count_if(F.col("excluded_weight") > rules.exclusion_tolerance), f"dates on which more than {rules.exclusion_tolerance:g} of weight has no market record"),
        },
        {
            "dates": F.count("*"), "raw_sum_min": F.min("raw_sum"), "raw_sum_max": F.max("raw_sum"), "raw_deviation_max": F.max(deviation), "excluded_count": F.coalesce(F.sum("excluded_count"), F.lit(0)),
            "excluded_weight_max": F.max("excluded_weight"), "universe_min": F.min("universe_count"), "universe_max": F.max("universe_count"),
        },
    ).select("date", "ordinal", "calibration_count", "signal_count", "benchmark_count", "universe_count", "raw_sum", "excluded_weight")
    tables = {
        "signal_full": full, "eligibility": able, "signal": best, "signal_candidates": best.select("date", "ticker"), "optimizer_universe": universe, "benchmark_weights": renormalised,
        "excluded": excluded.select("date", "ticker", "benchmark_weight"), "rebalance_dates": dates,
    }
    return Gated(tables, gate, ("signal_full", "eligibility", "rebalance_dates"))


def store_inputs(equity: DataFrame, weights: DataFrame, history_start: str, start: str, end: str) -> Gated:
    """Engine inputs from a daily equity table and index weights, both with their keys as ``date, symbol`` and ``date, ticker``.

    ``returns`` and ``market_cap`` run from ``history_start`` and are long (wide
    panels are an export); ``asset_returns``, ``tradability`` and
    ``benchmark_weights`` from ``start``. Repeated keys, a return of -100% or
    less, and either table without rows in its bounds are refused.
    """
    if not history_start <= start <= end:
        raise InputError("dates must be in the order history start, start, end")
    gate = Gate()
    daily = store_returns(equity).where(F.col("date").between(history_start, end))
    keys = lambda t: t.groupBy("date", "ticker").agg(F.count("*").alias("_n"))
    own = weights.where(F.col("date").between(start, end)).select("date", "ticker", finite("benchmark_weight").alias("benchmark_weight"))
    known = daily.where("return is not null")
    returns = gate.watch(
        known.select("date", "ticker", "return"),
        {"total_losses": (F.count_if(F.col("return") <= -1), "returns at or below -100%"), "no_returns": ((F.count("*") == 0).cast("int"), "no returns")},
        {"return_rows": F.count("*")},
    )
    flags = gate.watch(keys(daily), {"equity_duplicates": (F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)), "equity rows that repeat a key"), "no_equity": ((F.count("*") == 0).cast("int"), "no equity rows")}).drop("_n")
    bench = gate.watch(
        own.withColumn("_k", F.row_number().over(Window.partitionBy("date", "ticker").orderBy("benchmark_weight"))),
        {
            "weight_duplicates": (F.count_if(F.col("_k") > 1), "index weights that repeat a key"), "no_weights": ((F.count("*") == 0).cast("int"), "no index weights"),
            "weight_invalid": (F.count_if(F.col("benchmark_weight").isNull()), "index weights that are missing or not finite"),
        },
        {"weight_rows": F.count("*")},
    ).drop("_k")
    later = F.col("date") >= start
    tables = {"equity_keys": flags, "returns": returns, "market_cap": daily.where("cap is not null").select("date", "ticker", "cap"), "asset_returns": known.where(later).select("date", "ticker", "return")}
    return Gated(tables | {"tradability": daily.where(later).select("date", "ticker", "tradable"), "benchmark_weights": bench}, gate, ("equity_keys", "returns", "benchmark_weights"))


def gate_report(gated: Gated) -> DataFrame:
    """``name, value, must_be_zero`` of a gate's counts, one row each."""
    found = gated.counts()
    spark = next(iter(gated.tables.values())).sparkSession
    rows = [(k, None if v is None else float(v), k in gated.gate.zero) for k, v in sorted(found.items())]
    return spark.createDataFrame(rows, "name string, value double, must_be_zero boolean")
