"""Parameter sweeps: all variants in one job, with the variant as one more grouping key.

Variants that resolve to one configuration are run once. What goes wrong with a
variant becomes its status row; it does not end the others.
"""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.errors import ConfigError
from alphaloom.functions.expressions import average_rank, clipped, inverse_normal_sql
from alphaloom.operators import backtest
from alphaloom.operators.digest import canonical_hash
from alphaloom.sources.publish import settled

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
TRANSFORMS = ("uniform", "power", "normal_score")
BASE = {"signal": {"transform": "uniform", "power": 1.0, "winsorize_mad": 5.0, "higher_is_better": True}, "baseline": {"top_n": 10}, "backtest": {"cost_bps": 10.0}}


def overridden(base: dict, changes: dict[str, object]) -> dict:
    """``base`` with values at dotted paths replaced; a path or a kind of value that ``base`` does not know is an error."""
    out = copy.deepcopy(base)
    for path, value in changes.items():
        at, *rest = [out, *path.split(".")]
        for step in rest[:-1]:
            at = at.get(step) if isinstance(at, dict) else None
        if not isinstance(at, dict) or rest[-1] not in at or isinstance(at[rest[-1]], dict):
            raise ConfigError(f"{path}: no such setting")
        known = at[rest[-1]]
        number = isinstance(known, float) and isinstance(value, int | float) and not isinstance(value, bool)
        if not number and type(value) is not type(known):
            raise ConfigError(f"{path}: {value!r} is no {type(known).__name__}")
        at[rest[-1]] = float(value) if number else value
    return out


@dataclass(frozen=True)
class Variant:
    """One resolved variant; ``same_as`` names the earlier variant with the same configuration, if there is one."""

    name: str
    config: dict
    digest: str
    same_as: str | None


def resolve_variants(variants: list[tuple[str, dict[str, object]]], base: dict = BASE) -> list[Variant]:
    """Configurations of named variants. Malformed and repeated names, unknown settings and values out of range end the sweep before it begins."""
    out: list[Variant] = []
    for name, changes in variants:
        if not NAME.fullmatch(name):
            raise ConfigError(f"{name!r}: a variant's name has letters, digits, dots, dashes and underscores")
        if name.lower() in {v.name.lower() for v in out}:
            raise ConfigError(f"{name}: a variant of that name exists")
        config = overridden(base, changes)
        s = config["signal"]
        if s["transform"] not in TRANSFORMS or s["power"] <= 0 or s["winsorize_mad"] <= 0 or config["baseline"]["top_n"] < 1 or config["backtest"]["cost_bps"] < 0:
            raise ConfigError(f"{name}: a setting is out of range: {config}")
        digest = canonical_hash(config)
        out.append(Variant(name, config, digest, next((v.name for v in out if v.digest == digest), None)))
    if not out:
        raise ConfigError("a sweep needs variants")
    return out


def _signal_key(v: Variant) -> str:
    """What tells the signal settings of two variants apart; variants that share it share their scores."""
    return canonical_hash(v.config["signal"])[:16]


def _settings(variants: list[Variant]):
    """An array of the distinct signal settings, one struct each."""
    rows = []
    for key, s in {_signal_key(v): v.config["signal"] for v in variants}.items():
        values = {"key": key, "transform": s["transform"], "power": s["power"], "multiple": s["winsorize_mad"], "sign": 1.0 if s["higher_is_better"] else -1.0}
        rows.append(F.struct(*(F.lit(x).alias(k) for k, x in values.items())))
    return F.array(*rows)


def calibrated(signal: DataFrame, variants: list[Variant]) -> DataFrame:
    """``key, date, prediction, score``: rank scores of every distinct signal setting over each date's full cross-section (null on a flat date).

    A score depends on a prediction's value only, so a date has one row a
    distinct value, which counts as often as it occurs.
    """
    group = Window.partitionBy("key", "date")
    values = signal.groupBy("date", "prediction").agg(F.count("*").alias("_c"))
    rows = values.select("date", "prediction", "_c", F.explode(_settings(variants)).alias("v")).select("date", "prediction", "_c", "v.*").withColumn("x", F.col("prediction") * F.col("sign"))
    median = lambda x: F.percentile(x, 0.5, F.col("_c")).over(group)
    cut = rows.withColumn("median", median(F.col("x"))).withColumn("mad", median(F.abs(F.col("x") - F.col("median"))))
    cut = cut.withColumn("winsorized", clipped("x", "median", "mad", F.col("multiple")))
    upto = group.orderBy("winsorized").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = F.sum("_c").over(Window.partitionBy("key", "date", "winsorized"))
    ranked = cut.withColumn("n", F.sum("_c").over(group)).withColumn("rank", F.sum("_c").over(upto) - (ties - 1) / 2).withColumn("position", (F.col("rank") - 0.5) / F.col("n"))
    raw = F.when(F.col("transform") == "uniform", F.col("rank") / F.col("n")).when(F.col("transform") == "normal_score", F.expr(inverse_normal_sql("position")))
    raw = raw.otherwise(F.signum(F.col("position") - 0.5) * F.pow(F.abs(F.col("position") - 0.5), F.col("power")))
    mean = lambda x: F.sum(x * F.col("_c")).over(group) / F.col("n")
    centred = ranked.withColumn("raw", raw).withColumn("centred", F.col("raw") - mean(F.col("raw"))).withColumn("deviation", F.sqrt(mean(F.col("centred") * F.col("centred"))))
    return centred.select("key", "date", "prediction", F.when(F.col("deviation") > 1e-12, F.col("centred") / F.col("deviation")).alias("score"))


def statuses(scored: DataFrame, variants: list[Variant]) -> DataFrame:
    """``variant, error``: null for a variant that can be run; what is wrong comes from counts by date."""
    asked = F.array(*(F.struct(F.lit(v.name).alias("variant"), F.lit(_signal_key(v)).alias("key"), F.lit(v.config["baseline"]["top_n"]).alias("top_n")) for v in variants))
    by_date = scored.groupBy("key", "date").agg(F.count("*").alias("n"), F.count("score").alias("rated")).withColumn("v", F.explode(asked)).where("v.key = key")
    bad = by_date.groupBy("v.variant").agg(F.count_if(F.col("rated") == 0).alias("flat"), F.count_if(F.col("n") < F.col("v.top_n")).alias("short"), F.first("v.top_n").alias("top_n"))
    error = F.when(F.col("flat") > 0, F.concat(F.lit("no cross-sectional variation on "), "flat", F.lit(" dates")))
    error = error.when(F.col("short") > 0, F.concat(F.lit("fewer than "), "top_n", F.lit(" candidates on "), "short", F.lit(" dates")))
    named = scored.sparkSession.createDataFrame([(v.name,) for v in variants], "variant string")
    return named.join(bad, "variant", "left").select("variant", F.when(F.col("flat").isNull(), "no candidates").otherwise(error).alias("error"))


def chosen(scored: DataFrame, variants: list[Variant]) -> DataFrame:
    """``date, ticker, portfolio, target_weight``: each variant's ``top_n`` best names in equal parts, ties by ticker; a setting's names are placed once for its variants."""
    top = max((v.config["baseline"]["top_n"] for v in variants), default=0)
    order = Window.partitionBy("key", "date").orderBy(F.col("score").desc(), "ticker")
    placed = scored.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top)
    listed = [(v.name, _signal_key(v), v.config["baseline"]["top_n"]) for v in variants]
    asked = F.broadcast(scored.sparkSession.createDataFrame(listed, "portfolio string, key string, top_n int"))
    return placed.join(asked, "key").where("_place <= top_n").select("date", "ticker", "portfolio", (1.0 / F.col("top_n")).alias("target_weight"))


def sweep(signal: DataFrame, eligible: DataFrame, benchmark: DataFrame, returns: DataFrame, variants: list[Variant], periods: int = 252) -> DataFrame:
    """One row a variant: ``variant, config_sha256, status, error, reused_from`` and the measures of its equal-weight portfolio.

    ``signal`` (date, ticker, prediction) is calibrated whole; names are chosen
    among ``eligible`` (date, ticker), whose dates are the rebalance dates;
    ``benchmark`` (date, ticker, benchmark_weight) is held on the same dates.
    Only those dates are calibrated, a row a distinct prediction and signal setting;
    variants that share the setting share its scores. The driver sees a row a variant.
    """
    own = [v for v in variants if v.same_as is None]
    dates = F.broadcast(settled(eligible.select("date").distinct()))
    dated = signal.join(dates, "date", "left_semi")
    rated = calibrated(dated, own).withColumnRenamed("date", "_date").withColumnRenamed("prediction", "_value")
    names = dated.join(eligible.select("date", "ticker"), ["date", "ticker"], "left_semi")
    scored = names.join(rated, (F.col("date") == F.col("_date")) & F.col("prediction").eqNullSafe(F.col("_value"))).select("key", "date", "ticker", "score").persist()
    state = settled(statuses(scored, own))
    fine = {r.variant for r in state.where("error is null").collect()}
    targets = settled(chosen(scored, [v for v in own if v.name in fine]))  # top_n rows a date and variant
    scored.unpersist()
    held = benchmark.join(dates, "date").select("date", "ticker", F.lit("benchmark").alias("portfolio"), F.col("benchmark_weight").alias("target_weight"))
    gross = backtest.backtest(targets.union(held), returns, 0.0)
    costs = F.create_map(*(x for v in own for x in (F.lit(v.name), F.lit(v.config["backtest"]["cost_bps"] / 10000))))
    run = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paid = gross.withColumn("transaction_cost", F.col("turnover") * F.coalesce(F.try_element_at(costs, F.col("portfolio")), F.lit(0.0))).withColumn("net_return", F.col("gross_return") - F.col("transaction_cost"))
    daily = paid.withColumn("nav", F.product(1 + F.col("net_return")).over(run))
    daily = daily.withColumn("drawdown", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(run)) - 1)
    measures = backtest.summarize(backtest.relative_to_benchmark(daily), periods).where("portfolio <> 'benchmark'").withColumnRenamed("portfolio", "_run")
    listed = scored.sparkSession.createDataFrame([(v.name, v.digest, v.same_as, v.same_as or v.name) for v in variants], "variant string, config_sha256 string, reused_from string, _run string")
    joined = listed.join(state.withColumnRenamed("variant", "_run"), "_run", "left").join(measures, "_run", "left").drop("_run")
    return joined.select("variant", "config_sha256", F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), "error", "reused_from", *[c for c in measures.columns if c != "_run"])
