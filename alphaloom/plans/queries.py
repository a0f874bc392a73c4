"""The engine's registered queries over the test panel."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.functions.expressions import normal_date, normal_ticker, truth
from alphaloom.operators import adapters, asof, backtest, calendar, constraints, covariance, digest, gate, industry, optimize, ranges, risk, risk_cache, rolling, signal, sweep
from alphaloom.sources import panel as source
from alphaloom.sources import publish

Query = Callable[[SparkSession, str], DataFrame]

#: Monthly panel: years stand for the daily model's longer windows.
MONTHLY = risk.RiskSettings(
    styles=("SIZE", "BETA", "MOMENTUM", "RESVOL", "NLSIZE"), style_lookback=24, style_minimum=12, momentum_skip=1, lookback=60, minimum_periods=12,
    minimum_assets=5, minimum_specific=12, factor_halflife=12.0, specific_halflife=12.0, periods=12,
)
SIZE_ONLY = risk.RiskSettings(**{**MONTHLY.__dict__, "styles": ("SIZE",)})
COST_BPS, TOP_N, EVERY = 10.0, 10, 3


def rounded(value: str | Column, digits: int = 6) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, digits) + 0.0


def _round(table: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return table.withColumns({n: rounded(n, digits) for n in names})


def _rounded_cells(cells: DataFrame) -> DataFrame:
    """As ``_round``, for very many values: decimal arithmetic is left to those near a tie, very large or not finite."""
    millionths = F.col("covariance") * 1e6
    whole = F.rint(millionths)
    clear = (F.abs(millionths) < 2.0**40) & (F.abs(millionths - whole) < 0.499)
    return cells.withColumn("covariance", F.when(clear, whole / 1e6 + 0.0).otherwise(rounded("covariance")))


def _signal(p: DataFrame) -> DataFrame:
    return p.select("date", "ticker", "prediction")


def calibrate_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(signal.calibrate(_signal(source.market_panel(spark, sf_dir))), "signal_score", "expected_return")


def calibrate_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(signal.calibrate(_signal(source.market_panel(spark, sf_dir)), "power", power=2.0), "signal_score", "expected_return")


def calibrate_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(signal.calibrate(_signal(source.market_panel(spark, sf_dir)), "normal_score"), "signal_score", "expected_return")


def calibrate_expected_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal taken as an expected return, low ones better."""
    return _round(signal.given_returns(_signal(source.market_panel(spark, sf_dir)), higher_is_better=False), "signal_score", "expected_return")


def mad_winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = source.returns_of(source.market_panel(spark, sf_dir)).withColumnRenamed("return", "prediction")
    return _round(signal.winsorize(rets, 5.0).drop("prediction"), "winsorized")


def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = signal.calibrate(_signal(source.market_panel(spark, sf_dir)))
    return _round(signal.summarize(scored, "signal_score"), "minimum", "maximum", "mean", "deviation", "median")


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    return signal.top_candidates(_signal(p), TOP_N, p.select("date", "ticker", "tradable"))


def rebalance_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.rebalance_dates(source.market_panel(spark, sf_dir), EVERY, start="19990101")


def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    return adapters.signal_quality(_signal(p), p.select("date", "ticker", "tradable"))


def benchmark_renormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    return _round(adapters.renormalize_benchmark(source.benchmark_of(p), p.where("tradable")), "benchmark_weight", "retained", digits=8)


def benchmark_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    return _round(adapters.excluded_benchmark(source.benchmark_of(p), p.where("tradable")), "excluded_weight", digits=8)


def _candidates(p: DataFrame) -> DataFrame:
    return signal.top_candidates(_signal(p), TOP_N, p.select("date", "ticker", "tradable"))


def optimizer_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    return signal.optimizer_universe(_candidates(p), source.benchmark_of(p))


def coverage_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    b = source.benchmark_of(p).where("benchmark_weight > 0")
    return adapters.coverage_by_date(_signal(p), _candidates(p), b, signal.optimizer_universe(_candidates(p), b))


def store_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    store = p.select(
        "date", F.col("ticker").alias("symbol"), F.col("price").alias("close"), (F.col("price") / (1 + F.col("ret"))).alias("pre_close"), F.col("cap").alias("market_value"),
        F.when(F.col("tradable"), 1.0).otherwise(0.0).alias("volume"), F.col("cap").alias("amount"), F.lit(0).alias("trade_status"),
    )
    return _round(adapters.store_returns(store), "return")


def terminal_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = source.returns_of(source.market_panel(spark, sf_dir)).where((F.col("date") <= "20030101") | (F.substring("ticker", -1, 1) != "3"))
    return _round(adapters.terminal_returns(rets, "20031231"), "return")


def existing_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    scores = p.select("date", "ticker", F.col("prediction").alias("alpha_score"))
    return _round(adapters.existing_experiment(scores, p.where("cap > 500000").select("ticker")), "benchmark_weight", digits=8)


def industry_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    return industry.industry_asof(p.select("date", "ticker"), source.industry_history(p))


def industry_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    later = p.where("tradable").groupBy("ticker", "industry").agg(F.max("date").alias("in_date")).withColumn("out_date", F.lit(""))
    return industry.overlaps(source.industry_history(p).union(later.select("ticker", "industry", "in_date", "out_date")))


def _sections(p: DataFrame) -> DataFrame:
    return risk.cross_sections(source.returns_of(p), source.caps_of(p), MONTHLY)


def size_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = risk.size_exposure(_sections(source.market_panel(spark, sf_dir)), MONTHLY)
    return sized.select("date", "exposure_date", "ticker", rounded("weight").alias("weight"), rounded("SIZE").alias("size"))


def nlsize_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = risk.size_exposure(_sections(source.market_panel(spark, sf_dir)), MONTHLY)
    return risk.nlsize_exposure(sized, MONTHLY).select("date", "ticker", rounded("NLSIZE", 5).alias("nlsize"))


def return_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    return _round(risk.return_styles(_sections(p), source.returns_of(p), MONTHLY), "beta", "resvol", "momentum", digits=5)


def standardized_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    settings = risk.RiskSettings(**{**MONTHLY.__dict__, "styles": ("SIZE", "BETA")})
    return risk.exposures(_sections(p), source.returns_of(p), settings).select("date", "ticker", rounded("BETA", 5).alias("beta"))


def _responses(p: DataFrame) -> DataFrame:
    """Worked out once, with no plan behind it: what is made from it reads it many times."""
    return publish.settled(risk.response(risk.exposures(_sections(p), source.returns_of(p), SIZE_ONLY), SIZE_ONLY))


def factor_returns_market_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(risk.factor_returns_closed(_responses(source.market_panel(spark, sf_dir))), "factor_return")


def factor_returns_wls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    rows = risk.response(risk.exposures(_sections(p), source.returns_of(p), MONTHLY), MONTHLY)
    return _round(risk.factor_returns_wls(rows, MONTHLY.styles), "factor_return")


def factor_returns_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    sections = risk.cross_sections(source.returns_of(p), source.caps_of(p), SIZE_ONLY, p.select("date", "ticker", "industry"))
    rows = risk.response(risk.exposures(sections, source.returns_of(p), SIZE_ONLY), SIZE_ONLY)
    return _round(risk.factor_returns_wls(rows, ("SIZE",), tuple(f"R{i}" for i in range(5))), "factor_return")


def ewma_factor_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = risk.factor_returns_closed(_responses(source.market_panel(spark, sf_dir)))
    return _round(risk.ewma_covariance(returns, SIZE_ONLY), "covariance")


def covariance_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = risk.factor_returns_closed(_responses(source.market_panel(spark, sf_dir)))
    return _round(risk.floor_eigenvalues(risk.ewma_covariance(returns, SIZE_ONLY), SIZE_ONLY.eigenvalue_floor), "covariance")


def _specific(p: DataFrame) -> DataFrame:
    rows = _responses(p)
    return risk.specific_variance(risk.residuals(rows, publish.settled(risk.factor_returns_closed(rows)), ("SIZE",)), SIZE_ONLY)


def specific_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_specific(source.market_panel(spark, sf_dir)), "specific_var")


def specific_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    known = _specific(p).where(F.substring("ticker", -1, 1) != "7")
    return _round(risk.impute_specific(p.select("ticker"), known, p.select("ticker", "industry"), SIZE_ONLY), "specific_var")


def _last_model(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exposures on the last regression date, factor covariance and specific variance."""
    rows = _responses(p)
    returns = publish.settled(risk.factor_returns_closed(rows))
    last = publish.settled(rows.join(F.broadcast(rows.agg(F.max("date").alias("date"))), "date"))
    specific = risk.specific_variance(risk.residuals(rows, returns, ("SIZE",)), SIZE_ONLY)
    filled = risk.impute_specific(last.select("ticker"), specific, p.select("ticker", "industry"), SIZE_ONLY)
    return risk.long_exposures(last, ("SIZE",)), risk.ewma_covariance(returns, SIZE_ONLY), filled


def asset_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, f, d = _last_model(source.market_panel(spark, sf_dir))
    return _rounded_cells(risk.asset_covariance(x, f, d))


def asset_covariance_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matrix as ``asset_covariance``, from pairs of blocks of about 16 names."""
    return _rounded_cells(covariance.mirrored(covariance.asset_blocks(*_last_model(source.market_panel(spark, sf_dir)), block_names=16)))


def portfolio_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    x, f, d = _last_model(p)
    names = x.select("ticker").distinct()
    count = F.broadcast(names.agg(F.count("*").alias("n")))
    equal = names.crossJoin(count).select(F.lit("equal").alias("portfolio"), "ticker", (1.0 / F.col("n")).alias("weight"))
    sized = x.where("factor = 'SIZE'").select("ticker", F.greatest("exposure", F.lit(0.0)).alias("e"))
    total = F.broadcast(sized.agg(F.sum("e").alias("t")))
    large = sized.crossJoin(total).select(F.lit("large").alias("portfolio"), "ticker", (F.col("e") / F.col("t")).alias("weight"))
    return _round(risk.portfolio_variance(equal.union(large), x, f, d), "factor_variance", "specific_variance", "variance", "volatility")


def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected return, volatility and tracking error of two portfolios on the last regression date, against capitalisation shares."""
    p = source.market_panel(spark, sf_dir)
    x, f, d = map(publish.settled, _last_model(p))
    names = x.where("factor = 'SIZE'").select("date", "ticker", F.greatest("exposure", F.lit(0.0)).alias("e"))
    own = p.join(F.broadcast(names.select("date").distinct()), "date", "left_semi")  # calibration and shares are by date, over all of its names
    expected = signal.calibrate(_signal(own)).select("date", "ticker", "expected_return")
    known = names.join(source.benchmark_of(own), ["date", "ticker"]).join(expected, ["date", "ticker"])
    all_names = Window.partitionBy("date")
    share = lambda c: F.col(c) / F.sum(c).over(all_names)
    weighed = known.select("ticker", share("benchmark_weight").alias("benchmark_weight"), "expected_return", (1.0 / F.count("*").over(all_names)).alias("equal"), share("e").alias("large"))
    book = publish.settled(weighed.unpivot(["ticker", "benchmark_weight", "expected_return"], ["equal", "large"], "portfolio", "target_weight"))
    return _round(risk.portfolio_metrics(book, x, f, d), "expected_return", "active_expected_return", "variance", "volatility", "tracking_variance", "tracking_error")


#: As-of dates: every twentieth month after the first twenty-four; tradable names of the month are the targets.
AS_OF_FIRST, AS_OF_EVERY = 24, 20
AS_OF = risk.RiskSettings(**{**SIZE_ONLY.__dict__, "lookback": 24, "max_imputed": 1.0})


def _as_of_model(p: DataFrame) -> asof.AsOfModel:
    days = calendar.calendar(p).where((F.col("ix") >= AS_OF_FIRST) & (F.col("ix") % AS_OF_EVERY == 0)).select(F.col("date").alias("as_of"))
    targets = p.where("tradable").select(F.col("date").alias("as_of"), "ticker").join(F.broadcast(days), "as_of")
    members = days.crossJoin(p.select("ticker", "industry").distinct())
    return asof.estimate(source.returns_of(p), source.caps_of(p), targets, AS_OF, members)


def risk_asof_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MARKET and SIZE of each as-of date's own targets."""
    return _round(_as_of_model(source.market_panel(spark, sf_dir)).exposures, "exposure")


def risk_asof_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_as_of_model(source.market_panel(spark, sf_dir)).factor_cov, "covariance")


def risk_asof_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_as_of_model(source.market_panel(spark, sf_dir)).specific, "specific_var")


def risk_asof_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_of_model(source.market_panel(spark, sf_dir)).periods.select("as_of", "periods", "first", "last")


def risk_asof_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest of each as-of date's industry model says."""
    found = asof.diagnostics(_industry_model(source.market_panel(spark, sf_dir)))
    return _round(found, "names_median", "imputed_share", "specific_min", "specific_median", "specific_max", "factor_volatility")


#: A fifth of the specific variances may be imputed; names that end in 3 move to an industry of their own in March 1997, so that windows hold dates that cannot tell its return.
AS_OF_INDUSTRY = risk.RiskSettings(**{**AS_OF.__dict__, "max_imputed": 0.2})
MOVED_FROM = "19970301"


def _moving_history(p: DataFrame) -> DataFrame:
    known, moves = source.industry_history(p), F.substring("ticker", -1, 1) == "3"
    ended = known.withColumn("out_date", F.when(moves, F.lit("19970228")).otherwise(F.col("out_date")))
    moved = known.where(moves).select("ticker", F.lit("R9").alias("industry"), F.lit(MOVED_FROM).alias("in_date"), F.lit(None).cast("string").alias("out_date"))
    return ended.union(moved)


def _industry_model(p: DataFrame) -> asof.AsOfModel:
    days = calendar.calendar(p).where((F.col("ix") >= AS_OF_FIRST) & (F.col("ix") % AS_OF_EVERY == 0)).select(F.col("date").alias("as_of"))
    targets = p.where("tradable").select(F.col("date").alias("as_of"), "ticker").join(F.broadcast(days), "as_of")
    return asof.estimate(source.returns_of(p), source.caps_of(p), targets, AS_OF_INDUSTRY, history=_moving_history(p))


def risk_asof_industry_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIZE and the industry of each as-of date's own targets."""
    return _round(_industry_model(source.market_panel(spark, sf_dir)).exposures, "exposure")


def risk_asof_industry_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_industry_model(source.market_panel(spark, sf_dir)).factor_cov, "covariance")


def risk_asof_industry_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_industry_model(source.market_panel(spark, sf_dir)).specific, "specific_var")


def changed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months whose lines differ between two states of the order book.

    A fixture that differs on purpose: the first state lacks the months from
    mid-1998 on and the largest fully discounted seventh lines, the second those before July 1996.
    """
    lines = source.read_table(spark, sf_dir, "lineitem").select(
        F.date_format(F.date_trunc("month", "l_shipdate"), "yyyyMMdd").alias("date"), "l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * 100).cast("long").alias("units"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.round(F.col("l_discount") * 100).cast("long").alias("off")
    )
    before = lines.where("date < '19980601' and not (l_linenumber = 7 and units >= 4900 and off >= 10)")
    return digest.changed_partitions(before, lines.where("date >= '19960701'"))


def risk_cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each as-of date's risk model comes from in the second of two runs over one cache.

    The first run asks for every twentieth month. The second asks for every
    tenth, with one name less in month 44, and has a static model of the names of month 34.
    """
    p = source.market_panel(spark, sf_dir)
    days = calendar.calendar(p).where((F.col("ix") >= AS_OF_FIRST) & (F.col("ix") % (AS_OF_EVERY // 2) == AS_OF_FIRST % (AS_OF_EVERY // 2))).select(F.col("date").alias("as_of"), "ix")
    targets = p.where("tradable").select(F.col("date").alias("as_of"), "ticker").join(F.broadcast(days), "as_of")
    cache = risk_cache.RiskCache(spark, f"{publish.shared_folder(spark)}/risk-{uuid.uuid4().hex}")
    returns, caps = source.returns_of(p), source.caps_of(p)
    cache.resolve(targets.where(F.col("ix") % AS_OF_EVERY == AS_OF_FIRST % AS_OF_EVERY), returns, caps, AS_OF)
    known = targets.where(f"ix = {AS_OF_FIRST + AS_OF_EVERY // 2}").select("ticker")
    static = risk_cache.StaticModel(known.select("ticker", F.lit("MARKET").alias("factor"), F.lit(1.0).alias("exposure")), known.limit(0), known.select("ticker", F.lit(0.04).alias("specific_var")))
    gone = targets.where(f"ix = {AS_OF_FIRST + AS_OF_EVERY}").groupBy("as_of").agg(F.min("ticker").alias("ticker"))
    second = targets.join(F.broadcast(gone), ["as_of", "ticker"], "left_anti")
    return cache.resolve(second, returns, caps, AS_OF, static=static).states.drop("fingerprint")


def frozen_signal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that the frozen-signal adapter gathers while it writes, over every third month: names of less than 100,000 in revenue have no market record."""
    p = source.market_panel(spark, sf_dir)
    drifted = source.benchmark_of(p).withColumn("benchmark_weight", F.col("benchmark_weight") * 1.0002)
    rules = gate.SignalRules("19960101", "20011231", EVERY, TOP_N // 2, exclusion_tolerance=0.5)
    found = gate.gate_report(gate.frozen_signal(_signal(p), drifted, p.where("cap >= 100000").select("date", "ticker", "tradable"), rules))
    return _round(found, "value")


def equal_weight_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(signal.equal_weight_baseline(signal.calibrate(_signal(source.market_panel(spark, sf_dir))), TOP_N), "target_weight", digits=8)


def on_rebalances(p: DataFrame) -> DataFrame:
    """Rows of the panel on every third month that has weights of the benchmark and a successor.

    Scores, weights and exposures of a date come from its own rows, so the other months are left out before anything is sorted.
    """
    last = F.broadcast(p.agg(F.max("date").alias("last")))
    dates = calendar.rebalance_dates(p.where("prev_cap is not null"), EVERY).crossJoin(last).where("date < last").select("date")
    return p.join(F.broadcast(publish.settled(dates)), "date", "left_semi")


def targets_of(held: DataFrame) -> DataFrame:
    """``date, ticker, portfolio, target_weight`` on the dates of ``on_rebalances``: best names in equal parts, a score tilt, the benchmark."""
    b = source.benchmark_of(held)
    scored = signal.calibrate(_signal(held)).join(b, ["date", "ticker"])
    equal = signal.equal_weight_baseline(scored, TOP_N).select("date", "ticker", F.lit("equal_weight_signal").alias("portfolio"), "target_weight")
    positive = scored.where("signal_score > 0")
    tilt = positive.select("date", "ticker", F.lit("tilt").alias("portfolio"), (F.col("signal_score") / F.sum("signal_score").over(signal.day())).alias("target_weight"))
    bench = b.select("date", "ticker", F.lit("benchmark").alias("portfolio"), F.col("benchmark_weight").alias("target_weight"))
    return equal.union(tilt).union(bench).persist()


def _daily(p: DataFrame) -> DataFrame:
    return backtest.backtest(targets_of(on_rebalances(p)), source.dense_returns(p), COST_BPS)


def backtest_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_daily(source.market_panel(spark, sf_dir)), "gross_return", "transaction_cost", "net_return", "turnover", "nav", "drawdown")


def benchmark_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    relative = backtest.relative_to_benchmark(_daily(source.market_panel(spark, sf_dir)))
    return _round(relative.select("date", "portfolio", "benchmark_net_return", "active_return", "active_nav", "active_drawdown"), "benchmark_net_return", "active_return", "active_nav", "active_drawdown")


def _index(p: DataFrame) -> DataFrame:
    """An index that no portfolio holds: each month's mean return of the names that are tradable in it, 0 in a month without one."""
    tradable = F.when(F.col("tradable"), F.col("ret"))
    return p.groupBy("date").agg(F.coalesce(F.avg(tradable), F.lit(0.0)).alias("benchmark_net_return"))


def index_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portfolios against an external index series instead of a portfolio of the backtest."""
    p = source.market_panel(spark, sf_dir)
    relative = backtest.relative_to_series(_daily(p), _index(p))
    return _round(relative.select("date", "portfolio", "benchmark_net_return", "active_return", "active_nav", "active_drawdown"), "benchmark_net_return", "active_return", "active_nav", "active_drawdown")


def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backtest.summarize(backtest.relative_to_benchmark(_daily(source.market_panel(spark, sf_dir))), 12)
    return _round(out, *[c for c, t in out.dtypes if t == "double"], digits=5)


def drifted_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.market_panel(spark, sf_dir)
    held = backtest.holdings(targets_of(on_rebalances(p)).where("portfolio = 'equal_weight_signal'"), source.dense_returns(p))
    return _round(backtest.drifted_weights(held).select("date", "ticker", "weight"), "weight")


def _weights(held: DataFrame) -> DataFrame:
    t = targets_of(held).where("portfolio <> 'benchmark'")
    books = F.broadcast(t.select("date", "portfolio").distinct())  # one row a date and portfolio
    candidates = F.broadcast(_candidates(held).select("date", "ticker", F.lit(True).alias("c")))  # at most TOP_N rows a date
    names = source.benchmark_of(held).join(held.select("date", "ticker", "tradable"), ["date", "ticker"]).join(candidates, ["date", "ticker"], "left")
    joined = names.join(books, "date").join(t, ["date", "portfolio", "ticker"], "left")
    return joined.select("date", "portfolio", "ticker", F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), "benchmark_weight", "tradable", F.coalesce("c", F.lit(False)).alias("is_candidate"))


def constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = constraints.weight_checks(_weights(on_rebalances(source.market_panel(spark, sf_dir))), 0.15, 0.12)
    return _round(out, *[c for c, t in out.dtypes if t == "double"])


def industry_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = on_rebalances(source.market_panel(spark, sf_dir))
    members = p.select("date", "ticker", F.concat(F.lit("INDUSTRY:"), "industry").alias("factor"), F.lit(1.0).alias("exposure"))
    out = constraints.range_checks(constraints.exposure_sums(_weights(p), members), -0.2, 0.2)
    return _round(out, "portfolio_exposure", "benchmark_exposure", "active_exposure", "lower_slack", "upper_slack").drop("binding")


#: Limits of the range queries: industries have a default, one of its own and a wider one in a month; SIZE is held near a target.
RANGES = (
    ("INDUSTRY", None, None, -0.2, 0.2, None, None, True), ("INDUSTRY", None, "19980101", -0.3, 0.3, None, None, True), ("INDUSTRY", "INDUSTRY:R1", None, -0.05, 0.1, None, None, True),
    ("INDUSTRY", "INDUSTRY:R2", "19980101", None, None, 0.0, 0.02, True), ("INDUSTRY", "INDUSTRY:R3", "19980401", None, None, None, None, False), ("STYLE", "SIZE", None, None, None, 0.1, 0.15, True),
)


def _ranged(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active exposures to industries and SIZE on the dates of the book, and the ranges resolved for them."""
    p = on_rebalances(p)
    book = _weights(p)
    sized = p.select("date", "ticker", F.lit("SIZE").alias("factor"), ((F.log("cap") - F.avg(F.log("cap")).over(signal.day())) / F.stddev_pop(F.log("cap")).over(signal.day())).alias("exposure"))
    members = p.select("date", "ticker", F.concat(F.lit("INDUSTRY:"), "industry").alias("factor"), F.lit(1.0).alias("exposure"))
    sums = publish.settled(constraints.exposure_sums(book, members.union(sized)))  # a row a date, portfolio and factor; read by every refusal
    family = F.when(F.col("factor") == "SIZE", "STYLE").otherwise("INDUSTRY")
    limits = p.sparkSession.createDataFrame(list(RANGES), ranges.LIMITS)
    return sums, ranges.resolve_ranges(sums.select("date", "factor", family.alias("family")).distinct(), limits)


def resolved_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_ranged(source.market_panel(spark, sf_dir))[1], "lower", "upper")


def range_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of every resolved range, as lines of the constraint report."""
    sums, found = _ranged(source.market_panel(spark, sf_dir))
    return _round(ranges.range_lines(sums, found), "value", "bound", "excess")


#: A floor that some months' factor covariances do not reach.
DIAGNOSED = covariance.MatrixRules(annualized=True, eigenvalue_floor=0.036)


def covariance_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetry, eigenvalue range and repair of each as-of date's factor covariance."""
    found = _as_of_model(source.market_panel(spark, sf_dir)).factor_cov.toDF("matrix", "row_name", "col_name", "covariance")
    out = covariance.diagnostics(covariance.checked(found, DIAGNOSED), DIAGNOSED.eigenvalue_floor)
    return _round(out, "min_eigenvalue_before", "max_eigenvalue_before", "min_eigenvalue_after", "repair_frobenius", "max_asymmetry")


#: ``wide`` asks for more names than there are and fails on purpose; ``again`` is the base under another name.
VARIANTS = (
    ("base", {}), ("small", {"baseline.top_n": 5}), ("skewed", {"signal.transform": "power", "signal.power": 2.0}), ("costly", {"backtest.cost_bps": 50.0}), ("wide", {"baseline.top_n": 1_000_000}), ("again", {"baseline.top_n": 10}),
)


def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six variants of calibration, baseline and cost, held every third month."""
    p = source.market_panel(spark, sf_dir)
    held = on_rebalances(p)
    b = source.benchmark_of(held)
    out = sweep.sweep(_signal(held), b, b, source.dense_returns(p), sweep.resolve_variants(list(VARIANTS)), 12)
    kept = out.select("variant", "status", "error", "reused_from", "observations", "ending_nav", "annualized_return", "total_turnover", "total_cost", "active_ending_nav", "maximum_drawdown")
    return _round(kept, "ending_nav", "annualized_return", "total_turnover", "total_cost", "active_ending_nav", "maximum_drawdown", digits=5)


def _problems(p: DataFrame) -> DataFrame:
    """The optimiser's names on rebalance dates: a market loading of 1, specific variance of the last two years' returns, SIZE as the ranged exposure."""
    b = source.benchmark_of(p)
    scored = signal.calibrate(_signal(p)).select("date", "ticker", F.col("signal_score").alias("score"))
    past = Window.partitionBy("ticker").orderBy("date").rowsBetween(-24, Window.currentRow)
    own = p.select("date", "ticker", "tradable", F.coalesce(F.var_samp("ret").over(past), F.lit(0.04)).alias("specific_var"), F.ln("cap").alias("size"))
    candidates = _candidates(p).select("date", "ticker", F.lit(True).alias("is_candidate"))
    sized = (F.col("size") - F.avg("size").over(signal.day())) / F.stddev_samp("size").over(signal.day())
    return (
        b.join(F.broadcast(calendar.rebalance_dates(b, EVERY)), "date").join(scored, ["date", "ticker"]).join(own, ["date", "ticker"]).join(candidates, ["date", "ticker"], "left")
        .select(
            "date", F.lit("optimized").alias("variant"), "ticker", F.coalesce("score", F.lit(0.0)).alias("score"), (F.col("benchmark_weight") / F.sum("benchmark_weight").over(signal.day())).alias("benchmark_weight"),
            F.lit(None).cast("double").alias("current_weight"), "tradable", F.coalesce("is_candidate", F.lit(False)).alias("is_candidate"), F.greatest("specific_var", F.lit(1e-4)).alias("specific_var"),
            F.array(F.lit(1.0)).alias("loadings"), F.array(F.lit(0.002)).alias("half_loadings"), F.array(F.coalesce(sized, F.lit(0.0))).alias("exposures"),
        )
    )


LIMITS = optimize.Limits(max_weight=1.0, max_active=0.12, tracking_error=0.05, ranges=((-0.2, 0.2),))


def optimized_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score-maximising weights under tracking-error, stock and SIZE limits on every third month."""
    return _round(optimize.optimize(_problems(source.market_panel(spark, sf_dir)), LIMITS), "target_weight")


def _path(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All names on every rebalance date for two variants (the signal and its reverse), and what both hold at first: the benchmark.

    A ticker without lines in a month scores 0 in it. Every name can trade, so that holding the benchmark satisfies the limits.
    """
    b, own = source.benchmark_of(p), _problems(p).drop("variant", "current_weight")
    dates = calendar.rebalance_dates(b, EVERY)
    grid = F.broadcast(dates).crossJoin(p.select("ticker").distinct())
    empty = lambda x: F.array(F.lit(x))
    growth = rolling.growth_between(source.dense_returns(p), dates)
    rows = grid.join(own, ["date", "ticker"], "left").join(growth, ["date", "ticker"]).select(
        "date", "ticker", F.coalesce("benchmark_weight", F.lit(0.0)).alias("benchmark_weight"), F.lit(True).alias("tradable"), F.coalesce("is_candidate", F.lit(False)).alias("is_candidate"),
        F.coalesce("specific_var", F.lit(0.04)).alias("specific_var"), F.coalesce("loadings", empty(1.0)).alias("loadings"), F.coalesce("half_loadings", empty(0.002)).alias("half_loadings"), F.coalesce("exposures", empty(0.0)).alias("exposures"),
        "growth", F.coalesce("score", F.lit(0.0)).alias("_score"),
    )
    both = rows.select("*", F.explode(F.create_map(F.lit("reversed"), F.lit(-1.0), F.lit("signal"), F.lit(1.0))).alias("variant", "sign")).withColumn("score", F.col("_score") * F.col("sign"))
    first = dates.agg(F.min("date").alias("date"))
    start = b.join(F.broadcast(first), "date").select("ticker", (F.col("benchmark_weight") / F.sum("benchmark_weight").over(signal.day())).alias("weight"), "date").drop("date")
    return both.drop("_score", "sign"), start.select(F.explode(F.array(F.lit("reversed"), F.lit("signal"))).alias("variant"), "ticker", "weight")


PATH_LIMITS = optimize.Limits(max_weight=1.0, max_active=0.3, tracking_error=0.1, ranges=((-1.0, 1.0),))


def rolling_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimised weights along every third month, each from what the last has drifted to."""
    names, start = _path(source.market_panel(spark, sf_dir))
    return _round(rolling.rolling_targets(names, PATH_LIMITS, start), "current_weight", "target_weight")


def rolling_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of ``rolling_targets`` recomputed from its weights: one row a date and variant."""
    names, start = _path(source.market_panel(spark, sf_dir))
    found = rolling.rolling_targets(names, PATH_LIMITS, start).withColumnRenamed("variant", "portfolio")
    known = names.where("variant = 'signal'")
    book = found.join(known.select("date", "ticker", "benchmark_weight", "tradable", "is_candidate"), ["date", "ticker"]).persist()
    report = rolling.constraint_report(book, PATH_LIMITS, rolling.tracking_error(book, known))
    return report.groupBy("date", "portfolio").agg(F.count("*").alias("n_limits"), F.count_if(F.col("status") == "violated").alias("n_violated"))


def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every limit of the baselines, line by line, as if the benchmark were held before."""
    limits = optimize.Limits(max_weight=0.15, max_active=0.12, tracking_error=1.0, turnover=0.8, candidate_floor=0.5)
    book = _weights(on_rebalances(source.market_panel(spark, sf_dir))).withColumn("current_weight", F.col("benchmark_weight"))
    return _round(rolling.constraint_report(book, limits), "value", "bound", "excess")


def single_date_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimiser's names of every month, neutral where a benchmark name has no prediction."""
    p = source.market_panel(spark, sf_dir)
    scored = signal.calibrate(_signal(p.where("tradable")))
    return _round(rolling.problem(scored, _candidates(p), source.benchmark_of(p), policy="neutral_score"), "score", "expected_return", "benchmark_weight")


def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = source.read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), F.concat(F.lit(" "), (F.col("l_suppkey") * 1.0).cast("string"), F.lit(" ")).alias("t"), F.upper("l_linestatus").alias("s")
    )
    flag = truth(F.when(F.col("s") == "F", "No").otherwise("yes"))
    return raw.select("l_orderkey", "l_linenumber", normal_date("d").alias("date"), normal_ticker("t").alias("ticker"), flag.alias("open_line"))


QUERIES: tuple[Query, ...] = (
    calibrate_uniform, calibrate_power, calibrate_normal, calibrate_expected_return, mad_winsorize, signal_summary, top_candidates, rebalance_calendar, signal_quality, benchmark_renormalize, benchmark_excluded,
    optimizer_universe, coverage_by_date, store_returns, terminal_returns, existing_experiment, industry_asof, industry_overlap, size_exposure, nlsize_exposure, return_styles, standardized_beta,
    factor_returns_market_size, factor_returns_wls, factor_returns_industry, ewma_factor_covariance, covariance_repair, specific_variance, specific_impute, asset_covariance, asset_covariance_blocks, portfolio_risk, portfolio_metrics,
    risk_asof_exposures, risk_asof_covariance, risk_asof_specific, risk_asof_periods,
    changed_dates, risk_cache_states, frozen_signal_gate, resolved_ranges, range_report, covariance_diagnostics, risk_asof_diagnostics, sweep_summary, risk_asof_industry_exposures, risk_asof_industry_covariance, risk_asof_industry_specific,
    equal_weight_baseline, backtest_daily, benchmark_relative, index_relative, performance_summary, drifted_weights, constraint_checks, industry_exposures, optimized_targets, normalize_keys,
    rolling_targets, rolling_checks, constraint_report, single_date_problem,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}
