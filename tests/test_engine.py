"""The engine's queries against their SQL, and small cases worked by hand."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from alphaloom.errors import InputError, RiskError
from alphaloom.functions.expressions import normal_date, normal_ticker
from alphaloom.operators import adapters, backtest, guards, risk, signal
from alphaloom.plans import oracle, queries

FAST = ["calibrate_uniform", "calibrate_normal", "top_candidates", "benchmark_renormalize", "terminal_returns", "industry_overlap", "size_exposure", "standardized_beta", "drifted_weights", "industry_exposures", "normalize_keys"]


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "NULL" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, small, name):
    found = queries.queries()[name](spark, small)
    with duckdb.connect() as connection:
        for file in os.listdir(small):
            connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
        wanted = connection.execute(oracle.oracle_sql()[name])
        columns = [c[0] for c in wanted.description]
        assert sorted(found.columns) == sorted(columns)
        assert _plain(found.collect(), found.columns) == _plain(wanted.fetchall(), columns)


def test_registry():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found) and set(queries.queries()) <= set(found)


def test_calibration_by_hand(spark):
    table = spark.createDataFrame([("20230104", t, float(v)) for t, v in zip("ABCD", (4, 1, 3, 2), strict=True)], "date string, ticker string, prediction double")
    got = {r.ticker: r.signal_score for r in signal.calibrate(table, zscore=False).collect()}
    assert got == {"A": 0.375, "B": -0.375, "C": 0.125, "D": -0.125}
    flat = signal.calibrate(table.withColumn("prediction", table.prediction * 0))
    assert all(r.signal_score is None for r in flat.collect())


def test_backtest_by_hand(spark):
    targets = spark.createDataFrame([("20230102", "A", "p", 1.0), ("20230103", "B", "p", 1.0)], "date string, ticker string, portfolio string, target_weight double")
    days = [("20230102", 0.0, 0.0), ("20230103", 0.1, 0.0), ("20230104", 0.0, 0.2)]
    returns = spark.createDataFrame([(d, t, r) for d, a, b in days for t, r in (("A", a), ("B", b))], "date string, ticker string, return double")
    initial = spark.createDataFrame([("p", "A", 0.5), ("p", "B", 0.5)], "portfolio string, ticker string, weight double")
    got = backtest.backtest(targets, returns, 100.0, initial).orderBy("date").collect()
    assert [r.date for r in got] == ["20230103", "20230104"]
    for r, gross, turnover, nav in zip(got, (0.1, 0.2), (0.5, 1.0), (1.095, 1.30305), strict=True):
        assert math.isclose(r.gross_return, gross) and math.isclose(r.turnover, turnover) and math.isclose(r.nav, nav)


def test_relative_performance_by_hand(spark):
    rows = [("20230103", "p", 0.02, 1.02), ("20230104", "p", 0.0, 1.02), ("20230103", "benchmark", 0.01, 1.01), ("20230104", "benchmark", -0.01, 0.9999)]
    got = backtest.relative_to_benchmark(spark.createDataFrame(rows, "date string, portfolio string, net_return double, nav double")).where("portfolio = 'p'").orderBy("date").collect()
    assert [round(r.active_return, 12) for r in got] == [0.01, 0.01] and math.isclose(got[1].active_nav, 1.02 / 0.9999)


def test_terminal_rows_by_hand(spark):
    table = spark.createDataFrame([("20230102", "A", 0.0), ("20230103", "A", 0.0), ("20230104", "A", 0.0), ("20230102", "B", 0.0), ("20230103", "B", 0.0)], "date string, ticker string, return double")
    events = adapters.terminal_returns(table, "20230103").where("terminal").collect()
    assert [(r.date, r.ticker, r["return"]) for r in events] == [("20230104", "B", -1.0)]


def test_bad_inputs_stop(spark):
    table = spark.createDataFrame([("A", 1.0), ("A", None)], "ticker string, w double")
    for call in (lambda: guards.require_unique(table, ["ticker"], "t"), lambda: guards.require_finite(table, ["w"], "t"), lambda: guards.require_columns(table, ["x"], "t"), lambda: guards.require_rows(table.limit(0), "t")):
        with pytest.raises(InputError):
            call()
    with pytest.raises(ValueError):
        risk.RiskSettings(styles=("VALUE",))


def test_keys_are_normalised(spark):
    table = spark.createDataFrame([("2023-01-04", " 12.0 "), ("20230104.0", "A"), ("20231341", ""), (None, None)], "d string, t string")
    got = [tuple(r) for r in table.select(normal_date("d"), normal_ticker("t")).collect()]
    assert got == [("20230104", "12"), ("20230104", "A"), (None, None), (None, None)]


@pytest.mark.parametrize("name", ["optimizer_universe", "coverage_by_date"])
def test_universe_holds_every_positive_benchmark_name(spark, name):
    """At a size where most names weigh less than 0.02."""
    sf_dir = "/root/testdata/sf0.01"
    found = queries.queries()[name](spark, sf_dir)
    with duckdb.connect() as connection:
        for file in os.listdir(sf_dir):
            connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
        wanted = connection.execute(oracle.oracle_sql()[name])
        columns = [c[0] for c in wanted.description]
        assert _plain(found.collect(), found.columns) == _plain(wanted.fetchall(), columns)


def test_too_many_imputed_names_are_an_error(spark):
    names = spark.createDataFrame([(f"T{i}", "A") for i in range(10)], "ticker string, industry string")
    known = lambda n: spark.createDataFrame([(f"T{i}", 0.01 * (i + 1)) for i in range(n)], "ticker string, specific_var double")
    filled = {r.ticker: r for r in risk.impute_specific(names, known(8), names, risk.RiskSettings()).collect()}
    assert filled["T9"].imputed and filled["T9"].specific_var == pytest.approx(0.045) and sum(r.imputed for r in filled.values()) == 2
    with pytest.raises(RiskError, match="30.00%"):
        risk.impute_specific(names, known(7), names, risk.RiskSettings())
    assert risk.impute_specific(names, known(7), names, risk.RiskSettings(max_imputed=0.3)).count() == 10


@pytest.mark.parametrize("name", ["specific_impute", "portfolio_risk"])
def test_imputing_queries_equal_their_sql(spark, small, name):
    test_query_equals_its_sql(spark, small, name)


def test_return_styles_do_not_depend_on_the_slices_of_names(spark, small):
    p = queries.source.market_panel(spark, small)
    sections, returns = queries._sections(p), queries.source.returns_of(p)
    whole, sliced = ({(r.date, r.ticker): (r.beta, r.resvol, r.momentum) for r in risk.return_styles(sections, returns, queries.MONTHLY, names).collect()} for names in (10_000, 3))
    assert whole and set(whole) == set(sliced)
    for key, values in whole.items():
        assert all((a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(values, sliced[key], strict=True))


def test_panel_sums_lines_by_numbers(spark, small):
    plan = queries.source.market_panel(spark, small)._jdf.queryExecution().analyzed().toString()
    sums = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert sums and not any("date_format" in line or "lpad" in line for line in sums)
