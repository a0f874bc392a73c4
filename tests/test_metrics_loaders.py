"""Portfolio metrics, an external index, and the loaders of candidates, weights, covariances and dated files."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from alphaloom.errors import InputError
from alphaloom.operators import backtest, risk
from alphaloom.plans import oracle, queries
from alphaloom.sources import tables
from tests.test_engine import _plain

KEYED = "date string, ticker string, "
DAILY = "date string, portfolio string, net_return double, nav double"


@pytest.mark.parametrize("name", ["portfolio_metrics", "index_relative"])
def test_query_equals_its_sql(spark, small, name):
    found = queries.queries()[name](spark, small)
    with duckdb.connect() as connection:
        for file in os.listdir(small):
            connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
        wanted = connection.execute(oracle.oracle_sql()[name])
        columns = [c[0] for c in wanted.description]
        rows = wanted.fetchall()
    assert sorted(found.columns) == sorted(columns) and rows
    assert _plain(found.collect(), found.columns) == _plain(rows, columns)


def test_metrics_equal_dense_matrices(spark):
    rng = np.random.default_rng(3)
    names, factors = [f"T{i}" for i in range(9)], ["MARKET", "SIZE", "BETA"]
    x, root, d = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.random(9)
    f = root @ root.T
    w, b, mu = rng.dirichlet(np.ones(9)), rng.dirichlet(np.ones(9)), rng.normal(size=9)
    w[2] = b[2] = 0
    rows = [("p", n, float(w[i]), float(b[i]), float(mu[i])) for i, n in enumerate(names)] + [("flat", n, float(b[i]), float(b[i]), float(mu[i])) for i, n in enumerate(names)] + [("p", "gone", 0.0, 0.0, None)]
    book = spark.createDataFrame(rows, "portfolio string, ticker string, target_weight double, benchmark_weight double, expected_return double")
    exposure = spark.createDataFrame([(n, k, float(x[i, j])) for i, n in enumerate(names) for j, k in enumerate(factors)], "ticker string, factor string, exposure double")
    cov = spark.createDataFrame([(a, c, float(f[i, j])) for i, a in enumerate(factors) for j, c in enumerate(factors)], "factor_a string, factor_b string, covariance double")
    own = spark.createDataFrame([(n, float(v)) for n, v in zip(names, d, strict=True)], "ticker string, specific_var double")
    got = {r.portfolio: r for r in risk.portfolio_metrics(book, exposure, cov, own).collect()}
    dense = x @ f @ x.T + np.diag(d)
    for portfolio, held in (("p", w), ("flat", b)):
        active, r = held - b, got[portfolio]
        want = (held @ mu, active @ mu, held @ dense @ held, active @ dense @ active)
        assert np.allclose((r.expected_return, r.active_expected_return, r.variance, r.tracking_variance), want, atol=1e-12)
        assert np.allclose((r.volatility**2, r.tracking_error**2), want[2:])
    with pytest.raises(InputError, match="risk model: nothing for .*T3"):
        risk.portfolio_metrics(book, exposure, cov, own.where("ticker <> 'T3'"))
    with pytest.raises(InputError, match="risk model: nothing for .*T3"):
        risk.portfolio_metrics(book, exposure.where("ticker <> 'T3'"), cov, own)
    with pytest.raises(InputError, match="expected_return"):
        risk.portfolio_metrics(book.withColumn("expected_return", F.when(F.col("ticker") != "T3", F.col("expected_return"))), exposure, cov, own)


def _two_days(spark):
    return spark.createDataFrame([("20230103", "p", 0.1, 1.1), ("20230104", "p", -0.1, 0.99)], DAILY)


def test_external_index_by_hand(spark):
    series = spark.createDataFrame([("20230102", 0.5), ("20230103", 0.0), ("20230104", 0.1)], "date string, benchmark_net_return double")
    got = backtest.relative_to_series(_two_days(spark), series).orderBy("date").collect()
    assert [round(r.active_return, 9) for r in got] == [0.1, -0.2]
    assert [round(r.active_nav, 9) for r in got] == [1.1, 0.9] and round(got[1].active_drawdown, 9) == round(0.9 / 1.1 - 1, 9)


@pytest.mark.parametrize(
    ("rows", "what"),
    [([("20230103", 0.0), ("20230103", 0.1)], "repeated"), ([("20230103", float("nan"))], "not finite"), ([("20230103", -1.0)], "-1 or less"), ([(None, 0.0)], "missing or malformed"), ([("20230103", None)], "missing, not finite")],
)
def test_external_index_refusals(spark, rows, what):
    with pytest.raises(InputError, match=what):
        backtest.relative_to_series(_two_days(spark), spark.createDataFrame(rows, "date string, benchmark_net_return double"))


def test_external_index_must_cover_the_backtest(spark):
    with pytest.raises(PySparkException, match="nothing for 20230104"):
        backtest.relative_to_series(_two_days(spark), spark.createDataFrame([("20230103", 0.0)], "date string, benchmark_net_return double")).collect()


def test_benchmark_portfolio_once_a_date(spark):
    daily = _two_days(spark).union(spark.createDataFrame([("20230103", "benchmark", 0.0, 1.0)], DAILY))
    assert [r.active_nav for r in backtest.relative_to_benchmark(daily).where("portfolio = 'p'").orderBy("date").collect()] == [1.1, None]
    with pytest.raises(PySparkException, match="benchmark: 0 rows on 20230104"):
        backtest.relative_to_benchmark(daily, required=True).collect()
    with pytest.raises(PySparkException, match="benchmark: 2 rows on 20230103"):
        backtest.relative_to_benchmark(daily.union(daily.where("portfolio = 'benchmark'"))).collect()


def test_candidates_and_weights(spark):
    raw = spark.createDataFrame([("2023-01-04", " A ", 0.4), ("20230104", "B", 0.6)], KEYED + "benchmark_weight double")
    assert sorted(map(tuple, tables.load_candidates(raw).collect())) == [("20230104", "A"), ("20230104", "B")]
    with pytest.raises(InputError, match="no rows"):
        tables.load_candidates(raw.limit(0))
    with pytest.raises(InputError, match="repeated"):
        tables.load_candidates(raw.union(raw))
    universe = spark.createDataFrame([("20230104", "A"), ("20230104", "C")], "date string, ticker string")
    assert sorted(map(tuple, tables.load_weights(raw, "benchmark_weight", universe).collect())) == [("20230104", "A", 0.4), ("20230104", "C", 0.0)]
    with pytest.raises(InputError, match="nothing for"):
        tables.load_weights(raw, "benchmark_weight", universe, complete=True)
    assert sorted(map(tuple, tables.initial_weights("20230104", raw).collect())) == [("A", 0.4), ("B", 0.6)]
    held = spark.createDataFrame([("20230104", "Z", 1.0)], KEYED + "current_weight double")
    assert [tuple(r) for r in tables.initial_weights("20230104", raw, held).collect()] == [("Z", 1.0)]
    with pytest.raises(InputError):
        tables.initial_weights("20230105", raw)


def test_covariance_of_a_universe(spark):
    long = spark.createDataFrame([(a, b, 1.0 if a == b else 0.2) for a in "ABC" for b in "ABC"], "row_ticker string, col_ticker string, covariance double")
    pick = lambda *names: spark.createDataFrame([(n,) for n in names], "ticker string")
    assert {(r.row_ticker, r.col_ticker) for r in tables.covariance_for(long, pick("C", "A")).collect()} == {(a, b) for a in "AC" for b in "AC"}
    with pytest.raises(InputError, match="nothing for"):
        tables.covariance_for(long, pick("A", "D"))
    with pytest.raises(InputError, match="3 pairs for 2 names"):
        tables.covariance_for(long.where("not (row_ticker = 'A' and col_ticker = 'B')"), pick("A", "B"))


def test_dated_paths(spark, tmp_path):
    root, table = str(tmp_path / "cov"), spark.range(1)
    table.write.parquet(f"{root}/date=20230104/covariance.parquet")
    table.write.parquet(f"{root}/20230105.parquet")
    found = lambda d, **more: tables.dated_path(spark, root, d, tables.COVARIANCE_NAMES, **more)
    assert found("20230104") == f"{root}/date=20230104/covariance.parquet" and found("20230105") == f"{root}/20230105.parquet"
    table.write.parquet(f"{root}/date=20230104/asset_cov.parquet")
    assert found("20230104") == f"{root}/date=20230104/asset_cov.parquet"
    assert found("20230106", optional=True) is None
    with pytest.raises(InputError, match="nothing for 20230106"):
        found("20230106")
    part = next(f for f in (tmp_path / "cov" / "20230105.parquet").iterdir() if f.suffix == ".parquet")
    assert tables.dated_path(spark, str(part), "20230107", tables.EXPOSURE_NAMES) == str(part)
