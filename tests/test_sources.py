"""Table sources and their refusals."""

import datetime

import pytest
from pyspark.errors import PySparkException

from alphaloom.errors import InputError
from alphaloom.operators import backtest, industry, signal
from alphaloom.sources import tables

KEYED = "date string, ticker string, "


@pytest.mark.parametrize("kind", ["date", "timestamp", "int", "string"])
def test_hive_layout_compares_dates_in_their_own_type(spark, tmp_path, kind):
    rows = [(datetime.date(2023, m, d), f"T{d}") for m in (1, 2, 3) for d in (1, 15, 28)]
    table = spark.createDataFrame(rows, "d date, ticker string")
    own = {"date": "d", "timestamp": "cast(d as timestamp) + interval 5 hours", "int": "cast(date_format(d, 'yyyyMMdd') as int)", "string": "date_format(d, 'yyyyMMdd')"}[kind]
    table.selectExpr(f"{own} as date", "ticker", "year(d) as year", "month(d) as month").write.partitionBy("year", "month").parquet(str(tmp_path / "t"))
    got = tables.read_hive_layout(spark, str(tmp_path / "t"), "20230115", "20230215")
    assert sorted(r.ticker for r in got.collect()) == ["T1", "T15", "T15", "T28"]


def test_signal_refuses_malformed_keys(spark):
    with pytest.raises(InputError, match="ticker"):
        tables.load_signal(spark.createDataFrame([("20230104", " ", 1.0)], KEYED + "prediction double"))
    with pytest.raises(InputError, match="date"):
        tables.load_signal(spark.createDataFrame([("20231399", "A", 1.0)], KEYED + "prediction double"))
    with pytest.raises(InputError):
        tables.load_signal(spark.createDataFrame([("20230104", "A", 1.0), ("2023-01-04", "A", 2.0)], KEYED + "prediction double"))
    assert tables.load_signal(spark.createDataFrame([("2023-01-04", "1.0", 1.0)], KEYED + "prediction double")).first().ticker == "1"


def test_wide_panel_and_matrix(spark):
    wide = spark.createDataFrame([("2023-01-04", 0.1, None), ("2023-01-05", 0.2, 0.3)], "`date` string, ` 12.0 ` double, B double")
    got = sorted(map(tuple, tables.unpivot_panel(wide, "return").collect()))
    assert got == [("20230104", "12", 0.1), ("20230105", "12", 0.2), ("20230105", "B", 0.3)]
    square = spark.createDataFrame([("A", 1.0, 0.5), ("B", 0.5, 2.0)], "ticker string, A double, B double")
    assert tables.unpivot_matrix(square).count() == 4
    for rows in ([("A", 1.0, 0.5), ("A", 0.5, 2.0)], [("A", 1.0, 0.5), ("C", 0.5, 2.0)], [("A", 1.0, 0.5), ("B", 0.5, 2.0), ("B", 0.5, 2.0)]):
        with pytest.raises(InputError):
            tables.unpivot_matrix(spark.createDataFrame(rows, square.schema))


def test_weights_labels_and_exposures_cover_the_universe(spark):
    universe = spark.createDataFrame([("20230104", "A"), ("20230104", "B")], KEYED.rstrip(", "))
    weights = tables.load_weights(spark.createDataFrame([("20230104", "A", 1.0)], KEYED + "w double"), "w", universe)
    assert sorted(map(tuple, weights.collect())) == [("20230104", "A", 1.0), ("20230104", "B", 0.0)]
    with pytest.raises(InputError):
        tables.load_labels(spark.createDataFrame([("A", "x"), ("B", " ")], "ticker string, sector string"), "sector", universe)
    with pytest.raises(InputError):
        tables.load_tradability(spark.createDataFrame([("A", "maybe"), ("B", "yes")], "ticker string, tradable string"), universe)
    x = tables.load_exposures(spark.createDataFrame([("A", 1.0, "x"), ("B", 2.0, "y")], "ticker string, SIZE double, sector string"), universe)
    assert sorted(map(tuple, x.collect())) == [("A", "SIZE", 1.0), ("B", "SIZE", 2.0)]


def test_two_valid_industries_stop_the_job(spark):
    keys = spark.createDataFrame([("20230104", "A")], KEYED.rstrip(", "))
    history = spark.createDataFrame([("A", "x", "20220101", None), ("A", "y", "20230104", "")], "ticker string, industry string, in_date string, out_date string")
    with pytest.raises(PySparkException, match="two industries"):
        industry.industry_asof(keys, history).collect()


def test_missing_returns_and_total_loss_stop_the_backtest(spark):
    targets = spark.createDataFrame([("20230102", "A", "p", 1.0)], KEYED + "portfolio string, target_weight double")
    rows = [("20230102", "A", 0.0), ("20230103", "A", -1.0), ("20230102", "B", 0.0), ("20230103", "B", 0.0)]
    with pytest.raises(PySparkException, match="nothing is left"):
        backtest.backtest(targets, spark.createDataFrame(rows, KEYED + "return double"), 0.0).collect()
    with pytest.raises(PySparkException, match="no return for A"):
        backtest.backtest(targets, spark.createDataFrame([r for r in rows if r[1] == "B" or r[0] == "20230102"], KEYED + "return double"), 0.0).collect()


def test_keys_are_complete_and_unique(spark):
    universe = spark.createDataFrame([("20230102", "A"), ("20230102", "B")], "date string, ticker string")
    with pytest.raises(InputError, match="missing or malformed.*date"):
        tables.load_weights(spark.createDataFrame([("2023-13-41", "A", 1.0)], "date string, ticker string, w double"), "w")
    with pytest.raises(InputError, match="missing or malformed.*ticker"):
        tables.load_asset_returns(spark.createDataFrame([("20230102", None, 0.1)], "date string, ticker string, return double"))
    with pytest.raises(InputError, match="tradability: repeated keys .*'A'"):
        tables.load_tradability(spark.createDataFrame([("A", "true"), ("A", "false"), ("B", "true")], "ticker string, tradable string"), universe)
    with pytest.raises(InputError, match="exposures: repeated keys .*'B'"):
        tables.load_exposures(spark.createDataFrame([("A", 1.0), ("B", 2.0), ("B", 3.0)], "ticker string, SIZE double"), universe)


def test_expected_returns_are_taken_as_they_are(spark):
    table = spark.createDataFrame([("d1", t, float(v)) for t, v in zip("ABC", (0.01, 0.03, -0.01), strict=True)], "date string, ticker string, prediction double")
    got = {r.ticker: (round(r.signal_score, 6), r.expected_return) for r in signal.given_returns(table).collect()}
    assert got == {"A": (0.0, 0.01), "B": (1.224745, 0.03), "C": (-1.224745, -0.01)}
    assert {r.ticker: r.expected_return for r in signal.given_returns(table, higher_is_better=False).collect()}["B"] == -0.03
    with pytest.raises(Exception, match="no cross-sectional variation on d1"):
        signal.given_returns(table.withColumn("prediction", table.prediction * 0)).collect()
    with pytest.raises(Exception, match="missing or not finite on d1"):
        signal.given_returns(table.union(spark.createDataFrame([("d1", "D", float("nan"))], table.schema))).collect()
    with pytest.raises(InputError, match="no cross-sectional variation"):
        signal.require_variation(signal.calibrate(table.withColumn("prediction", table.prediction * 0)))
    assert signal.require_variation(signal.calibrate(table)).count() == 3
