"""Steps that many queries share: what they cost does not grow beyond one pass over the rows."""

import pytest

from alphaloom.operators import backtest, ranges, risk
from alphaloom.operators.calendar import common_calendar
from alphaloom.plans import queries
from alphaloom.sources.publish import settled

ROWS = [("d1", "a", 0.5, "X", 1.0), ("d1", "b", 1.0, "Y", 2.0), ("d1", "c", None, "Z", 3.0), ("d2", "a", 2.0, "X", 4.0)]
RETURNS = [("d1", "SIZE", 0.1), ("d1", "INDUSTRY:X", 1.0), ("d1", "INDUSTRY:Y", -1.0), ("d3", "SIZE", 9.0)]


def _plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


def _tables(spark):
    rows = spark.createDataFrame(ROWS, "date string, ticker string, SIZE double, industry string, y double")
    return rows, spark.createDataFrame(RETURNS, "date string, factor string, factor_return double")


def test_residuals_do_not_shuffle_the_rows(spark):
    rows, returns = _tables(spark)
    found = risk.residuals(rows, returns, ("SIZE",), market=False, industry=True)
    got = {(r.date, r.ticker): r.residual for r in found.collect()}
    assert set(got) == {("d1", "a"), ("d1", "b"), ("d1", "c")} and got["d1", "c"] is None
    assert got["d1", "a"] == pytest.approx(1.0 - 1.05) and got["d1", "b"] == pytest.approx(2.0 + 0.9)
    assert "SortMergeJoin" not in _plan(found) and "Generate" not in _plan(found)


def test_a_name_without_any_factor_return_has_no_residual(spark):
    rows, returns = _tables(spark)
    found = risk.residuals(rows.drop("industry"), returns.where("factor <> 'SIZE'"), ("SIZE",))
    assert found.count() == 0


def test_common_dates_come_from_dates_alone(spark):
    one = spark.createDataFrame([("d1",), ("d2",), ("d2",), ("d4",)], "date string")
    other = spark.createDataFrame([("d2",), ("d4",), ("d4",), ("d5",)], "date string")
    found = common_calendar(one, other)
    assert sorted(map(tuple, found.select("date", "ix", "prev_date").collect())) == [("d2", 0, None), ("d4", 1, "d2")]
    assert "Join" not in _plan(found)


def test_settled_tables_are_read_by_column(spark):
    kept = settled(spark.range(10).selectExpr("id", "id * 2 as twice"))
    assert sorted(r.twice for r in kept.select("twice").collect()) == list(range(0, 20, 2))
    assert "ReadSchema: struct<twice:bigint>" in _plan(kept.select("twice"))


def test_ranges_are_resolved_from_one_pass_over_the_factors(spark):
    rows = [(d, f, "STYLE") for d in ("d1", "d2") for f in ("A", "B", "C")]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    factors = spark.createDataFrame(rows, "date string, factor string, family string").mapInArrow(counted, "date string, factor string, family string")
    found = ranges.resolve_ranges(factors, spark.createDataFrame([("STYLE", None, None, -1.0, 1.0, None, None, True)], ranges.LIMITS))
    assert found.count() == 6 and seen.value == 6


def test_range_lines_do_not_work_the_book_out_again(spark, small):
    assert "lineitem" not in _plan(queries.range_report(spark, small))


def test_names_are_held_once_and_what_follows_reads_none(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    days = [f"2023010{d}" for d in range(2, 8)]
    returns = spark.createDataFrame([(d, t, 0.01 * i) for d in days for i, t in enumerate("AB")], "date string, ticker string, return double")
    rows = [("20230102", "A", "p", 1.0), ("20230104", "B", "p", 1.0), ("20230104", "A", "p", 0.0), ("20230103", "B", "q", 1.0)]
    targets = spark.createDataFrame(rows, "date string, ticker string, portfolio string, target_weight double")
    daily = backtest.backtest(targets, returns.mapInArrow(counted, returns.schema), 100.0)
    got = {(r.portfolio, r.date): (r.gross_return, r.turnover) for r in daily.collect()}
    assert set(got) == {("p", d) for d in days[1:]} | {("q", d) for d in days[2:]}
    assert got["p", "20230104"] == (pytest.approx(0.0), 0.0) and got["p", "20230105"] == (pytest.approx(0.01), 1.0) and got["q", "20230104"] == (pytest.approx(0.01), 0.0)
    assert seen.value <= 2 * len(days) * 2  # the calendar and the holdings
