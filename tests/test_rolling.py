"""Single-date problems, paths of targets and limit reports on small cases worked by hand."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from alphaloom.errors import InputError
from alphaloom.operators import optimize, rolling

LIMITS = optimize.Limits(max_weight=1.0, max_active=0.4, tracking_error=1.0)


def _tables(spark):
    scored = spark.createDataFrame([("20230104", t, s, s / 20) for t, s in (("A", 1.0), ("B", 0.5), ("C", -1.0))], "date string, ticker string, signal_score double, expected_return double")
    candidates = spark.createDataFrame([("20230104", "A"), ("20230104", "B")], "date string, ticker string")
    benchmark = spark.createDataFrame([("20230104", "B", 0.5), ("20230104", "D", 0.5)], "date string, ticker string, benchmark_weight double")
    return scored, candidates, benchmark


def test_problem_and_its_refusals(spark):
    scored, candidates, benchmark = _tables(spark)
    got = {r.ticker: r for r in rolling.problem(scored, candidates, benchmark, policy="neutral_score").collect()}
    assert set(got) == {"A", "B", "D"} and got["D"].was_missing and got["D"].score == 0 and got["A"].current_weight is None and got["A"].is_candidate and not got["D"].is_candidate
    with pytest.raises(InputError, match="without a prediction.*D"):
        rolling.problem(scored, candidates, benchmark)
    flags = lambda **f: spark.createDataFrame([("20230104", t, f.get(t, True)) for t in "ABD"], "date string, ticker string, tradable boolean")
    with pytest.raises(InputError, match="need current weights.*D"):
        rolling.problem(scored, candidates, benchmark, flags(D=False), policy="neutral_score")
    current = spark.createDataFrame([("20230104", "D", 1.0)], "date string, ticker string, current_weight double")
    frozen = {r.ticker: r for r in rolling.problem(scored, candidates, benchmark, flags(D=False), current).collect()}
    assert frozen["D"].current_weight == 1.0 and frozen["A"].current_weight == 0.0
    with pytest.raises(InputError, match="candidates"):
        rolling.problem(scored.where("ticker <> 'A'"), candidates, benchmark)
    with pytest.raises(InputError, match="unknown policy"):
        rolling.problem(scored, candidates, benchmark, policy="drop")


def test_growth_between_dates(spark):
    returns = spark.createDataFrame([(f"2023010{d}", t, 0.1 * d) for d in range(1, 6) for t in ("A", "B") if (d, t) != (4, "B")], "date string, ticker string, return double")
    dates = spark.createDataFrame([("20230102",), ("20230105",)], "date string")
    got = {(r.date, r.ticker): r.growth for r in rolling.growth_between(returns, dates).collect()}
    assert set(got) == {("20230102", "A"), ("20230102", "B"), ("20230105", "A")}
    assert math.isclose(got["20230105", "A"], 1.3 * 1.4 * 1.5) and math.isclose(got["20230102", "A"], 1.1 * 1.2)


def _path(spark, rows):
    return spark.createDataFrame(
        [(d, "v", t, s, b, tr, True, 0.04, [1.0], [0.01], [0.0], g) for d, t, s, b, tr, g in rows],
        "date string, variant string, ticker string, score double, benchmark_weight double, tradable boolean, is_candidate boolean, specific_var double, loadings array<double>, half_loadings array<double>, exposures array<double>, growth double",
    )


def test_path_starts_each_date_from_drifted_weights(spark):
    rows = [("20230104", "A", 1.0, 0.8, True, 1.0), ("20230104", "B", -1.0, 0.2, True, 1.0), ("20230105", "A", None, 0.8, False, 2.0), ("20230105", "B", -1.0, 0.2, True, 1.0)]
    wide = optimize.Limits(max_weight=0.9, max_active=0.25, tracking_error=1.0)
    got = {(r.date, r.ticker): r for r in rolling.rolling_targets(_path(spark, rows), wide).collect()}
    assert got["20230104", "A"].current_weight is None and math.isclose(got["20230104", "A"].target_weight, 0.9, abs_tol=1e-4)
    drifted = 2 * 0.9 / (2 * 0.9 + 0.1)
    for field in ("current_weight", "target_weight"):
        assert math.isclose(got["20230105", "A"][field], drifted, abs_tol=1e-4) and math.isclose(got["20230105", "B"][field], 1 - drifted, abs_tol=1e-4)


def test_path_refuses_what_is_held_and_unknown(spark):
    rows = [("20230104", "A", 1.0, 0.5, True, 1.0), ("20230104", "B", -1.0, 0.5, True, 1.0), ("20230105", "B", -1.0, 1.0, True, 1.0)]
    with pytest.raises(PySparkException, match="nothing known of the held A"):
        rolling.rolling_targets(_path(spark, rows), LIMITS).collect()
    with pytest.raises(PySparkException, match="no prediction for A"):
        rolling.rolling_targets(_path(spark, [("20230104", "A", None, 1.0, True, 1.0)]), LIMITS).collect()
    assert rolling.rolling_targets(_path(spark, []), LIMITS).count() == 0


def test_report_lines(spark):
    rows = [("20230104", "p", "A", 0.6, 0.2, 0.6, False, True), ("20230104", "p", "B", 0.4, 0.8, 0.4, True, False)]
    book = spark.createDataFrame(rows, "date string, portfolio string, ticker string, target_weight double, benchmark_weight double, current_weight double, tradable boolean, is_candidate boolean")
    risk = spark.createDataFrame([("20230104", "p", 0.2)], "date string, portfolio string, tracking_error double")
    limits = optimize.Limits(max_weight=0.5, max_active=0.3, tracking_error=0.2, turnover=0.1, candidate_floor=0.7)
    got = {r["constraint"]: r.status for r in rolling.constraint_report(book, limits, risk).collect()}
    assert got == {
        "fully_invested": "binding", "long_only": "slack", "max_weight": "slack", "max_active_weight": "violated", "tradability_freeze": "binding", "max_turnover": "slack", "max_tracking_error": "binding", "candidate_weight_range:lower": "violated",
    }
    free = {r["constraint"]: r.status for r in rolling.constraint_report(book.withColumn("current_weight", F.lit(None).cast("double")), limits).collect()}
    assert free["max_weight"] == "violated" and "max_turnover" not in free and "tradability_freeze" not in free


def test_path_of_many_names_and_of_variants_that_skip_a_date(spark):
    n, dates = 3000, ("20230104", "20230105", "20230106")
    grid = spark.createDataFrame([(d, v) for d in dates for v in ("a", "b") if (d, v) != ("20230105", "b")], "date string, variant string").crossJoin(spark.range(n))
    names = grid.select(
        "date", "variant", F.format_string("T%05d", "id").alias("ticker"), F.sin(F.col("id") * 1.0).alias("score"), F.lit(1.0 / n).alias("benchmark_weight"), F.lit(True).alias("tradable"), F.lit(True).alias("is_candidate"), F.lit(0.04).alias("specific_var"),
        F.array(F.lit(1.0)).alias("loadings"), F.array(F.lit(0.002)).alias("half_loadings"), F.array(F.cos(F.col("id") * 3.0)).alias("exposures"), F.lit(1.0).alias("growth"),
    )
    limits = optimize.Limits(max_weight=0.5, max_active=0.2, tracking_error=0.02, turnover=0.2, ranges=((-0.3, 0.3),))
    got = rolling.rolling_targets(names, limits)
    moved = got.groupBy("variant", "date").agg(F.sum("target_weight").alias("total"), F.sum(F.abs(F.col("target_weight") - F.col("current_weight"))).alias("moved")).collect()
    assert len(moved) == 5 and all(abs(r.total - 1) < 1e-6 and (r.moved is None) == (r.date == dates[0]) and (r.moved is None or r.moved <= 0.4 + 1e-6) for r in moved)
