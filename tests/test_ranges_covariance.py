"""Range resolution by precedence, report lines, and covariance checks in long form against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.errors import ConfigError, RiskError
from alphaloom.operators import covariance, ranges, risk
from alphaloom.plans import queries

FACTORS = [(d, f, "STYLE" if f == "SIZE" else "INDUSTRY") for d in ("d1", "d2") for f in ("A", "B", "SIZE")]


def _resolve(spark, *limits):
    factors = spark.createDataFrame(FACTORS, "date string, factor string, family string")
    return ranges.resolve_ranges(factors, spark.createDataFrame(list(limits), ranges.LIMITS))


def _limit(family, factor=None, date=None, lower=None, upper=None, target=None, tolerance=None, enabled=True):
    return family, factor, date, lower, upper, target, tolerance, enabled


def test_the_most_specific_limit_decides(spark):
    got = _resolve(
        spark, _limit("INDUSTRY", lower=-0.2, upper=0.2), _limit("INDUSTRY", date="d2", lower=-0.3, upper=0.3), _limit("INDUSTRY", "B", target=0.1, tolerance=0.05), _limit("INDUSTRY", "A", "d1", enabled=False),
    )
    assert sorted((r.date, r.factor, round(r.lower, 9), round(r.upper, 9), r.level) for r in got.collect()) == [
        ("d1", "B", 0.05, 0.15, "factor"), ("d2", "A", -0.3, 0.3, "family on a date"), ("d2", "B", 0.05, 0.15, "factor"),
    ]


REFUSED = {
    "two limits of one key": [_limit("STYLE", lower=-1.0, upper=1.0), _limit("STYLE", lower=-2.0, upper=2.0)],
    "bounds crossed": [_limit("STYLE", lower=1.0, upper=-1.0)],
    "without a range": [_limit("STYLE", target=0.0)],
    "no date has": [_limit("INDUSTRY", lower=-1.0, upper=1.0), _limit("INDUSTRY", "C", lower=-1.0, upper=1.0)],
    "without a limit in a family": [_limit("INDUSTRY", "A", lower=-1.0, upper=1.0)],
}


@pytest.mark.parametrize("what", REFUSED)
def test_limits_that_are_refused(spark, what):
    with pytest.raises(ConfigError, match=what):
        _resolve(spark, *REFUSED[what])


def test_range_lines_by_hand(spark):
    sums = spark.createDataFrame([("d1", "p", "A", 0.25), ("d1", "p", "B", -0.1)], "date string, portfolio string, factor string, active_exposure double")
    found = spark.createDataFrame([("d1", "A", -0.2, 0.2), ("d1", "B", -0.1, 0.3), ("d1", "SIZE", -0.5, 0.5), ("d2", "A", 0.0, 0.0)], "date string, factor string, lower double, upper double")
    got = {r.constraint: (r.value, r.bound, round(r.excess, 9), r.status) for r in ranges.range_lines(sums, found).collect()}
    assert got["active_exposure_range:A:upper"] == (0.25, 0.2, 0.05, "violated") and got["active_exposure_range:A:lower"][3] == "slack"
    assert got["active_exposure_range:B:lower"] == (-0.1, -0.1, 0.0, "binding") and got["active_exposure_range:SIZE:upper"] == (0.0, 0.5, -0.5, "slack") and len(got) == 6


def test_frozen_names_outside_their_bounds_are_disclosed(spark):
    rows = [("d", "p", "A", False, 0.35, 0.3), ("d", "p", "B", False, 0.2, 0.25), ("d", "p", "C", True, 0.4, 0.1), ("d", "p", "D", False, None, 0.1)]
    table = spark.createDataFrame(rows, "date string, portfolio string, ticker string, tradable boolean, current_weight double, benchmark_weight double")
    assert [(r.ticker, r.held_weight, r.upper) for r in ranges.frozen_bounds(table, 0.3, 0.2).collect()] == [("A", 0.35, 0.3)]


def _cells(spark, *matrices):
    rows = [(name, f"n{i}", f"n{j}", float(m[i][j])) for name, m in matrices for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, "matrix string, row_name string, col_name string, covariance double")


def test_diagnostics_and_repair_equal_numpy(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(5, 3))
    low = a @ a.T / 252 + np.diag([1e-9] * 5)
    skew = np.zeros((5, 5))
    skew[0, 1] = 1e-11
    rules = covariance.MatrixRules(annualized=False, periods=252, eigenvalue_floor=1e-3)
    checked = covariance.checked(_cells(spark, ("low", low + skew), ("fine", np.eye(3) / 252)), rules)
    got = {r.matrix: r for r in covariance.diagnostics(checked, rules.eigenvalue_floor).collect()}
    values, vectors = np.linalg.eigh((low + (skew + skew.T) / 2) * 252)
    fixed = (vectors * np.maximum(values, 1e-3)) @ vectors.T
    r = got["low"]
    assert (r.names, r.was_repaired) == (5, True) and r.max_asymmetry == pytest.approx(1e-11 * 252, rel=1e-3) and r.max_eigenvalue_before == pytest.approx(values[-1])
    assert r.min_eigenvalue_before == pytest.approx(values[0], abs=1e-9) and r.min_eigenvalue_after == pytest.approx(1e-3) and r.repair_frobenius == pytest.approx(np.linalg.norm(fixed - low * 252), rel=1e-6)
    assert not got["fine"].was_repaired and got["fine"].repair_frobenius == pytest.approx(0, abs=1e-12) and got["fine"].min_eigenvalue_before == pytest.approx(1)
    frame = covariance.repaired(checked.where("matrix = 'low'").drop("asymmetry"), 1e-3).toPandas().pivot(index="row_name", columns="col_name", values="covariance")
    assert np.allclose(frame.to_numpy(), fixed)


@pytest.mark.parametrize("block_names", [2, 100])
def test_blocks_make_the_whole_matrix(spark, block_names):
    rng = np.random.default_rng(1)
    names, factors = [f"T{i}" for i in range(9)], ["M", "S"]
    x, f, d = rng.normal(size=(9, 2)), np.array([[0.04, 0.01], [0.01, 0.02]]), rng.uniform(0.1, 0.2, 9)
    x[3, 1] = 0
    exposure = spark.createDataFrame([(n, k, float(x[i, j])) for i, n in enumerate(names) for j, k in enumerate(factors) if x[i, j]], "ticker string, factor string, exposure double")
    factor_cov = spark.createDataFrame([(a, b, float(f[i, j])) for i, a in enumerate(factors) for j, b in enumerate(factors)], "factor_a string, factor_b string, covariance double")
    cells = covariance.asset_blocks(exposure, factor_cov, spark.createDataFrame(list(zip(names, map(float, d), strict=True)), "ticker string, specific_var double"), block_names)
    assert cells.count() == 45
    want = x @ f @ x.T + np.diag(d)
    both = covariance.mirrored(cells).toPandas().pivot(index="row_ticker", columns="col_ticker", values="covariance")
    assert np.allclose(both.to_numpy(), want) and both.shape == (9, 9)
    out = covariance.wide(cells, ["T8", "T0"])
    assert out.columns == ["ticker", "T8", "T0"] and {r.ticker: (r.T8, r.T0) for r in out.collect()} == {n: (pytest.approx(want[i, 8]), pytest.approx(want[i, 0])) for i, n in ((8, "T8"), (0, "T0"))}


def test_wanted_names_may_come_in_any_order(spark):
    names = spark.createDataFrame([("m", "n2"), ("m", "n0")], "matrix string, name string")
    got = covariance.checked(_cells(spark, ("m", np.arange(9).reshape(3, 3) + np.arange(9).reshape(3, 3).T)), covariance.MatrixRules(), names)
    assert sorted((r.row_name, r.col_name, r.covariance) for r in got.collect()) == [("n0", "n0", 0.0), ("n0", "n2", 8.0), ("n2", "n0", 8.0), ("n2", "n2", 16.0)]
    with pytest.raises(RiskError, match="lacks rows or columns of .*'m'"):
        covariance.checked(_cells(spark, ("m", np.eye(2))), covariance.MatrixRules(), names)


def test_matrices_that_are_refused(spark):
    whole, rules = _cells(spark, ("m", np.eye(3))), covariance.MatrixRules()
    with pytest.raises(RiskError, match="missing or repeated for .*'n0', 'n1'"):
        covariance.checked(whole.where("not (row_name = 'n1' and col_name = 'n0')"), rules)
    with pytest.raises(RiskError, match="missing or repeated for .*'n2', 'n2'"):
        covariance.checked(whole.union(whole.where("row_name = 'n2' and col_name = 'n2'")), rules)
    with pytest.raises(RiskError, match="lacks rows or columns"):
        covariance.checked(whole.where("least(row_name, col_name) <> 'n0' or greatest(row_name, col_name) <> 'n1'"), rules)
    with pytest.raises(RiskError, match="not finite"):
        covariance.checked(_cells(spark, ("m", [[1, float("nan")], [0, 1]])), rules)
    with pytest.raises(RiskError, match="asymmetry beyond"):
        covariance.checked(_cells(spark, ("m", [[1, 0.1], [0.2, 1]])), rules)


def test_small_blocks_of_many_names_make_few_copies(spark):
    draw = np.random.default_rng(5)
    x, f = draw.normal(size=(300, 2)), np.array([[0.04, 0.01], [0.01, 0.02]])
    names, factors = [f"T{i:03d}" for i in range(300)], ["M", "S"]
    exposure = spark.createDataFrame([(n, k, float(x[i, j])) for i, n in enumerate(names) for j, k in enumerate(factors)], "ticker string, factor string, exposure double")
    factor_cov = spark.createDataFrame([(a, b, float(f[i, j])) for i, a in enumerate(factors) for j, b in enumerate(factors)], "factor_a string, factor_b string, covariance double")
    specific = spark.createDataFrame([(n, 0.1) for n in names], "ticker string, specific_var double")
    dealt, blocks, _ = covariance._dealt(exposure, factor_cov, specific, 1)
    assert blocks == covariance.MOST_BLOCKS and dealt.select("block").distinct().count() > blocks // 2
    want = x @ f @ x.T + 0.1 * np.eye(300)
    got = risk.asset_covariance(exposure, factor_cov, specific).toPandas().pivot(index="row_ticker", columns="col_ticker", values="covariance")
    assert got.shape == (300, 300) and np.allclose(got.to_numpy(), want)
    half = covariance.asset_blocks(exposure, factor_cov, specific, 1).toPandas()
    assert len({frozenset(p) for p in zip(half["row_ticker"], half["col_ticker"], strict=True)}) == len(half) == 300 * 301 // 2 and np.isclose(half["covariance"].sum(), np.triu(want).sum())


def test_a_written_matrix_is_small(spark, tmp_path):
    """Cells lie in the order of exposures, tile by tile: files hold runs, not a code a cell."""
    n = 1001
    names = spark.range(n).select(F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("ticker"), ((F.col("id") * 37 % 60) / 64.0).alias("s"), F.lit(0.1).alias("specific_var"))
    exposure = names.select("ticker", F.lit("M").alias("factor"), F.lit(1.0).alias("exposure")).union(names.select("ticker", F.lit("S"), "s"))
    factor_cov = spark.createDataFrame([("M", "M", 0.04), ("M", "S", 0.01), ("S", "M", 0.01), ("S", "S", 0.02)], "factor_a string, factor_b string, covariance double")
    for kind, cells in (("all", covariance.asset_cells(exposure, factor_cov, names, 143)), ("half", covariance.asset_blocks(exposure, factor_cov, names, 143))):
        cells.write.parquet(str(tmp_path / kind))
        assert spark.read.parquet(str(tmp_path / kind)).distinct().count() == (n * n if kind == "all" else n * (n + 1) // 2)
    assert sum(f.stat().st_size for f in (tmp_path / "all").glob("*.parquet")) < n * n / 2  # bytes; 1.9 a cell in the order of hashes
    dealt, blocks, _ = covariance._dealt(exposure, factor_cov, names, 143)
    got = dealt.orderBy("place").toPandas()
    assert blocks == 7 and list(got["place"]) == list(range(n)) and got["x_1"].is_monotonic_increasing
    assert (got["block"] == got["place"] // 144).all()


def test_no_names_make_an_empty_matrix(spark):
    none = spark.createDataFrame([], "ticker string, factor string, exposure double, specific_var double")
    factor_cov = spark.createDataFrame([("M", "M", 0.04)], "factor_a string, factor_b string, covariance double")
    assert covariance.asset_cells(none, factor_cov, none).count() == covariance.asset_blocks(none, factor_cov, none).count() == 0


def test_cells_are_rounded_as_decimals(spark):
    """The quick way takes no value that decimal rounding settles otherwise: ties, their neighbours, large and missing values."""
    rng = np.random.default_rng(2)
    values = [0.0, -0.0, 0.0000005, -0.0000005, 1.0000005, 2.4999995, 1e5 + 0.1234565, -3e-7, 1e300, -1e300, 2.0**40, 1234567.8912345, float("nan"), float("inf"), float("-inf"), None]
    values += [float(v) for v in rng.normal(size=3000)] + [float(k + 0.5) / 1e6 for k in range(1000)] + [float(np.nextafter((k + 0.5) / 1e6, k % 2)) for k in range(1000)]
    cells = spark.createDataFrame([(v,) for v in values], "covariance double")
    same = queries._rounded_cells(cells.withColumn("want", queries.rounded("covariance"))).where(F.col("covariance").eqNullSafe(F.col("want")))
    assert same.count() == len(values)
