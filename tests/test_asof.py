"""The risk model as of dates: nothing later enters, and what it refuses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.errors import RiskError
from alphaloom.operators import asof, risk
from alphaloom.plans import queries
from alphaloom.sources import panel as source


def _rows(table, digits=9):
    doubles = [c for c, t in table.dtypes if t == "double"]
    return sorted(map(tuple, table.withColumns({c: F.round(c, digits) for c in doubles}).collect()))


def _months(p):
    return sorted(r.date for r in p.select("date").distinct().collect())


def test_later_rows_change_nothing(spark, small):
    p = source.market_panel(spark, small)
    month, day = _months(p)[45], _months(p)[45][:6] + "28"
    targets = p.where(p.date == month).where("tradable").select(F.lit(day).alias("as_of"), "ticker")
    returns, caps = source.returns_of(p), source.caps_of(p)
    later = asof.estimate(returns, caps, targets, queries.AS_OF)
    until = asof.estimate(returns.where(F.col("date") <= day), caps.where(F.col("date") <= day), targets, queries.AS_OF)
    for a, b in ((later.exposures, until.exposures), (later.factor_cov, until.factor_cov), (later.specific, until.specific), (later.periods, until.periods)):
        assert _rows(a) == _rows(b) and a.count()
    assert later.periods.first()["last"] == month


def test_refusals(spark, small):
    p = source.market_panel(spark, small)
    returns, caps = source.returns_of(p), source.caps_of(p)
    early, month = _months(p)[5], _months(p)[45]
    known = p.where(p.date == month).select(F.lit(month).alias("as_of"), "ticker")
    with pytest.raises(RiskError, match="fewer than 12"):
        asof.estimate(returns, caps, known.withColumn("as_of", F.lit(early)), queries.AS_OF)
    with pytest.raises(RiskError, match="without capitalisation.*NOBODY"):
        asof.estimate(returns, caps, known.union(spark.createDataFrame([(month, "NOBODY")], "as_of string, ticker string")), queries.AS_OF)
    strict = risk.RiskSettings(**{**queries.AS_OF.__dict__, "minimum_specific": 25, "max_imputed": 0.0})
    with pytest.raises(RiskError, match="imputed"):
        asof.estimate(returns, caps, known, strict)


def test_normal_equations_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    rows = []
    for d in range(6):
        for i in range(40):
            x = rng.normal(size=2)
            code = "ABC"[i % 3] if d else "AB"[i % 2]
            rows.append((f"2020010{d}", f"T{i}", float(rng.uniform(1, 5)), float(rng.normal() + (code == "B")), float(x[0]), float(x[0] if d == 5 else x[1]), code))
    table = spark.createDataFrame(rows, "date string, ticker string, weight double, y double, P double, Q double, industry string")
    frame = table.toPandas()
    for group in ("industry", None):
        sums = risk.regression_sums(table, ("P", "Q"), group)
        assert sums.count() == (17 if group else 6)
        got = risk.factor_returns_normal(sums, ("P", "Q")).toPandas()
        assert set(got.date) == {f"2020010{d}" for d in range(5)}  # the styles of the last date are equal
        for date, own in got.groupby("date"):
            day = frame[frame.date == date]
            codes = sorted(day.industry.unique()) if group else ["MARKET"]
            dummies = [np.ones(len(day)) if c == "MARKET" else (day.industry == c).to_numpy(float) for c in codes]
            root = np.sqrt(day.weight.to_numpy())
            want = np.linalg.lstsq(np.column_stack([day.P, day.Q, *dummies]) * root[:, None], day.y * root, rcond=None)[0]
            names = ["P", "Q", *(c if c == "MARKET" else f"INDUSTRY:{c}" for c in codes)]
            assert own.set_index("factor").factor_return[names].to_numpy() == pytest.approx(want, rel=1e-9) and set(own.n_codes) == {len(codes)}


def test_windows_keep_dates_that_show_all_their_industries(spark):
    window = spark.createDataFrame([("w", f"d{k}", 5 - k) for k in range(6)] + [("v", "d0", 0)], "as_of string, date string, age int")
    codes = spark.createDataFrame([(f"d{k}", "A") for k in range(6)] + [(f"d{k}", "B") for k in (1, 3, 4)], "date string, code string")
    kept, listed = asof.complete_windows(window, codes)
    assert _rows(kept) == [("v", "d0", 0), ("w", "d1", 2), ("w", "d3", 1), ("w", "d4", 0)]
    assert _rows(listed) == [("v", "A"), ("w", "A"), ("w", "B")]


def test_industries_as_of_a_date(spark, small):
    p = source.market_panel(spark, small)
    month = _months(p)[45]
    returns, caps = source.returns_of(p), source.caps_of(p)
    targets = p.where(p.date == month).where("tradable").select(F.lit(month).alias("as_of"), "ticker")
    settings = risk.RiskSettings(**{**queries.AS_OF_INDUSTRY.__dict__, "styles": ("SIZE", "NLSIZE")})
    history = spark.createDataFrame([(r.ticker, "AB"[i % 2], "19900101", None) for i, r in enumerate(p.select("ticker").distinct().orderBy("ticker").collect())], "ticker string, industry string, in_date string, out_date string")
    model = asof.estimate(returns, caps, targets, settings, history=history)
    assert {r.factor for r in model.exposures.select("factor").distinct().collect()} == {"SIZE", "NLSIZE", "INDUSTRY:A", "INDUSTRY:B"}
    assert model.exposures.where("factor like 'INDUSTRY:%'").groupBy("ticker").count().where("count <> 1").count() == 0
    assert model.factor_cov.count() == 16 and model.specific.count() == targets.count()
    matrix = model.factor_cov.toPandas().pivot(index="factor_a", columns="factor_b", values="covariance").to_numpy()
    assert np.allclose(matrix, matrix.T) and np.linalg.eigvalsh(matrix)[0] > 0
    one = targets.first().ticker
    moved = history.withColumn("out_date", F.when(F.col("ticker") == one, F.lit(_months(p)[44]))).union(spark.createDataFrame([(one, "NEW", month, None)], history.schema))
    with pytest.raises(RiskError, match="not seen.*INDUSTRY:NEW"):
        asof.estimate(returns, caps, targets, settings, history=moved)
    with pytest.raises(RiskError, match=f"without industry.*{one}"):
        asof.estimate(returns, caps, targets, settings, history=history.where(F.col("ticker") != one))
