"""Optimised weights against problems with known optima, and a recheck of every limit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.errors import ConfigError, SolverError
from alphaloom.operators import constraints, optimize
from alphaloom.operators.optimize import Limits, solve
from alphaloom.plans import queries
from alphaloom.sources import panel as source

NONE = np.zeros(4, dtype=bool)
FLAT = np.full(4, 0.25)
EMPTY = np.zeros((4, 0))


def test_binding_tracking_error():
    limits = Limits(0.6, 0.4, tracking_error=0.05, candidate_floor=0.55)
    w = solve(np.array([4.0, 3, 2, 1]), FLAT, None, NONE, np.array([True, True, False, False]), 0.1 * np.eye(4), EMPTY, limits)
    assert np.allclose(w, [0.35606602, 0.28535534, 0.21464466, 0.14393398], atol=1e-6)


def test_binding_turnover():
    limits = Limits(0.6, 0.4, tracking_error=0.30, turnover=0.50, cost=0.001)
    w = solve(np.array([1, 0.5, -0.5, -1]), FLAT, FLAT, NONE, NONE, 0.1 * np.eye(4), EMPTY, limits)
    assert np.allclose(w, [0.6, 0.4, 0, 0], atol=1e-6)


def test_mean_variance_interior():
    mu = np.array([0.02, 0.01, -0.01, -0.02])
    w = solve(mu, FLAT, None, NONE, NONE, 0.1 * np.eye(4), EMPTY, Limits(0.9, 0.9, risk_aversion=5.0))
    assert np.allclose(w, FLAT + mu / 0.5, atol=1e-6)


def test_frozen_name_and_ranges():
    x = np.array([[-1.0], [-0.5], [0.5], [1.0]])
    frozen = np.array([True, False, False, False])
    w = solve(np.array([4.0, 3, 2, 1]), FLAT, np.array([0.35, 0.25, 0.2, 0.2]), frozen, NONE, 0.1 * np.eye(4), x, Limits(0.3, 0.2, tracking_error=0.3, ranges=((-0.05, 0.05),)))
    assert w[0] == 0.35 and abs(w.sum() - 1) < 1e-9 and w[1:].max() <= 0.3 + 1e-6 and abs(x[:, 0] @ (w - FLAT)) <= 0.05 + 1e-6


def test_infeasible_limits():
    with pytest.raises(SolverError):
        solve(FLAT, FLAT, None, NONE, NONE, np.eye(4), EMPTY, Limits(0.1, 0.4, tracking_error=0.3))
    with pytest.raises(SolverError):
        solve(FLAT, FLAT, None, NONE, np.array([True, False, False, False]), np.eye(4), EMPTY, Limits(0.3, 0.4, tracking_error=0.9, candidate_floor=0.5))
    with pytest.raises(ConfigError):
        Limits(0.3, 0.2)


def test_groups(spark):
    rows = [(d, "v", t, s, 0.25, None, True, True, 0.1, [], [], []) for d in ("20230104", "20230105") for t, s in zip("ABCD", (4.0, 3.0, 2.0, 1.0), strict=True)]
    kind = "date string, variant string, ticker string, score double, benchmark_weight double, current_weight double, tradable boolean, is_candidate boolean, specific_var double, loadings array<double>, half_loadings array<double>, exposures array<double>"
    limits = Limits(0.6, 0.4, tracking_error=0.05)
    got = optimize.optimize(spark.createDataFrame(rows, kind), limits).orderBy("date", "ticker").collect()
    assert len(got) == 8 and np.allclose([r.target_weight for r in got[:4]], [r.target_weight for r in got[4:]]) and abs(got[0].target_weight - 0.35606602) < 1e-6
    assert optimize.optimize(spark.createDataFrame([], kind), limits).count() == 0


def test_query_keeps_every_limit(spark, small):
    p = source.market_panel(spark, small)
    names = queries._problems(p)
    targets = optimize.optimize(names, queries.LIMITS).persist()
    weights = targets.join(names.select("date", "ticker", "benchmark_weight", "tradable", "is_candidate", "specific_var", "exposures", "score"), ["date", "ticker"]).withColumnRenamed("variant", "portfolio")
    report = constraints.weight_checks(weights, 1.0, 0.12).collect()
    assert report and all(r.passed for r in report)
    active = "target_weight - benchmark_weight"
    rows = weights.groupBy("date").agg(F.expr(f"sqrt(0.002 * power(sum({active}), 2) + sum(specific_var * power({active}, 2)))").alias("te"), F.expr(f"sum(({active}) * exposures[0])").alias("size"), F.expr(f"sum(({active}) * score)").alias("gain")).collect()
    assert all(r.te <= 0.05 + 1e-6 and abs(r.size) <= 0.2 + 1e-6 and r.gain >= -1e-6 for r in rows) and max(r.gain for r in rows) > 0


def test_many_names_in_factored_form():
    n, draw = 20_000, np.random.default_rng(3)
    benchmark, score, size = draw.uniform(0.5, 1.5, n), draw.normal(size=n), draw.normal(size=(n, 1))
    benchmark /= benchmark.sum()
    risk = optimize.Covariance.factored(draw.uniform(0.02, 0.2, n), np.ones((n, 1)), np.full((n, 1), 0.002))
    w = solve(score, benchmark, benchmark, np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), risk, size, Limits(1.0, 0.12, tracking_error=0.05, turnover=0.3, ranges=((-0.2, 0.2),)))
    active = w - benchmark
    assert abs(w.sum() - 1) < 1e-6 and w.min() > -1e-6 and np.abs(active).sum() / 2 <= 0.3 + 1e-6 and abs(size[:, 0] @ active) <= 0.2 + 1e-6
    assert np.sqrt(active @ risk.times(active)) <= 0.05 + 1e-6 and score @ active > 0.5


def test_factored_and_dense_covariance_agree():
    draw = np.random.default_rng(4)
    x, f, d = draw.normal(size=(30, 3)), np.diag([0.01, 0.002, 0.004]), draw.uniform(0.02, 0.1, 30)
    dense = x @ f @ x.T + np.diag(d)
    limits = Limits(0.4, 0.3, tracking_error=0.1, turnover=0.4, cost=0.001, ranges=((-0.5, 0.5),))
    both = [solve(x[:, 0] - x[:, 1], np.full(30, 1 / 30), np.full(30, 1 / 30), np.zeros(30, dtype=bool), np.zeros(30, dtype=bool), c, x[:, 2:], limits) for c in (dense, optimize.Covariance.factored(d, x, x @ f))]
    assert np.allclose(*both, atol=1e-6)
