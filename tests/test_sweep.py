"""Sweeps: settings by dotted path, what is refused before the run, and errors as rows."""

import pytest

from alphaloom.errors import ConfigError
from alphaloom.operators import backtest, signal, sweep

BASE = sweep.BASE


def test_overrides_by_path():
    got = sweep.overridden(BASE, {"signal.power": 2, "baseline.top_n": 3})
    assert got["signal"]["power"] == 2.0 and isinstance(got["signal"]["power"], float) and got["baseline"] == {"top_n": 3} and BASE["baseline"] == {"top_n": 10}
    for path, value in (("signal.unknown", 1), ("unknown.power", 1), ("signal", {}), ("signal.power.deep", 1), ("baseline.top_n", 2.5), ("baseline.top_n", True), ("signal.transform", 1), ("signal.power", "2"), ("signal.power", True)):
        with pytest.raises(ConfigError, match=path):
            sweep.overridden(BASE, {path: value})


def test_variants_are_named_once_and_hashed():
    found = sweep.resolve_variants([("a", {}), ("b.1", {"baseline.top_n": 5}), ("c-2", {"baseline.top_n": 10})])
    assert [v.same_as for v in found] == [None, None, "a"] and found[0].digest == found[2].digest != found[1].digest
    for wrong in ([("a", {}), ("A", {})], [("-a", {})], [("a b", {})], [("", {})], [], [("a", {"signal.transform": "magic"})], [("a", {"backtest.cost_bps": -1.0})], [("a", {"baseline.top_n": 0})]):
        with pytest.raises(ConfigError):
            sweep.resolve_variants(wrong)


def _tables(spark):
    days, names = [f"2023010{d}" for d in range(2, 7)], "ABCD"
    rows = [(d, t, float(i + (k % 2) * (3 - 2 * i)), 0.01 * (i - 1) + 0.001 * k) for k, d in enumerate(days) for i, t in enumerate(names)]
    table = spark.createDataFrame(rows, "date string, ticker string, prediction double, return double")
    signals, returns = table.select("date", "ticker", "prediction"), table.select("date", "ticker", "return")
    eligible = signals.where("date in ('20230102', '20230104')").select("date", "ticker")
    return signals, returns, eligible, eligible.selectExpr("date", "ticker", "0.25 as benchmark_weight")


def test_a_failed_variant_is_a_row_and_equal_ones_run_once(spark):
    signals, returns, eligible, bench = _tables(spark)
    variants = sweep.resolve_variants([("two", {"baseline.top_n": 2}), ("wide", {"baseline.top_n": 5}), ("twin", {"baseline.top_n": 2}), ("dear", {"baseline.top_n": 2, "backtest.cost_bps": 100.0}), ("low", {"baseline.top_n": 1, "signal.higher_is_better": False})])
    got = {r.variant: r for r in sweep.sweep(signals, eligible, bench, returns, variants).collect()}
    assert {n: (r.status, r.error, r.reused_from) for n, r in got.items()} == {
        "two": ("success", None, None), "wide": ("failed", "fewer than 5 candidates on 2 dates", None), "twin": ("success", None, "two"), "dear": ("success", None, None), "low": ("success", None, None),
    }
    assert got["wide"].ending_nav is None and got["twin"].ending_nav == got["two"].ending_nav and got["dear"].ending_nav < got["two"].ending_nav
    scored = signal.calibrate(signals).join(eligible, ["date", "ticker"])
    targets = signal.equal_weight_baseline(scored, 2).selectExpr("date", "ticker", "'p' as portfolio", "target_weight")
    want = backtest.backtest(targets, returns, 10.0).orderBy("date").collect()
    assert got["two"].ending_nav == pytest.approx(want[-1].nav, rel=1e-12) and got["two"].total_turnover == pytest.approx(sum(r.turnover for r in want))


def test_flat_signals_fail_their_variant_only(spark):
    signals, returns, eligible, bench = _tables(spark)
    flat = signals.selectExpr("date", "ticker", "case when date = '20230104' then 1.0 else prediction end as prediction")
    got = sweep.sweep(flat, eligible, bench, returns, sweep.resolve_variants([("two", {"baseline.top_n": 2})])).first()
    assert (got.status, got.error, got.observations) == ("failed", "no cross-sectional variation on 1 dates", None)


def test_variants_share_the_scores_of_equal_predictions(spark):
    values = [0.5, 0.5, -1.0, 3.0, 3.0, 3.0, 40.0, None, 0.25, -0.75]
    rows = [(d, f"T{i}", v) for d in ("20230102", "20230103") for i, v in enumerate(values[: 10 if d == "20230102" else 7])]
    signals = spark.createDataFrame(rows, "date string, ticker string, prediction double")
    made = {"base": {}, "small": {"baseline.top_n": 2}, "dear": {"backtest.cost_bps": 50.0}, "skewed": {"signal.transform": "power", "signal.power": 2.0}, "bell": {"signal.transform": "normal_score", "signal.higher_is_better": False}}
    variants = sweep.resolve_variants(list(made.items()))
    got = {(r.key, r.date, r.prediction): r.score for r in sweep.calibrated(signals, variants).collect()}
    assert len(got) == 3 * (7 + 4)  # three signal settings, distinct predictions of two dates
    for v in variants:
        s = v.config["signal"]
        for r in signal.calibrate(signals, s["transform"], s["power"], s["winsorize_mad"], higher_is_better=s["higher_is_better"]).collect():
            assert got[sweep._signal_key(v), r.date, r.raw_prediction] == pytest.approx(r.signal_score, rel=1e-9)
