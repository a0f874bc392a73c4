"""The adapters' gates: what is published when all counts pass, and one refusal for each count."""

import json
import os

import pytest

from alphaloom.errors import InputError
from alphaloom.operators import gate
from alphaloom.sources import publish

DATES = ["20230102", "20230103", "20230104"]
NAMES = ["000001", "000002", "000003", "000004"]
RULES = gate.SignalRules("20230101", "20230131", 2, 2)
SIGNAL, BENCH, ABLE = "date string, ticker string, prediction double", "date string, ticker string, benchmark_weight double", "date string, ticker string, tradable string"


def _inputs():
    signal = [(d, t, float(i + (t == "000002") * 10)) for d in DATES for i, t in enumerate(NAMES)]
    bench = [(d, t, w) for d in DATES for t, w in (("000001", 0.30001), ("000002", 0.3), ("000004", 0.40002))]
    able = [(d, t, str(t != "000004").lower()) for d in DATES for t in NAMES]
    return {"signal": signal, "bench": bench, "able": able}


def _gated(spark, rules=RULES, **changed):
    rows = _inputs() | changed
    frames = [spark.createDataFrame(rows[k], s) for k, s in (("signal", SIGNAL), ("bench", BENCH), ("able", ABLE))]
    return gate.frozen_signal(*frames, rules), dict(zip(("signal", "benchmark", "eligibility"), frames, strict=True))


def _rows(folder, spark):
    return sorted(map(tuple, spark.read.parquet(folder).collect()))


def test_what_passes_is_published_whole(spark, tmp_path):
    gated, inputs = _gated(spark)
    target = f"{tmp_path}/inputs"
    manifest = gated.publish(target, inputs, notes={"rebalance_every": 2})
    assert sorted(os.listdir(tmp_path)) == ["inputs"] and set(manifest["outputs"]) == set(gated.tables)
    assert _rows(f"{target}/signal_candidates", spark) == [(d, t) for d in (DATES[0], DATES[2]) for t in ("000002", "000003")]
    assert _rows(f"{target}/optimizer_universe", spark) == [(d, t) for d in (DATES[0], DATES[2]) for t in NAMES]
    weights = [r for r in _rows(f"{target}/benchmark_weights", spark) if r[0] == DATES[0]]
    assert sum(r[2] for r in weights) == pytest.approx(1, abs=1e-12) and len(weights) == 3
    assert [r[:6] for r in _rows(f"{target}/rebalance_dates", spark)] == [(DATES[0], 1, 4, 2, 3, 4), (DATES[2], 2, 4, 2, 3, 4)]
    stored = json.load(open(f"{target}/manifest.json"))
    assert stored["quality"]["signal_rows"] == 8 and stored["quality"]["raw_deviation_max"] == pytest.approx(3e-5) and stored["rebalance_every"] == 2
    digests = {k: v for k, v in stored["inputs"].items()}
    assert publish.published(spark, target, digests)["signal"].count() == 4


def test_names_without_a_record_are_left_out_and_disclosed(spark):
    rows = [(d, t, w) for d in DATES for t, w in (("000001", 0.6), ("000002", 0.399), ("999999", 0.001))]
    gated, _ = _gated(spark, bench=rows)
    assert sorted({r.ticker for r in gated.tables["excluded"].collect()}) == ["999999"]
    assert all(abs(s - 1) < 1e-12 for _, s in gated.tables["benchmark_weights"].groupBy("date").sum("benchmark_weight").collect())
    counts = gated.counts()
    assert counts["excluded_count"] == 2 and counts["excluded_weight_max"] == pytest.approx(0.001) and not counts["benchmark_excluded_dates"]
    report = {r.name: (r.value, r.must_be_zero) for r in gate.gate_report(_gated(spark, bench=rows)[0]).collect()}
    assert report["excluded_count"] == (2.0, False) and report["short_dates"] == (0.0, True)


def test_lower_is_better_takes_the_other_end(spark):
    gated, _ = _gated(spark, gate.SignalRules("20230101", "20230131", 2, 2, higher_is_better=False))
    assert {r.ticker for r in gated.tables["signal"].collect()} == {"000001", "000003"}


_I = _inputs()
FAULTS = {
    "invalid_tickers": {"signal": [*_I["signal"], (DATES[0], " ", 1.0)]},
    "invalid_predictions": {"signal": [(d, t, float("nan") if t == "000003" else p) for d, t, p in _I["signal"]]},
    "duplicate_keys": {"signal": [*_I["signal"], (DATES[2], "000001", 3.0)]},
    "eligibility_duplicates": {"able": [*_I["able"], (DATES[0], "000001", "true")]},
    "eligibility_invalid": {"able": [(d, t, "perhaps" if t == "000001" else a) for d, t, a in _I["able"]]},
    "no_dates": {"signal": [("20220103", t, 1.0) for t in NAMES]},
    "short_dates": {"able": [(d, t, str(t == "000001").lower()) for d, t, _ in _I["able"]]},
    "benchmark_missing_dates": {"bench": [r for r in _I["bench"] if r[0] != DATES[2]]},
    "benchmark_duplicates": {"bench": [*_I["bench"], (DATES[0], "000001", 0.30001)]},
    "benchmark_invalid": {"bench": [*_I["bench"], (DATES[0], "000003", -0.0001)]},
    "benchmark_sum_dates": {"bench": [(d, t, w * 1.01) for d, t, w in _I["bench"]]},
    "benchmark_excluded_dates": {"bench": [(d, "999999" if t == "000001" else t, w) for d, t, w in _I["bench"]]},
}


@pytest.mark.parametrize("fault", FAULTS)
def test_each_fault_is_refused(spark, fault):
    gated, _ = _gated(spark, **FAULTS[fault])
    gated.counts()
    with pytest.raises(InputError, match=f"refused: .*{fault} = "):
        gated.gate.require()


def test_what_is_refused_leaves_nothing(spark, tmp_path):
    gated, inputs = _gated(spark, **FAULTS["short_dates"])
    with pytest.raises(InputError, match="refused: short_dates = 2 .*fewer than 2 tradable"):
        gated.publish(f"{tmp_path}/inputs", inputs)
    assert os.listdir(tmp_path) == []


def test_rules_are_checked():
    for wrong in ({"every": 0}, {"candidates": 0}, {"start": "20240101"}, {"sum_tolerance": float("nan")}, {"exclusion_tolerance": -1.0}):
        with pytest.raises(InputError):
            gate.SignalRules(**({"start": "20230101", "end": "20230131", "every": 1, "candidates": 1} | wrong))


EQUITY = "date string, symbol string, close double, pre_close double, market_value double, volume double, amount double, trade_status int"


def _equity(close=(11.0, 18.0)):
    return [("20230103", "000001", close[0], 10.0, 100.0, 5.0, 50.0, 0), ("20230103", "000002", close[1], 20.0, -1.0, 0.0, 0.0, 0), ("20230102", "000001", 10.0, 10.0, 90.0, 5.0, 50.0, 1)]


def test_store_inputs(spark, tmp_path):
    weights = spark.createDataFrame([("20230103", "000001", 1.0)], BENCH)
    equity = spark.createDataFrame(_equity(), EQUITY)
    gated = gate.store_inputs(equity, weights, "20230101", "20230103", "20230104")
    gated.publish(f"{tmp_path}/store", {"equity": equity, "weights": weights})
    assert [(r[1], round(r[2], 12)) for r in _rows(f"{tmp_path}/store/asset_returns", spark)] == [("000001", 0.1), ("000002", -0.1)]
    assert _rows(f"{tmp_path}/store/tradability", spark) == [("20230103", "000001", True), ("20230103", "000002", False)]
    assert len(_rows(f"{tmp_path}/store/returns", spark)) == 3 and [r[2] for r in _rows(f"{tmp_path}/store/market_cap", spark)] == [90.0, 100.0]
    broken = {
        "total_losses": (_equity((11.0, 18.0))[:2] + [("20230103", "000003", 1e-320, 20.0, 1.0, 1.0, 1.0, 0)], [("20230103", "000001", 1.0)]),
        "equity_duplicates": (_equity() + _equity()[:1], [("20230103", "000001", 1.0)]),
        "weight_duplicates": (_equity(), [("20230103", "000001", 1.0)] * 2),
        "weight_invalid": (_equity(), [("20230103", "000001", None)]),
        "no_weights": (_equity(), [("20220103", "000001", 1.0)]),
        "no_equity": ([("2022" + r[0][4:], *r[1:]) for r in _equity()], [("20230103", "000001", 1.0)]),
    }
    for fault, (rows, held) in broken.items():
        gated = gate.store_inputs(spark.createDataFrame(rows, EQUITY), spark.createDataFrame(held, BENCH), "20230101", "20230103", "20230104")
        gated.counts()
        with pytest.raises(InputError, match=f"refused: .*{fault} = "):
            gated.gate.require()
    assert os.listdir(tmp_path) == ["store"]
    with pytest.raises(InputError, match="order"):
        gate.store_inputs(equity, weights, "20230104", "20230103", "20230104")
