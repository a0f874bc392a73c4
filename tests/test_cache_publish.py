"""Digests, changed partitions, outputs that appear whole, and the risk cache: reuse, resumption, refusals."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from alphaloom.errors import InputError, RiskError
from alphaloom.operators import asof, digest, risk, risk_cache
from alphaloom.plans import oracle, queries
from alphaloom.sources import publish

ROWS = [("d1", "A", 1.0), ("d1", "B", None), ("d2", "A", 2.5), ("d3", None, 0.0)]
SCHEMA = "date string, ticker string, value double"


def _digest(spark, rows):
    return digest.table_digest(spark.createDataFrame(rows, SCHEMA))


def test_digest_goes_by_rows_not_by_order(spark):
    table = spark.createDataFrame(ROWS, SCHEMA)
    same = digest.table_digest(table)
    assert same == _digest(spark, ROWS[::-1]) == digest.table_digest(table.repartition(3).select("value", "ticker", "date"))
    others = [ROWS[:-1], [*ROWS, ROWS[0]], [*ROWS, ROWS[0], ROWS[0]], [("d1", "A", 1.0), ("d1", "", None), *ROWS[2:]], [("d1", "AB", None), *ROWS[2:], ROWS[0]]]
    assert len({json.dumps(_digest(spark, r)) for r in [ROWS, *others]}) == 6
    assert digest.table_digest(table.limit(0)) == {"rows": 0, "digest": "000000000000000-0"}
    assert digest.canonical_hash({"b": 1, "a": [1.0]}) == digest.canonical_hash({"a": [1.0], "b": 1}) != digest.canonical_hash({"a": [1], "b": 2})


def test_values_that_run_together_differ(spark):
    a, b = ([("a|b", "c")], [("a", "b|c")])
    assert digest.table_digest(spark.createDataFrame(a, "x string, y string")) != digest.table_digest(spark.createDataFrame(b, "x string, y string"))


def test_changed_partitions_by_hand(spark):
    after = [("d1", "A", 1.0), ("d1", "B", None), ("d2", "A", 2.6), ("d4", "A", 1.0)]
    got = digest.changed_partitions(spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(after, SCHEMA))
    assert sorted(map(tuple, got.collect())) == [("d1", "same", 2, 2), ("d2", "changed", 1, 1), ("d3", "removed", 1, 0), ("d4", "added", 0, 1)]


def _sql(small, name):
    with duckdb.connect() as connection:
        for file in os.listdir(small):
            connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
        wanted = connection.execute(oracle.oracle_sql()[name])
        columns = [c[0] for c in wanted.description]
        return columns, sorted(map(tuple, wanted.fetchall()))


def test_changed_dates_equal_their_sql(spark, small):
    columns, want = _sql(small, "changed_dates")
    assert sorted(map(tuple, queries.changed_dates(spark, small).select(columns).collect())) == want
    assert {r[1] for r in want} >= {"added", "removed", "same", "changed"}


def test_publishing_is_all_or_nothing(spark, tmp_path):
    target, table = f"{tmp_path}/out", spark.createDataFrame(ROWS, SCHEMA)
    broken = table.withColumn("value", F.raise_error(F.lit("broken on purpose")).cast("double"))
    with pytest.raises(Exception, match="broken on purpose"):
        publish.publish(target, {"good": table, "bad": broken}, {})
    assert os.listdir(tmp_path) == []
    manifest = publish.publish(target, {"one": table, "two": table.where("date = 'd1'"), "three": table}, {"signal": {"rows": 4, "digest": "x"}}, {"two": "csv", "three": "json"}, {"note": "n"})
    assert manifest["outputs"]["one"]["rows"] == 4 and manifest["outputs"]["two"]["format"] == "csv" and manifest["note"] == "n"
    assert sorted(os.listdir(tmp_path)) == ["out"] and json.load(open(f"{target}/manifest.json")) == manifest
    found = publish.published(spark, target, manifest["inputs"])
    assert sorted(map(str, found["one"].collect())) == sorted(map(str, found["three"].collect())) == sorted(map(str, table.collect()))
    with pytest.raises(InputError, match="new or empty"):
        publish.publish(target, {"one": table}, {})
    with pytest.raises(InputError, match="not a format"):
        publish.publish(f"{tmp_path}/other", {"one": table}, {}, {"one": "xls"})
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_published_outputs_are_reused_or_refused(spark, tmp_path):
    table, calls = spark.createDataFrame(ROWS, SCHEMA), []

    def make():
        calls.append(1)
        return {"out": table.where("date <> 'd1'"), "events": table.where("date = 'd1'")}

    target = f"{tmp_path}/deep/out"
    assert publish.publish_once(target, {"table": table}, make)[1] == "built"
    found, state = publish.publish_once(target, {"table": table.repartition(2)}, make)
    assert state == "reused" and len(calls) == 1 and found["events"].count() == 2
    with pytest.raises(InputError, match="stale, other inputs: .'table'"):
        publish.publish_once(target, {"table": table.limit(2)}, make)
    with pytest.raises(InputError, match="stale, other inputs: .'more'"):
        publish.publish_once(target, {"table": table, "more": table}, make)
    inputs = {"table": digest.table_digest(table)}
    table.limit(1).write.mode("overwrite").parquet(f"{target}/events")
    with pytest.raises(InputError, match="events is not what was published"):
        publish.published(spark, target, inputs)
    publish.remove(spark, f"{target}/events")
    with pytest.raises(InputError, match="incomplete, no events"):
        publish.published(spark, target, inputs)
    publish.write_json(spark, f"{target}/manifest.json", {"status": "running"})
    with pytest.raises(InputError, match="incomplete"):
        publish.published(spark, target, inputs)
    open(f"{target}/manifest.json", "w").write("{")
    os.remove(f"{target}/.manifest.json.crc")
    with pytest.raises(InputError, match="no JSON"):
        publish.published(spark, target, inputs)
    assert publish.published(spark, f"{tmp_path}/nothing", inputs) is None


def test_json_is_replaced_at_once(spark, tmp_path):
    path = f"{tmp_path}/state.json"
    publish.write_json(spark, path, {"a": 1})
    publish.write_json(spark, path, {"a": [2, "ü"]})
    assert publish.read_json(spark, path) == {"a": [2, "ü"]} and [n for n in os.listdir(tmp_path) if n.endswith(".json")] == ["state.json"]
    with pytest.raises(InputError, match="exists"):
        publish.write_json(spark, path, {}, replace=False)
    with pytest.raises(InputError, match="missing"):
        publish.read_json(spark, f"{tmp_path}/none.json")


@pytest.fixture
def counted(monkeypatch):
    """A stand-in for the estimation, which counts its dates and fails on those in ``fail``."""
    state = {"dates": [], "fail": set()}

    def estimate(returns, caps, targets, settings, members=None, history=None):
        dates = sorted(r.as_of for r in targets.select("as_of").distinct().collect())
        if state["fail"] & set(dates):
            raise RiskError("broken on purpose")
        state["dates"] += dates
        x = targets.select("as_of", "ticker", F.lit("MARKET").alias("factor"), F.lit(1.0).alias("exposure"))
        one = targets.select("as_of").distinct()
        cov = one.select("as_of", F.lit("MARKET").alias("factor_a"), F.lit("MARKET").alias("factor_b"), F.lit(0.1).alias("covariance"))
        return asof.AsOfModel(x, cov, targets.select("as_of", "ticker", F.lit(0.2).alias("specific_var"), F.lit(False).alias("imputed")), one.select("as_of", F.lit(9).cast("long").alias("periods"), F.lit("a").alias("first"), F.lit("b").alias("last")))

    monkeypatch.setattr(asof, "estimate", estimate)
    return state


def _inputs(spark, extra=()):
    returns = spark.createDataFrame([(f"2020{m:02}01", t, 0.01 * m) for m in range(1, 7) for t in "ABC"] + list(extra), "date string, ticker string, return double")
    return returns, returns.select("date", "ticker", F.lit(5.0).alias("cap"))


def _targets(spark, names):
    return spark.createDataFrame([(d, t) for d, ts in names.items() for t in ts], "as_of string, ticker string")


def _states(resolved):
    return {r.as_of: r.source for r in resolved.states.collect()}


SETTINGS = risk.RiskSettings()
THREE = {"20200301": "AB", "20200415": "ABC", "20200601": "BC"}


def test_second_run_builds_nothing_and_one_name_rebuilds_one_date(spark, tmp_path, counted):
    returns, caps = _inputs(spark)
    cache = risk_cache.RiskCache(spark, f"{tmp_path}/cache")
    first = cache.resolve(_targets(spark, THREE), returns, caps, SETTINGS)
    assert set(_states(first).values()) == {"dynamic_built"} and counted["dates"] == sorted(THREE)
    again = cache.resolve(_targets(spark, {d: t[::-1] for d, t in THREE.items()}).repartition(3), returns, caps, SETTINGS)
    assert set(_states(again).values()) == {"dynamic_reused"} and len(counted["dates"]) == 3
    assert {r.as_of: r.names for r in again.states.collect()} == {d: len(t) for d, t in THREE.items()}
    assert sorted(map(tuple, again.model.exposures.select("as_of", "ticker").collect())) == sorted((d, t) for d, ts in THREE.items() for t in ts)
    changed = cache.resolve(_targets(spark, THREE | {"20200415": "AB"}), returns, caps, SETTINGS)
    assert _states(changed) == {"20200301": "dynamic_reused", "20200415": "dynamic_built", "20200601": "dynamic_reused"}
    assert changed.model.exposures.where("as_of = '20200415'").count() == 2
    other = cache.resolve(_targets(spark, THREE), returns, caps, risk.RiskSettings(lookback=200))
    assert set(_states(other).values()) == {"dynamic_built"}


def test_later_rows_keep_models_and_earlier_ones_do_not(spark, tmp_path, counted):
    cache = risk_cache.RiskCache(spark, f"{tmp_path}/cache")
    cache.resolve(_targets(spark, THREE), *_inputs(spark), SETTINGS)
    later = cache.resolve(_targets(spark, THREE), *_inputs(spark, [("20200701", "A", 0.5)]), SETTINGS)
    assert set(_states(later).values()) == {"dynamic_reused"}
    between = cache.resolve(_targets(spark, THREE), *_inputs(spark, [("20200420", "A", 0.5)]), SETTINGS)
    assert _states(between) == {"20200301": "dynamic_reused", "20200415": "dynamic_reused", "20200601": "dynamic_built"}


def test_static_models_are_used_where_they_cover_every_name(spark, tmp_path, counted):
    x = spark.createDataFrame([("A", "MARKET", 1.0), ("B", "MARKET", 1.0), ("C", "MARKET", 1.0)], "ticker string, factor string, exposure double")
    specific = spark.createDataFrame([("A", 0.1), ("B", 0.1)], "ticker string, specific_var double")
    static = risk_cache.StaticModel(x, x.limit(0), specific)
    cache = risk_cache.RiskCache(spark, f"{tmp_path}/cache")
    found = cache.resolve(_targets(spark, THREE), *_inputs(spark), SETTINGS, static=static)
    assert _states(found) == {"20200301": "static_reused", "20200415": "dynamic_built", "20200601": "dynamic_built"}
    assert counted["dates"] == ["20200415", "20200601"] and found.model.specific.where("as_of = '20200301'").count() == 0
    only = risk_cache.RiskCache(spark, f"{tmp_path}/unused").resolve(_targets(spark, {"20200301": "AB"}), *_inputs(spark), SETTINGS, static=static)
    assert _states(only) == {"20200301": "static_reused"} and only.model is None


def test_a_broken_job_resumes_after_its_last_batch(spark, tmp_path, counted):
    returns, caps = _inputs(spark)
    cache = risk_cache.RiskCache(spark, f"{tmp_path}/cache", batch=1)
    counted["fail"] = {"20200415"}
    with pytest.raises(RiskError, match="on purpose"):
        cache.resolve(_targets(spark, THREE), returns, caps, SETTINGS)
    assert counted["dates"] == ["20200301"] and cache.commits().count() == 1
    counted["fail"] = set()
    found = cache.resolve(_targets(spark, THREE), returns, caps, SETTINGS)
    assert _states(found) == {"20200301": "dynamic_reused", "20200415": "dynamic_built", "20200601": "dynamic_built"}
    assert counted["dates"] == sorted(THREE)


def test_half_written_dates_are_not_read_and_damaged_ones_are_refused(spark, tmp_path, counted):
    returns, caps = _inputs(spark)
    root = f"{tmp_path}/cache"
    cache = risk_cache.RiskCache(spark, root, batch=1)
    cache.resolve(_targets(spark, THREE), returns, caps, SETTINGS)
    victim = cache.commits().where("as_of = '20200415'").first()
    os.remove(f"{root}/commits/{victim.run}.json")  # the models of a job that ended between its models and its commit
    found = cache.resolve(_targets(spark, THREE), returns, caps, SETTINGS)
    assert _states(found)["20200415"] == "dynamic_built" and found.model.exposures.count() == 7
    victim = cache.commits().where("as_of = '20200415'").first()
    publish.remove(spark, f"{root}/models/specific/run={victim.run}")
    with pytest.raises(RiskError, match="stored specific are not what was committed for .'20200415'"):
        cache.resolve(_targets(spark, THREE), returns, caps, SETTINGS)
    rest = cache.resolve(_targets(spark, {"20200301": "AB"}), returns, caps, SETTINGS)
    assert _states(rest) == {"20200301": "dynamic_reused"}
