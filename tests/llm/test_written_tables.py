"""Lineage cuts: what is written, what is deleted, and what the session keeps."""

import os

import pytest

from alphaloom.llm import _spark
from tests.llm.common import awkward


def _folder(table):
    return _spark._FOLDERS[table].removeprefix("file://")


def test_spent_tables_go_once_the_next_is_written(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    before = spark.conf.get(_spark._DROP_SHUFFLE_FILES)
    first = _spark.checkpoint(source.groupBy("id").count(), source)
    old = _folder(first)
    assert os.path.isdir(old) and source.count() == 10
    second = _spark.checkpoint(first.where("id < 4"), first)
    assert not os.path.isdir(old) and os.path.isdir(_folder(second))
    assert sorted(r.id for r in second.collect()) == [0, 1, 2, 3] and second.dtypes == first.dtypes
    assert spark.conf.get(_spark._DROP_SHUFFLE_FILES) == before


def test_a_table_without_rows_keeps_its_columns(spark):
    docs = awkward(spark)
    assert _spark.checkpoint(docs.limit(0)).dtypes == docs.dtypes and _spark.checkpoint(docs.limit(0)).count() == 0
    assert _spark.checkpoint(docs).exceptAll(docs).count() == 0


def test_a_failed_write_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(_spark._DROP_SHUFFLE_FILES)
    with pytest.raises(Exception, match="no such thing"):
        _spark.checkpoint(spark.range(3).selectExpr("raise_error('no such thing') as x").selectExpr("cast(x as int) as x"))
    assert spark.conf.get(_spark._DROP_SHUFFLE_FILES) == before
