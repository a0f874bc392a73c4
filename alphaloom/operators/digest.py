"""Content digests of tables: equal rows in any order and partitioning give equal digests; all are aggregates."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEX = 15


def row_text(columns: list[str]) -> Column:
    """A row as one text: each value with its length before it, ``-`` for null, so that no two rows read alike."""
    one = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat(*(one(c) for c in columns))


def _halves(table: DataFrame) -> tuple[Column, Column]:
    """Two 60-bit numbers of each row's MD5."""
    key = F.md5(row_text(sorted(table.columns)))
    return tuple(F.conv(F.substring(key, at, _HEX), 16, 10).cast("long") for at in (1, 1 + _HEX))


def _sums(table: DataFrame) -> list[Column]:
    first, second = _halves(table)
    return [F.count("*").alias("n_rows"), F.bit_xor(first).alias("mixed"), F.sum(second.cast("decimal(38,0)")).alias("total")]


def partition_digests(table: DataFrame, by: str = "date") -> DataFrame:
    """``by, n_rows, mixed, total``: one row a value of ``by``; repeated rows count (their xor cancels, their sum does not)."""
    return table.groupBy(by).agg(*_sums(table))


def table_digest(table: DataFrame) -> dict:
    """``rows`` and ``digest`` of a whole table, for a manifest."""
    found = table.agg(*_sums(table)).first()
    return {"rows": found.n_rows, "digest": f"{found.mixed or 0:015x}-{int(found.total or 0):x}"}


def changed_partitions(before: DataFrame, after: DataFrame, by: str = "date") -> DataFrame:
    """``by, state, rows_before, rows_after`` with state ``added``, ``removed``, ``changed`` or ``same``."""
    old, new = (partition_digests(t, by).select(by, F.struct("n_rows", "mixed", "total").alias(n)) for t, n in ((before, "old"), (after, "new")))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return old.join(new, by, "full").select(by, state.alias("state"), F.coalesce("old.n_rows", F.lit(0)).alias("rows_before"), F.coalesce("new.n_rows", F.lit(0)).alias("rows_after"))


def canonical_hash(content: object) -> str:
    """SHA-256 of plain data as sorted, compact JSON."""
    return hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
