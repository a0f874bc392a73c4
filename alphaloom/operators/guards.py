"""Fail-closed input checks: one aggregate per table, run before anything is computed from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.errors import InputError
from alphaloom.functions.expressions import finite


def require_columns(table: DataFrame, names: list[str], label: str, exactly: bool = False) -> DataFrame:
    missing = sorted(set(names) - set(table.columns))
    extra = sorted(set(table.columns) - set(names)) if exactly else []
    if missing or extra:
        raise InputError(f"{label}: missing columns {missing}" + (f", unexpected columns {extra}" if extra else ""))
    return table


def require_unique(table: DataFrame, keys: list[str], label: str) -> DataFrame:
    repeated = table.groupBy(*keys).count().where("count > 1").orderBy(*keys).limit(10).collect()
    if repeated:
        raise InputError(f"{label}: repeated keys {[tuple(r[k] for k in keys) for r in repeated]}")
    return table


def require_keys(table: DataFrame, keys: list[str], label: str) -> DataFrame:
    """No key is null (which is what malformed dates and tickers turn into)."""
    counts = table.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys]).first().asDict()
    if bad := {k: n for k, n in counts.items() if n}:
        raise InputError(f"{label}: keys that are missing or malformed: {bad}")
    return table


def require_finite(table: DataFrame, columns: list[str], label: str, minimum: float | None = None) -> DataFrame:
    tests = [F.count_if(finite(c).isNull() | (F.lit(False) if minimum is None else finite(c) < minimum)).alias(c) for c in columns]
    counts = table.agg(*tests).first().asDict()
    if bad := {c: n for c, n in counts.items() if n}:
        raise InputError(f"{label}: values that are missing, not finite or too small: {bad}")
    return table


def require_rows(table: DataFrame, label: str) -> DataFrame:
    if table.isEmpty():
        raise InputError(f"{label}: no rows")
    return table


def require_covered(universe: DataFrame, table: DataFrame, keys: list[str], label: str) -> DataFrame:
    missing = universe.join(table, keys, "left_anti").select(*keys).distinct().orderBy(*keys).limit(10).collect()
    if missing:
        raise InputError(f"{label}: nothing for {[tuple(r) for r in missing]}")
    return table


def require_weights(table: DataFrame, value: str, by: list[str], label: str, tolerance: float = 1e-8) -> DataFrame:
    """Weights are finite, not below -``tolerance`` and sum to 1 within ``tolerance`` in each group."""
    require_finite(table, [value], label, -tolerance)
    bad = table.groupBy(*by).agg(F.sum(value).alias("s")).where(F.abs(F.col("s") - 1) > tolerance).limit(10).collect()
    if bad:
        raise InputError(f"{label}: weights do not sum to one for {[tuple(r) for r in bad]}")
    return table
