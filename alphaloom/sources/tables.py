"""Table sources: files by suffix, wide panels and square matrices in long form, and validated inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.errors import InputError
from alphaloom.functions.expressions import finite, normal_date, normal_ticker, truth
from alphaloom.operators.guards import require_columns, require_covered, require_finite, require_keys, require_rows, require_unique
from alphaloom.sources.publish import exists, is_file

_KEYS = {"ticker", "symbol", "stock_symbol", "date", "l1_code", "industry", "sector"}


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or Parquet table by suffix; CSV columns are read as text, so leading zeros of tickers stay."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=False)
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raise InputError(f"{path}: not a .csv, .parquet or .pq table")


def read_hive_layout(spark: SparkSession, root: str, start: str, end: str, date: str = "date") -> DataFrame:
    """A ``year=/month=`` layout; bounds on partitions and date let the scan skip files and row groups.

    ``start`` and ``end`` are ``yyyyMMdd`` and inclusive. The date column may be
    a date, a timestamp, an integer or text in that form; it is compared in its
    own type, so that the bounds reach the scan.
    """
    table = spark.read.option("basePath", root).parquet(root)
    months = F.col("year").cast("int") * 100 + F.col("month").cast("int")
    return table.where(months.between(int(start[:6]), int(end[:6]))).where(_between_days(table, date, start, end)).drop("year", "month")


def _between_days(table: DataFrame, date: str, start: str, end: str) -> Column:
    kind, day = dict(table.dtypes)[date], F.col(date)
    as_date = lambda text: F.to_date(F.lit(text), "yyyyMMdd")
    if kind == "date":
        return day.between(as_date(start), as_date(end))
    if kind.startswith("timestamp"):
        return (day >= as_date(start)) & (day < F.date_add(as_date(end), 1))
    if kind in ("int", "bigint"):
        return day.between(int(start), int(end))
    if kind == "string":
        return day.between(start, end)
    raise InputError(f"{date}: a column of type {kind} is no date")


def unpivot_panel(wide: DataFrame, value: str, date: str = "date") -> DataFrame:
    """``date, ticker, value`` of a wide panel (one column per ticker); empty cells are left out."""
    names = [c for c in wide.columns if c not in (date, "__index_level_0__")]
    index = date if date in wide.columns else "__index_level_0__"
    typed = wide.select(normal_date(F.col(f"`{index}`")).alias("date"), *[finite(F.col(f"`{c}`")).alias(c) for c in names])
    long = typed.unpivot("date", [F.col(f"`{c}`") for c in names], "ticker", value).withColumn("ticker", normal_ticker("ticker"))
    return require_unique(long.where(F.col(value).isNotNull()), ["date", "ticker"], "wide panel")


def unpivot_matrix(wide: DataFrame, key: str = "ticker") -> DataFrame:
    """``row_ticker, col_ticker, covariance`` of a square matrix; row and column names must agree."""
    names = [c for c in wide.columns if c != key]
    own = wide.select(F.col(key).cast("string").alias("name"))
    counts = own.agg(F.count("*"), F.count_distinct("name"), F.count_if(F.col("name").isin(names))).first()
    if tuple(counts) != (len(names),) * 3:
        raise InputError(f"covariance: {counts[0]} rows with {counts[1]} names, {counts[2]} of them among the {len(names)} columns")
    typed = wide.select(normal_ticker(key).alias("row_ticker"), *[finite(F.col(f"`{c}`")).alias(c) for c in names])
    return typed.unpivot("row_ticker", [F.col(f"`{c}`") for c in names], "col_ticker", "covariance")


def covariance_for(matrix: DataFrame, universe: DataFrame) -> DataFrame:
    """The rows of a long covariance whose two names are in ``universe`` (``ticker``); a name or pair of it that the matrix lacks is an error."""
    names = universe.select("ticker").distinct()
    require_covered(names, matrix.where("row_ticker = col_ticker").select(F.col("row_ticker").alias("ticker")), ["ticker"], "covariance")
    kept = matrix.join(names.toDF("row_ticker"), "row_ticker", "left_semi").join(names.toDF("col_ticker"), "col_ticker", "left_semi")
    n, pairs = names.count(), kept.count()
    if pairs != n * n:
        raise InputError(f"covariance: {pairs} pairs for {n} names")
    return kept.select(*matrix.columns)


#: File names in external layouts of one folder or file a date (fixed values).
COVARIANCE_NAMES = ("asset_cov", "covariance")
EXPOSURE_NAMES = ("exposures", "style_exposures")


def dated_path(spark: SparkSession, root: str, date: str, names: tuple[str, ...], optional: bool = False) -> str | None:
    """Where a date's table lies: ``root`` itself if it is a file, else the first there is of ``date=D/<name>.parquet`` and ``D.parquet``.

    Looked up through Hadoop's FileSystem, so any of its stores will do; without one it is an error, or null if ``optional``.
    """
    if is_file(spark, root):
        return root
    tried = [*(f"{root}/date={date}/{name}.parquet" for name in names), f"{root}/{date}.parquet"]
    for path in tried:
        if exists(spark, path):
            return path
    if optional:
        return None
    raise InputError(f"nothing for {date}; looked for {tried}")


def select_date(table: DataFrame, date: str, label: str, optional: bool = False) -> DataFrame:
    """Rows of one date; a table without dates counts for every date if ``optional``."""
    if "date" not in table.columns:
        if optional:
            return table
        raise InputError(f"{label}: missing columns ['date']")
    kind = dict(table.dtypes)["date"]
    own = _between_days(table, "date", date, date) if kind in ("date", "int", "bigint") or kind.startswith("timestamp") else normal_date("date") == date
    return require_rows(table.where(own), f"{label} on {date}")


def load_signal(table: DataFrame) -> DataFrame:
    """``date, ticker, prediction``: exactly these columns, unique keys, finite values."""
    require_columns(table, ["date", "ticker", "prediction"], "signal", exactly=True)
    clean = table.select(normal_date("date").alias("date"), normal_ticker("ticker").alias("ticker"), finite("prediction").alias("prediction"))
    require_keys(clean, ["date", "ticker"], "signal")
    require_finite(clean, ["prediction"], "signal")
    return require_unique(clean, ["date", "ticker"], "signal")


def load_candidates(table: DataFrame) -> DataFrame:
    """``date, ticker`` of candidates or risk-model targets: at least one, no key malformed or repeated; other columns are left out."""
    require_columns(table, ["date", "ticker"], "candidates")
    clean = table.select(normal_date("date").alias("date"), normal_ticker("ticker").alias("ticker"))
    require_keys(require_rows(clean, "candidates"), ["date", "ticker"], "candidates")
    return require_unique(clean, ["date", "ticker"], "candidates")


def initial_weights(first: str, benchmark: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """``ticker, weight`` held before the first rebalance date: those of ``initial`` (``current_weight``) on it, or the benchmark's."""
    column, table, label = ("benchmark_weight", benchmark, "benchmark") if initial is None else ("current_weight", initial, "initial weights")
    return load_weights(select_date(table, first, label), column).select("ticker", F.col(column).alias("weight"))


def load_weights(table: DataFrame, value: str, universe: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """``date, ticker, value``; with a ``universe`` (``date, ticker``), exactly its names, absent ones at 0 or, if it must be ``complete``, refused."""
    clean = require_finite(table.select(normal_date("date").alias("date"), normal_ticker("ticker").alias("ticker"), finite(value).alias(value)), [value], value)
    require_keys(clean, ["date", "ticker"], value)
    require_unique(clean, ["date", "ticker"], value)
    if universe is None:
        return clean
    if complete:
        require_covered(universe, clean, ["date", "ticker"], value)
    return universe.select("date", "ticker").join(clean, ["date", "ticker"], "left").na.fill(0.0, [value])


def load_labels(table: DataFrame, column: str, universe: DataFrame) -> DataFrame:
    """``ticker, column`` for every name of ``universe``; a missing or empty label is an error."""
    clean = table.select(normal_ticker("ticker").alias("ticker"), F.trim(F.col(column).cast("string")).alias(column)).where(F.length(column) > 0)
    require_unique(clean, ["ticker"], column)
    require_covered(universe, clean, ["ticker"], column)
    return universe.select("ticker").distinct().join(clean, "ticker")


def load_tradability(table: DataFrame, universe: DataFrame) -> DataFrame:
    """``ticker, tradable`` for every name of ``universe``; other words than the boolean vocabulary are errors."""
    clean = table.select(normal_ticker("ticker").alias("ticker"), truth("tradable").alias("tradable"))
    if not clean.where("tradable is null").isEmpty():
        raise InputError("tradability: values that are no booleans")
    require_unique(clean, ["ticker"], "tradability")
    require_covered(universe, clean, ["ticker"], "tradability")
    return universe.select("ticker").distinct().join(clean, "ticker")


def load_exposures(table: DataFrame, universe: DataFrame, styles: list[str] | None = None) -> DataFrame:
    """``ticker, factor, exposure`` of the asked (or all non-industry) style columns, finite and complete over ``universe``."""
    names = styles or [c for c in table.columns if c.lower() not in _KEYS and not c.startswith("INDUSTRY:") and c != "__index_level_0__"]
    require_columns(table, names, "exposures")
    key = "ticker" if "ticker" in table.columns else "__index_level_0__"
    clean = table.select(normal_ticker(key).alias("ticker"), *[finite(c).alias(c) for c in names])
    require_unique(clean, ["ticker"], "exposures")
    require_covered(universe, clean, ["ticker"], "exposures")
    kept = clean.join(universe.select("ticker").distinct(), "ticker", "left_semi")
    return require_finite(kept, names, "exposures").unpivot("ticker", names, "factor", "exposure")


def load_asset_returns(table: DataFrame) -> DataFrame:
    """``date, ticker, return``: unique keys, finite, at least -1."""
    clean = table.select(normal_date("date").alias("date"), normal_ticker("ticker").alias("ticker"), finite("return").alias("return"))
    require_keys(clean, ["date", "ticker"], "asset returns")
    return require_unique(require_finite(clean, ["return"], "asset returns", -1.0), ["date", "ticker"], "asset returns")
