"""A cache of as-of risk models by exact universe, filled in batches that survive a broken job.

A model is known by a fingerprint of its as-of date, its names in any order, the
settings, and the inputs up to that date: rows of later dates change nothing, so
a growing history keeps its models. Models are written under a run's id and
count only once a commit file names them; what has no commit is never read.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.errors import RiskError
from alphaloom.operators import asof, risk
from alphaloom.operators.digest import canonical_hash, partition_digests
from alphaloom.sources import publish

TABLES = tuple(f.name for f in fields(asof.AsOfModel))
_COMMIT = "as_of string, fingerprint string, names long, run string, " + ", ".join(f"{t} struct<n_rows:long,mixed:long,total:string>" for t in TABLES)


@dataclass(frozen=True)
class StaticModel:
    """A model given from outside, for any date: ``exposures`` (ticker, factor, exposure), ``factor_cov`` and ``specific`` (ticker, specific_var)."""

    exposures: DataFrame
    factor_cov: DataFrame
    specific: DataFrame


@dataclass(frozen=True)
class Resolved:
    """``states`` (as_of, names, source, fingerprint), and the models of the dates that no static model covers (none if the cache has never built one)."""

    states: DataFrame
    model: asof.AsOfModel | None


def inputs_until(as_of: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """``as_of, n_rows, mixed, total``: digest of the rows of ``table`` dated ``by`` on or before each as-of date.

    Running sums over one row a date; the rows themselves are aggregated before.
    """
    marks = partition_digests(table, by).select(F.col(by).cast("string").alias("at"), "n_rows", "mixed", "total", F.lit(None).cast("string").alias("as_of"))
    asked = as_of.select(F.col("as_of").alias("at"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("decimal(38,0)"), "as_of")
    upto = Window.orderBy("at", F.col("as_of").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = marks.union(asked).select("as_of", F.sum("n_rows").over(upto).alias("n_rows"), F.bit_xor("mixed").over(upto).alias("mixed"), F.sum("total").over(upto).alias("total"))
    return running.where("as_of is not null")


def fingerprints(targets: DataFrame, inputs: dict[str, tuple[DataFrame, str]], settings: risk.RiskSettings) -> DataFrame:
    """``as_of, names, fingerprint`` of the models that ``targets`` (``as_of, ticker``) ask for; ``inputs`` are tables with their date columns."""
    own = F.xxhash64("ticker")
    found = targets.select("as_of", "ticker").distinct().groupBy("as_of").agg(
        F.count("*").alias("names"), F.bit_xor(own).alias("x"), F.sum(F.xxhash64(F.lit(7), "ticker").cast("decimal(38,0)")).alias("s")
    )
    parts = [F.lit(canonical_hash(asdict(settings))), F.col("as_of"), *(F.col(c).cast("string") for c in ("names", "x", "s"))]
    days = found.select("as_of")
    for name, (table, by) in sorted(inputs.items()):
        own = inputs_until(days, table, by).select("as_of", F.concat_ws(":", F.lit(name), "n_rows", "mixed", "total").alias(f"_{name}"))
        found = found.join(own, "as_of")
        parts.append(F.col(f"_{name}"))
    return found.select("as_of", "names", F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


def covered_dates(targets: DataFrame, static: StaticModel) -> DataFrame:
    """``as_of`` whose names all have exposures and a specific variance in ``static``."""
    known = static.exposures.select("ticker").intersect(static.specific.select("ticker"))
    missing = targets.join(known, "ticker", "left_anti").select("as_of").distinct()
    return targets.select("as_of").distinct().join(missing, "as_of", "left_anti")


class RiskCache:
    """Models under ``root``: ``models/<table>/run=<id>/`` in parts by fingerprint, and ``commits/`` with one file a finished batch."""

    def __init__(self, spark: SparkSession, root: str, batch: int = 250) -> None:
        self.spark, self.root, self.batch = spark, root.rstrip("/"), batch

    def commits(self) -> DataFrame:
        """Committed models; of two that were built at once for one fingerprint the first run's counts."""
        if not publish.exists(self.spark, f"{self.root}/commits"):
            return self.spark.createDataFrame([], _COMMIT)
        found = self.spark.read.schema(_COMMIT).json(f"{self.root}/commits")
        first = Window.partitionBy("fingerprint").orderBy("run")
        return found.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")

    def _stored(self, name: str, wanted: DataFrame) -> DataFrame:
        """Rows of a table that belong to ``wanted`` commits."""
        folder = f"{self.root}/models/{name}"
        table = self.spark.read.option("basePath", folder).parquet(folder)
        return table.join(F.broadcast(wanted.select("run", "fingerprint")), ["run", "fingerprint"], "left_semi")

    def _verify(self, wanted: DataFrame) -> None:
        """What commits name must be there, row for row: a part that was lost, cut short or written over is refused."""
        for name in TABLES:
            folder = f"{self.root}/models/{name}"
            there = partition_digests(self._stored(name, wanted).drop("run"), "fingerprint") if publish.exists(self.spark, folder) else self.spark.createDataFrame([], "fingerprint string, n_rows long, mixed long, total decimal(38,0)")
            held = wanted.select("as_of", "fingerprint", f"{name}.*").join(there.select("fingerprint", *(F.col(c).cast("string").alias(f"_{c}") for c in ("n_rows", "mixed", "total"))), "fingerprint", "left")
            bad = held.where(" or ".join(f"not ({c} <=> _{c})" for c in ("n_rows", "mixed", "total"))).where("n_rows > 0 or _n_rows is not null")
            if broken := [r.as_of for r in bad.select("as_of").orderBy("as_of").limit(10).collect()]:
                raise RiskError(f"{self.root}: stored {name} are not what was committed for {broken}")

    def _build(self, dates: list[str], wanted: DataFrame, targets: DataFrame, returns: DataFrame, caps: DataFrame, settings: risk.RiskSettings, history: DataFrame | None) -> str:
        """Estimate one batch of dates, write its models and then its commit; the run's id."""
        run = f"run{uuid.uuid4().hex}"
        asked = wanted.where(F.col("as_of").isin(dates))
        model = asof.estimate(returns, caps, targets.where(F.col("as_of").isin(dates)), settings, history=history)
        found = asked
        for name in TABLES:
            folder = f"{self.root}/models/{name}/run={run}"
            getattr(model, name).join(F.broadcast(asked.select("as_of", "fingerprint")), "as_of").repartition("fingerprint").write.partitionBy("fingerprint").parquet(folder)
            sums = partition_digests(self.spark.read.option("basePath", folder).parquet(folder), "fingerprint")
            own = sums.select("fingerprint", F.struct("n_rows", "mixed", F.col("total").cast("string").alias("total")).alias(name))
            found = found.join(own, "fingerprint", "left")
        rows = [r.asDict(recursive=True) | {"run": run} for r in found.collect()]  # one row a date of the batch
        publish.write_json(self.spark, f"{self.root}/commits/{run}.json", rows)
        return run

    def resolve(self, targets: DataFrame, returns: DataFrame, caps: DataFrame, settings: risk.RiskSettings, history: DataFrame | None = None, static: StaticModel | None = None) -> Resolved:
        """Models of all dates in ``targets``: from ``static`` where it covers a date's names, from the cache, or built now.

        Batches are committed one by one; if one fails, a later call finds those
        before it and builds the rest.
        """
        inputs = {"returns": (returns, "date"), "caps": (caps, "date")} | ({} if history is None else {"history": (history, "in_date")})
        targets = targets.select("as_of", "ticker").distinct()
        asked = fingerprints(targets, inputs, settings)
        wanted = self.spark.createDataFrame(asked.collect(), asked.schema)  # one row a date
        covered = wanted.limit(0).select("as_of") if static is None else covered_dates(targets, static)
        by_static = {r.as_of for r in covered.collect()}
        dynamic = wanted.where(~F.col("as_of").isin(*by_static)) if by_static else wanted
        committed = lambda: self.commits().join(F.broadcast(dynamic.select("fingerprint")), "fingerprint", "left_semi")
        before = committed()
        self._verify(before)
        missing = [r.as_of for r in dynamic.join(before, "fingerprint", "left_anti").select("as_of").orderBy("as_of").collect()]
        built = [self._build(missing[at : at + self.batch], wanted, targets, returns, caps, settings, history) for at in range(0, len(missing), self.batch)]
        held = committed()
        source = F.when(F.col("as_of").isin(*by_static) if by_static else F.lit(False), "static_reused").when(F.col("run").isin(*built) if built else F.lit(False), "dynamic_built").otherwise("dynamic_reused")
        states = wanted.join(held.select("fingerprint", "run"), "fingerprint", "left").select("as_of", "names", source.alias("source"), "fingerprint")
        there = publish.exists(self.spark, f"{self.root}/models")
        return Resolved(states, asof.AsOfModel(*(self._stored(n, held).drop("run", "fingerprint") for n in TABLES)) if there else None)
