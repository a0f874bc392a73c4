"""Outputs that appear whole or not at all, with a manifest that says what they were made from.

Everything goes through Hadoop's FileSystem, so targets may lie in any store
that Spark writes to.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from alphaloom.errors import InputError
from alphaloom.operators.digest import table_digest

MANIFEST = "manifest.json"
FORMATS = ("parquet", "csv", "json")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local master without that setting gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or "cluster" in context.master:
            raise InputError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def settled(table: DataFrame) -> DataFrame:
    """``table`` as Parquet in the shared folder: worked out once, with no plan behind it, there when an executor is lost, and read by column."""
    folder = f"{shared_folder(table.sparkSession)}/settled-{uuid.uuid4().hex}"
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def _place(spark: SparkSession, path: str):
    """File system and path objects of ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _place(spark, path)
    return fs.exists(at)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, at = _place(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def is_empty(spark: SparkSession, path: str) -> bool:
    """No such folder, or nothing in it; a file in its place is an error."""
    fs, at = _place(spark, path)
    if not fs.exists(at):
        return True
    if not fs.getFileStatus(at).isDirectory():
        raise InputError(f"{path}: not a folder")
    return len(fs.listStatus(at)) == 0


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _place(spark, path)
    fs.delete(at, True)


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, at = _place(spark, source)
    if not fs.rename(at, _place(spark, target)[1]):
        raise InputError(f"{target}: could not be put in place")


def write_json(spark: SparkSession, path: str, content: object, replace: bool = True) -> None:
    """Write one JSON file by way of a sibling and a rename, so that readers see the old or the new content."""
    fs, at = _place(spark, path)
    if fs.exists(at) and not replace:
        raise InputError(f"{path}: exists already")
    aside = f"{at.getParent().toString()}/.{at.getName()}.tmp-{uuid.uuid4().hex}"
    out = fs.create(_place(spark, aside)[1], True)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True, separators=(",", ":")).encode()))
    finally:
        out.close()
    if fs.exists(at):
        fs.delete(at, False)
    _move(spark, aside, path)


def read_json(spark: SparkSession, path: str) -> object:
    fs, at = _place(spark, path)
    if not fs.exists(at):
        raise InputError(f"{path}: missing")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    except ValueError as broken:
        raise InputError(f"{path}: no JSON") from broken
    finally:
        stream.close()


@contextmanager
def staged(spark: SparkSession, target: str) -> Iterator[str]:
    """A sibling folder that takes the place of ``target`` when the block ends well, and is deleted when it does not.

    ``target`` must be new or empty, before and after the work.
    """
    target = target.rstrip("/")
    if not is_empty(spark, target):
        raise InputError(f"{target}: must be new or empty")
    parent, _, name = target.rpartition("/")
    aside = f"{parent}/.{name}.tmp-{uuid.uuid4().hex}"
    try:
        yield aside
        if not is_empty(spark, target):
            raise InputError(f"{target}: was filled meanwhile")
        if exists(spark, target):
            remove(spark, target)
        _move(spark, aside, target)
    except BaseException:
        remove(spark, aside)
        raise


def _read(spark: SparkSession, folder: str, entry: dict) -> DataFrame:
    reader = spark.read.schema(entry["schema"])
    return reader.csv(folder, header=True) if entry["format"] == "csv" else reader.format(entry["format"]).load(folder)


def write_output(table: DataFrame, folder: str, kind: str = "parquet") -> dict:
    """Write ``table`` and describe what was written: format, schema, rows and content digest, both read back from the files."""
    if kind not in FORMATS:
        raise InputError(f"{kind}: not a format of {FORMATS}")
    entry = {"format": kind, "schema": ", ".join(f"`{c}` {t}" for c, t in table.dtypes)}
    table.write.format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(folder)
    return entry | table_digest(_read(table.sparkSession, folder, entry))


def publish(target: str, tables: dict[str, DataFrame], inputs: dict[str, dict], kinds: dict[str, str] | None = None, notes: dict | None = None, passes: Callable[[], dict] | None = None) -> dict:
    """Write all ``tables`` and their manifest to ``target`` at once; returns the manifest.

    ``inputs`` are digests of what the tables were made from (``table_digest``).
    ``passes`` is called when all tables are written; what it returns joins the
    manifest, and an error from it, like any failure, leaves nothing at ``target``.
    """
    if not tables:
        raise InputError(f"{target}: nothing to publish")
    spark = next(iter(tables.values())).sparkSession
    with staged(spark, target) as aside:
        outputs = {name: write_output(t, f"{aside}/{name}", (kinds or {}).get(name, "parquet")) for name, t in tables.items()}
        manifest = {"schema_version": 1, "status": "success", "created_at": datetime.now(UTC).isoformat(), "inputs": inputs, "outputs": outputs} | (notes or {}) | (passes() if passes else {})
        write_json(spark, f"{aside}/{MANIFEST}", manifest)
    return manifest


def published(spark: SparkSession, target: str, inputs: dict[str, dict]) -> dict[str, DataFrame] | None:
    """The tables of ``target`` if they are complete and made from ``inputs``; none if nothing is there.

    Refused, naming what differs: other inputs (stale), no manifest of success,
    and outputs that are missing or not those of the manifest.
    """
    if is_empty(spark, target):
        return None
    manifest = read_json(spark, f"{target}/{MANIFEST}")
    if not isinstance(manifest, dict) or manifest.get("status") != "success":
        raise InputError(f"{target}: incomplete")
    before = manifest.get("inputs", {})
    if changed := sorted(k for k in {*before, *inputs} if before.get(k) != inputs.get(k)):
        raise InputError(f"{target}: stale, other inputs: {changed}")
    found = {}
    for name, entry in manifest["outputs"].items():
        folder = f"{target}/{name}"
        if not exists(spark, folder):
            raise InputError(f"{target}: incomplete, no {name}")
        found[name] = _read(spark, folder, entry)
        if table_digest(found[name]) != {k: entry[k] for k in ("rows", "digest")}:
            raise InputError(f"{target}: {name} is not what was published")
    return found


def publish_once(target: str, inputs: dict[str, DataFrame], make, kinds: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], str]:
    """Tables of ``target`` and ``built`` or ``reused``: ``make()`` runs only if they are not there yet, for the same inputs."""
    spark = next(iter(inputs.values())).sparkSession
    digests = {name: table_digest(t) for name, t in inputs.items()}
    if (found := published(spark, target, digests)) is not None:
        return found, "reused"
    publish(target, make(), digests, kinds)
    return published(spark, target, digests), "built"
