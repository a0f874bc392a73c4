"""Best-fit packing of tokenised documents by patterns and non-negative least squares.

Packing is decided on the histogram of piece lengths, which has at most
``max_len`` entries however large the corpus is. Patterns of one to three
lengths that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded down, and what
is left over is packed best-fit decreasing. Pieces then find their place by their
running number among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm._spark import checkpoint, text_column
from alphaloom.llm.tokens import encoder_of, load_vocabulary

MAX_LEN = 1024
SWEEPS = 30


def enumerate_patterns(max_len: int) -> np.ndarray:
    """All patterns of up to three lengths with sum ``max_len``, as rows of three lengths in rising order (0: none)."""
    found = [(0, 0, max_len)]
    found += [(0, i, max_len - i) for i in range(1, max_len // 2 + 1)]
    for i in range(1, max_len // 3 + 1):
        found += [(i, j, max_len - i - j) for j in range(i, (max_len - i) // 2 + 1)]
    return np.array(found, dtype=np.int64)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ``|A x - histogram|`` by cyclic coordinate descent.

    A's column of a pattern counts its lengths. Long lengths come first in a
    sweep, as they fit in few patterns; a sweep visits only patterns that are in
    use or whose gradient asks for more of them.
    """
    rest = histogram.astype(float).copy()
    x = np.zeros(len(patterns))
    order = np.argsort(-patterns[:, 2], kind="stable")
    columns = [Counter(int(v) for v in p if v) for p in patterns]
    norms = np.array([sum(c * c for c in column.values()) for column in columns], dtype=float)
    for _ in range(sweeps):
        rest[0] = 0.0
        gain = rest[patterns].sum(axis=1)
        active = order[(gain[order] > 1e-9 * norms[order]) | (x[order] > 0)]
        moved = 0.0
        for p in active.tolist():
            column = columns[p]
            new = max(0.0, x[p] + sum(rest[v] * c for v, c in column.items()) / norms[p])
            step = new - x[p]
            if step:
                x[p] = new
                for v, c in column.items():
                    rest[v] -= c * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def pack_best_fit(histogram: np.ndarray, max_len: int) -> Counter:
    """Best-fit decreasing over a histogram: groups of equal bins are filled together."""
    by_space: dict[int, Counter] = {}
    done: Counter = Counter()
    for length in range(max_len, 0, -1):
        n = int(histogram[length])
        while n:
            space = min((s for s in by_space if s >= length), default=None)
            if space is None:
                each = max_len // length
                pattern, bins = (length,) * each, n // each
                if not bins:
                    pattern, bins = (length,) * n, 1
                n -= bins * len(pattern)
                by_space.setdefault(max_len - length * len(pattern), Counter())[pattern] += bins
                continue
            group = by_space[space]
            pattern, bins = max(group.items())
            each = min(space // length, n)
            take = min(bins, n // each)
            n -= take * each
            group[pattern] -= take
            if not group[pattern]:
                del group[pattern]
            if not group:
                del by_space[space]
            by_space.setdefault(space - each * length, Counter())[pattern + (length,) * each] += take
    for group in by_space.values():
        done.update(group)
    return done


def plan_packing(histogram: np.ndarray, max_len: int = MAX_LEN) -> Counter:
    """Patterns with their repeat counts that use up the histogram exactly (index: length)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan: Counter = Counter()
    patterns = enumerate_patterns(max_len)
    fitted = fit_counts(patterns, left)
    used = np.flatnonzero(fitted > 1e-6)
    columns = {p: Counter(int(v) for v in patterns[p] if v) for p in used.tolist()}
    room = lambda p: min(int(left[v]) // c for v, c in columns[p].items())
    for p in used.tolist():
        n = min(int(fitted[p]), room(p))
        if n > 0:
            for v, c in columns[p].items():
                left[v] -= n * c
            plan[tuple(sorted(columns[p].elements(), reverse=True))] += n
    plan.update(pack_best_fit(left, max_len))
    return plan


def _slots(plan: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of pieces of one length: key (length, first number), first number, first sequence, offset; sorted by key."""
    taken: Counter = Counter()
    sequence, rows = 0, []
    for pattern, n in sorted(plan.items(), reverse=True):
        offset = 0
        for length in pattern:
            rows.append(((length << 44) + taken[length], taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    table = np.array(sorted(rows) or np.zeros((0, 4)), dtype=np.int64)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def cut_pieces(docs: DataFrame, tokenizer_path: str, eos_id: int, max_len: int = MAX_LEN, keep_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, task, number[, ids]``: pieces, numbered by length within their task."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_path))
    end = eos_id.to_bytes(4, "little")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(vocabulary.value), TaskContext.get().partitionId()
        numbers = [0] * (max_len + 1)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text")), strict=True):
                ids += end
                n = len(ids) // 4
                start, piece = 0, 0
                stop = n % max_len or max_len
                while start < n:
                    length, own = stop - start, ids[4 * start : 4 * stop]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), task, numbers[length], own)[: 7 + keep_ids])
                    numbers[length] += 1
                    start, stop, piece = stop, stop + max_len, piece + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number", "ids"][: 7 + keep_ids]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    return text_column(docs).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer_path: str, eos_id: int, max_len: int = MAX_LEN, keep_ids: bool = True) -> DataFrame:
    """Pack every document of ``docs`` into sequences of at most ``max_len`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` and, if asked for, ``ids`` (little-endian unsigned
    32-bit). A document is its ids and ``eos_id``; a longer one is cut into
    pieces of ``max_len``, the first of which may be shorter. Null and empty
    texts are one piece of one token; repeated rows are packed one by one, and
    pieces of equal length fill a sequence's places in the order of their tasks;
    an empty table gives an empty result; other columns are ignored.

    The driver sees the histogram (``max_len`` rows) and makes the plan, whose
    size depends on ``max_len`` alone. Pieces are written once, numbered within
    their task; offsets by task and length make the numbers global without
    bringing the pieces of a frequent length together.
    """
    pieces = checkpoint(cut_pieces(docs, tokenizer_path, eos_id, max_len, keep_ids))
    counts = checkpoint(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(max_len + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    slots = docs.sparkSession.sparkContext.broadcast(_slots(plan_packing(histogram, max_len)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["task", "length"]).withColumn("number", F.col("number") + F.col("base")).drop("task", "base")
    names = [c for c in pieces.columns if c not in ("task", "number")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, offset = slots.value
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.searchsorted(key, (length << 44) + number, "right") - 1
            placed = [pa.array(sequence[at] + number - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *placed], [*names, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id bigint, offset bigint"
    return numbered.mapInArrow(place, schema)
