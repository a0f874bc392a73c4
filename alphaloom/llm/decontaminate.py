"""Benchmark decontamination by greedy string tiling.

Rolling Karp-Rabin hashes of ``width`` words seed matches between documents and
benchmark items. For each document and item that share seeds, the longest
matches that do not overlap what is already marked are marked one after the
other; the share of the item's words so covered does not depend on the order in
which a document holds its passages.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm._spark import checkpoint
from alphaloom.llm._words import NON_ALNUM, chunks, split_words, windows

WIDTH = 5
MIN_COVERAGE = 0.6
#: Benchmarks of up to so many bytes of text are broadcast as seeds; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Size of the bitmap (8 MB at any size of the benchmark) that keeps a document's other words from the shuffle.
BITMAP_BITS = 26
_PAIRS_AT_ONCE = 1 << 20


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits of the leading ``BITMAP_BITS`` of every ``seed``, combined by Spark and gathered as 4 KB pieces."""
    slot = F.shiftrightunsigned("seed", 64 - BITMAP_BITS) + 1
    pieces = seeds.groupBy(F.bitmap_bucket_number(slot).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bits = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for piece, own in pieces.toLocalIterator():
        bits[(piece - 1) * len(own) : piece * len(own)] = np.frombuffer(own, dtype=np.uint8)
    return bits


def _seeds(texts: DataFrame, width: int, wanted: np.ndarray | None, bitmap: Broadcast | None = None) -> DataFrame:
    """``row, id, at, seed, n_words``: rolling hashes of every text, or of those in ``wanted`` (sorted) or with their bit in ``bitmap``."""

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:
            likely = np.zeros(1 << 20, dtype=bool)
            likely[wanted >> np.uint64(44)] = True
        for batch in batches:
            row_ids, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id"))
            for chunk in chunks(batch.column("text")):
                words = split_words(chunk, NON_ALNUM)
                seeds, at = windows(words, width)
                if wanted is not None:
                    near = np.flatnonzero(likely[seeds >> np.uint64(44)])
                    near = near[wanted[np.minimum(np.searchsorted(wanted, seeds[near]), len(wanted) - 1)] == seeds[near]] if len(wanted) else near[:0]
                    seeds, at = seeds[near], at[near]
                if bitmap is not None:
                    slot = (seeds >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    near = np.flatnonzero(bitmap.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    seeds, at = seeds[near], at[near]
                row = np.searchsorted(words.bounds, at, "right") - 1
                columns = [row_ids[chunk.first + row], ids[chunk.first + row], at - words.bounds[row], seeds.view(np.int64), np.diff(words.bounds)[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "id", "at", "seed", "n_words"])

    return texts.mapInArrow(roll, "row long, id long, at long, seed long, n_words long")


def _runs(doc_at: np.ndarray, doc_seed: np.ndarray, item_seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in document, start in item and number of seeds of every longest run of equal seeds along a diagonal.

    Equal pairs are looked at in blocks, and only those kept that no pair goes
    before or none follows, so memory goes by runs and not by pairs.
    """
    order = np.argsort(item_seeds, kind="stable")
    by_seed, last = item_seeds[order], len(item_seeds) - 1
    low, high = np.searchsorted(by_seed, doc_seed, "left"), np.searchsorted(by_seed, doc_seed, "right")
    n = high - low
    held, seed_at = np.zeros(int(doc_at.max(initial=0)) + 3, dtype=bool), np.zeros(int(doc_at.max(initial=0)) + 3, dtype=doc_seed.dtype)
    held[doc_at + 1], seed_at[doc_at + 1] = True, doc_seed  # shifted by one, so that every place has a neighbour
    starts, ends = [np.zeros((2, 0), dtype=np.int64)], [np.zeros((2, 0), dtype=np.int64)]
    total = np.cumsum(n)
    bounds = [0, *np.unique(np.searchsorted(total, np.arange(_PAIRS_AT_ONCE, n.sum(), _PAIRS_AT_ONCE)) + 1).tolist(), len(n)]
    for i, j in zip(bounds, bounds[1:], strict=False):
        own = n[i:j]
        p = np.repeat(doc_at[i:j], own)
        t = order[np.repeat(low[i:j], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]
        first = ~(held[p] & (t > 0) & (seed_at[p] == item_seeds[np.maximum(t - 1, 0)]))
        final = ~(held[p + 2] & (t < last) & (seed_at[p + 2] == item_seeds[np.minimum(t + 1, last)]))
        starts.append(np.stack([p[first], t[first]]))
        ends.append(np.stack([p[final], t[final]]))
    (p, t), (q, u) = np.concatenate(starts, axis=1), np.concatenate(ends, axis=1)
    by_place, by_end = np.lexsort((t, p - t)), np.lexsort((u, q - u))
    return p[by_place], t[by_place], u[by_end] - t[by_place] + 1


def tile(doc_at: np.ndarray, doc_seed: np.ndarray, item_seeds: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Tiles (start in document, start in item, words) by greedy string tiling.

    A match of ``width`` words or more is a run of seeds along one diagonal. Runs
    are taken longest first (ties: earliest in item, then document); one that
    meets marked words is cut to what is free and put back if long enough.
    """
    p, t, n = _runs(doc_at, doc_seed, item_seeds)
    queue = list(zip((-(n + width - 1)).tolist(), t.tolist(), p.tolist(), strict=True))
    heapq.heapify(queue)
    in_item = np.zeros(len(item_seeds) + width - 1, dtype=bool)
    in_doc = np.zeros(int(doc_at.max(initial=0)) + width, dtype=bool)
    tiles, left = [], len(in_item)
    while queue and left >= width:
        length, a, b = heapq.heappop(queue)
        length = -length
        marked = np.flatnonzero(in_item[a : a + length] | in_doc[b : b + length])
        if not len(marked):
            tiles.append((b, a, length))
            in_item[a : a + length] = in_doc[b : b + length] = True
            left -= length
            continue
        edges = np.concatenate([[-1], marked, [length]])
        for j in np.flatnonzero(np.diff(edges) > width).tolist():
            at = int(edges[j]) + 1
            heapq.heappush(queue, (at - int(edges[j + 1]), a + at, b + at))
    return sorted(tiles)


def overlaps(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, item_id, item_words, n_tiles, covered, coverage, first_word, last_word`` for all pairs that share ``width`` words.

    Words are runs of ASCII letters, digits and non-ASCII characters with A-Z
    lowered. Null and empty texts, and items of fewer than ``width`` words, match
    nothing. Repeated rows are compared one by one; empty tables give an empty
    result; other columns are ignored. Rows with null ids are left out of
    ``benchmark``. Very long texts are hashed whole, chunk by chunk. A document
    and an item are tiled in one task, whose memory goes by their runs of
    equal words; ties in length go to the earliest place in the item.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    items = benchmark.where("item_id is not null").select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    item_seeds = checkpoint(_seeds(items, width, None))
    by_seed = item_seeds.select("seed", F.col("row").alias("item")).distinct()
    by_item = item_seeds.groupBy(F.col("row").alias("item"), F.col("id").alias("item_id"), "n_words").agg(F.array_sort(F.collect_list(F.struct("at", "seed"))).alias("own")).select("item", "item_id", F.col("n_words").alias("item_words"), F.col("own.seed").alias("item_seeds"))
    wanted = bitmap = None
    if size > BROADCAST_BYTES:
        bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(item_seeds))
    else:
        wanted = np.unique(np.array([r[0] for r in by_seed.select("seed").distinct().collect()], dtype=np.int64).view(np.uint64))
        by_seed, by_item = F.broadcast(by_seed), F.broadcast(by_item)
    shared = (
        _seeds(rows, width, wanted, bitmap)
        .select("row", F.col("id").alias("doc_id"), "at", "seed")
        .join(by_seed, "seed")
        .groupBy("row", "doc_id", "item")
        .agg(F.array_sort(F.collect_list(F.struct("at", "seed"))).alias("own"))
        .join(by_item, "item")
        .select("doc_id", "item_id", "item_words", F.col("own.at").alias("doc_at"), F.col("own.seed").alias("doc_seeds"), "item_seeds")
    )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            at, seeds, own = (batch.column(c) for c in ("doc_at", "doc_seeds", "item_seeds"))
            for i in range(batch.num_rows):
                tiles = tile(*(c[i].values.to_numpy(zero_copy_only=False) for c in (at, seeds, own)), width)
                found.append((len(tiles), sum(x[2] for x in tiles), min(x[0] for x in tiles), max(x[0] + x[2] for x in tiles)))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), batch.column("item_words"), *(pa.array(c, pa.int64()) for c in columns)],
                ["doc_id", "item_id", "item_words", "n_tiles", "covered", "first_word", "last_word"],
            )

    return shared.mapInArrow(mark, "doc_id long, item_id long, item_words long, n_tiles long, covered long, first_word long, last_word long").withColumn(
        "coverage", F.col("covered") / F.col("item_words")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The pairs of ``overlaps`` in which a document covers ``min_coverage`` of an item's words or more."""
    return overlaps(docs, benchmark, width).where(F.col("coverage") >= min_coverage)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``docs``, all columns, without the documents that hold benchmark items.

    Rows without a ``doc_id`` stay, as do null and empty texts; an id that stands
    for several rows goes with all of them if one of its texts holds an item. A
    coverage equal to ``min_coverage`` goes. Empty tables change nothing.
    """
    found = contaminated(docs, benchmark, width, min_coverage).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == F.col("_leaked"), "left_anti")
