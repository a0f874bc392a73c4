"""Chroma audio fingerprints of a media column.

A recording's frames are reduced to the energy of the twelve pitch classes.
Rectangle filters over an integral image of frames and pitch classes, each
quantised to two bits in Gray code, pack into one 32-bit integer per frame.
Recordings are aligned by integers that differ in two bits at most: each offset at
which enough of them meet is judged by the differing bits of the overlap there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm._spark import checkpoint

RATE, FRAME, HOP = 4096, 1024, 512
LOWEST_HZ, HIGHEST_HZ = 110.0, 1760.0
#: A match holds so many agreeing integers (up to ``NEAR_BITS`` differing bits), overlap and share of differing bits.
MIN_VOTES, MIN_OVERLAP, MAX_BIT_ERROR = 3, 12, 0.2
NEAR_BITS = 2
SPAN = 8
#: Queries and recordings that meet in one task, and pairs of frames that it holds at once.
QUERY_BLOCK, RECORDING_BLOCK, HELD = 1024, 16384, 4_000_000

#: The sixteen filters by rule: widths 2, 4, 8 frames and two pitch bands each way; kind 0 compares
#: halves in pitch, 1 halves in time, 2 the quadrants crosswise, 3 the inner with the outer thirds.
FILTERS = tuple((kind, band * 4 % 12, 4 + 4 * (i % 2), 2 ** (1 + i % 3)) for i, (kind, band) in enumerate((k, b) for b in range(4) for k in range(4)))
#: Gray code of the four quantiser levels.
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
_CUTS = (-0.12, 0.0, 0.12)


def _pitch_class_map() -> np.ndarray:
    """Spectrum bins to pitch classes: bins x 12, zero outside the range of pitch."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(hz), 12), dtype=np.float32)
    for i, f in enumerate(hz):
        if LOWEST_HZ <= f <= HIGHEST_HZ:
            out[i, int(round(12 * np.log2(f / 440.0))) % 12] = 1
    return out


_MAP = _pitch_class_map()
_WINDOW = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12 energies, each frame scaled to length 1; silent frames are zero."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), dtype=np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)) ** 2
    energy = power.astype(np.float32) @ _MAP
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-3 * FRAME, energy / np.maximum(norm, 1e-12), 0)


def fingerprint(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One unsigned 32-bit integer per frame that ``SPAN`` frames follow, and whether those frames hold sound."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=bool)
    wrapped = np.concatenate([frames, frames], axis=1).astype(float)
    integral = np.zeros((len(frames) + 1, 25))
    integral[1:, 1:] = wrapped.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return integral[t + t1, p1] - integral[t + t0, p1] - integral[t + t1, p0] + integral[t + t0, p0]

    packed = np.zeros(n, dtype=np.uint32)
    for kind, low, height, width in FILTERS:
        half, mid = max(1, width // 2), low + height // 2
        whole = area(0, width, low, low + height)
        if kind == 0:
            plus = area(0, width, mid, low + height)
        elif kind == 1:
            plus = area(half, width, low, low + height)
        elif kind == 2:
            plus = area(0, half, low, mid) + area(half, width, mid, low + height)
        else:
            plus = area(0, width, low + height // 4, low + 3 * height // 4)
        level = np.digitize((2 * plus - whole) / (np.abs(whole) + 0.1), _CUTS)
        packed = (packed << np.uint32(2)) | _GRAY[level]
    sound = frames.any(axis=1).astype(np.int64)
    heard = np.concatenate([[0], np.cumsum(sound)])
    return packed, heard[SPAN : SPAN + n] - heard[:n] >= SPAN // 2


def fingerprints(media: DataFrame) -> DataFrame:
    """``media_id, prints, sounds`` of 16-bit little-endian mono PCM at ``RATE``: integers and audible flags by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sounds = [], []
            for pcm in batch.column("pcm"):
                raw = pcm.as_py() or b""
                packed, heard = fingerprint(chroma(np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<i2") / 32768))
                prints.append(packed.astype(np.int64))
                sounds.append(heard)
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), pa.array(prints, pa.list_(pa.int64())), pa.array(sounds, pa.list_(pa.bool_()))], ["media_id", "prints", "sounds"])

    return media.select("media_id", "pcm").mapInArrow(run, "media_id long, prints array<long>, sounds array<boolean>")


def synthesise(embeddings: DataFrame) -> DataFrame:
    """``media_id, pcm``: a melody of one note per component of each vector.

    The test tables hold no audio, so the media column is rendered from them:
    the component's sign and size choose the note, and ``vec_id % 5`` notes of
    silence come first, so that equal melodies lie at different offsets. Null
    vectors and components are silent.
    """
    note = np.arange(RATE // 8) / RATE
    tones = [np.sin(2 * np.pi * 220.0 * 2 ** (k / 12) * note) * np.sin(np.pi * note * 8) for k in range(24)]
    silent = np.zeros(len(note))

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, clips = batch.slice(at, 128), []
                for i, vector in zip(part.column("media_id").to_pylist(), part.column("embedding").to_pylist(), strict=True):
                    line = [silent] * (i % 5) + [silent if v is None or v != v else tones[int(np.clip(round(12 + 40 * v), 0, 23))] for v in vector or []]
                    clips.append((np.concatenate(line or [silent[:0]]) * 12000).astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("media_id"), pa.array(clips, pa.binary())], ["media_id", "pcm"])

    ids = embeddings.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("media_id"), "embedding")
    return ids.mapInArrow(play, "media_id long, pcm binary")


#: All masks of up to ``NEAR_BITS`` bits.
_MASKS = np.array([sum(1 << b for b in bits) for n in range(NEAR_BITS + 1) for bits in combinations(range(32), n)], dtype=np.uint32)


class _Prints:
    """Recordings end to end: ids, prints, bounds of each, and the audible frames in order of recording."""

    def __init__(self, table: pa.Table) -> None:
        self.nodes = table.column("node").to_numpy()
        self.ids = table.column("class_id").to_numpy()
        self.members = table.column("members").to_numpy()
        parts = [np.frombuffer(b, dtype="<u4") for b in table.column("prints").to_pylist()]
        self.bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
        self.prints = np.concatenate([np.zeros(0, dtype="<u4"), *parts])
        self.heard = np.flatnonzero(np.frombuffer(b"".join(table.column("sounds").to_pylist()), dtype=np.uint8))
        self.starts = np.searchsorted(self.heard, self.bounds)


def _slot(prints: np.ndarray) -> np.ndarray:
    return (prints * np.uint32(2654435761)) >> np.uint32(9)


def _met(q: _Prints, q0: int, q1: int, r: _Prints, r0: int, r1: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, recording and offset wherever at least ``MIN_VOTES`` frames of ``q[q0:q1]`` and ``r[r0:r1]`` are near."""
    own, at, n = np.unique(q.prints[q.heard[q.starts[q0] : q.starts[q1]]], return_inverse=True, return_counts=True)
    theirs, at_theirs, n_theirs = np.unique(r.prints[r.heard[r.starts[r0] : r.starts[r1]]], return_inverse=True, return_counts=True)
    if not len(own) or not len(theirs):
        return
    filled = np.zeros(1 << 23, dtype=bool)
    filled[_slot(theirs)] = True
    left, right = [], []
    for mask in _MASKS:
        flipped = own ^ mask
        maybe = np.flatnonzero(filled[_slot(flipped)])
        place = np.minimum(np.searchsorted(theirs, flipped[maybe]), len(theirs) - 1)
        hit = theirs[place] == flipped[maybe]
        left.append(maybe[hit])
        right.append(place[hit])
    u, v = np.concatenate(left), np.concatenate(right)
    many = n[u] * n_theirs[v]
    if many.sum() > HELD and (q1 - q0 > 1 or r1 - r0 > 1):
        if q1 - q0 > 1:
            middle = (q0 + q1) // 2
            yield from _met(q, q0, middle, r, r0, r1)
            yield from _met(q, middle, q1, r, r0, r1)
        else:
            middle = (r0 + r1) // 2
            yield from _met(q, q0, q1, r, r0, middle)
            yield from _met(q, q0, q1, r, middle, r1)
        return
    # every frame that holds the one print against every frame that holds the other
    pair = np.repeat(np.arange(len(u)), many)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
    held, held_theirs = np.argsort(at, kind="stable"), np.argsort(at_theirs, kind="stable")
    width = n_theirs[v][pair]
    fq = q.heard[q.starts[q0] + held[(np.cumsum(n) - n)[u][pair] + k // width]]
    fr = r.heard[r.starts[r0] + held_theirs[(np.cumsum(n_theirs) - n_theirs)[v][pair] + k % width]]
    i, j = np.searchsorted(q.bounds, fq, "right") - 1, np.searchsorted(r.bounds, fr, "right") - 1
    offset = (fr - r.bounds[j]) - (fq - q.bounds[i])
    low = offset.min(initial=0)
    reach = int(offset.max(initial=0) - low) + 1
    code, votes = np.unique(((i - q0) * (r1 - r0) + (j - r0)) * reach + (offset - low), return_counts=True)
    code = code[votes >= MIN_VOTES]
    both = code // reach
    yield q0 + both // (r1 - r0), r0 + both % (r1 - r0), code % reach + low


def _compared(queries: pa.Table, recordings: pa.Table) -> pa.Table:
    """``q, r, offset, members, error`` of the pairs that match (node of the query, class id of the recording), each at its offset of least bit error."""
    q, r = _Prints(queries), _Prints(recordings)
    out = []
    for first in range(0, len(q.ids), 64):
        for i, j, offset in _met(q, first, min(first + 64, len(q.ids)), r, 0, len(r.ids)):
            start = np.maximum(0, -offset)
            overlap = np.minimum(np.diff(q.bounds)[i], np.diff(r.bounds)[j] - offset) - start
            ok = (overlap >= MIN_OVERLAP) & (q.nodes[i] != r.nodes[j])
            i, j, offset, start, overlap = i[ok], j[ok], offset[ok], start[ok], overlap[ok]
            error = np.zeros(len(i))
            for cut in range(0, len(i), 1 << 16):
                part = slice(cut, cut + (1 << 16))
                ends = np.cumsum(overlap[part])
                k = np.arange(ends[-1]) - np.repeat(ends - overlap[part], overlap[part])
                bits = np.bitwise_count(
                    q.prints[np.repeat(q.bounds[i[part]] + start[part], overlap[part]) + k] ^ r.prints[np.repeat(r.bounds[j[part]] + start[part] + offset[part], overlap[part]) + k]
                )
                error[part] = np.add.reduceat(bits.astype(np.int64), ends - overlap[part]) / (32.0 * overlap[part])
            order = np.lexsort((offset, np.abs(offset), error, j, i))
            order = order[error[order] <= MAX_BIT_ERROR]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
            best = order[new]
            out.append(pa.table({"q": q.nodes[i[best]], "r": r.ids[j[best]], "offset": offset[best].astype(np.int32), "members": r.members[j[best]], "error": error[best]}))
    none = pa.table({c: pa.array([], t) for c, t in (("q", pa.int64()), ("r", pa.int64()), ("offset", pa.int32()), ("members", pa.int64()), ("error", pa.float64()))})
    return pa.concat_tables([none, *out])


def _packed(reps: DataFrame) -> DataFrame:
    """``prints`` as four bytes and ``sounds`` as one byte a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [np.array(x, dtype="<u4").tobytes() for x in batch.column("prints").to_pylist()]
            sounds = [np.array(x, dtype=np.uint8).tobytes() for x in batch.column("sounds").to_pylist()]
            names = ["node", "class_id", "members", "asked"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(prints, pa.binary()), pa.array(sounds, pa.binary())], [*names, "prints", "sounds"])

    return reps.select("node", "class_id", "members", "asked", "prints", "sounds").mapInArrow(run, "node long, class_id long, members long, asked boolean, prints binary, sounds binary")


def align(media_prints: DataFrame, every: int = 20) -> DataFrame:
    """``media_id, class_id, n_prints, is_query, n_links, best_id, best_offset, best_bit_error``, one row per recording.

    Recordings with equal prints are one class, named by its smallest id, and
    only class representatives are compared. Queries are the classes that hold
    an id divisible by ``every``; ``n_links`` counts the other recordings that
    match (class members included; null for others than queries) and ``best``
    is the closest other class: its id, how many frames later the query's music
    stands in it, and the share of bits that differ there. Silent frames do not
    vote. Empty or too short recordings match nothing. Repeated rows come back
    one by one and count as members of their class; an id that stands for two
    recordings belongs to the classes of both, whose rows are told apart by
    ``n_prints`` and links. Other columns are ignored; an empty table gives an empty result.
    A recording's prints are one row, so its length is bounded by a task's memory.

    Blocks of queries meet blocks of recordings, each pair of blocks in one
    task, so votes are counted where they arise and only matches leave it.
    """
    key = F.md5(F.array_join("prints", ",").cast("binary"))
    prints = checkpoint(media_prints.select("media_id", "prints", "sounds", key.alias("key")))
    keyed = prints.select("media_id", "key", F.size("prints").alias("n_prints"))
    classes = keyed.groupBy("key").agg(F.min("media_id").alias("class_id"), F.count("*").alias("members"), F.max(F.col("media_id") % every == 0).alias("asked"))
    classes = checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))
    named = classes.withColumn("media_id", F.col("class_id"))
    reps = checkpoint(_packed(prints.join(named, ["media_id", "key"]).dropDuplicates(["node"])))

    sizes = reps.agg(F.count_if("asked").alias("queries"), F.count("*").alias("recordings")).first()
    n_q, n_r = -(-sizes["queries"] // QUERY_BLOCK), -(-sizes["recordings"] // RECORDING_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("node"), F.lit(max(n, 1)))
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)).cast("array<long>"))
    queries = reps.where("asked").select(block(n_q).alias("qb"), every_block(n_r).alias("rb"), "node", "class_id", "members", "prints", "sounds")
    others = reps.select(every_block(n_q).alias("qb"), block(n_r).alias("rb"), "node", "class_id", "members", "prints", "sounds")
    matched = queries.groupBy("qb", "rb").cogroup(others.groupBy("qb", "rb")).applyInArrow(_compared, "q long, r long, offset int, members long, error double")
    best = matched.groupBy("q").agg(F.sum("members").alias("links"), F.min(F.struct("error", "r", "offset")).alias("best"))
    joined = keyed.join(classes, "key").join(best, F.col("node") == F.col("q"), "left")
    return joined.select(
        "media_id", "class_id", "n_prints", F.col("asked").alias("is_query"),
        F.when(F.col("asked"), F.coalesce("links", F.lit(0)) + F.when(F.col("n_prints") > 0, F.col("members") - 1).otherwise(0)).alias("n_links"),
        F.col("best.r").alias("best_id"), F.col("best.offset").alias("best_offset"), F.round("best.error", 6).alias("best_bit_error"),
    )
