"""Quality scores by Bradley-Terry pairwise ranking.

Every pair of a document labelled good and one labelled bad prefers the good one;
logistic loss on the difference of their features gives a linear score. The score's
quantile at the share of bad training documents is the threshold, and scores are
mapped to (0, 1) so that it lies at ``THRESHOLD``.

Pairs are never listed. A pair's loss depends on two scores only, so sums over all
pairs come from how many rows of either label lie at each place of the score, and
a Newton step is two passes over the labelled rows' features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm._spark import checkpoint, text_column
from alphaloom.llm._words import SPACES, Chunk, chunks, split_words

#: Pairs that are drawn where rows are held in memory (``fit_bradley_terry``); ``train_ranker`` takes all.
TRAINING_PAIRS = 40_000
#: Up to so many labels are sent to all executors.
BROADCAST_LABELS = 1_000_000
#: Distance of the places at which the sums over partners are held, for the gradient (cubic between them) and for the curvature (linear).
FINE, COARSE = 1 / 16, 1 / 2
#: Places whose sums go in one row, and tasks of a pass over the features (240 bytes a labelled row).
PAGE, TRAINING_TASKS = 64, 16
NEWTON_STEPS = 25
THRESHOLD = 0.7
RIDGE = 1e-3

_CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "comma", "shout", "pipe", "symbol", "quote", "dash", "markup", "lead", "trail", "control")


def _class_of(b: int) -> int:
    c = chr(b)
    for name, chars in (("newline", "\n\r"), ("blank", " \t"), ("stop", ".;:"), ("comma", ","), ("shout", "!?"), ("pipe", "|"), ("symbol", "#$%&*+@^~"), ("quote", "\"'`()[]"), ("dash", "-_/\\"), ("markup", "<>={}")):
        if c in chars:
            return _CLASSES.index(name)
    if b >= 0xC0:
        return _CLASSES.index("lead")
    if b >= 0x80:
        return _CLASSES.index("trail")
    kind = "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "control"
    return _CLASSES.index(kind)


_CLASS = np.array([_class_of(b) for b in range(256)], dtype=np.int64)
_LINE_ENDS = np.array([b in (10, 13) for b in range(256)], dtype=bool)


def features(chunk: Chunk) -> np.ndarray:
    """Rows of shares and logs that describe each text's characters, words and lines."""
    rows, k = chunk.rows, len(_CLASSES)
    size = np.diff(chunk.bounds)
    row = np.repeat(np.arange(rows), size)
    counts = np.bincount(row * k + _CLASS[chunk.data], minlength=rows * k).reshape(rows, k).astype(float)
    shares = counts / np.maximum(size, 1)[:, None]
    words, lines = split_words(chunk, SPACES), split_words(chunk, _LINE_ENDS)
    length = words.ends - words.starts
    out = np.zeros((rows, 12))
    for i in range(rows):
        a, b = words.bounds[i], words.bounds[i + 1]
        own, n = words.hashes[a:b], b - a
        if n:
            _, seen = np.unique(own, return_counts=True)
            pairs = own[1:] * np.uint64(3) + own[:-1]
            out[i, 0] = len(seen) / n
            out[i, 1] = len(seen) / n**0.75
            out[i, 2] = seen.max() / n
            out[i, 3] = (own[1:] == own[:-1]).mean() if n > 1 else 0
            out[i, 4] = len(np.unique(pairs)) / max(n - 1, 1) if n > 1 else 1
            out[i, 5] = length[a:b].mean()
            out[i, 6] = length[a:b].max()
            out[i, 7] = length[a:b].std()
            out[i, 8] = n
        own_lines = lines.row(i)
        m = len(own_lines)
        out[i, 9] = len(np.unique(own_lines)) / m if m else 1
        out[i, 10] = m
        out[i, 11] = n / max(m, 1)
    out[:, 5:9], out[:, 10:] = np.log1p(out[:, 5:9]), np.log1p(out[:, 10:])
    letters = counts[:, :2].sum(axis=1) + counts[:, _CLASSES.index("lead")]
    upper = counts[:, 1] / np.maximum(letters, 1)
    return np.column_stack([np.sqrt(shares), out, upper, letters / np.maximum(size, 1)])


@dataclass(frozen=True)
class Ranker:
    """A fitted score: standardised features and their squares times ``weights``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1); ``THRESHOLD`` or more from the quantile threshold on."""
        z = (self.raw(x) - self.threshold) / self.spread + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z / 3], axis=1)


def _undecided(width: int) -> Ranker:
    return Ranker(np.zeros(width), np.ones(width), np.zeros(2 * width), 0.0, 1.0)


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = TRAINING_PAIRS, seed: int = 5) -> Ranker:
    """Fit on features and 0/1 labels in memory, on drawn pairs. With one label only, or no rows, every text scores ``THRESHOLD``."""
    width = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return _undecided(width)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = expand((x - mean) / scale)
    rng = np.random.default_rng(seed)
    difference = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        gradient = -(difference * p[:, None]).mean(axis=0) + RIDGE * w
        curvature = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    raw = z @ w
    threshold = float(np.quantile(raw, len(bad) / len(y)))
    spread = float(np.quantile(raw, 0.95) - np.quantile(raw, 0.05)) / 8 + 1e-9
    return Ranker(mean, scale, w, threshold, spread)


def _featured(docs: DataFrame) -> DataFrame:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for chunk in chunks(batch.column("text")):
                x = features(chunk)
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(x)), batch.column("quality").slice(at, len(x)), flat], ["doc_id", "quality", "x"])
                at += len(x)

    return docs.mapInArrow(describe, "doc_id long, quality int, x array<double>")


def _cubic(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four places around each score, and their weights in Lagrange's interpolation."""
    first = np.floor(score / FINE)
    t = score / FINE - first
    weights = np.stack([-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6], axis=1)
    return first.astype(np.int64)[:, None] + np.arange(-1, 3), weights


def _linear(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.floor(score / COARSE)
    t = score / COARSE - first
    return first.astype(np.int64)[:, None] + np.arange(2), np.stack([1 - t, t], axis=1)


def _logistic(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d, -40, 40)))


def _over_partners(mass: np.ndarray, step: float, slope: bool) -> tuple[np.ndarray, np.ndarray]:
    """At each place the sums over all partners (``mass`` a place) of the logistic function of (partner - place) and of (place - partner), or of its ``slope``.

    Beyond a distance of 40 the function is 0 or 1, so its difference from a step is all that is folded.
    """
    reach = int(40 / step)
    d = np.arange(-reach, reach + 1) * step
    p = _logistic(d)
    if slope:
        found = np.convolve(mass, p * (1 - p))[reach : reach + len(mass)]
        return found, found
    below = np.convolve(mass, p - (d >= 0))[reach : reach + len(mass)] + np.cumsum(mass)
    return mass.sum() - below, below


def _summed(rows: DataFrame, width: int, emit) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sums, ``width`` a key, of what ``emit(x, quality)`` makes of each batch's features and labels; a task adds up its batches, Spark the tasks."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                for key, value in emit(x, batch.column("quality").to_numpy().astype(np.int64)):
                    found[key] = found[key] + value if key in found else value
        if found:
            flat = np.concatenate(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * width, flat)], ["key", "value"])

    tasks = rows.select("x", "quality").coalesce(TRAINING_TASKS).mapInArrow(parts, "key long, value array<double>")
    sums = tasks.groupBy("key").agg(*(F.sum(F.col("value")[i]).alias(f"v_{i}") for i in range(width))).toArrow().sort_by("key")
    return sums.column("key").to_numpy(), np.column_stack([sums.column(f"v_{i}").to_numpy() for i in range(width)])


def _newton_step(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, pairs: float) -> np.ndarray:
    """The Newton step of the mean loss over all pairs at ``w``: gradient exact up to the interpolation (1e-7), curvature up to 2 %."""
    k = len(w)

    def places(x: np.ndarray, quality: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        score = expand((x - mean) / scale) @ w
        for kind, (at, weights) in enumerate((_cubic(score), _linear(score))):
            page = at // PAGE
            for y in (0, 1):
                of = quality == y
                for own in np.unique(page[of]):
                    here = of[:, None] & (page == own)
                    yield int(own) * 4 + 2 * kind + y, np.bincount(at[here] - own * PAGE, weights[here], PAGE)

    key, value = _summed(rows, PAGE, places)
    page, sort = key // 4, key % 4
    first, mass = {}, {}
    for kind in (0, 1):
        own = sort // 2 == kind
        low, high = int(page[own].min()), int(page[own].max())
        first[kind] = low * PAGE
        for y in (0, 1):
            of = sort == 2 * kind + y
            held = np.zeros((high - low + 1, PAGE))
            held[page[of] - low] = value[of]
            mass[kind, y] = held.ravel()
    # of a good row: how surely bad ones beat it; of a bad one: how surely it beats good ones
    losses = [_over_partners(mass[0, 1], FINE, False)[1], _over_partners(mass[0, 0], FINE, False)[0]]
    slopes = [_over_partners(mass[1, 1], COARSE, True)[0], _over_partners(mass[1, 0], COARSE, True)[0]]
    lines = len(mass[1, 0])

    def sums(x: np.ndarray, quality: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        z = expand((x - mean) / scale)
        score = z @ w
        (fine, cubic), (coarse, linear) = _cubic(score), _linear(score)
        gradient, curvature, lean = np.zeros(k), np.zeros((k, k)), np.zeros((2, lines, k))
        for y in (0, 1):
            of = quality == y
            gradient += (losses[y][fine[of] - first[0]] * cubic[of]).sum(axis=1) @ z[of] * (1 - 2 * y)
            curvature += (z[of] * (slopes[y][coarse[of] - first[1]] * linear[of]).sum(axis=1)[:, None]).T @ z[of]
            for side in (0, 1):
                np.add.at(lean[y], coarse[of, side] - first[1], z[of] * linear[of, side, None])
        return enumerate(np.concatenate([gradient[None], curvature, lean.reshape(2 * lines, k)]))

    value = _summed(rows, k, sums)[1] / pairs
    gradient, curvature, lean = value[0] + RIDGE * w, value[1 : k + 1], value[k + 1 :].reshape(2, lines, k)
    meeting = np.stack([_over_partners(column, COARSE, True)[0] for column in lean[1].T], axis=1)
    cross = lean[0].T @ meeting * pairs
    return np.linalg.solve(curvature - cross - cross.T + RIDGE * np.eye(k), gradient)


def _at_shares(scores: DataFrame, count: int, shares: list[float], *spent: DataFrame) -> list[float]:
    """Quantiles of ``raw`` (linear between neighbours) from its rows' places in order; ``scores`` has ``raw`` and a unique ``doc_id``. ``spent`` are tables that only ``scores`` still needs."""
    ranged = checkpoint(scores.repartitionByRange("raw", "doc_id").select("*", F.spark_partition_id().alias("part")), *spent)
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row a part
    parts = F.broadcast(ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before")))
    own = F.row_number().over(Window.partitionBy("part").orderBy("raw", "doc_id"))
    ranks = [share * (count - 1) for share in shares]
    wanted = sorted({int(r) for r in ranks} | {min(int(r) + 1, count - 1) for r in ranks})
    placed = ranged.withColumn("own", own).join(parts, "part").select("raw", (F.col("before") + F.col("own") - 1).alias("place"))
    at = {r.place: r.raw for r in placed.where(F.col("place").isin(wanted)).collect()}
    return [at[int(r)] + (at[min(int(r) + 1, count - 1)] - at[int(r)]) * (r - int(r)) for r in ranks]


def train_ranker(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fit on all labelled rows of ``docs`` and all pairs of a good and a bad one.

    ``labels`` has ``doc_id`` and ``quality``; rows with a null in either, or
    with another value than 0 or 1, are left out, and an id labelled twice
    counts once (with the smaller label). Of an id that stands for several texts
    the one with the smallest features counts. The driver gets sums by place of the
    score and by pair of features, never rows. Weights are kept to six decimals,
    so that the order in which sums are combined does not show.
    """
    clean = checkpoint(labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")))
    sample = text_column(docs).join(F.broadcast(clean) if clean.count() <= BROADCAST_LABELS else clean, "doc_id")
    rows = checkpoint(_featured(sample.select("doc_id", "text", "quality")).groupBy("doc_id", "quality").agg(F.min("x").alias("x")), clean)
    width = len(_CLASSES) + 14
    counted = [F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))]
    n, good, *moments = rows.agg(*counted, *(f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(width))).first()
    if good in (0, n):
        return _undecided(width)
    mean, scale = np.round(moments[:width], 9), np.round(moments[width:], 9) + 1e-6
    w = np.zeros(2 * width)
    for _ in range(NEWTON_STEPS):
        step = _newton_step(rows, mean, scale, w, float(good) * (n - good))
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    fitted = Ranker(mean, scale, np.round(w, 6), 0.0, 1.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fitted.raw(x))], ["doc_id", "raw"])

    scores = rows.select("doc_id", "x").mapInArrow(score, "doc_id long, raw double")
    threshold, high, low = _at_shares(scores, n, [(n - good) / n, 0.95, 0.05], rows)
    return Ranker(mean, scale, fitted.weights, threshold, (high - low) / 8 + 1e-9)


def score_quality(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """``doc_id, score`` of every row; null and empty texts are scored by their (zero) features.

    A narrow map over whole texts of any length; repeated rows are scored one by
    one and equal texts get equal scores, an empty table gives an empty result, other columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [ranker.score(features(chunk)) for chunk in chunks(batch.column("text"))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return text_column(docs).mapInArrow(score, "doc_id long, score double")


def keep_good(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold.

    A narrow map over whole texts, chunk by chunk. Null and empty texts are judged
    by their (zero) features, repeated rows and rows without an id each by
    themselves; a score equal to the threshold stays; an empty table stays empty.
    """
    names = docs.columns
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            for chunk in chunks(batch.column(at)):
                part = batch.slice(chunk.first, chunk.rows)
                yield part.filter(pa.array(ranker.score(features(chunk)) >= THRESHOLD))

    return docs.mapInArrow(keep, schema)


def held_out():
    """Whether a row's label is never learnt from: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
