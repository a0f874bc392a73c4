"""Toxicity by a classifier chain.

Categories are predicted one after the other: each link is a linear model over
term features and the probabilities of the links before it. In training those
probabilities come from models that have not seen the row (out of fold), so a
link learns to trust earlier ones as far as they deserve on new text. The last
link predicts toxicity itself.

``labels`` has one toxic flag and no categories. ``derive_categories`` makes
them: terms that mark toxic training rows are grouped by the rows they occur
in, and a category is a toxic row that holds a term of its group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm._spark import text_column
from alphaloom.llm._words import NON_ALNUM, Chunk, chunks, split_words

#: Bound of the rows gathered for training; half of it for either label.
TRAINING_ROWS = 5_000
BUCKETS = 1 << 20
PREFIX_BYTES = 5
TERMS = 256
CATEGORIES = 5
FOLDS = 4
RIDGE = 3e-4
THRESHOLD = 0.5
#: Log-odds of a target that no training row has.
NEVER = -10.0


def term_ids(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every distinct term (word or word beginning) of a chunk."""
    words = split_words(chunk, NON_ALNUM, prefix=PREFIX_BYTES)
    row = words.rows_of_words()
    buckets = np.concatenate([words.hashes, words.prefixes]) >> np.uint64(44)
    both = np.unique((np.concatenate([row, row]) << 20) | buckets.astype(np.int64))
    return both >> 20, both & (BUCKETS - 1)


@dataclass(frozen=True)
class Chain:
    """``terms`` maps buckets to feature numbers (-1: none); a link has weights for terms, earlier links and a constant."""

    terms: np.ndarray
    names: tuple[str, ...]
    weights: tuple[np.ndarray, ...]

    def features(self, chunk: Chunk) -> np.ndarray:
        row, bucket = term_ids(chunk)
        number = self.terms[bucket]
        x = np.zeros((chunk.rows, int(self.terms.max(initial=-1)) + 1))
        x[row[number >= 0], number[number >= 0]] = 1
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, one column a link."""
        out = np.zeros((len(x), len(self.weights)))
        for i, w in enumerate(self.weights):
            out[:, i] = _sigmoid(x @ w[: x.shape[1]] + out[:, :i] @ w[x.shape[1] : -1] + w[-1])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Ridge logistic regression with a constant, by accelerated gradient steps (their length by power iteration)."""
    if not np.any(y):
        return np.append(np.zeros(x.shape[1]), NEVER)
    design = np.column_stack([x, np.ones(len(x))])
    top = np.ones(design.shape[1])
    for _ in range(12):
        top = design.T @ (design @ top)
        top /= np.linalg.norm(top) + 1e-12
    bound = 0.3 * float(np.sum((design @ top) ** 2)) / max(len(x), 1) + RIDGE
    w = momentum = np.zeros(design.shape[1])
    t = 1.0
    for _ in range(steps):
        gradient = design.T @ (_sigmoid(design @ momentum) - y) / max(len(x), 1) + RIDGE * momentum
        new = momentum - gradient / bound
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def fit_chain(x: np.ndarray, targets: np.ndarray, names: tuple[str, ...], terms: np.ndarray, folds: int = FOLDS) -> Chain:
    """Fit the links in the order of ``targets``' columns; later ones see earlier ones' out-of-fold probabilities."""
    n = len(x)
    fold = np.arange(n) % folds
    earlier = np.zeros((n, 0))
    weights = []
    for i in range(targets.shape[1]):
        design, y = np.column_stack([x, earlier]), targets[:, i].astype(float)
        own = np.zeros(n)
        for f in range(folds):
            w = _logistic(design[fold != f], y[fold != f])
            own[fold == f] = _sigmoid(design[fold == f] @ w[:-1] + w[-1])
        weights.append(_logistic(design, y))
        earlier = np.column_stack([earlier, own])
    return Chain(terms, names, tuple(weights))


def choose_terms(rows: list[np.ndarray], toxic: np.ndarray, most: int = TERMS) -> np.ndarray:
    """Buckets that tell toxic rows from others best, by a smoothed log-odds z-score, strongest first."""
    positive, negative = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for own, y in zip(rows, toxic, strict=True):
        (positive if y else negative)[own] += 1
    n1, n0 = toxic.sum() + 1, (1 - toxic).sum() + 1
    odds = np.log((positive + 0.5) / (n1 - positive + 0.5)) - np.log((negative + 0.5) / (n0 - negative + 0.5))
    z = odds / np.sqrt(1 / (positive + 0.5) + 1 / (negative + 0.5))
    seen = np.flatnonzero(positive + negative >= 3)
    return seen[np.argsort(-z[seen], kind="stable")][:most]


def derive_categories(x: np.ndarray, toxic: np.ndarray, most: int = CATEGORIES) -> np.ndarray:
    """Category flags (rows x categories): toxic rows that hold a term of a group of terms that occur together.

    Only terms of which nine in ten rows are toxic found groups; a term joins the
    first group that holds at least three in ten of its rows.
    """
    groups: list[np.ndarray] = []
    for j in np.argsort(-(x * toxic[:, None]).sum(axis=0), kind="stable"):
        own = x[:, j] > 0
        hits = own & (toxic == 1)
        if hits.sum() < 5 or hits.sum() < 0.9 * own.sum():
            continue
        for g in groups:
            if (g & hits).sum() >= 0.3 * hits.sum():
                g |= hits
                break
        else:
            if len(groups) < most:
                groups.append(hits.copy())
    return np.column_stack(groups).astype(float) if groups else np.zeros((len(x), 0))


def train_chain(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Chain:
    """Fit on at most ``rows / 2`` labelled rows of either label, those with the smallest hash of their id.

    Labels that are null or no flag are left out; an id labelled twice counts
    once, as toxic if any label says so. Of an id that stands for several texts the
    one with the smallest terms counts, so ``rows`` bounds what the driver gets. Without toxic rows every probability is low.
    """
    clean = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda y: clean.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
    sample = text_column(docs).join(F.broadcast(pick(1).union(pick(0))), "doc_id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for chunk in chunks(batch.column("text")):
                row, bucket = term_ids(chunk)
                offsets = np.searchsorted(row, np.arange(chunk.rows + 1)).astype(np.int32)
                terms = pa.ListArray.from_arrays(offsets, bucket.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, chunk.rows), batch.column("toxic").slice(at, chunk.rows), terms], ["doc_id", "toxic", "terms"])
                at += chunk.rows

    gathered = sample.select("doc_id", "text", "toxic").mapInArrow(gather, "doc_id long, toxic int, terms array<int>")
    found = gathered.groupBy("doc_id", "toxic").agg(F.min("terms").alias("terms")).orderBy("doc_id").toArrow()
    toxic = found.column("toxic").to_numpy().astype(float)
    own = [t.values.to_numpy(zero_copy_only=False) for t in found.column("terms")]
    chosen = choose_terms(own, toxic) if len(own) else np.zeros(0, dtype=np.int64)
    terms = np.full(BUCKETS, -1, dtype=np.int16)
    terms[chosen] = np.arange(len(chosen))
    x = np.zeros((len(own), len(chosen)))
    for i, t in enumerate(own):
        number = terms[t]
        x[i, number[number >= 0]] = 1
    categories = derive_categories(x, toxic)
    names = (*(f"category_{i + 1}" for i in range(categories.shape[1])), "toxic")
    order = np.random.default_rng(3).permutation(len(x))
    return fit_chain(x[order], np.column_stack([categories, toxic])[order], names, terms)


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, categories (map of name to probability), score, toxic`` of every whole text.

    ``score`` is the last link's probability and ``toxic`` whether it reaches the
    threshold (a tie with it counts as toxic). Null and empty texts have no
    terms; very long texts are scored whole. A narrow map: repeated rows are
    scored one by one, an empty table gives an empty result, other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            at = 0
            for chunk in chunks(batch.column("text")):
                p = own.predict(own.features(chunk))
                flat = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], p.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(p)), flat], ["doc_id", "p"])
                at += len(p)

    scored = text_column(docs).mapInArrow(score, "doc_id long, p array<double>")
    names = F.array(*[F.lit(n) for n in chain.names])
    return scored.select("doc_id", F.map_from_arrays(names, "p").alias("categories"), F.element_at("p", -1).alias("score")).withColumn("toxic", F.col("score") >= threshold)
