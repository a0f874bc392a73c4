"""Quality and toxicity on held-out labels, chats against plain Python, audio on made-up recordings, and the pipeline's stages."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from alphaloom.llm import audio, chat, quality, toxicity
from alphaloom.llm._words import chunks
from alphaloom.llm.queries import op5_quality_classifier, op6_audio_fingerprints
from tests.llm.common import awkward, empty, texts_of
from tests.llm.test_neardup import brute_force

TENTH = "/root/testdata/sf0.1"


def _rank_accuracy(score, label):
    """Chance that a row of label 1 scores above one of label 0 (ties half)."""
    rank = pd.Series(score).rank().to_numpy()
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_quality_of_held_out_labels(spark):
    got = op5_quality_classifier(spark, TENTH).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    joined = got[got.held_out].merge(pd.read_parquet(f"{TENTH}/labels.parquet"), on="doc_id")
    assert _rank_accuracy(joined.score, joined.quality.to_numpy()) > 0.9
    assert (joined.predicted == joined.quality).mean() > 0.9


def test_ranker_minimises_the_pairwise_loss():
    """Bradley-Terry written out pair by pair: the fitted weights are its minimum, and the threshold cuts off as many rows as are bad."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] - x[:, 2] + rng.normal(size=60) > 0.3).astype(int)
    got = quality.fit_bradley_terry(x, y, pairs=400)
    z = []
    for row in (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6):
        clipped = [min(max(v, -6.0), 6.0) for v in row]
        z.append(np.array([*clipped, *(v * v / 3 for v in clipped)]))
    draw = np.random.default_rng(5)
    pairs = list(zip(draw.choice(np.flatnonzero(y == 1), 400), draw.choice(np.flatnonzero(y == 0), 400), strict=True))

    def loss(w):
        return sum(np.log1p(np.exp(-(z[i] @ w - z[j] @ w))) for i, j in pairs) / len(pairs) + quality.RIDGE * (w @ w) / 2

    least = loss(got.weights)
    for k in range(6):
        for step in (-1e-2, 1e-2):
            moved = got.weights.copy()
            moved[k] += step
            assert loss(moved) > least
    assert abs(int((got.raw(x) < got.threshold).sum()) - int((y == 0).sum())) <= 1
    assert ((got.score(x) >= quality.THRESHOLD) == (got.raw(x) >= got.threshold)).all()


def test_ranker_learns_from_all_pairs(spark):
    """The loss over every pair of a good and a bad text, written out, has no slope at the weights; the threshold is a quantile of all scores."""
    rng = np.random.default_rng(4)
    words = ["the", "of", "Market", "price,", "7", "x!!", "and", "a.", "||", "\n", "QUITE"]
    texts = [" ".join(rng.choice(words, rng.integers(3, 60), p=rng.dirichlet(np.ones(len(words))))) for _ in range(70)]
    label = [int(t.count("the") + t.count("and") + rng.integers(0, 3) > t.count("x!!") + t.count("7") + 1) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = quality.train_ranker(docs, spark.createDataFrame(list(enumerate(label)), "doc_id long, quality int"))
    x, y = np.concatenate([quality.features(c) for c in chunks(pa.array(texts))]), np.array(label)
    assert 10 < y.sum() < 60 and np.allclose(got.mean, x.mean(axis=0)) and np.allclose(got.scale, x.std(axis=0) + 1e-6)
    z = quality.expand((x - got.mean) / got.scale)
    slope, pairs = quality.RIDGE * got.weights, y.sum() * (1 - y).sum()
    for i in np.flatnonzero(y == 1):
        for j in np.flatnonzero(y == 0):
            slope = slope - (z[i] - z[j]) / (1 + np.exp((z[i] - z[j]) @ got.weights)) / pairs
    assert np.abs(slope).max() < 1e-5
    assert got.threshold == pytest.approx(np.quantile(got.raw(x), (1 - y).mean()), abs=1e-9)
    assert got.spread == pytest.approx((np.quantile(got.raw(x), 0.95) - np.quantile(got.raw(x), 0.05)) / 8, abs=1e-6)


def test_ranker_learns_from_all_rows(spark):
    """The only bad rows are the last 100 of 13,000 in the order of hashes."""
    ids = spark.range(13_000).withColumnRenamed("id", "doc_id")
    late = ids.orderBy(F.xxhash64("doc_id").desc()).limit(100).withColumn("late", F.lit(True))
    docs = ids.join(late, "doc_id", "left").select("doc_id", F.when(F.col("late"), "!! 7 ## | 7 ##").otherwise(F.concat(F.lit("plain words in row "), "doc_id")).alias("text"), F.col("late").isNull().cast("int").alias("quality"))
    got = quality.train_ranker(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    kept = quality.keep_good(docs, got).groupBy("quality").count().collect()
    assert [tuple(r) for r in kept] == [(1, 12_900)]


def _plain_logistic(x, y):
    """Newton's method, row by row."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(40):
        gradient, curvature = toxicity.RIDGE * w, toxicity.RIDGE * np.eye(len(w))
        for row, label in zip(x, y, strict=True):
            full = np.append(row, 1.0)
            p = 1 / (1 + np.exp(-(full @ w)))
            gradient = gradient + full * (p - label) / len(x)
            curvature = curvature + np.outer(full, full) * p * (1 - p) / len(x)
        w = w - np.linalg.solve(curvature, gradient)
    return w


def test_chain_equals_plain_fit():
    """Each link against a plain fit on the features and the earlier links' out-of-fold probabilities."""
    rng = np.random.default_rng(8)
    x = (rng.random((90, 4)) < 0.4).astype(float)
    targets = np.column_stack([x[:, 0] * (rng.random(90) < 0.8), x[:, 1] * (rng.random(90) < 0.7), np.maximum(x[:, 0], x[:, 1]) * (rng.random(90) < 0.9)])
    chain = toxicity.fit_chain(x, targets, ("a", "b", "toxic"), np.arange(4), folds=3)
    earlier = []
    for i in range(3):
        design = [np.array([*row, *(e[n] for e in earlier)]) for n, row in enumerate(x)]
        w = _plain_logistic(np.array(design), targets[:, i])
        assert np.abs(1 / (1 + np.exp(-(np.column_stack([design, np.ones(90)]) @ w))) - 1 / (1 + np.exp(-(np.column_stack([design, np.ones(90)]) @ chain.weights[i])))).max() < 0.02
        own = np.zeros(90)
        for fold in range(3):
            inside = [n for n in range(90) if n % 3 != fold]
            held = _plain_logistic(np.array([design[n] for n in inside]), targets[inside, i])
            for n in range(fold, 90, 3):
                own[n] = 1 / (1 + np.exp(-(np.append(design[n], 1.0) @ held)))
        earlier.append(own)


def test_quality_without_usable_labels(spark):
    docs = awkward(spark)
    none = quality.train_ranker(docs, spark.createDataFrame([(4, None), (None, 1), (5, 1), (5, 1)], "doc_id long, quality int"))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {quality.THRESHOLD}
    assert quality.keep_good(docs, none).count() == 10 and quality.keep_good(docs, none).columns == docs.columns
    assert quality.score_quality(empty(spark), none).count() == 0
    both = quality.train_ranker(docs, spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, quality int"))
    assert quality.score_quality(docs, both).where("score between 0 and 1").count() == 10


def test_toxicity_of_unseen_rows(spark):
    docs, labels = spark.read.parquet(f"{TENTH}/documents.parquet"), spark.read.parquet(f"{TENTH}/labels.parquet")
    chain = toxicity.train_chain(docs, labels.where(~quality.held_out()))
    scored = toxicity.score_toxicity(docs, chain).where(quality.held_out()).withColumnRenamed("toxic", "said").join(labels, "doc_id")
    found = scored.select("doc_id", "score", "said", "toxic").toPandas()
    truth = found.toxic.to_numpy()
    assert _rank_accuracy(found.score, truth) > 0.97
    assert (found.said == (truth == 1)).mean() > 0.97
    assert len(chain.names) == len(chain.weights) and [len(w) for w in chain.weights] == [len(chain.weights[0]) + i for i in range(len(chain.weights))]


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    chain = toxicity.train_chain(docs, spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs, chain)
    assert got.count() == 10 and got.where("score between 0 and 1").count() == 10
    assert toxicity.score_toxicity(empty(spark), chain).count() == 0
    blank = toxicity.train_chain(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, blank).where("toxic").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_chats_equal_plain_python(spark, seed):
    rng = np.random.default_rng(seed)
    turns, chains = [], {}
    for conv in range(60):
        n = int(rng.integers(1, 5))
        chain = [("user" if i % 2 == 0 else "assistant", None if rng.random() < 0.1 else f"t{int(rng.integers(0, 2))}") for i in range(n)]
        chains[conv] = tuple(chain)
        turns += [(conv, i, r, t, "clash") for i, (r, t) in enumerate(chain)]
    by = defaultdict(list)
    for conv, c in chains.items():
        by[c].append(conv)
    maximal = {min(ids): (len(c), len(ids), c) for c, ids in by.items() if not any(len(o) > len(c) and o[: len(c)] == c for o in by)}
    table = spark.createDataFrame(turns + [(None, 0, "user", "x", "clash")], "conv_id long, turn int, role string, text string, place string").repartition(5)
    got = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert got.keys() == maximal.keys()
    for i, (n, copies, chain) in maximal.items():
        assert (got[i].n_turns, got[i].n_copies) == (n, copies)
        assert got[i].rendered == "".join(f"<|{r}|>\n{t or ''}\n<|end|>\n" for r, t in chain)
    assert chat.format_chats(table.limit(0)).count() == 0


def test_snapshots_collapse_into_the_longest(spark):
    turns = [(c, i, "user", f"line {i}", None) for c in range(200) for i in range(1 + c % 9)]
    got = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, extra string")).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in got] == [(8, 9, 22)]


def _melody(rng, notes):
    t = np.arange(audio.RATE // 8) / audio.RATE
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (int(k) / 12) * t) * np.sin(np.pi * t * 8) for k in rng.integers(0, 24, notes)])


def test_recordings_align_at_their_offset(spark):
    rng = np.random.default_rng(8)
    pcm = lambda x: (np.clip(x, -1, 1) * 12000).astype("<i2").tobytes()
    tunes = [_melody(rng, 60) for _ in range(12)]
    frames = 4
    shifted = np.concatenate([np.zeros(audio.HOP * frames), tunes[0] + 0.01 * rng.standard_normal(len(tunes[0]))])
    media = [(20 * (i + 1), pcm(x)) for i, x in enumerate(tunes)] + [(1001, pcm(shifted)), (1002, pcm(tunes[0])), (1003, None), (1004, b"\x01"), (1005, pcm(np.zeros(9000)))]
    got = {r.media_id: r for r in audio.align(audio.fingerprints(spark.createDataFrame(media, "media_id long, pcm binary"))).collect()}
    assert len(got) == 17
    assert (got[20].best_id, got[20].best_offset, got[20].n_links) == (1001, frames, 2) and got[20].best_bit_error < 0.1
    assert got[1002].class_id == 20
    assert all(got[20 * i].n_links == 0 for i in range(2, 13))
    assert got[1003].n_links is None and got[1003].n_prints == 0 and got[1005].best_id is None
    assert audio.align(audio.fingerprints(spark.createDataFrame([], "media_id long, pcm binary"))).count() == 0


def test_audio_filters_equal_direct_sums():
    rng = np.random.default_rng(5)
    frames = rng.random((30, 12)).astype(np.float32)
    packed, _ = audio.fingerprint(frames)
    wrapped = np.concatenate([frames, frames], axis=1).astype(float)
    for t in (0, 7, 22):
        word = 0
        for kind, low, height, width in audio.FILTERS:
            block = wrapped[t : t + width, low : low + height]
            half, mid = max(1, width // 2), height // 2
            plus = {0: block[:, mid:], 1: block[half:], 3: block[:, height // 4 : 3 * height // 4]}.get(kind, block[:0]).sum()
            if kind == 2:
                plus = block[:half, :mid].sum() + block[half:, mid:].sum()
            level = int(np.digitize((2 * plus - block.sum()) / (abs(block.sum()) + 0.1), audio._CUTS))
            word = word << 2 | (0, 1, 3, 2)[level]
        assert packed[t] == word


def test_audio_query_links_equal_brute_force(spark, small):
    got = op6_audio_fingerprints(spark, small).collect()
    assert all((r.media_id % 20 == 0) <= r.is_query for r in got) and len({r.media_id for r in got}) == len(got)
    prints = {r.media_id: (np.array(r.prints), np.array(r.sounds, bool)) for r in audio.fingerprints(audio.synthesise(spark.read.parquet(f"{small}/embeddings.parquet"))).collect()}
    members = Counter(r.class_id for r in got)
    for q in sorted({r.class_id for r in got if r.is_query})[:12]:
        pq, sq = prints[q]
        links = members[q] - 1
        for r in members:
            if r == q:
                continue
            pr, sr = prints[r]
            votes = Counter()
            for i in range(len(pq) - 1):
                if sq[i] and sq[i + 1]:
                    for j in np.flatnonzero((pr[:-1] == pq[i]) & (pr[1:] == pq[i + 1]) & sr[:-1] & sr[1:]):
                        votes[int(j) - i] += 1
            if not votes:
                continue
            most = max(votes.values())
            offset = min(o for o, v in votes.items() if v == most)
            a, b = max(0, -offset), min(len(pq), len(pr) - offset)
            if most >= audio.MIN_VOTES and b - a >= audio.MIN_OVERLAP:
                error = sum(int(x).bit_count() for x in pq[a:b] ^ pr[a + offset : b + offset]) / 32 / (b - a)
                links += members[r] * (error <= audio.MAX_BIT_ERROR)
        assert {r.n_links for r in got if r.class_id == q} == {links}


def test_audio_recall_of_true_bit_error(spark):
    """Noisy copies, and copies that start part of a hop later, against the bit error at every offset."""
    rng = np.random.default_rng(12)
    sets = [("noise", x) for x in (0.3, 0.45, 0.6)] + [("late", x) for x in (1 / 8, 1 / 4, 3 / 8)]
    media, prints = [], {}
    for n in range(25 * len(sets)):
        kind, by = sets[n % len(sets)]
        tune = _melody(rng, 64)
        copy = tune + by * rng.standard_normal(len(tune)) if kind == "noise" else np.concatenate([np.zeros(int(audio.HOP * (4 + by))), tune])
        for media_id, x in ((20 * n, tune), (20 * n + 1, copy)):
            raw = (np.clip(x, -1, 1) * 12000).astype("<i2")
            media.append((media_id, raw.tobytes()))
            prints[media_id] = audio.fingerprint(audio.chroma(raw / 32768))[0]
    got = {r.media_id: r for r in audio.align(audio.fingerprints(spark.createDataFrame(media, "media_id long, pcm binary"))).collect()}
    true, found = Counter(), Counter()
    for n in range(25 * len(sets)):
        a, b = prints[20 * n], prints[20 * n + 1]
        errors = []
        for o in range(audio.MIN_OVERLAP - len(a), len(b) - audio.MIN_OVERLAP + 1):
            x, y = max(0, -o), min(len(a), len(b) - o)
            if y - x >= audio.MIN_OVERLAP:
                errors.append((int(np.bitwise_count(a[x:y] ^ b[x + o : y + o]).sum()) / 32 / (y - x), o))
        if min(errors)[0] <= audio.MAX_BIT_ERROR:
            true[sets[n % len(sets)]] += 1
            r = got[20 * n]
            found[sets[n % len(sets)]] += (r.best_id, r.best_offset, r.best_bit_error) == (20 * n + 1, min(errors)[1], round(min(errors)[0], 6))
    assert true.total() > 120 and all(found[k] >= 0.9 * true[k] for k in true), (true, found)


def test_recordings_that_repeat_or_share_an_id(spark):
    rng = np.random.default_rng(21)
    pcm = lambda x: (x * 12000).astype("<i2").tobytes()
    one, two = _melody(rng, 60), _melody(rng, 60)
    late = lambda x: pcm(np.concatenate([np.zeros(audio.HOP * 3), x]))
    media = [(20, pcm(one)), (20, pcm(one)), (20, pcm(two)), (31, late(one)), (32, late(two)), (40, None)]
    table = spark.createDataFrame([(*m, "clash", "clash") for m in media], "media_id long, pcm binary, key string, node string")
    got = audio.align(audio.fingerprints(table)).collect()
    assert sorted((r.media_id, r.class_id, r.n_links, r.best_id, r.best_offset) for r in got if r.media_id == 20) == [(20, 20, 1, 32, 3), (20, 20, 2, 31, 3), (20, 20, 2, 31, 3)]
    assert sorted(r.media_id for r in got) == [20, 20, 20, 31, 32, 40]


def test_chats_with_ties_nulls_and_long_turns(spark):
    """Turns that tie go by role, then text; repeated rows are turns of their own; null roles and texts are not empty ones."""
    long = "word " * 40_000
    turns = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b"), (3, 0, None, None), (4, 0, "", ""), (5, 0, None, None), (5, 1, "user", long), (6, 0, "user", "a"), (6, 0, "user", "a"), (7, None, "user", "a")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()}
    assert {i: (r.n_turns, r.n_copies) for i, r in got.items()} == {1: (2, 2), 4: (1, 1), 5: (2, 1), 6: (2, 1)}
    assert got[1].rendered == "<|user|>\na\n<|end|>\n<|user|>\nb\n<|end|>\n" and got[5].rendered == f"<|unknown|>\n\n<|end|>\n<|user|>\n{long}\n<|end|>\n"


def test_audio_blocks_change_nothing(spark, small, monkeypatch):
    prints = audio.fingerprints(audio.synthesise(spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 200")))
    whole = sorted(map(tuple, audio.align(prints, every=2).collect()), key=str)
    monkeypatch.setattr(audio, "QUERY_BLOCK", 30)
    monkeypatch.setattr(audio, "RECORDING_BLOCK", 70)
    assert sorted(map(tuple, audio.align(prints, every=2).collect()), key=str) == whole


def test_pipeline_stages_hold_what_they_promise(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], small).cache())
        assert kept[-1].columns == docs.columns
    quality_out, unique, clean, redacted = (t.toPandas() for t in kept[1:])
    want = brute_force(quality_out.doc_id.tolist(), quality_out.text.tolist(), 5)
    assert set(unique.doc_id) == {i for i in want if want[i][1] == i}
    assert set(clean.doc_id) < set(unique.doc_id) and set(redacted.doc_id) == set(clean.doc_id)
    assert not redacted.text.fillna("").str.contains(r"[a-z]@[a-z]+\.(?:com|org|net)\b", regex=True).any()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[-1], small).toPandas()
    assert set(packed.doc_id) == set(redacted.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 1024
    assert corpus_pipeline.run(spark, small).count() == len(packed)


def test_pipeline_of_awkward_and_empty_documents(spark, small):
    docs = awkward(spark).selectExpr("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, small)
            table.collect()
    assert re.match("quality", corpus_pipeline.STAGES[0][0])
