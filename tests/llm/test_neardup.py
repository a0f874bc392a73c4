"""Near duplicates against all-pairs comparison on full shingle sets."""

import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import neardup
from alphaloom.llm.queries import op9_near_duplicates
from tests.llm.common import awkward, empty, texts_of


def _set(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_force(ids, texts, width, percent=80):
    """``{id: (set size, smallest id reachable)}`` over all pairs that share a shingle."""
    sets = {i: _set(t, width) for i, t in zip(ids, texts, strict=True)}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = sorted((i for i in ids if sets[i]), key=lambda i: len(sets[i]))
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if len(sets[b]) * percent > 100 * len(sets[a]):
                break
            inter = len(sets[a] & sets[b])
            if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def _check(docs, found, width):
    want = brute_force(docs.doc_id.tolist(), docs.text.tolist(), width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == want
    return sum(i != c for i, (_, c) in want.items())


def test_two_word_links_equal_brute_force(spark, small):
    assert _check(texts_of(f"{small}/documents.parquet"), op9_near_duplicates(spark, small), 2)


def test_five_word_links_equal_brute_force(spark, small):
    assert _check(texts_of(f"{small}/documents.parquet"), neardup.near_duplicates(spark.read.parquet(f"{small}/documents.parquet")), 5)


@pytest.mark.parametrize("seed", [0, 1])
def test_hard_groups_equal_brute_force(spark, seed):
    """Chains, hubs, exact copies and short texts around the similarity bound."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"t{i}" for i in range(400)]
    texts = []
    for _ in range(6):
        base = [vocabulary[i] for i in rng.integers(0, 400, int(rng.integers(30, 90)))]
        for _ in range(15):
            texts.append(" ".join(base))
            for at in rng.integers(0, len(base), int(rng.integers(0, 3))):
                base = [*base[:at], vocabulary[int(rng.integers(400))], *base[at + 1 :]]
    texts += ["one", "ONE", "one two", "one  two", "two one", "", " ", None] * 2
    pdf = __import__("pandas").DataFrame({"doc_id": np.arange(len(texts)) * 7 % 1009 + 5, "text": texts}).drop_duplicates("doc_id")
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(pdf.doc_id, pdf.text, strict=True)], "doc_id long, text string").repartition(7)
    assert _check(pdf, neardup.near_duplicates(docs, 2), 2)


@pytest.mark.parametrize(("seed", "vocabulary", "edits"), [(5, 5000, 16), (6, 60, 12), (7, 5000, 9)])
def test_large_group_of_near_copies_equals_brute_force(spark, seed, vocabulary, edits):
    """Copies of two templates with up to so many edits: most pairs meet in the index, many of them just under the bound."""
    rng = np.random.default_rng(seed)
    rows = []
    for template in rng.integers(0, 5000, (2, 120)):
        for _ in range(170):
            words = [f"t{w}" for w in template]
            for at in rng.integers(0, len(words), int(rng.integers(0, edits + 1))):
                words[at] = f"e{rng.integers(vocabulary)}"
            rows.append((len(rows) * 11 % 3571, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pdf = __import__("pandas").DataFrame(rows, columns=["doc_id", "text"])
    assert _check(pdf, neardup.near_duplicates(docs, 2), 2)


def test_links_by_delta_equal_all_pairs(spark):
    """Without a single link of the hub's own, the differences alone find every pair of members at the bound or above."""
    rng = np.random.default_rng(11)
    base = np.arange(90)
    sets = {0: set(base.tolist())}
    for i in range(1, 220):
        own = rng.choice(base, int(rng.integers(50, 90)), replace=False).tolist() if i % 3 else sorted(sets[i - 1])[: int(rng.integers(40, 90))]
        sets[i] = set(own) | set(rng.integers(1000, 1400, int(rng.integers(0, 25))).tolist())
    ties = spark.createDataFrame([(0, i, 90, len(s), sorted(s ^ sets[0])) for i, s in sets.items() if i], "a long, b long, hub_size int, size int, delta array<long>")
    links = {(min(r), max(r)) for r in map(tuple, neardup._links_by_delta(ties, spark.createDataFrame([], "node long, component long"), 80).collect())}
    similar = {(i, j) for i, j in combinations(sets, 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links <= similar and len(similar) > 20
    assert _roots(links, sets) == _roots(similar, sets)


def test_members_are_entered_once_an_element(spark, monkeypatch):
    """Entries of a large group of near copies grow with its members' differences, not with the weights of their partners."""
    kept, whole = [], neardup.checkpoint

    def watched(table, *spent):
        found = whole(table, *spent)
        if {"b", "e"} <= set(table.columns):
            kept.append((found.count(), found.select("a", "b", "e").distinct().count()))
        return found

    monkeypatch.setattr(neardup, "checkpoint", watched)
    rng = np.random.default_rng(8)
    base = np.arange(200)
    sets = [set(base.tolist()) ^ set(rng.choice(base, int(rng.integers(10, 30)), replace=False).tolist()) ^ set(rng.integers(1000, 1100, int(rng.integers(1, 30))).tolist()) for _ in range(150)]
    ties = spark.createDataFrame([(0, i + 1, 200, len(s), sorted(s ^ set(base.tolist()))) for i, s in enumerate(sets)], "a long, b long, hub_size int, size int, delta array<long>")
    neardup._links_by_delta(ties, spark.createDataFrame([], "node long, component long"), 80)
    [(entries, distinct)] = kept
    assert 0 < entries == distinct <= sum(len(s ^ set(base.tolist())) for s in sets)


def _roots(links, nodes):
    name = {i: i for i in nodes}
    for _ in nodes:
        before = dict(name)
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
        if name == before:
            break
    return name


def test_two_texts_of_one_id_keep_their_own_sets(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "p q r s t"), (3, "p q r s t"), (9, "a b c d"), (5, "a b c d")], "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(docs, 2).collect()))
    assert got == [(3, 4, 3, True), (5, 3, 5, True), (5, 3, 5, True), (5, 4, 3, False), (9, 3, 5, False)]


def test_ids_by_shuffle_or_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    rows = [(i, f"w{i // 3} " + " ".join(f"x{i // 3}y{j}" for j in range(40)) + (" z" if i % 3 else "")) for i in range(30)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i - i % 3 for i in range(30)}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(map(int, rng.integers(0, 400, 2)))) for _ in range(260)} | {(i, i + 1) for i in range(500, 560)}
    links = spark.createDataFrame(sorted(pairs), "a long, b long")
    got = {r.node: r.component for r in neardup.components(links).collect()}
    name = {i: i for p in pairs for i in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(name[a], name[b])
            changed |= name[a] != low or name[b] != low
            name[a] = name[b] = low
    assert {i: got.get(i, i) for i in name} == name


def test_index_meets_every_pair_within_its_distance():
    """Pigeonhole: signatures that differ in MAX_DISTANCE symbols or fewer share a key."""
    rng = np.random.default_rng(3)
    one = rng.integers(0, 65536, (200, neardup.SYMBOLS)).astype("<u2")
    other = one.copy()
    for row in other:
        at = rng.choice(neardup.SYMBOLS, int(rng.integers(0, neardup.MAX_DISTANCE + 1)), replace=False)
        row[at] ^= rng.integers(1, 65536, len(at)).astype("<u2")
    for a, b in zip(neardup.chunk_keys(one), neardup.chunk_keys(other), strict=True):
        assert set(a.tolist()) & set(b.tolist())


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(3, 4, True)] * 2 and by[6] == [(1, 6, True)] and by[7] == [(1, 7, True)]
    assert by[None] == [(4, None, True)]
    assert neardup.near_duplicates(empty(spark)).count() == 0
    pairs = combinations([r.doc_id for r in got if r.doc_id], 2)
    assert all(a == b or by[a][0][1] != by[b][0][1] for a, b in pairs)
    copies = docs.where("doc_id = 5").crossJoin(spark.range(300).select(F.col("id").alias("copy"))).withColumn("doc_id", F.col("copy") + 1000)
    assert {(r.component_id, r.n_shingles) for r in neardup.near_duplicates(copies).collect()} == {(1000, 6)}
