"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``SYMBOLS`` MinHash values of 16 bits. Cut into ``CHUNKS``
chunks, two signatures that differ in at most ``2 * CHUNKS - 1`` symbols have,
by pigeonhole, a chunk with at most one differing symbol. Each chunk is
therefore indexed once for every symbol left out (the allowed chunk error), so
every pair within that distance meets under some key.

Keys are not expanded into all pairs. Every document under a key is tied to the
key's best-connected document, its hub, and compared with it on the full sets.
What then shares a component needs no further look. Two other members of one hub
are similar or not by how far their differences from the hub differ; these pairs
come from an exact prefix filter on the differences (``_links_by_delta``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm._spark import checkpoint, text_column
from alphaloom.llm._words import SPACES, Words, chunks, mix, split_words, windows

SYMBOLS, CHUNKS = 96, 19
MAX_DISTANCE = 2 * CHUNKS - 1
_FACTORS = np.random.default_rng(977).integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNKS = np.array_split(np.arange(SYMBOLS), CHUNKS)
_BLOCK = 1024
#: Candidate documents up to which their ids are broadcast to the texts (8 MB of ids); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a row of fewer words has its whole sequence as its one shingle."""
    rolled, at = windows(words, width)
    bounds = np.searchsorted(at, words.bounds)
    for i in range(len(words.bounds) - 1):
        own = rolled[bounds[i] : bounds[i + 1]]
        short = words.row(i)
        if not len(own) and len(short):
            own = mix(np.array([len(short)], dtype=np.uint64) + np.bitwise_xor.reduce(mix(short + np.arange(len(short), dtype=np.uint64))))
        yield np.unique(own)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 16-bit symbols of a non-empty set: mixed minima of ``SYMBOLS`` multiplicative orders."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), _BLOCK):
        np.minimum(least, (_FACTORS[:, None] * shingles[None, i : i + _BLOCK]).min(axis=1), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2")


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """Index keys of signatures (rows x ``SYMBOLS``): one per chunk and left-out symbol."""
    wide, keys = symbols.astype(np.uint64), []
    for number, chunk in enumerate(_CHUNKS):
        for left_out in chunk:
            key = np.full(len(wide), number * SYMBOLS + int(left_out) + 1, dtype=np.uint64)
            for j in chunk[chunk != left_out]:
                key = mix(key ^ wide[:, j]) + np.uint64(j)
            keys.append(key)
    return np.stack(keys, axis=1)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a non-empty set."""
    return tuple(np.array([np.add.reduce(mix(shingles)), np.bitwise_xor.reduce(mix(shingles + np.uint64(77)))], dtype=np.uint64).view(np.int64).tolist())


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, k1, k2, symbols``: set size, set key and signature of every text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunk in chunks(batch.column("text")):
                for own in shingle_sets(split_words(chunk, SPACES), width):
                    rows.append((len(own), *set_key(own), signature(own).tobytes()) if len(own) else (0, 0, 0, None))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_shingles", "k1", "k2", "symbols"])

    return text_column(docs).mapInArrow(sign, "doc_id long, n_shingles long, k1 long, k2 long, symbols binary")


def _index(reps: DataFrame) -> DataFrame:
    """``key, node`` of every representative."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                symbols = np.frombuffer(b"".join(part.column("symbols").to_pylist()), dtype="<u2").reshape(-1, SYMBOLS)
                keys = chunk_keys(symbols).view(np.int64)
                nodes = np.repeat(part.column("node").to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes, pa.int64())], ["key", "node"])

    return reps.select("node", "symbols").mapInArrow(expand, "key long, node long")


def _stars(reps: DataFrame) -> DataFrame:
    """``a, b``: every node ``b`` that shares a key with others, tied to the hub ``a`` of that key.

    Counts, degrees and hubs are combined before they are shuffled; no key's
    rows meet in one task other than as a skewed join's, which is split.
    """
    sizes = _index(reps).groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = checkpoint(_index(reps).join(sizes, "key"))
    degrees = met.groupBy("node").agg(F.sum("size").alias("degree"))
    hubs = met.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", F.negative("node").alias("order"), "node")).alias("hub"))
    return checkpoint(met.join(hubs.select("key", F.col("hub.node").alias("a")), "key").where("a <> node").select("a", F.col("node").alias("b")).distinct(), met)


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` of the classes ``wanted`` (``node, doc_id, k1, k2``), computed anew from their representatives' texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (nodes, first, second) = 0, (batch.column(c).to_pylist() for c in ("node", "k1", "k2"))
            for chunk in chunks(batch.column("text")):
                sets = list(enumerate(shingle_sets(split_words(chunk, SPACES), width), at))
                own = [(i, s) for i, s in sets if len(s) and set_key(s) == (first[i], second[i])]
                offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in own])]).astype(np.int32)
                flat = np.concatenate([s for _, s in own]).view(np.int64) if own else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in own], pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["node", "shingles"])
                at += len(sets)

    few = wanted.count() <= BROADCAST_IDS
    return text_column(docs).join(F.broadcast(wanted) if few else wanted, "doc_id").select("node", "k1", "k2", "text").mapInArrow(build, "node long, shingles array<long>").dropDuplicates(["node"])


def _similar(size_a, size_b, apart, percent: int):
    """Whether sets that differ in ``apart`` elements reach the similarity: 100 inter >= percent union, doubled."""
    return (size_a + size_b - apart) * 100 >= (size_a + size_b + apart) * percent


def _ties(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, hub_size, size, delta, linked`` of pairs of a hub ``a`` and a member ``b``: set sizes, what only one of the two has, and whether they are similar."""
    both = stars.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
    delta = F.concat(F.array_except("set_a", "set_b"), F.array_except("set_b", "set_a"))
    sized = both.select("a", "b", F.size("set_a").alias("hub_size"), F.size("set_b").alias("size"), delta.alias("delta"))
    return sized.withColumn("linked", _similar(F.col("hub_size"), F.col("size"), F.size("delta"), percent))


def _links_by_delta(ties: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between members of one hub that join up components which the hub's own links leave apart.

    Sets u, v are similar when what only one of them has, |u xor v|, is at most
    ``(100 - percent) / (100 + percent)`` of their sizes' sum. With du, dv their
    differences from any common centre, |u xor v| = |du| + |dv| - 2 |du & dv|. A
    weight w(u) = (100 + percent) |du| - (100 - percent) size(u) for each set
    then says it all: u and v are similar exactly when they share at least
    (w(u) + w(v)) / (2 (100 + percent)) elements of their differences.

    * If w(u) + w(v) <= 0 they are similar whatever they share. Both are then
      similar to the hub's member of least weight, and are linked to that.
    * Otherwise take the first element, rarest first, that both hold: each has, from
      it on, as many elements as they must share, or more (prefix filter). The count
      depends on the partner, so a set is entered once under each element, with
      how many it has left from there on; a pair is held against that when it
      meets. Elements too late for the lightest set of another component are left out.

    Tables of one row a hub are written before they meet a hub's members, so
    that joins on a large hub can be split or broadcast at run time. Elements of one set only meet nothing and are left out, but take their place
    in the prefix. The centre is the hub with the elements that most of its
    members differ in turned over, so a template's members differ from it by
    their own edits, which are rare, and few pairs meet that are no links.
    """
    total, gap = 100 + percent, 100 - percent
    members = ties.select("a", "b", "hub_size", "size", "delta")
    hubs = ties.groupBy("a").agg(F.first("hub_size").alias("hub_size"))
    members = members.union(hubs.select("a", F.col("a").alias("b"), "hub_size", F.col("hub_size").alias("size"), F.array().cast("array<bigint>").alias("delta")))
    members = members.join(named.toDF("b", "c"), "b", "left").withColumn("c", F.coalesce("c", "b"))
    torn = members.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("a", "n")
    torn = checkpoint(torn)
    members = checkpoint(members.join(torn, "a"), torn)

    often = checkpoint(members.select("a", "n", F.explode("delta").alias("e")).groupBy("a", "e").agg(F.count("*").alias("times"), F.first("n").alias("n")).where("times > 1"))
    turned = often.where("2 * times > n").groupBy("a").agg(F.collect_list("e").alias("turned"))
    none = F.array().cast("array<bigint>")
    turned = checkpoint(turned)
    apart = members.join(turned, "a", "left").withColumn("turned", F.coalesce("turned", none))
    apart = apart.withColumn("delta", F.concat(F.array_except("delta", "turned"), F.array_except("turned", "delta")))
    apart = apart.withColumn("weight", F.size("delta").cast("long") * total - F.col("size") * gap)
    apart = checkpoint(apart.select("a", "b", "c", "size", "delta", "weight"), members, turned)

    by_component = apart.groupBy("a", "c").agg(F.min(F.struct("weight", "b", "c")).alias("least"))
    first = by_component.groupBy("a").agg(F.min("least").alias("least"))
    others = by_component.join(first.select("a", F.col("least.c").alias("c1")), "a").where("c <> c1").groupBy("a").agg(F.min("least.weight").alias("next"))
    least = checkpoint(first.join(others, "a"))
    certain = apart.join(least, "a").where("weight + least.weight <= 0 and c <> least.c").select(F.col("least.b").alias("a"), "b")

    elements = apart.select("a", "b", F.explode("delta").alias("e"))
    shared = often.select("a", "e", F.when(F.expr("2 * times > n"), F.col("n") - F.col("times")).otherwise(F.col("times")).alias("times")).where("times > 1")
    ordered = elements.join(shared, ["a", "e"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("times", "e"))).alias("shared"))

    lightest = F.when(F.col("c") == F.col("least.c"), F.col("next")).otherwise(F.col("least.weight"))
    share = F.greatest(F.lit(1), F.ceil((F.col("weight") + lightest) / (2 * total)))
    entered = (
        apart.select("a", "b", "c", "weight").join(least, "a").join(ordered, ["a", "b"])
        .select("a", "b", "c", "weight", F.size("shared").alias("n"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.size("shared") - share + 1).cast("int"))).alias("before", "x"))
        .select("a", F.col("x.e").alias("e"), "b", "c", "weight", (F.col("n") - F.col("before")).alias("left"))
    )
    entered = entered_all = checkpoint(entered)
    by = ["a", "e"]
    live = entered.groupBy(by).agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select(by)
    entered = entered.join(live, by)
    u, v = (entered.select(*by, F.col("b").alias(x), F.col("c").alias(f"c{x}"), F.col("weight").alias(f"w{x}"), F.col("left").alias(f"left_{x}")) for x in "uv")
    met = u.join(v, by).where(f"u < v and cu <> cv and wu + wv > 0 and wu + wv <= {2 * total} * least(left_u, left_v)").select("a", "u", "v")
    met = met.groupBy("u", "v").agg(F.min("a").alias("a"))
    own = apart.select("a", "b", "size", "delta")
    sized = met.join(own.toDF("a", "u", "su", "du"), ["a", "u"]).join(own.toDF("a", "v", "sv", "dv"), ["a", "v"])
    differ = F.size("du") + F.size("dv") - 2 * F.size(F.array_intersect("du", "dv"))
    links = sized.where(_similar(F.col("su"), F.col("sv"), differ, percent)).select(F.col("u").alias("a"), F.col("v").alias("b")).union(certain)
    return checkpoint(links, apart, often, least, entered_all)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of the nodes in ``links`` (``a``, ``b``); a component is named by its smallest node.

    Alternating large-star and small-star steps over edges (high, low) until
    they no longer change; the minimum of a node's neighbours is a map-side
    combined aggregate, so a hub's neighbours never meet in one task.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("low"), F.col("high"))) if large else edges
        both = both.toDF("node", "other")
        lowest = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        tied = both.join(lowest, "node")
        if large:
            moved = tied.where(F.col("other") > F.col("node")).select(F.col("other").alias("high"), F.col("m").alias("low"))
        else:
            moved = tied.select(F.col("other").alias("high"), F.col("m").alias("low")).union(lowest.select(F.col("node"), F.col("m")))
        return moved.where("high <> low").distinct()

    edges = checkpoint(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low").distinct())
    seen = None
    while True:
        print_of = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low")), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if print_of == seen:
            break
        seen = print_of
        edges = checkpoint(star(star(edges, True), False), edges)
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(edges.select("low", "low").distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Documents are linked when ``100 * intersection >= percent * union`` of their
    distinct ``width``-word shingles (words: runs of bytes other than ASCII white
    space, A-Z lowered). ``component_id`` is the smallest id that links reach,
    ``kept`` marks it. Null and empty texts and texts without words have no
    shingles and link with nothing; shorter texts than ``width`` words have one
    shingle. Rows with equal sets are one class with one representative, so a
    copy held a million times is searched once. Repeated ids come back as often
    as they stand in ``docs``; a row without an id links with nothing, has a null
    component and is kept; an empty table gives an empty result.

    An id that stands for different texts stands for each of them: its rows
    keep their own sets and components, named by the smallest id reached. Very
    long texts are hashed whole, chunk by chunk; only sets of candidates are
    shuffled.

    Nothing is capped: two sets at the similarity bound miss each other only if
    their signatures differ in more than ``MAX_DISTANCE`` of ``SYMBOLS`` symbols
    (below 3 in 100,000 at 0.8, and falling fast above it) and no third set links them.
    """
    signed = checkpoint(signatures(docs, width))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["k1", "k2", "n_shingles"]
    reps = checkpoint(full.groupBy(same).agg(F.min(F.struct("doc_id", "symbols")).alias("r")).select(*same, "r.*", F.monotonically_increasing_id().alias("node")))

    stars = _stars(reps)
    needed = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    wanted = checkpoint(reps.join(needed, "node").select("node", "doc_id", "k1", "k2"))
    sets = checkpoint(_full_sets(docs, wanted, width), wanted)
    ties = checkpoint(_ties(stars, sets, percent), stars, sets)
    named = components(ties.where("linked").select("a", "b"))
    more = _links_by_delta(ties, named, percent)
    lifted = more.join(named.toDF("a", "ca"), "a", "left").join(named.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    final = named.toDF("node", "c").join(components(lifted).toDF("c", "c2"), "c", "full").select(F.coalesce("node", "c").alias("node"), F.coalesce("c2", "c").alias("c"))
    found = reps.select(*same, "node", "doc_id").join(final, "node", "left").withColumn("c", F.coalesce("c", "node"))
    least = found.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    linked = full.select("doc_id", *same).join(found.join(least, "c").select(*same, "component_id"), same).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
