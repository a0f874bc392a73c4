"""Prefix trie of conversations by LCP-aware external mergesort.

Spark deals the distinct turn sequences to key ranges. Inside a range, sorted
runs of bounded size carry, for each sequence, how many leading turns it shares
with the one before it (its LCP) and only what follows; Spark's own spilling sort
holds their blocks. A loser tree merges the runs one block each: two sequences
with different LCPs to the last output need no comparison, and with equal ones
compare only past them. The merged stream drives a stack of open nodes; a node
that falls off the stack is finished. Nodes on a range's first or last sequence
may go on in a neighbouring range, so they leave as partial rows that Spark adds
up (at most two sequences a range).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from dataclasses import field as slot

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm._spark import checkpoint

#: Bytes of a turn's digest in a sequence's key.
WIDTH = 16
#: Members of equal sequences travel in blocks of 2**9 consecutive ids.
ID_BLOCK_BITS = 9
RUN_BYTES, BLOCK_ROWS, BLOCK_BYTES = 16 << 20, 256, 1 << 20
#: Finished children that wait for their parent's smallest member; beyond, they are joined to it.
WAITING = 4096

_RUN_FIELDS = [
    ("header", pa.bool_()), ("first", pa.binary()), ("first_id", pa.int64()), ("run", pa.int64()), ("seq", pa.int64()), ("next", pa.binary()), ("next_id", pa.int64()), ("next_lcp", pa.int64()),
    ("lcps", pa.list_(pa.int64())), ("tails", pa.list_(pa.binary())), ("sizes", pa.list_(pa.list_(pa.int64()))), ("counts", pa.list_(pa.int64())), ("smallest", pa.list_(pa.int64())), ("members", pa.list_(pa.string())),
]
RUNS = pa.schema(_RUN_FIELDS)
RUNS_DDL = (
    "header boolean, first binary, first_id long, run long, seq long, next binary, next_id long, next_lcp long, "
    "lcps array<long>, tails array<binary>, sizes array<array<long>>, counts array<long>, smallest array<long>, members array<string>"
)
#: sort ``node``: a finished node; ``asked``: the key of one whose children ask for it; ``edge``: part of a node on a range's first or last sequence.
_NODE_FIELDS = [("sort", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
_NODE_FIELDS += [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
_NODE_FIELDS += [("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("size", pa.int64()), ("first_no", pa.int64()), ("last_no", pa.int64())]
NODES = pa.schema(_NODE_FIELDS)
NODES_DDL = (
    "sort string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, key binary, parent_key binary, size long, first_no long, last_no long"
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, steps``: each conversation's turns in order, as digests and UTF-8 sizes of their texts.

    Turns are ordered by ``turn`` (null first), then role, then text; null roles
    and texts become empty; turns without a conversation are left out. Rows are
    dealt by the conversation's group of five, so nothing is shuffled again for
    rebuilding.
    """
    order = Window.partitionBy("base", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
        .where(F.col("conv_id").isNotNull())
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
        .repartition("base")
        .select("base", "conv_id", F.row_number().over(order).alias("place"), F.md5(whole.cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("size"))
        .groupBy("base", "conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "digest", "size"))).alias("steps"))
    )


def rebuild(sequences: DataFrame) -> DataFrame:
    """``conv_id, steps``: the first h turns of conversation c - c % 5 (all if fewer, none if absent), then c's own after its first h; h = crc32(c) % 9."""
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("steps", 1, 8))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    none = F.slice("steps", 1, 0)
    return sequences.withColumn("head", F.coalesce(head, none)).select("conv_id", F.concat(F.slice("head", 1, h), F.slice("steps", h + 1, F.size("steps"))).alias("steps"))


def distinct_paths(sequences: DataFrame) -> DataFrame:
    """``path, block, sizes, n, smallest, members``: equal sequences with their members' ids, in blocks of bounded size."""
    path = F.unhex(F.array_join("steps.digest", ""))
    return (
        sequences.select("conv_id", path.alias("path"), F.col("steps.size").alias("sizes"), F.shiftright("conv_id", ID_BLOCK_BITS).alias("block"))
        .groupBy("path", "block")
        .agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("smallest"), F.array_sort(F.collect_list("conv_id")).alias("ids"))
        .withColumn("members", F.array_join(F.col("ids").cast("array<string>"), ","))
        .drop("ids")
    )


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Leading turns that two keys share, the first ``known`` of which are not looked at."""
    at, end = known * WIDTH, min(len(a), len(b))
    while at < end and a[at : at + WIDTH] == b[at : at + WIDTH]:
        at += WIDTH
    return at // WIDTH


@dataclass(slots=True)
class Row:
    """A sequence in the merge; ``lcp`` is to the last output. Without sizes it only announces its run's next block."""

    path: bytes
    smallest: int
    lcp: int
    run: int
    sizes: list[int] | None = None
    n: int = 0
    members: str = ""


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of bounded size, front-coded in blocks, after a header that announces each."""
    held: list[tuple] = []
    size = number = 0
    for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
        columns = [batch.column(c).to_pylist() for c in ("path", "smallest", "n", "sizes", "members")]
        for row in zip(*columns, strict=True):
            held.append(row)
            size += len(row[0]) + 8 * len(row[3]) + len(row[4])
            if size >= RUN_BYTES:
                yield from _blocks(held, number)
                held, size, number = [], 0, number + 1
    if held:
        yield from _blocks(held, number)


def _blocks(rows: list[tuple], run: int) -> Iterator[pa.RecordBatch]:
    rows.sort(key=lambda r: r[:2])
    lcps = [0] + [shared(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)]
    cuts, size = [0], 0
    for i, row in enumerate(rows):
        if i - cuts[-1] >= BLOCK_ROWS or size >= BLOCK_BYTES:
            cuts.append(i)
            size = 0
        size += len(row[0]) + len(row[4])
    header = {"header": True, "first": rows[0][0], "first_id": rows[0][1], "run": run, "seq": -1}
    yield pa.RecordBatch.from_pylist([header], RUNS)
    for seq, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(rows)], strict=True)):
        known = [0] + lcps[a + 1 : b]
        block = {"header": False, "first": rows[a][0], "first_id": rows[a][1], "run": run, "seq": seq, "lcps": known}
        block |= {"tails": [r[0][k * WIDTH :] for r, k in zip(rows[a:b], known, strict=True)], "sizes": [r[3][k:] for r, k in zip(rows[a:b], known, strict=True)]}
        block |= {"counts": [r[2] for r in rows[a:b]], "smallest": [r[1] for r in rows[a:b]], "members": [r[4] for r in rows[a:b]]}
        if b < len(rows):
            block |= {"next": rows[b][0], "next_id": rows[b][1], "next_lcp": lcps[b]}
        yield pa.RecordBatch.from_pylist([block], RUNS)


def _block_rows(block: dict, first_lcp: int) -> Iterator[Row]:
    """A block's rows, and at its end the announcement of the next; each lcp is to the row before."""
    path, sizes = b"", []
    for i, (known, tail, more) in enumerate(zip(block["lcps"], block["tails"], block["sizes"], strict=True)):
        path, sizes = path[: known * WIDTH] + tail, sizes[:known] + more
        yield Row(path, block["smallest"][i], known if i else first_lcp, block["run"], sizes, block["counts"][i], block["members"][i])
    if block["next"] is not None:
        yield Row(block["next"], block["next_id"], block["next_lcp"], block["run"])


def play(a: Row | None, b: Row | None) -> tuple[Row | None, Row | None]:
    """Winner and loser; the loser's lcp becomes the one to the winner. None (a spent run) loses."""
    if a is None or b is None:
        return (b, a) if a is None else (a, b)
    if a.lcp != b.lcp:
        return (a, b) if a.lcp > b.lcp else (b, a)
    common = shared(a.path, b.path, a.lcp)
    winner, loser = (a, b) if (a.path[common * WIDTH :][:WIDTH], a.smallest) < (b.path[common * WIDTH :][:WIDTH], b.smallest) else (b, a)
    loser.lcp = common
    return winner, loser


class LoserTree:
    """The least row of several runs; a run's next row is played only against the losers on its way up."""

    def __init__(self, rows: list[Row]) -> None:
        self.width = 1
        while self.width < len(rows):
            self.width *= 2
        winners: list[Row | None] = [None] * self.width + rows + [None] * (self.width - len(rows))
        self.losers: list[Row | None] = [None] * self.width
        for i in range(self.width - 1, 0, -1):
            winners[i], self.losers[i] = play(winners[2 * i], winners[2 * i + 1])
        self.least = winners[1]

    def replace(self, row: Row | None, run: int) -> None:
        """Put the next row of the winning run in its place."""
        at = (self.width + run) // 2
        while at:
            row, self.losers[at] = play(row, self.losers[at])
            at //= 2
        self.least = row


def merged(blocks: Iterator[dict]) -> Iterator[Row]:
    """All runs' rows in order; one block a run is in memory.

    Blocks come in the order of their first rows, so the block that the winning
    announcement waits for is always the next one.
    """
    heads: list[Row] = []
    block = next(blocks, None)
    while block is not None and block["header"]:
        heads.append(Row(block["first"], block["first_id"], 0, block["run"]))
        block = next(blocks, None)
    heads.sort(key=lambda r: r.run)
    tree, open_blocks = LoserTree(heads), {}
    while (row := tree.least) is not None:
        if row.sizes is None:
            open_blocks[row.run] = _block_rows(block, row.lcp)
            row = tree.least = next(open_blocks[row.run])
            block = next(blocks, None)
        run = row.run
        yield row
        following = next(open_blocks[run], None)
        if following is None:
            del open_blocks[run]
        tree.replace(following, run)


@dataclass(slots=True)
class Node:
    """An open node: what its finished children left, and its own members."""

    depth: int
    size: int
    hasher: object
    on_first: bool
    conv_id: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: object = None
    asked: bool = False
    waiting: list[dict] = slot(default_factory=list)

    @property
    def key(self) -> bytes:
        return self.hasher.digest()

    def add(self, n: int, smallest: int) -> None:
        self.n += n
        self.conv_id = smallest if self.conv_id is None else min(self.conv_id, smallest)

    def end(self, members: str) -> None:
        if self.ends is None:
            self.ends = hashlib.sha256()
        else:
            self.ends.update(b",")
        self.ends.update(members.encode())


class OpenPath:
    """The stack of open nodes from the root down; finished nodes go to ``emit``."""

    def __init__(self, part: int, emit: Callable[[dict], None]) -> None:
        self.part, self.emit, self.stack = part, emit, []

    def take(self, row: Row) -> None:
        first = not self.stack
        if first:
            self.stack.append(Node(0, 0, hashlib.md5(usedforsecurity=False), True))
        while len(self.stack) - 1 > row.lcp:
            self.finish(False)
        for depth in range(len(self.stack), len(row.path) // WIDTH + 1):
            hasher = self.stack[-1].hasher.copy()
            hasher.update(row.path[(depth - 1) * WIDTH : depth * WIDTH])
            self.stack.append(Node(depth, row.sizes[depth - 1], hasher, first))
        self.stack[-1].add(row.n, row.smallest)
        self.stack[-1].end(row.members)

    def finish(self, at_end: bool) -> None:
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        if parent is not None:
            parent.add(node.n, node.conv_id)
        edge = node.on_first or at_end
        row = {"sort": "edge" if edge else "node", "conv_id": node.conv_id, "depth": node.depth, "n_convs": node.n, "n_children": node.children}
        row["ends_sha256"] = node.ends.hexdigest() if node.ends else None if edge else _NO_ENDS
        if edge:
            row |= {"key": node.key, "parent_key": parent.key if parent else None, "size": node.size, "n_leaves": node.leaves, "saved_tokens": node.saved}
            row |= {"first_no": 2 * self.part + (not node.on_first), "last_no": 2 * self.part + at_end}
            self.release(node, None)
            self.emit(row)
        else:
            row |= {"n_leaves": node.leaves or 1, "saved_tokens": node.saved + (node.n - 1) * node.size}
            if node.asked:
                self.emit({"sort": "asked", "conv_id": node.conv_id, "key": node.key})
            self.release(node, node.conv_id)
            parent.waiting.append(row)
            parent.children += 1
            if len(parent.waiting) >= WAITING:
                parent.asked = True
                self.release(parent, None)
        if parent is not None:
            parent.leaves += row["n_leaves"]
            parent.saved += row["saved_tokens"]

    def release(self, node: Node, parent_conv_id: int | None) -> None:
        """Emit the children that wait for ``node``, with its smallest member or else its key."""
        known = {"parent_conv_id": parent_conv_id} if parent_conv_id is not None else {"parent_key": node.key}
        for row in node.waiting:
            self.emit(row | known)
        node.waiting = []


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished nodes and edge parts of one key range."""
    out: list[dict] = []
    path = OpenPath(TaskContext.get().partitionId(), out.append)
    for row in merged(row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
        path.take(row)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, NODES)
            out.clear()
    while path.stack:
        path.finish(True)
    if out:
        yield pa.RecordBatch.from_pylist(out, NODES)


def _edges(parts: DataFrame) -> DataFrame:
    """Edge nodes added up over their ranges.

    Edge sequences in order, each with the nodes that it is the first to hold,
    list the edge nodes in preorder; so what the edge nodes below a node add is
    a difference of running sums (over one sequence, and over two rows a range).
    """
    sums = {"n_convs": F.sum, "n_children": F.sum, "n_leaves": F.sum, "saved_tokens": F.sum, "conv_id": F.min, "first_no": F.min, "last_no": F.max, "size": F.max, "parent_key": F.max, "ends_sha256": F.max}
    nodes = checkpoint(parts.groupBy("key", "depth").agg(*(f(c).alias(c) for c, f in sums.items())))
    below = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("below"))
    own = nodes.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("below", F.lit(0)))
    own = own.withColumn("own", F.struct((F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")))
    along = Window.partitionBy("first_no").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    own = checkpoint(own.select("*", *(F.coalesce(F.sum(f"own.{c}").over(along), F.lit(0)).alias(f"{c}_above") for c in ("leaves", "saved"))))
    each = own.select(F.col("first_no").alias("no"), "own.leaves", "own.saved").union(own.select("last_no", F.lit(0), F.lit(0))).groupBy("no").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    upto = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = each.select("no", *(F.sum(c).over(upto).alias(f"{c}_upto") for c in ("leaves", "saved")), "leaves", "saved")
    begun = running.select(F.col("no").alias("first_no"), *((F.col(f"{c}_upto") - F.col(c)).alias(f"{c}_before") for c in ("leaves", "saved")))
    ended = running.select(F.col("no").alias("last_no"), "leaves_upto", "saved_upto")
    added = own.join(begun, "first_no").join(ended, "last_no")
    total = lambda c, held: (F.col(held) + F.col(f"{c}_upto") - F.col(f"{c}_before") - F.col(f"{c}_above")).alias(held)
    return checkpoint(
        added.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", total("leaves", "n_leaves"), total("saved", "saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256")),
        nodes, own,
    )


def trie_of(sequences: DataFrame) -> DataFrame:
    """The trie's nodes, one row each: smallest member, depth, parent, members, children, leaves, what sharing saves, and a digest of the members that end there.

    ``sequences`` has ``conv_id`` and ``steps`` (place, digest, size). Equal
    sequences are one row a block of ids before they are sorted, and a turn that
    a third of all conversations begin with is dealt by what follows it.
    """
    paths = checkpoint(distinct_paths(sequences))
    blocks = paths.drop("block").repartitionByRange("path").mapInArrow(_runs, RUNS_DDL)
    ordered = blocks.sortWithinPartitions(F.desc("header"), "first", "first_id")
    parts = checkpoint(ordered.mapInArrow(_nodes, NODES_DDL), paths)
    edges = _edges(parts.where("sort = 'edge'"))
    named = edges.select("key", "conv_id").union(parts.where("sort = 'asked'").select("key", "conv_id"))
    parents = named.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found_id"))
    inner = parts.where("sort = 'node'")
    known = inner.where("parent_key is null").select(RESULT)
    asking = inner.where("parent_key is not null").drop("parent_conv_id").select("parent_key", *(c for c in RESULT if c != "parent_conv_id"))
    asking = asking.union(edges.select(asking.columns))
    return known.union(asking.join(parents, "parent_key", "left").withColumnRenamed("found_id", "parent_conv_id").select(RESULT))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Trie of the rebuilt conversations of ``turns``.

    Repeated rows are turns of their own; conversations without turns after
    rebuilding end at the root; texts of any length count by their digest and
    size; other columns are ignored; an empty table gives an empty result.
    """
    return trie_of(rebuild(turn_sequences(turns)))
