"""Prefix trie of conversations: one row per distinct beginning, with its members and what sharing it saves.

A turn is named by 128 bits of SHA-256 over role and text, a conversation by the path of its turns' names.  Conversations
are dealt to shards by ranges of (path, conv_id); the splitters between shards are quantiles of a bounded sample, cut to
the shortest beginning that still separates them.  A node whose members lie in several shards is a beginning of a
splitter between them.  The trie of all splitter paths, the skeleton, is broadcast (at most shards times the turns of a
splitter nodes).  A task walks its sorted shard once and finishes every node outside the skeleton; for skeleton nodes it
gives partial aggregates, which are summed over shards and folded from the leaves to the root.  A path that most
conversations share is split among shards by conv_id.

The conv_ids that end at a skeleton node come from its shards as ordered chunks and are hashed in that order.

Defined results: turns are ordered by number, null first, those of equal number by their names, so the order of repeated
rows makes no difference; null roles and texts are empty; rows without conv_id take no part; an empty table has no nodes,
not even a root; other columns are ignored.  A conversation's turns (20 bytes each) lie in one row.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.llm import common

WIDTH = 16                  # bytes that name a turn
SHARD_ROWS = 100_000        # conversations of a shard, about
LEAST_ROWS = 64             # and at least, where the table is small
SAMPLE = 32                 # sampled conversations per shard
CHUNK = 50_000              # conv_ids of a chunk
_SMALLEST = -2**63
_COLUMNS = {
    "kind": pa.int32(), "node": pa.int32(), "parent": pa.int32(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "words": pa.int64(),
    "shard": pa.int32(), "part": pa.int64(), "ends": pa.string(),
}
_SCHEMA = ", ".join(f"{k} {'string' if v == pa.string() else 'int' if v == pa.int32() else 'long'}" for k, v in _COLUMNS.items())
_NODE, _PARTIAL, _ENDS = 0, 1, 2


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, an array of (name, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))
    named = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct("turn", name.alias("name"), words.alias("words")).alias("t"))
    return named.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["name"], t["words"])).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with the first crc32(c) % ``most`` turns of conversation c - c % ``every`` in place of its own."""
    own = common.staged(turns(conversations), "turns")
    lead = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    return own.withColumn("h", h).join(lead, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("lead", F.array().cast("array<struct<name:binary,words:int>>")), F.lit(1), F.col("h")),
                            F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def packed(conversations: DataFrame) -> DataFrame:
    """conv_id, path (names one after another) and words of its turns."""
    def pack(batches):
        for batch in batches:
            names = batch.column("names").combine_chunks() if isinstance(batch.column("names"), pa.ChunkedArray) else batch.column("names")
            at = np.array(names.offsets)
            flat = b"".join(names.flatten().to_pylist())
            at = (at - at[0]) * WIDTH
            path = pa.array([flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), path, batch.column("words")], ["conv_id", "path", "words"])

    return conversations.select("conv_id", F.col("turns.name").alias("names"), F.col("turns.words").alias("words")) \
        .mapInArrow(pack, "conv_id long, path binary, words array<int>")


def shortened(splitters: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """Each splitter cut to the shortest beginning that is still beyond the one before it."""
    out, before = [], None
    for path, conv in splitters:
        common_turns = 0
        if before is not None:
            least = min(len(before), len(path)) // WIDTH
            while common_turns < least and before[common_turns * WIDTH: (common_turns + 1) * WIDTH] == path[common_turns * WIDTH: (common_turns + 1) * WIDTH]:
                common_turns += 1
        cut = path[: (common_turns + 1) * WIDTH]
        out.append((path, conv) if len(cut) == len(path) else (cut, _SMALLEST))
        before = path
    return out


class Skeleton:
    """Trie of the splitters' paths; node 0 is the root and parents come before their children."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.depth = [-1], [0]
        for path, _ in splitters:
            at = 0
            for k in range(0, len(path), WIDTH):
                name = path[k: k + WIDTH]
                if name not in self.children[at]:
                    self.children[at][name] = len(self.parent)
                    self.children.append({})
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.children[at][name]

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))


class _Node:
    __slots__ = ("name", "skeleton", "depth", "words", "conv", "n", "children", "leaves", "saved", "ends", "part", "waiting")

    def __init__(self, name: bytes, skeleton: int, depth: int, words: int):
        self.name, self.skeleton, self.depth, self.words = name, skeleton, depth, words
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.part, self.waiting = None, 0, 0, 0, 0, [], 0, []


class Walk:
    """Walks sorted shards; ``rows`` collects finished nodes, partial aggregates and chunks of ends."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton, self.rows, self.stack, self.shard = skeleton, [], [], None

    def _chunk(self, node: _Node) -> None:
        self.rows.append((_ENDS, node.skeleton, None, None, None, None, None, None, None, None, None, self.shard, node.part, ",".join(map(str, node.ends))))
        node.part += 1
        node.ends = []

    def _close(self) -> None:
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        if above:
            above.n += node.n
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
        if node.skeleton >= 0:
            if node.ends:
                self._chunk(node)
            self.rows.append((_PARTIAL, node.skeleton, None, node.conv, None, None, node.n, node.children, node.leaves, node.saved, node.words, None, None, None))
            return
        if not node.children:
            node.leaves = 1
        node.saved += (node.n - 1) * node.words
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        mine = (node.conv, node.depth, node.n, node.children, node.leaves, node.saved, ends)
        if above.skeleton >= 0:
            self._emit(mine, above.skeleton, None)
        else:
            above.waiting.append(mine)
        for child in node.waiting:
            self._emit(child, None, node.conv)

    def _emit(self, node: tuple, parent: int | None, parent_conv: int | None) -> None:
        conv, depth, n, children, leaves, saved, ends = node
        self.rows.append((_NODE, None, parent, conv, depth, parent_conv, n, children, leaves, saved, None, None, None, ends))

    def finish(self) -> None:
        while self.stack:
            self._close()

    def add(self, shard: int, path: bytes, conv: int, words: list[int]) -> None:
        if shard != self.shard:
            self.finish()
            self.shard, self.stack = shard, [_Node(b"", 0, 0, 0)]
        stack, turns_ = self.stack, len(path) // WIDTH
        same = 0
        while same < turns_ and same + 1 < len(stack) and stack[same + 1].name == path[same * WIDTH: (same + 1) * WIDTH]:
            same += 1
        while len(stack) > same + 1:
            self._close()
        for k in range(same, turns_):
            name, above = path[k * WIDTH: (k + 1) * WIDTH], stack[-1].skeleton
            stack.append(_Node(name, self.skeleton.children[above].get(name, -1) if above >= 0 else -1, k + 1, words[k]))
        top = stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.ends.append(conv)
        if top.skeleton >= 0 and len(top.ends) >= CHUNK:
            self._chunk(top)

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_COLUMNS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COLUMNS.values())], list(_COLUMNS))


def _splitters(paths: DataFrame, shards: int, n: int) -> list[tuple[bytes, int]]:
    """Quantiles of a sample of about ``SAMPLE`` rows per shard; only the chosen rows reach the driver."""
    if shards < 2:
        return []
    share = min(1.0, shards * SAMPLE / n)
    sample = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("path", "conv_id")
    ranked = sample.selectExpr("path", "conv_id", f"ntile({shards}) over (order by path, conv_id) as tile")
    rows = ranked.groupBy("tile").agg(F.min(F.struct("path", "conv_id")).alias("first")).where("tile > 1").select("first.*").collect()
    return sorted((bytes(r.path), r.conv_id) for r in rows)


def _hashed(chunks: DataFrame) -> DataFrame:
    """node, ends_sha256 of ordered chunks, one chunk in memory at a time."""
    def digest(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for n, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if n != node:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string())], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    return chunks.repartition("node").sortWithinPartitions("node", "shard", "part").select("node", "ends").mapInArrow(digest, "node int, ends_sha256 string")


def _folded(skeleton: Skeleton, partials: DataFrame) -> list[tuple]:
    """Rows of the skeleton's nodes: sums over shards, then from the leaves to the root (no larger than the broadcast trie)."""
    summed = {r.node: r for r in partials.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("words").alias("words")).collect()}
    children, leaves, saved = ([0] * len(skeleton.parent) for _ in range(3))
    out = []
    for node in range(len(skeleton.parent) - 1, -1, -1):
        r = summed[node]
        children[node] += r.children
        leaves[node] = leaves[node] + r.leaves or 1
        saved[node] += r.saved + (r.n - 1) * r.words
        above = skeleton.parent[node]
        if above >= 0:
            children[above] += 1
            leaves[above] += leaves[node]
            saved[above] += saved[node]
        out.append((node, r.conv_id, skeleton.depth[node], summed[above].conv_id if above >= 0 else None, r.n, children[node], leaves[node], saved[node]))
    return out


def nodes(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turns as ``rebuilt`` gives them).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = conversations.sparkSession
    common.ship(spark)
    paths = common.staged(packed(conversations), "paths")
    n = paths.count()
    columns = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    if not n:
        return spark.createDataFrame([], columns + ", ends_sha256 string")
    shards = shards or max(math.ceil(n / SHARD_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST_ROWS), 1)
    skeleton = Skeleton(shortened(_splitters(paths, shards, n)))
    shared = spark.sparkContext.broadcast(skeleton)

    def deal(batches):
        for batch in batches:
            place = shared.value.shard
            at = [place(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "shard"])

    def walk(batches):
        walker = Walk(shared.value)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "words"))):
                walker.add(*row)
            yield walker.taken()
        walker.finish()
        yield walker.taken()

    dealt = paths.mapInArrow(deal, "conv_id long, path binary, words array<int>, shard int")
    found = common.staged(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(walk, _SCHEMA), "nodes")
    top = spark.createDataFrame(_folded(skeleton, found.where(f"kind = {_PARTIAL}")), "node int, " + columns)
    ends = _hashed(found.where(f"kind = {_ENDS}"))
    names = [c.split()[0] for c in columns.split(", ")]
    tops = top.join(ends, "node", "left").select(*names, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    above = top.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    local = found.where(f"kind = {_NODE}").join(F.broadcast(above), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return local.select(*names, F.col("ends").alias("ends_sha256")).unionByName(tops)
