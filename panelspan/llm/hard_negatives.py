"""Hard negatives by zone maps over blocks of candidates in the order of a Hilbert curve.

Vectors become integers, and all rows of one label and length are sorted along a Hilbert curve through their components
and cut into blocks of at most ``BLOCK`` rows, written as Parquet with the least and greatest value of every component:
the zone map.  For an anchor ``a`` the scores of a block lie between the sums of ``min(a*low, a*high)`` and of
``max(a*low, a*high)``.  A block is read for an anchor only if these bounds can change its result:

* positives: blocks of its label whose upper bound reaches the fifth best score within the anchor's own block;
* negatives: first the ``SEEDS`` blocks (per group of zones) with the highest upper bounds among blocks of other labels
  whose bounds meet one of the anchor's windows, then every other such block, with each window's lower end raised to
  the third best score found so far.

Blocks that no anchor needs are not read, all others in full, so results are exact.  Anchors are cut into chunks along
the same order.  A unit of work is one chunk with one block (or one group of zone maps): bounded, whatever shares a label.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; rows without
vec_id are no anchors and come last among equal scores; "other rows" are other rows, also with an equal vec_id; vectors of
different lengths have no score; empty vectors score 0.  Products are exact; scores beyond the range of a long are cut to
its ends, as are scaled components.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspan.llm import common
from panelspan.operators.ranking import Ranked

BLOCK = 1024
CHUNK = 1024                # anchors of a chunk
ZONES = 1024                # zone maps of a group
SEEDS = 2
POSITIVES, NEGATIVES = 5, 3
BITS = 2                    # of each component in the curve's key
KEY = 32                    # bytes of the key
_FAR = np.iinfo(np.int64).max
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys (rows of bytes) along the Hilbert curve of points with coordinates below ``2**bits``.

    Skilling's transform: undo the turns of each level, Gray-code, and read the bits of all coordinates by level.
    """
    x = cells.astype(np.int64).T.copy()
    size = len(x)
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        below = level - 1
        for i in range(size):
            turned = (x[i] & level) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, size):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    level = top
    while level > 1:
        flip ^= np.where(x[size - 1] & level, level - 1, 0)
        level >>= 1
    x ^= flip
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, cut to the range of a long."""
    top = int(np.abs(a.astype(float)).max(initial=0)) * int(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1)
    if top < 2**52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if top < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -_FAR, _FAR).astype(np.int64).reshape(len(a), len(b))


def best(scores: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``count`` highest allowed scores; of equal ones the lower columns, best first."""
    key = np.where(allowed, -scores, _FAR)
    count = min(count, key.shape[1])
    if np.abs(key[allowed]).max(initial=0) < 2**50:                # scores and columns fit one number
        key = np.where(allowed, key * 2048 + np.arange(key.shape[1]), _FAR)
        column = np.sort(np.partition(key, count - 1, axis=1)[:, :count], axis=1) & 2047 if count else np.empty((len(key), 0), np.int64)
    else:
        column = np.argsort(key, axis=1, kind="stable")[:, :count]
    row = np.repeat(np.arange(len(key)), column.shape[1])
    column = column.ravel()
    keep = allowed[row, np.minimum(column, key.shape[1] - 1)] if len(column) else np.empty(0, bool)
    keep &= np.repeat(allowed.sum(axis=1), count) > np.tile(np.arange(count), len(key)) if len(column) else keep
    return row[keep], column[keep]


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible product of each anchor with a vector between ``low`` and ``high``."""
    split = np.concatenate([np.maximum(anchors, 0), np.minimum(anchors, 0)], axis=1)
    return products(split, np.concatenate([low, high], axis=1)), products(split, np.concatenate([high, low], axis=1))


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(lists.flatten(), dtype=np.int64).reshape(len(lists), -1 if len(lists.flatten()) else 0)


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and where they are null."""
    missing = np.array(column.is_null())
    return np.array(column.fill_null(0), dtype=np.int64), missing


def _lists(rows: list, kind) -> pa.Array:
    return pa.array([None if r is None else list(map(int, r)) for r in rows], pa.list_(kind))


def _groups(batches, keys: list[str], rows: int):
    """Whole groups, one table each, from sorted batches."""
    for table in common.whole_groups(batches, keys, rows):
        table = table.combine_chunks()
        fresh = np.zeros(table.num_rows, bool)
        fresh[:1] = True
        for key in keys:
            fresh[1:] |= np.diff(np.array(table.column(key))) != 0
        ends = np.append(np.flatnonzero(fresh), table.num_rows)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield table.slice(a, b - a)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and integer vector of the rows that take part."""
    label = F.col("label").cast("int")
    return vectors.where("label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))").select(
        F.col("vec_id").cast("long"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).cast("int").alias("label"),
        F.expr("transform(embedding, x -> floor(256 * cast(x as double)))").alias("v")).withColumn("size", F.size("v"))


def blocks(points: DataFrame, every: int = 50) -> DataFrame:
    """Candidate blocks: block, at (row within it), size, label, vec_id, v; low and high on each first row; near_id and
    near_score, the best other rows of the block, on anchors."""
    row = points.select(F.count("*"), F.sum(F.expr("aggregate(v, 0D, (s, x) -> s + x)")), F.sum(F.expr("aggregate(v, 0D, (s, x) -> s + double(x) * x)")), F.sum("size")).first()
    n, parts = row[0], max(1, row[3] or 0)
    mean = (row[1] or 0) / parts
    spread = math.sqrt(max((row[2] or 0) / parts - mean * mean, 0)) or 1.0

    def keyed(batches):
        for batch in batches:
            size = np.array(batch.column("size"))
            keys = np.empty(len(size), dtype=object)
            for d in np.unique(size):
                mine = np.flatnonzero(size == d)
                if d == 0:
                    keys[mine] = b""
                    continue
                vectors = _matrix(batch.column("v").take(pa.array(mine)))
                cells = np.clip(np.floor((vectors - mean) / spread) + (1 << BITS) // 2, 0, (1 << BITS) - 1)
                keys[mine] = [k.tobytes()[:KEY] for k in hilbert(cells, BITS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "key"])

    order = ["size", "label", "key", "vec_id"]
    sorted_ = points.mapInArrow(keyed, "vec_id long, label int, v array<long>, size int, key binary") \
        .repartitionByRange(max(1, math.ceil(n / (4 * BLOCK))), *order).sortWithinPartitions(*order).drop("key")

    def cut(batches):
        number = TaskContext.get().partitionId() << 24
        for group in _groups(batches, ["size", "label"], 4 * BLOCK):
            for a in range(0, group.num_rows, BLOCK):
                table = group.slice(a, BLOCK)
                table = table.take(pc.sort_indices(table, [("vec_id", "ascending")]))      # nulls last: ties go by column
                v = _matrix(table.column("v"))
                ids, missing = _ids(table.column("vec_id"))
                anchors = np.flatnonzero(~missing & (ids % every == 0))
                near_id, near_score = [None] * len(v), [None] * len(v)
                if len(anchors):
                    scores = products(v[anchors], v)
                    r, c = best(scores, np.arange(len(v)) != anchors[:, None], POSITIVES)
                    at = np.searchsorted(r, np.arange(len(anchors) + 1))
                    for k, anchor in enumerate(anchors):
                        mine = c[at[k]: at[k + 1]]
                        near_id[anchor] = [None if missing[m] else int(ids[m]) for m in mine]
                        near_score[anchor] = scores[k, mine].tolist()
                rest = [None] * (len(v) - 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(v), number)), pa.array(np.arange(len(v), dtype=np.int32)), *(table.column(c).combine_chunks() for c in ("size", "label", "vec_id", "v")),
                    _lists([v.min(axis=0), *rest], pa.int64()), _lists([v.max(axis=0), *rest], pa.int64()),
                    pa.array(near_id, pa.list_(pa.int64())), pa.array(near_score, pa.list_(pa.int64()))],
                    ["block", "at", "size", "label", "vec_id", "v", "low", "high", "near_id", "near_score"])
                number += 1

    return sorted_.mapInArrow(cut, "block long, at int, size int, label int, vec_id long, v array<long>, low array<long>, high array<long>, near_id array<long>, near_score array<long>")


def _chunked(anchors: DataFrame) -> DataFrame:
    """Adds ``chunk``: anchors in the blocks' order, at most ``CHUNK`` of one vector length each, however they are partitioned."""
    number = F.floor((F.col("place") - 1) / CHUNK)
    return Ranked(anchors, "aid").with_rank("place").withColumn("chunk", F.shiftleft(F.col("size").cast("long"), 40) + number).drop("place")


def _needed(anchors: DataFrame, zones: DataFrame, chosen) -> DataFrame:
    """chunk, block, who: the anchors (aid) that must read a block, as ``chosen`` decides from bounds.

    ``anchors`` has aid, chunk, size, label, v and w, an array of longs that ``chosen`` understands.
    """
    units = anchors.select("chunk", "size").distinct().join(zones.select("part", "size").distinct(), "size").select("chunk", "part")
    left = anchors.join(units, "chunk").select("chunk", "part", F.lit(0).alias("kind"), F.col("aid").alias("id"), "label", "v", "w")
    right = zones.join(units, "part").select("chunk", "part", F.lit(1).alias("kind"), F.col("block").alias("id"), "label", F.col("low").alias("v"), F.col("high").alias("w"))

    def decide(batches):
        for group in _groups(batches, ["chunk", "part"], 2 * CHUNK):
            kind = np.array(group.column("kind"))
            cut = int(np.searchsorted(kind, 1))
            if cut in (0, len(kind)):
                continue
            a, z = group.slice(0, cut), group.slice(cut)
            least, most = bounds(_matrix(a.column("v")), _matrix(z.column("v")), _matrix(z.column("w")))
            ids = np.array(a.column("id")), np.array(z.column("id"))
            same = np.array(a.column("label"))[:, None] == np.array(z.column("label"))
            mask = chosen(least, most, same, *ids, a.column("w").to_pylist())
            some = np.flatnonzero(mask.any(axis=0))
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), group.column("chunk")[0].as_py())), pa.array(ids[1][some]), _lists([ids[0][mask[:, k]] for k in some], pa.int64())],
                    ["chunk", "block", "who"])

    united = left.unionByName(right).repartition("chunk", "part").sortWithinPartitions("chunk", "part", "kind")
    return common.staged(united.mapInArrow(decide, "chunk long, block long, who array<long>"), "needed")


def _scored(anchors: DataFrame, candidates: DataFrame, need: DataFrame, windows: bool) -> DataFrame:
    """aid, j, vec_id, score: the best rows of every needed block, per anchor, or per window j of ``w`` (lows, then highs)."""
    who = need.select("chunk", "block", F.explode("who").alias("aid"))
    left = who.join(anchors.select("aid", "v", "w"), "aid").select("chunk", "block", F.lit(0).alias("kind"), F.col("aid").alias("id"), "v", "w")
    right = candidates.join(need.select("chunk", "block"), "block").select("chunk", "block", F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("array<long>").alias("w"))

    def score(batches):
        for group in _groups(batches, ["chunk", "block"], 2 * CHUNK):
            cut = int(np.searchsorted(np.array(group.column("kind")), 1))
            if cut in (0, group.num_rows):
                continue
            a, c = group.slice(0, cut), group.slice(cut)
            c = c.take(pc.sort_indices(c, [("id", "ascending")]))                          # nulls last
            aid = np.array(a.column("id"))
            ids = c.column("id").combine_chunks()
            scores = products(_matrix(a.column("v")), _matrix(c.column("v")))
            ends = a.column("w").to_pylist()
            for j in range(max(len(w) // 2 for w in ends) if windows else 1):
                allowed = np.ones(scores.shape, bool)
                if windows:
                    low = np.array([w[j] if j < len(w) // 2 else 1 for w in ends])[:, None]
                    high = np.array([w[len(w) // 2 + j] if j < len(w) // 2 else 0 for w in ends])[:, None]
                    allowed = (scores >= low) & (scores <= high)
                r, k = best(scores, allowed, NEGATIVES if windows else POSITIVES)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(aid[r]), pa.array(np.full(len(r), j, np.int32)), ids.take(pa.array(k)), pa.array(scores[r, k])], ["aid", "j", "vec_id", "score"])

    united = left.unionByName(right).repartition("chunk", "block").sortWithinPartitions("chunk", "block", "kind")
    return united.mapInArrow(score, "aid long, j int, vec_id long, score long")


def _first(found: DataFrame, count: int, *key: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _meets(least, most, same, w):
    """Where an anchor's bounds meet one of its windows; ``w`` holds the windows' lows and highs."""
    out = np.zeros(same.shape, bool)
    for j in range(POSITIVES):
        low = np.array([x[j] if j < len(x) // 2 else 1 for x in w])[:, None]
        high = np.array([x[len(x) // 2 + j] if j < len(x) // 2 else 0 for x in w])[:, None]
        out |= (most >= low) & (least <= high) & (low <= high)
    return out & ~same


def mine(vectors: DataFrame, every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    spark = vectors.sparkSession
    common.ship(spark)
    points = common.staged(usable(vectors), "points")
    candidates = common.staged(blocks(points, every), "blocks")
    zones = candidates.where("at = 0").select("block", "size", "label", "low", "high")
    n_zones = zones.count()
    anchors = candidates.where(f"vec_id % {every} = 0").withColumn("aid", F.col("block") * 2048 + F.col("at")) \
        .select("aid", "size", "label", "vec_id", "v", "near_id", "near_score")
    if not anchors.limit(1).count():
        return spark.createDataFrame([], _OUT)
    parts = math.ceil(n_zones / ZONES)
    zones = zones.withColumn("part", F.col("size").cast("long") * parts + F.pmod(F.xxhash64("block"), F.lit(parts)))    # of one length each
    anchors = common.staged(_chunked(anchors), "anchors")

    def positives(least, most, same, aid, block, near):
        floor = np.array([x[-1] if len(x) == POSITIVES else -_FAR for x in near])
        return same & (aid[:, None] // 2048 != block) & (most >= floor[:, None])

    seeking = anchors.withColumn("w", F.col("near_score"))
    own = anchors.select("aid", F.inline(F.arrays_zip(F.col("near_id").alias("vec_id"), F.col("near_score").alias("score"))))
    more = _scored(seeking, candidates, _needed(seeking, zones, positives), False)
    positive = common.staged(_first(own.unionByName(more.drop("j")), POSITIVES, "aid"), "positives")
    # 50 p <= 100 s <= 95 p in whole numbers; nothing lies between for negative p
    window = positive.select(
        "aid", (F.col("rank") - 1).alias("j"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr("if(score < 0, 1L, score div 2 + score % 2)").alias("low"), F.expr("if(score < 0, 0L, score - score div 20 - if(score % 20 > 0, 1, 0))").alias("high"))

    def with_windows(w: DataFrame) -> DataFrame:
        ends = w.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("j", "low", "high", "start"))).alias("e"))
        return anchors.join(ends, "aid").withColumn("start", F.concat("e.start", "e.high")).withColumn("w", F.concat("e.low", "e.high")).drop("e")

    def seeds(least, most, same, w):
        meets = _meets(least, most, same, w)
        row, column = best(most, meets, SEEDS)
        out = np.zeros(same.shape, bool)
        out[row, column] = True
        return out

    begun = with_windows(window.withColumn("start", F.col("low")))
    first = _scored(begun, candidates, _needed(begun, zones, lambda least, most, same, aid, block, w: seeds(least, most, same, w)), True)
    first = common.staged(_first(first, NEGATIVES, "aid", "j").drop("rank"), "negatives")
    third = first.groupBy("aid", "j").agg(F.min("score").alias("third"), F.count("*").alias("n")).where(F.col("n") == NEGATIVES).drop("n")
    raised = window.join(third, ["aid", "j"], "left").withColumn("start", F.col("low")).withColumn("low", F.greatest("low", "third"))
    raised = common.staged(with_windows(raised), "raised")
    half = F.size("start")

    def others(least, most, same, aid, block, w):
        start = [x[: len(x) // 3] + x[2 * (len(x) // 3):] for x in w]
        now = [x[len(x) // 3:] for x in w]
        return _meets(least, most, same, now) & ~seeds(least, most, same, start)

    thrice = raised.withColumn("w", F.concat(F.slice("start", F.lit(1), (half / 2).cast("int")), "w"))
    rest = _scored(raised, candidates, _needed(thrice, zones, others), True)
    negative = _first(first.unionByName(rest), NEGATIVES, "aid", "j").select("aid", "j", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select("aid", F.col("vec_id").alias("anchor_id"))
    return window.join(negative, ["aid", "j"]).join(names, "aid").select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
