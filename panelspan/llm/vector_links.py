"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated by random orthogonal matrices and keeps the signs as its code, plus the correction factor
``<code, vector>`` of the first rotation.  ``<code of o, q> / factor of o`` is an unbiased estimate of ``<o, q>`` whose
error is below ``EPSILON * sqrt((1 - factor**2) / factor**2 / (d - 1))`` but for a chance that falls exponentially in
``EPSILON**2``; only pairs whose upper bound reaches the threshold are recomputed, in double precision.

Which pairs are estimated: code bits form bands, and vectors meet where all bits of a band agree.  Bits per band grow
with the logarithm of the number of vectors, so a bucket of unrelated vectors stays at about 2**``SPARE``, and the
bands suffice for a pair at the threshold to meet with probability ``RECALL``.  A pair counts in its first common band
only.  Buckets beyond ``TILE`` vectors are cut into tiles, and every pair of tiles is a unit of work, so a group of
copies of any size is spread out.  Equal vectors are one node and are not expanded.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
their own component; vectors of different lengths never link; repeated rows link with each other; a null vec_id counts
in links but is no component's name if another id is there; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.llm import common
from panelspan.llm.components import components

LEAST = 0.9
EPSILON = 4.0
SPARE = 6
RECALL = 0.995
TILE = 2048


@functools.lru_cache(maxsize=8)
def rotations(size: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices of this size, one below the other."""
    made = [np.linalg.qr(np.random.default_rng([size, k]).standard_normal((size, size)))[0] for k in range(count)]
    return np.concatenate(made)


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the largest component is divided out first, so squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def plan(n: int, least: float = LEAST) -> tuple[int, int]:
    """Bits per band and bands for ``n`` vectors."""
    bits = max(6, math.ceil(math.log2(max(n, 2))) - SPARE)
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))


def band_codes(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Per vector and band its bits as a number."""
    turns = rotations(unit.shape[1], -(-bits * bands // unit.shape[1]))[: bits * bands]
    signs = (unit @ turns.T > 0).reshape(len(unit), bands, bits)
    return (signs.astype(np.int64) << np.arange(bits)).sum(axis=2)


def linked(unit: np.ndarray, codes: np.ndarray, band: int, tile: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of one bucket whose first common band this is; of different tiles if there are two."""
    size = unit.shape[1]
    turned = unit @ rotations(size, 1).T
    code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(size)
    factor = (code * turned).sum(axis=1)
    error = EPSILON * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(size - 1, 1))
    split = tile[0] != tile[-1] if len(tile) else False
    out_i, out_j = [], []
    for a in range(0, len(unit), 1024):
        estimate = code[a: a + 1024] @ turned.T / factor[a: a + 1024, None]
        i, j = np.nonzero(estimate + error[a: a + 1024, None] >= least)
        i += a
        keep = (i < j) & ((tile[i] != tile[j]) if split else True)
        i, j = i[keep], j[keep]
        keep = (unit[i] * unit[j]).sum(axis=1) >= least
        i, j = i[keep], j[keep]
        keep = ~(codes[i, :band] == codes[j, :band]).any(axis=1)
        out_i.append(i[keep])
        out_j.append(j[keep])
    return np.concatenate(out_i), np.concatenate(out_j)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect."""
    root = np.arange(n)
    while True:                                                    # least labels until nothing moves
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _nodes(vectors: DataFrame) -> DataFrame:
    usable = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")) \
        .withColumn("node", F.expr(f"case when {usable} then xxhash64(embedding) end"))


def links(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    common.ship(vectors.sparkSession)
    rows = _nodes(vectors)
    nodes = rows.where("node is not null").groupBy("node", "embedding").agg(F.count("*").alias("copies"))
    nodes = common.staged(nodes, "vectors")
    bits, bands = plan(nodes.count(), least)

    def banded(batches):
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(np.array(lists.offsets))
            for d in np.unique(size):
                mine = np.flatnonzero(size == d)
                vector = np.array(lists.take(pa.array(mine)).flatten()).reshape(len(mine), d)
                codes = band_codes(units(vector), bits, bands)
                key = common.mix((codes + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + common.mix((np.arange(bands) * 65536 + d).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(mine)), pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * bands), pa.array(key.ravel().view(np.int64)))], ["node", "keys"])

    keys = nodes.select("node", "embedding").mapInArrow(banded, "node long, keys array<long>").select("node", F.posexplode("keys").alias("band", "bucket"))
    keys = common.staged(keys, "bands")
    tiles = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    placed = keys.join(tiles, "bucket").withColumn("tile", F.pmod(F.xxhash64("node", "bucket"), F.col("tiles")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))) \
        .select("node", "bucket", "band", "tile", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"))
    work = placed.join(nodes, "node").select("bucket", "one", "two", "band", "tile", "node", "copies", "embedding")
    group = ["bucket", "one", "two"]

    def compare(batches):
        for table in common.whole_groups(batches, group, 8192):
            table = table.combine_chunks()
            columns = {c: np.array(table.column(c)) for c in (*group, "band", "tile", "node", "copies")}
            lists = table.column("embedding").combine_chunks()
            fresh = np.zeros(table.num_rows, bool)
            fresh[0] = True
            for c in group:
                fresh[1:] |= np.diff(columns[c]) != 0
            ends = np.append(np.flatnonzero(fresh), table.num_rows)
            a_list, b_list, n_list = [], [], []
            for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if high - low < 2:
                    continue
                vector = np.array(lists.slice(low, high - low).flatten()).reshape(high - low, -1)
                unit = units(vector)
                tile = columns["tile"][low:high]
                order = np.argsort(tile, kind="stable")
                unit, node, copies = unit[order], columns["node"][low:high][order], columns["copies"][low:high][order]
                i, j = linked(unit, band_codes(unit, bits, bands), int(columns["band"][low]), tile[order], least)
                if len(i):
                    n = np.bincount(i, weights=copies[j], minlength=high - low) + np.bincount(j, weights=copies[i], minlength=high - low)
                    some = np.flatnonzero(n)
                    a, b = _forest(i, j, high - low)
                    a_list += [node[some], node[a]]
                    b_list += [node[some], node[b]]
                    n_list += [n[some].astype(np.int64), np.zeros(len(a), np.int64)]
            if a_list:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a_list, b_list, n_list)], ["a", "b", "n"])

    found = common.staged(work.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "a long, b long, n long"), "found")
    counted = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    joined = components(found.where("n = 0").select("a", "b"))
    own = nodes.select("node", "copies").join(counted, "node", "left").join(joined, "node", "left") \
        .select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    placed = rows.select("vec_id", "node").join(own, "node", "left")
    names = placed.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return placed.join(names, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
