"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A text's shingles are its runs of five words (white space between, A-Z lower-cased), each weighted by how often it
occurs; a shorter text is one shingle.  Every shingle is a Poisson process whose rate is its weight; its arrivals fall
on random slots and a slot keeps the shingle that arrived first.  Two texts agree in a slot with their probability
Jaccard similarity.  Arrivals later than a text's last filled slot cannot matter, so a process ends there.

Texts with equal shingles are one node.  Slots are grouped into bands, and within each band's buckets the node of the
smallest doc_id is compared with the others by the exact probability Jaccard similarity, beginning with the one that a
node meets most often and leaving out those that are then in its component already.  After linking, pairs of a
bucket that are still in different components are compared too, in tiles, unless their shingles that nobody else has
already rule them out, so every two components with a similar pair that shares a bucket become one.  A pair of tiles
gives a forest over the components in it, never all their pairs.

Defined results: null, empty and blank texts link with nothing; repeated rows belong together; a null doc_id is a
document like others but never the kept one of a group that has an id; texts are shingled whole; an empty table gives
an empty result; other columns are ignored or, in :func:`deduplicated`, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.llm import common
from panelspan.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5         # a pair of similarity 0.8 meets in a bucket with probability 0.9999

TILE = 4 << 20              # bytes of text on one side of a unit of comparison

_PIECE = 1 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), by text and hash."""
    part = data[offsets[0]: offsets[-1]].copy()
    part[(part >= 65) & (part <= 90)] += 32
    inside = part > 32
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[1:-1] - offsets[0]
    edge = edge[(edge > 0) & (edge < len(part))]
    begin[edge], end[edge - 1] = inside[edge], inside[edge - 1]
    low, high = np.flatnonzero(begin), np.flatnonzero(end) + 1
    words = common.Rolling(part)(low, high)
    text = np.searchsorted(offsets - offsets[0], low, side="right") - 1
    count = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    number = np.maximum(count - size + 1, np.minimum(count, 1))
    at = common.ranges(first, first + number)
    owner = np.repeat(np.arange(len(count)), number)
    width = np.minimum(count, size)[owner]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    total = width.astype(np.uint64)
    for k in range(size):
        total = total + np.where(k < width, padded[at + k] * _FACTORS[k % 5] + np.uint64(k // 5), np.uint64(0))
    total = common.mix(total)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    fresh = np.flatnonzero(np.concatenate([[True], (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])])) if len(total) else np.empty(0, np.int64)
    return owner[fresh], total[fresh], np.diff(np.append(fresh, len(total)))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Per text the element that arrives first in each slot (n by slots); zeros for texts without elements."""
    first = np.full(n * slots, np.inf)
    kept = np.zeros(n * slots, np.uint64)
    time = np.zeros(len(element))
    live = np.arange(len(element))
    arrival = 0
    while len(live):
        arrival += 1
        draw = common.mix(element[live] + np.uint64(arrival * 0xA0761D6478BD642F % 2**64))
        time[live] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        slot = text[live] * slots + (common.mix(draw) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(first, slot, time[live])
        won = first[slot] == time[live]
        kept[slot[won]] = element[live[won]]
        last = first.reshape(n, slots).max(axis=1)
        live = live[time[live] < last[text[live]]]
    return kept.reshape(n, slots)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two (sorted elements, weights): sum over common i of 1 / sum_j max(a_j / a_i, b_j / b_i)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = a[1].astype(float), b[1].astype(float)
    ratio, where = np.unique(y[ib] / x[ia], return_inverse=True)      # y_i / x_i of the common elements
    only_x, only_y = x.sum() - x[ia].sum(), y.sum() - y[ib].sum()
    cx, cy = np.bincount(where, weights=x[ia]), np.bincount(where, weights=y[ib])
    below_x = np.cumsum(cx)                                           # x_j where y_j / x_j <= ratio: there x_j / x_i is the larger
    above_y = cy[::-1].cumsum()[::-1] - cy
    # sum_j max(x_j / x_i, y_j / y_i) = (x-part) / x_i + (y-part) / y_i
    return float((1 / ((only_x + below_x[where]) / x[ia] + (only_y + above_y[where]) / y[ib])).sum())


def sketched(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (hash of the weighted shingles, null without words) and the hash of each band."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            offsets, data = common.utf8(batch.column(1))
            for low, high in common.slices(offsets, _PIECE):
                n = high - low
                text, element, weight = shingles(data, offsets[low: high + 1])
                node = np.zeros(n, np.uint64)
                np.add.at(node, text, common.mix(element ^ common.mix(weight.astype(np.uint64))))
                none = np.bincount(text, minlength=n) == 0
                slots = signatures(text, element, weight, n, bands * rows).reshape(n, bands, rows)
                hashes = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
                for k in range(rows):
                    hashes = common.mix(hashes * _FACTORS[k % 5] + slots[:, :, k])
                node = pa.array(common.mix(node).view(np.int64), mask=none)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(hashes.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), node, lists], ["doc_id", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, node long, bands array<long>")


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    return shingles(raw, np.array([0, len(raw)]))[1:]


def _with_nodes(docs: DataFrame) -> DataFrame:
    """node and text of (doc_id, node, text) rows whose text has that node; a doc_id may stand for several texts."""
    def run(batches):
        for batch in batches:
            nodes, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keep = []
            for node, text in zip(nodes, texts):
                element, weight = _features(text or "")
                own = common.mix(np.array([common.mix(element ^ common.mix(weight.astype(np.uint64))).sum()], np.uint64)).view(np.int64)[0]
                keep.append(len(element) > 0 and int(own) == node)
            yield batch.select([1, 2]).filter(pa.array(keep, pa.bool_()))

    return docs.select("doc_id", "node", "text").mapInArrow(run, "node long, text string")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least this similarity."""
    def run(batches):
        held: tuple = (None, None)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2), batch.column(3)
            keep = []
            for i, center in enumerate(a):
                if held[0] != center:
                    held = center, _features(ta[i].as_py())
                keep.append(similarity(held[1], _features(tb[i].as_py())) >= least - 1e-12)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _alone(texts: DataFrame) -> DataFrame:
    """node and the share of its weight in shingles that none of the other texts has.

    With such shares p and q, the similarity of two texts is at most 1 / (1 / (1 - p) + q / (1 - q)): the sum over common
    shingles of x * y / (y + q * x) for their shares x and y is largest if these are all in one shingle.
    """
    def run(batches):
        for batch in batches:
            offsets, data = common.utf8(batch.column(1))
            nodes = np.array(batch.column(0))
            for low, high in common.slices(offsets, _PIECE):
                text, element, weight = shingles(data, offsets[low: high + 1])
                share = weight / np.bincount(text, weights=weight, minlength=high - low)[text]
                yield pa.RecordBatch.from_arrays([pa.array(element.view(np.int64)), pa.array(nodes[low + text]), pa.array(share)], ["element", "node", "share"])

    shares = texts.select("node", "text").mapInArrow(run, "element long, node long, share double")
    once = shares.groupBy("element").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("share").alias("share")).where("n = 1")
    return once.groupBy("node").agg(F.sum("share").alias("alone"))


def _tiles(rows: DataFrame, name: str) -> DataFrame:
    """Per bucket the number of tiles of about ``TILE`` bytes that its texts need."""
    return rows.groupBy("bucket").agg(F.ceil(F.sum("bytes") / TILE).cast("int").alias(name))


def _across(open_: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between components that hold similar nodes of one bucket, other than with the bucket's center.

    The nodes outside a bucket's main component are set against all its nodes in tiles of bounded size.  Within a pair of
    tiles, a node's shingles are looked up among those of the other tile at once: the similarity is at most the sum of
    the smaller shares of common shingles, and only pairs whose sum reaches ``least`` are computed exactly, and only while
    their components are not yet joined by other links of the same tiles.  So a pair of tiles gives fewer links than it has
    components, and these links join what all its similar pairs would.  A pair that shares several buckets is judged in the
    first of them.
    """
    sizes = texts.select("node", F.octet_length("text").alias("bytes"))
    every = open_.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    rows = common.staged(open_.join(every, "node").join(sizes, "node"), "across")
    rest = rows.where("component <> main")
    tiles = _tiles(rest, "rest_tiles").join(_tiles(rows, "tiles"), "bucket")
    columns = ["bucket", "i", "j", "kind", "node", "component", "center", "main", "buckets"]

    def placed(side: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        mine, across = ("i", "j") if kind == 0 else ("j", "i")
        dealt = side.join(tiles, "bucket").withColumn(mine, F.pmod(F.xxhash64("node", F.lit(kind)), F.col(own)).cast("int"))
        return dealt.withColumn(across, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).withColumn("kind", F.lit(kind)).select(*columns)

    units = placed(rest, 0, "rest_tiles", "tiles").unionByName(placed(rows, 1, "tiles", "rest_tiles")).join(texts, "node")
    keys = ["bucket", "i", "j"]

    def compare(batches):
        for table in common.whole_groups(batches, keys, 256):
            table = table.combine_chunks()
            fresh = np.ones(table.num_rows, bool)
            fresh[1:] = np.any([np.diff(np.array(table.column(k))) != 0 for k in keys], axis=0)
            ends = np.append(np.flatnonzero(fresh), table.num_rows).tolist()
            for low, high in zip(ends[:-1], ends[1:]):
                a, b = _joined(table.slice(low, high - low), least)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = units.repartition(*keys).sortWithinPartitions(*keys, "kind").select(*columns, "text")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _joined(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Components that similar pairs of a unit join, rows of kind 0 against those of kind 1: a forest over its components."""
    kind, node, component, center, main = (np.array(table.column(c)) for c in ("kind", "node", "component", "center", "main"))
    cut = int(np.searchsorted(kind, 1))
    none = np.empty(0, np.int64)
    if cut in (0, len(kind)):
        return none, none
    bucket = table.column("bucket")[0].as_py()
    lists = table.column("buckets").combine_chunks()
    width = np.diff(np.array(lists.offsets))
    buckets = np.full((len(kind), int(width.max())), np.iinfo(np.int64).max)
    buckets[np.arange(buckets.shape[1]) < width[:, None]] = np.array(lists.flatten())
    offsets, data = common.utf8(table.column("text"))
    owner, element, weight = [], [], []
    for low, high in common.slices(offsets, _PIECE):
        text, e, w = shingles(data, offsets[low: high + 1])
        owner.append(text + low)
        element.append(e)
        weight.append(w.astype(float))
    owner, element, weight = (np.concatenate(x) for x in (owner, element, weight))
    share = weight / np.bincount(owner, weights=weight, minlength=len(kind))[owner]
    first = np.searchsorted(owner, np.arange(len(kind) + 1))
    below = first[cut]
    order = np.argsort(element[below:], kind="stable") + below                     # the other tile's shingles, by hash
    hashes = element[order]
    label = component.copy()                                                       # equal once joined within the unit
    out_a, out_b = [], []
    for x in range(cut):
        mine = slice(first[x], first[x + 1])
        a, b = np.searchsorted(hashes, element[mine]), np.searchsorted(hashes, element[mine], side="right")
        at = order[common.ranges(a, b)]
        bound = np.bincount(owner[at] - cut, weights=np.minimum(share[at], np.repeat(share[mine], b - a)), minlength=len(kind) - cut)
        y = np.flatnonzero(bound >= least - 1e-9) + cut
        y = y[(label[y] != label[x]) & (node[y] != center[x]) & (node[x] != center[x]) & ((component[y] == main[x]) | (node[x] < node[y]))]
        if len(y):
            common_ = np.where(np.isin(buckets[y], buckets[x][: width[x]]), buckets[y], np.iinfo(np.int64).max)
            y = y[common_.min(axis=1) == bucket]
        for k in y:
            theirs = slice(first[k], first[k + 1])
            if label[k] != label[x] and similarity((element[mine], weight[mine]), (element[theirs], weight[theirs])) >= least - 1e-12:
                out_a.append(component[x])
                out_b.append(component[k])
                label[label == label[k]] = label[x]
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, node, class_id (smallest doc_id of its group), class_size and kept."""
    with common.scratch():
        return common.staged(_groups(docs, least), "groups", keep=True)


def _groups(docs: DataFrame, least: float) -> DataFrame:
    sketches = common.staged(sketched(docs), "sketches")
    nodes = sketches.where("node is not null").groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "bands")).alias("s")) \
        .select("node", "s.doc_id", F.explode("s.bands").alias("bucket"))
    members = common.staged(nodes, "buckets")
    centers = members.groupBy("bucket").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = members.join(centers, "bucket").select("bucket", "node", "doc_id", F.col("first.node").alias("center"))
    shared = common.staged(shared, "shared")
    wanted = shared.select("node", "doc_id").distinct()
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), F.col("text").cast("string"))
    # merged whatever the sizes, so that a small table shows what a large one needs
    texts = common.staged(_with_nodes(own.join(wanted.hint("merge"), "doc_id")).dropDuplicates(["node"]), "texts")
    # first each node against the center it meets most often, then only centers that are still in other components
    stars = common.staged(shared.where("node <> center").groupBy(F.col("center").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n")), "stars")
    nearest = stars.groupBy("b").agg(F.max(F.struct("n", "a")).alias("most")).select("most.a", "b")
    links = common.staged(_verified(nearest, texts, least), "links")
    found = components(links)
    label = lambda c: F.coalesce(f"component_{c}", c)
    known = {c: found.withColumnsRenamed({"node": c, "component": f"component_{c}"}).hint("merge") for c in "ab"}
    apart = stars.join(known["a"], "a", "left").join(known["b"], "b", "left").where(label("a") != label("b")).select("a", "b")
    links = common.staged(links.unionByName(_verified(apart, texts, least)), "links")
    found = components(links)
    # buckets whose nodes are not all in one component: their pairs across components
    placed = shared.join(found, "node", "left").select("bucket", "node", "center", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = common.staged(placed.join(split.select("bucket", F.col("main.component").alias("main")), "bucket"), "open")
    alone = common.staged(_alone(texts.join(open_.select("node").distinct(), "node", "left_semi")), "alone")
    open_ = open_.join(alone, "node", "left").where(F.coalesce("alone", F.lit(0.0)) < 1 - least + 1e-9)
    more = common.staged(_across(common.staged(open_, "reachable"), texts, least), "links")
    if more.limit(1).count():
        found = components(links.unionByName(more))
    placed = sketches.select("doc_id", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return placed.join(sizes, "component", "left").select(
        "doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.coalesce("class_id", "doc_id") == F.col("doc_id"), F.col("class_id").isNull()).alias("kept"))


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents without later near copies: of each group the one with the smallest doc_id stays, repeated rows once; all columns stay."""
    kept = groups(docs, least).where("kept").select("doc_id").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"])
    return docs.join(kept.hint("merge"), same, "left_semi").distinct()
