"""Repeated passages: every byte inside a string of ``LENGTH`` bytes that starts earlier in the corpus as well.

Longest-previous-factor arrays give the answer: a string starts earlier exactly where the longest earlier match is at
least ``LENGTH``, and the longest earlier match is that with the previous or the next smaller position in suffix order.
Suffixes are compared only where they can agree at all.  Each window of ``LENGTH`` bytes has an anchor, its ``GRAM``-byte
piece of least hash; equal windows have equal anchors at equal offsets.  Consecutive windows with one anchor form a
block.  The work is done in four steps, each a shuffle on a key without hot groups:

1. Documents are dealt into buckets; a bucket reports each of its distinct blocks once (so copies meet before they travel).
2. Per anchor, equal blocks of several buckets are one block; all but its first place are repeats as a whole.
3. Where an anchor has different blocks, the text of their first places is put in suffix order around the anchor: by
   what follows it and by what precedes it.  A window repeats if the previous or next smaller position among the
   suffixes that share ``LENGTH`` bytes with it comes earlier.
4. The buckets mark the bytes of all repeating windows.

Positions are (doc_id, first byte).  Strings are judged on the input, not on what is left.

Defined results: null and empty texts have no bytes; texts below ``LENGTH`` bytes lose nothing; repeated rows with one
doc_id are not earlier than each other; a null doc_id comes before all others; long texts are searched whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspan.llm import common

LENGTH = 100
GRAM = 32
BUCKETS = 4                 # per shuffle partition
_NONE = np.iinfo(np.uint64).max


def blocks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Blocks of the texts: first window, last window, anchor place (bytes of ``data``), anchor hash and block hash."""
    base, end = int(offsets[0]), int(offsets[-1])
    part, n = data[base:end], end - base
    empty = tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    if n < length:
        return empty
    rolling = common.Rolling(part)
    places = np.arange(n - gram + 1)
    hashes = rolling(places, places + gram)
    span = length - gram + 1                                        # anchors to choose from
    least, width = hashes, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n - length + 1], least[span - width: span - width + n - length + 1])
    valid = np.zeros(n - length + 1, bool)
    first, last = offsets[:-1] - base, offsets[1:] - base - length
    long_enough = last >= first
    change = np.zeros(n - length + 2, np.int8)
    change[first[long_enough]] += 1
    change[last[long_enough] + 1] -= 1
    valid = np.cumsum(change[:-1], dtype=np.int8) > 0
    if not valid.any():
        return empty
    heads = np.zeros(len(valid), bool)
    heads[first[long_enough]] = True
    new = valid & heads
    new[1:] |= valid[1:] & (~valid[:-1] | (least[1:] != least[:-1]))
    low = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
    lows, highs, anchors = [], [], []
    while len(low):                                                 # leftmost place of the least hash; again where it leaves a tie behind
        anchor = np.empty(len(low), np.int64)
        for a in range(0, len(low), 1 << 16):
            anchor[a: a + (1 << 16)] = low[a: a + (1 << 16)] + hashes[low[a: a + (1 << 16), None] + np.arange(span)].argmin(axis=1)
        high = np.minimum(stop, anchor)
        lows.append(low)
        highs.append(high)
        anchors.append(anchor)
        more = stop > anchor
        low, stop = anchor[more] + 1, stop[more]
    low, high, anchor = (np.concatenate(x) for x in (lows, highs, anchors))
    order = np.argsort(low, kind="stable")
    low, high, anchor = low[order], high[order], anchor[order]
    block = common.mix(rolling(low, high + length) + common.mix(((anchor - low) * 1024 + high - low).astype(np.uint64)))
    return low + base, high + base, anchor + base, hashes[anchor], block


class _Bucket:
    """The documents of one bucket in order of doc_id, and the first place of each of their distinct blocks."""

    def __init__(self, doc_ids: pa.Array, texts: pa.Array):
        ids = np.array(doc_ids.fill_null(np.iinfo(np.int64).min))
        order = np.argsort(ids, kind="stable")
        self.doc_ids, self.ids = doc_ids.take(pa.array(order)), ids[order]
        self.offsets, self.data = common.utf8(texts.take(pa.array(order)))
        found = [blocks(self.data, self.offsets[a: b + 1]) for a, b in common.slices(self.offsets, 1 << 20)]
        self.low, self.high, self.anchor, self.anchor_hash, self.block = (np.concatenate([f[i] for f in found]) for i in range(5))
        self.text = np.searchsorted(self.offsets, self.low, side="right") - 1
        at = self.low - self.offsets[self.text]
        self.distinct, self.first, self.number = np.unique(self.block, return_index=True, return_inverse=True)
        # the smallest (doc_id, place); rows are in that order but for repeated doc_ids
        order = np.lexsort((at, self.ids[self.text], self.number)) if (np.diff(self.ids) == 0).any() else None
        if order is not None:
            self.first = order[np.searchsorted(self.number[order], np.arange(len(self.distinct)))]
        self.at = at
        lead = self.first[self.number]
        self.later = (self.ids[self.text] != self.ids[self.text[lead]]) | (at != at[lead])


def _column(table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _distinct(table: pa.Table) -> pa.Table:
    own = _Bucket(_column(table, "doc_id"), _column(table, "text"))
    f = own.first
    shape = (own.anchor[f] - own.low[f]) * 1024 + own.high[f] - own.low[f]
    return pa.table([pa.array(own.anchor_hash[f].view(np.int64)), pa.array(own.distinct.view(np.int64)), pa.array(own.ids[own.text[f]]), pa.array(own.at[f]),
                     pa.array(shape.astype(np.int32)), pa.array(np.full(len(f), _column(table, "bucket")[0].as_py(), np.int32))], ["anchor", "block", "doc_id", "at", "shape", "bucket"])


def _context(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """Text of the wanted blocks' windows."""
    if not wanted.num_rows or not docs.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())], CONTEXT)
    ids = _column(docs, "doc_id").fill_null(np.iinfo(np.int64).min)
    keep = pa.array(np.isin(np.array(ids), np.array(_column(wanted, "doc_id"))))
    own = _Bucket(ids.filter(keep), _column(docs, "text").filter(keep))
    block = np.array(_column(wanted, "block")).view(np.uint64)
    order = np.argsort(own.block, kind="stable")
    place = {}
    left, right = np.searchsorted(own.block[order], block), np.searchsorted(own.block[order], block, side="right")
    wanted_id, wanted_at = np.array(_column(wanted, "doc_id")), np.array(_column(wanted, "at"))
    texts = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        o = next(o for o in order[a:b].tolist() if own.ids[own.text[o]] == wanted_id[i] and own.at[o] == wanted_at[i])
        texts.append(own.data[own.low[o]: own.high[o] + LENGTH].tobytes())
    return pa.table([*(_column(wanted, c) for c in CONTEXT[:-1]), pa.array(texts, pa.binary())], CONTEXT)


CONTEXT = ["anchor", "block", "doc_id", "at", "shape", "bucket", "text"]


def _words(matrix: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian words, last word first, for lexsort."""
    width = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), width), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    return list(padded.view(">u8").astype(np.uint64).T[::-1])


def _order(anchor: np.ndarray, matrix: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order within each anchor, and the common prefix of each suffix with the one before it (-1: another anchor)."""
    order = np.lexsort([*_words(matrix), anchor])
    a, b = matrix[order[1:]], matrix[order[:-1]]
    differ = a != b
    common_bytes = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    common_bytes = np.minimum(common_bytes, np.minimum(known[order[1:]], known[order[:-1]]))
    return order, np.concatenate([[-1], np.where(anchor[order[1:]] == anchor[order[:-1]], common_bytes, -1)])


def earlier(run: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Whether the previous or the next smaller position in suffix order lies in the same run of suffixes.

    ``run`` numbers, ascending in suffix order, the suffixes that share ``LENGTH`` bytes; ``position`` ranks their places.
    """
    top = int(position.max(initial=0)) + 2
    before = np.minimum.accumulate(position - run * top) + run * top          # least position up to here, in this run
    after = (np.minimum.accumulate((position + run * top)[::-1]) - (run * top)[::-1])[::-1]
    return (before < position) | (after < position)


def repeated(anchor: np.ndarray, position: np.ndarray, offset: np.ndarray, texts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For blocks (sorted into groups by ``anchor``): matrix of windows (by block and number) that start earlier elsewhere."""
    size = np.array([len(t) for t in texts])
    windows = size - length + 1
    raw = np.frombuffer(b"".join(texts), np.uint8)
    first = np.cumsum(size) - size
    known_right, known_left = np.minimum(size - offset, length), offset
    right = np.zeros((len(texts), length), np.uint8)
    step = np.arange(length)
    use = step < known_right[:, None]
    right[use] = raw[((first + offset)[:, None] + step)[use]]
    left = np.zeros((len(texts), max(int(offset.max(initial=0)), 1)), np.uint8)
    step = np.arange(left.shape[1])
    use = step < known_left[:, None]
    left[use] = raw[((first + offset - 1)[:, None] - step)[use]]
    order_right, lcp_right = _order(anchor, right, known_right)
    order_left, lcp_left = _order(anchor, left, known_left)
    out = np.zeros((len(texts), int(windows.max(initial=0))), bool)
    run_right, run_left = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
    for back in range(int(offset.max(initial=0)) + 1):               # windows that begin so many bytes before the anchor
        number = offset - back
        mine = np.flatnonzero((number >= 0) & (number < windows))
        if len(mine) < 2:
            continue
        run_right[order_right] = np.cumsum(lcp_right < length - back)
        run_left[order_left] = np.cumsum(lcp_left < back)
        key = run_left[mine] * (len(texts) + 1) + run_right[mine]
        order = np.argsort(key, kind="stable")
        run = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        hit = mine[order[earlier(run, position[mine[order]])]]
        out[hit, number[hit]] = True
    return out


def _compare(batches):
    """Blocks in order of their anchor in, stretches of repeating windows out."""
    def done(table: pa.Table):
        anchor, block, doc_id, at, shape, bucket = (np.array(_column(table, c)) for c in CONTEXT[:-1])
        # equal windows lie at one offset from their anchors, so the anchors' places decide
        offset = (shape // 1024).astype(np.int64)
        place = at + offset
        order = np.lexsort((place, doc_id))
        position = np.empty(len(order), np.int64)
        same = np.concatenate([[True], (np.diff(doc_id[order]) != 0) | (np.diff(place[order]) != 0)])
        position[order] = np.cumsum(same)
        hit = repeated(anchor, position, offset, _column(table, "text").to_pylist())
        padded = np.zeros((len(hit), hit.shape[1] + 1), bool)
        padded[:, :-1] = hit
        low, high = common.runs(padded.ravel())
        row = low // padded.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(bucket[row]), pa.array(block[row]), pa.array((low % padded.shape[1]).astype(np.int32)), pa.array((high - 1 - row * padded.shape[1]).astype(np.int32))],
                                          ["bucket", "block", "low", "high"])

    for table in common.whole_groups(batches, ["anchor"], 30_000):
        yield done(table)


def _marked(docs: pa.Table, marks: pa.Table):
    """The bucket, and which of its bytes go."""
    own = _Bucket(_column(docs, "doc_id"), _column(docs, "text"))
    change = np.zeros(len(own.data) + 1 if len(own.data) else 1, np.int32)
    repeat = own.later.copy()
    block = np.array(_column(marks, "block")).view(np.uint64) if marks.num_rows else np.empty(0, np.uint64)
    at = np.searchsorted(own.distinct, block)
    low, high = (np.array(_column(marks, c)) if marks.num_rows else np.empty(0, np.int32) for c in ("low", "high"))
    whole = np.zeros(len(own.distinct), bool)
    whole[at[high < 0]] = True
    repeat |= whole[own.number]
    np.add.at(change, own.low[repeat], 1)
    np.add.at(change, own.high[repeat] + LENGTH, -1)
    # stretches of windows concern every first place of the block (several where a doc_id repeats)
    some = high >= 0
    if some.any():
        place = np.flatnonzero(~own.later & ~repeat)
        order = np.argsort(own.number[place], kind="stable")
        place = place[order]
        a, b = np.searchsorted(own.number[place], at[some]), np.searchsorted(own.number[place], at[some], side="right")
        target = place[common.ranges(a, b)]
        np.add.at(change, own.low[target] + np.repeat(low[some], b - a), 1)
        np.add.at(change, own.low[target] + np.repeat(high[some], b - a) + LENGTH, -1)
    return own, np.cumsum(change)[: len(own.data)] > 0


def _digests(docs: pa.Table, marks: pa.Table) -> pa.Table:
    rows = []
    if docs.num_rows:
        own, gone = _marked(docs, marks)
        for i, (a, b) in enumerate(zip(own.offsets[:-1].tolist(), own.offsets[1:].tolist())):
            mask = gone[a:b]
            low, high = common.runs(mask)
            kept = own.data[a:b][~mask].tobytes() if len(low) else own.data[a:b].tobytes()
            rows.append((own.doc_ids[i].as_py(), b - a, int((high - low).sum()), [{"low": x, "high": y} for x, y in zip(low.tolist(), high.tolist())], hashlib.sha256(kept).hexdigest()))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.string()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, spans (bytes to remove: low, high exclusive) and kept_sha256."""
    spark = docs.sparkSession
    common.ship(spark)
    count = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(count)).cast("int").alias("bucket"), F.col("doc_id").cast("long"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    places = dealt.groupBy("bucket").applyInArrow(_distinct, "anchor long, block long, doc_id long, at long, shape int, bucket int")
    per_anchor, per_block = Window.partitionBy("anchor"), Window.partitionBy("anchor", "block")
    place = F.struct("doc_id", "at", "bucket")
    judged = places.withColumn("first", F.min(place).over(per_block)) \
        .withColumn("n", F.count("*").over(per_anchor)).withColumn("blocks_differ", F.min("block").over(per_anchor) != F.max("block").over(per_anchor)) \
        .where("n > 1")
    later = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.at") != F.col("at"))
    lead = F.col("blocks_differ") & (F.col("first") == place)
    judged = common.staged(judged.select(*CONTEXT[:-1], later.alias("later"), lead.alias("lead")).where("later or lead"), "blocks")
    wanted = judged.where("lead").select(*CONTEXT[:-1])
    context = dealt.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(
        _context, "anchor long, block long, doc_id long, at long, shape int, bucket int, text binary")
    stretches = common.staged(context.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "bucket int, block long, low int, high int"), "stretches")
    # a block that is equal in several places of one doc_id keeps one of them: all others follow their own bucket's rule
    whole = judged.where("later").select("bucket", "block", F.lit(0).alias("low"), F.lit(-1).alias("high"))
    marks = whole.unionByName(stretches)
    return dealt.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(
        _digests, "doc_id long, n_bytes long, n_removed long, spans array<struct<low: long, high: long>>, kept_sha256 string")
