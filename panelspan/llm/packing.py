"""Packing documents into training sequences by an order-preserving dynamic program.

The ids of the documents, in the order of their input partition, form one line.  The line may be cut at document ends
(free), at sentence ends (``SENTENCE_CUT``), at clause ends (``CLAUSE_CUT``) and, inside clauses longer than a
sequence, after ``size`` ids (``HARD_CUT``).  A sequence is one stretch between two cuts of at most ``size`` ids; it is padded to ``size`` unless
its length is a power of two.  Least total cost, with ``f(j)`` for the best cutting up to cut ``j``::

    f(j) = penalty(j) + PER_SEQUENCE + min( min over i of f(i) + size - (j - i),   over the cuts i within size before j
                                            min over k of f(j - 2**k) )            where that is a cut

The inner minimum is that of ``f(i) + i`` over a sliding window, kept in a monotone queue, so the program is linear.
It runs over blocks of whole documents of about ``BLOCK`` ids; a block ends a sequence.

Defined results: null and empty texts hold their end id alone; repeated rows are packed one by one; documents of any
length are packed whole; without rows there are no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.llm import common, tokens

SIZE = 1024
SENTENCE_CUT = 2            # in padding ids
CLAUSE_CUT = 6
HARD_CUT = 64
PER_SEQUENCE = 4
BLOCK = 1_000_000


def cuts(places: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The chosen places, of the ascending ``places`` where the line may be cut (the last one ends it)."""
    where, costs = places.tolist(), penalty.tolist()
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    number = np.full(where[-1] + 1, -1, np.int32)
    number[0] = 0
    number[places] = np.arange(1, len(where) + 1)
    number = number.tolist()
    at, best, back = [0, *where], [0.0] * (len(where) + 1), [0] * (len(where) + 1)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])      # f(i) + i ascending, place, number
    for j, place in enumerate(where, 1):
        while queue[0][1] < place - size:
            queue.popleft()
        least, _, source = queue[0]
        least += size - place
        for power in powers:
            if power > place:
                break
            i = number[place - power]
            if i >= 0 and best[i] < least:
                least, source = best[i], i
        f = least + costs[j - 1] + PER_SEQUENCE
        best[j], back[j] = f, source
        key = f + place
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, place, j))
    out, j = [], len(where)
    while j:
        out.append(at[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


def allowed(total: np.ndarray, stops: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Where the line may be cut and at what cost; no two neighbours are more than ``size`` apart."""
    places = np.flatnonzero(stops) + 1
    penalty = np.where(stops[places - 1] == tokens.SENTENCE, float(SENTENCE_CUT), float(CLAUSE_CUT))
    penalty[np.searchsorted(places, np.cumsum(total))] = 0
    gap = np.diff(places, prepend=0)
    wide = np.flatnonzero(gap > size)
    if len(wide):
        more = (gap[wide] - 1) // size
        hard = np.repeat(places[wide] - gap[wide], more) + size * (common.ranges(np.zeros_like(more), more) + 1)
        places = np.concatenate([places, hard])
        penalty = np.concatenate([penalty, np.full(len(hard), float(HARD_CUT))])
        order = np.argsort(places, kind="stable")
        places, penalty = places[order], penalty[order]
    return places, penalty


def _pieces(doc_ids: pa.Array, ids: np.ndarray, total: np.ndarray, stops: np.ndarray, first_sequence: int, size: int):
    ends = np.cumsum(total)
    chosen = cuts(*allowed(total, stops, size), size)
    bounds = np.union1d(chosen, ends)
    low = np.concatenate([[0], bounds[:-1]])
    doc = np.searchsorted(ends, low, side="right")
    sequence = np.searchsorted(chosen, low, side="right")
    begin = np.concatenate([[0], chosen])[sequence]
    raw = ids.astype("<u4")
    crc = [zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), bounds.tolist())]
    columns = [low - (ends - total)[doc], bounds - low, np.array(crc, np.int64), total[doc], first_sequence + sequence, low - begin]
    return doc, bounds, pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), *map(pa.array, columns)], COLUMNS), len(chosen)


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: which ids of it (start, length), and where they lie (sequence_id, offset).

    ``sequence_id`` holds the input partition in its high bits.  ``with_ids`` adds the ids themselves.
    """
    common.ship(docs.sparkSession)
    vocabulary = vocabulary or tokens.default_vocabulary()

    def run(batches):
        encoder = tokens.encoder(vocabulary)
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        count = 0

        def block():
            nonlocal sequence, held, count
            names = pa.concat_arrays([h[0] for h in held])
            ids, total, stops = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            _, bounds, rows, n = _pieces(names, ids, total, stops, sequence, size)
            sequence, held, count = sequence + n, [], 0
            if with_ids:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], bounds]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                rows = pa.RecordBatch.from_arrays([*rows.columns, lists], [*COLUMNS, "ids"])
            return rows

        for batch in batches:
            for low, high, data, offsets in tokens.texts(batch, 1):
                held.append((batch.column(0).slice(low, high - low), *tokens.with_end(*encoder.encode(data, offsets, sentences=True))))
                count += len(held[-1][1])
                if count >= BLOCK:
                    yield block()
        if held:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
