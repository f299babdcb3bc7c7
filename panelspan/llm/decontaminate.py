"""Benchmark decontamination with one FM-index per shard of the training texts.

Words are the runs of digits, letters and non-ASCII characters of the text with A-Z lower-cased.  A window is ten
consecutive words of a benchmark item, or all words of a shorter item.  Each task takes its documents shard by shard:
words that no window has become a separator, stretches too short for any window go, and the rest is indexed as a
Burrows-Wheeler transform in a wavelet matrix.  All windows are searched backwards at once; the places of their
occurrences come from suffix positions sampled every eighth place.  The places, merged, are the spans to remove.

The windows travel to the tasks in blocks of at most ``BLOCK_WINDOWS``, one pass over the documents per block, so the
shared part has a fixed bound however large the benchmark is.  Words are told apart by a 64-bit hash.

Defined results: null, empty and wordless texts have no words and no hits; items without words, null or repeated items
are harmless (equal windows belong to each item that has them); an empty benchmark hits nothing; repeated documents are
judged one by one; texts are indexed whole; other columns are ignored or, in :func:`removed`, kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.llm import common

WORDS = 10
BLOCK_WINDOWS = 200_000
SHARD_WORDS = 250_000       # indexed words of a shard
SHARD_BYTES = 6 << 20       # text of a shard
SAMPLE = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def words_of(part: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of the words of texts that begin at ``heads`` of ``part``."""
    part = _LOWER[part]
    inside = _IS_WORD[part]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = heads[heads < len(part)]
    begin[heads] = inside[heads]
    low = np.flatnonzero(begin)
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = heads[heads > 0] - 1
    end[cut] = inside[cut]
    high = np.flatnonzero(end) + 1
    return low, high, common.Rolling(part)(low, high)


class FmIndex:
    """Index of a line of small integers; ``search`` gives the occurrences of patterns, ``locate`` their places."""

    def __init__(self, line: np.ndarray, sample: int = SAMPLE):
        n = len(line)
        rank = np.unique(line, return_inverse=True)[1].astype(np.int64) + 1
        width = 1
        while True:                                                # suffix order by doubling
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] if width < n else 0
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], (np.diff(key[order]) != 0).cumsum()])
            rank[order] = step + 1
            width *= 2
            if step[-1] == n - 1:
                break
        # the end of the line comes first, as a suffix of its own
        self.suffixes = np.concatenate([[n], order])
        last = np.where(self.suffixes > 0, line[self.suffixes - 1], -1) + 1
        self.sample = np.where(self.suffixes % sample == 0, self.suffixes, -1)
        self.n, self.bits = n + 1, max(1, int(last.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=1 << self.bits))])
        self.levels = []                                           # wavelet matrix: ones before each place, and zeros in all
        for bit in range(self.bits - 1, -1, -1):
            ones = (last >> bit & 1).astype(bool)
            counts = np.zeros(self.n + 1, np.int32)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((bit, counts, self.n - int(counts[-1])))
            last = np.concatenate([last[~ones], last[ones]])
        del self.suffixes

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``place`` letters of the transform."""
        low = np.zeros_like(place)
        for bit, counts, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            low = np.where(one, zeros + counts[low], low - counts[low])
            place = np.where(one, zeros + counts[place], place - counts[place])
        return place - low

    def letter(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros_like(place)
        for bit, counts, zeros in self.levels:
            one = counts[place + 1] - counts[place]
            out |= one.astype(np.int64) << bit
            place = np.where(one == 1, zeros + counts[place], place - counts[place])
        return out

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes of each row of ``patterns``, filled from the right; empty where it does not occur."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = patterns[live, -back] + 1
            known = symbol < 1 << self.bits
            low[live[~known]] = high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places in the line of the suffixes with these numbers."""
        row, steps, todo = row.copy(), np.zeros(len(row), np.int64), np.arange(len(row))
        while len(todo):
            todo = todo[self.sample[row[todo]] < 0]
            symbol = self.letter(row[todo])
            row[todo] = self.before[symbol] + self.rank(symbol, row[todo])
            steps[todo] += 1
        return self.sample[row] + steps


class Windows:
    """A block of windows: words as numbers from 1 on, and the items of each window."""

    def __init__(self, rows: list[tuple[int, tuple]]):
        distinct = sorted({w for _, w in rows})
        number = {w: i for i, w in enumerate(distinct)}
        self.vocabulary = np.unique(np.array([h for w in distinct for h in w], np.uint64))
        self.lengths = np.array([len(w) for w in distinct], np.int64)
        self.patterns = np.zeros((len(distinct), int(self.lengths.max(initial=1))), np.int64)
        for i, w in enumerate(distinct):
            self.patterns[i, -len(w):] = np.searchsorted(self.vocabulary, np.array(w, np.uint64)) + 1
        pairs = np.array(sorted({(number[w], item) for item, w in rows}), np.int64).reshape(-1, 2)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        self.items = pairs[:, 1]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, 0 for those of no window."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def window_blocks(benchmark: DataFrame, size: int = WORDS, block: int = BLOCK_WINDOWS) -> Iterator[Windows]:
    """The windows of all items, in blocks of bounded size."""
    rows = []
    for item, text in benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        part = np.frombuffer(text.encode("utf-8"), np.uint8)
        words = words_of(part, np.zeros(1, np.int64))[2].tolist()
        for i in range(max(len(words) - size, 0) + 1 if words else 0):
            rows.append((item, tuple(words[i: i + size])))
            if len(rows) >= block:
                yield Windows(rows)
                rows = []
    if rows:
        yield Windows(rows)


def occurrences(windows: Windows, numbers: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in a line of word numbers; ``text_of``: text of each word."""
    least = int(windows.lengths.min())
    known = numbers > 0
    breaks = np.flatnonzero(np.diff(text_of, prepend=-1, append=-1))
    low, high = common.runs(known)
    inner = breaks[(breaks > 0) & (breaks < len(known))]
    inner = inner[known[inner] & known[inner - 1]]                 # a stretch ends with its text
    low, high = np.sort(np.concatenate([low, inner])), np.sort(np.concatenate([high, inner]))
    long_enough = high - low >= least
    low, high = low[long_enough], high[long_enough]
    if not len(low):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = common.ranges(low, high + 1)                            # each stretch and a separator after it
    ends = np.cumsum(high - low + 1) - 1
    line = numbers[np.minimum(place, len(numbers) - 1)].copy()
    line[ends] = 0
    index = FmIndex(line)
    first, stop = index.search(windows.patterns, windows.lengths)
    window = np.repeat(np.arange(len(first)), stop - first)
    return window, place[index.locate(common.ranges(first, stop))]


class Shard:
    """Documents of a task whose words are indexed together."""

    def __init__(self):
        self.rows: list[pa.RecordBatch] = []
        self.parts: list[tuple] = []
        self.texts = self.known = self.bytes = 0

    def add(self, windows: Windows, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        part = data[offsets[0]: offsets[-1]]
        heads = offsets[:-1] - offsets[0]
        low, high, hashes = words_of(part, heads)
        text = np.searchsorted(offsets - offsets[0], low, side="right") - 1
        numbers = windows.numbers(hashes)
        first = (offsets - offsets[0])[text]
        # one text is below 2 GB, a shard's texts and a block's words are few
        self.parts.append(tuple(x.astype(np.int32) for x in (numbers, text + self.texts, low - first, high - first)))
        self.rows.append(rows)
        self.texts += len(offsets) - 1
        self.known += int(np.count_nonzero(numbers))
        self.bytes += len(part)

    @property
    def full(self) -> bool:
        return self.known >= SHARD_WORDS or self.bytes >= SHARD_BYTES

    def results(self, windows: Windows):
        """Rows, words per text, (text, item) pairs, and removal spans as (text, first word, end, first byte, end)."""
        numbers, text, low, high = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        self.parts = []
        window, first = occurrences(windows, numbers, text)
        change = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + windows.lengths[window], -1)
        hit = np.cumsum(change)[:-1] > 0
        count = windows.first[window + 1] - windows.first[window]
        pairs = np.column_stack([np.repeat(text[first], count), windows.items[common.ranges(windows.first[window], windows.first[window + 1])]])
        begin = hit & ~(np.concatenate([[False], hit[:-1]]) & np.concatenate([[False], text[1:] == text[:-1]]))
        finish = hit & ~(np.concatenate([hit[1:], [False]]) & np.concatenate([text[1:] == text[:-1], [False]]))
        number = np.arange(len(text)) - np.searchsorted(text, text)
        spans = np.column_stack([text[begin], number[begin], number[finish] + 1, low[begin], high[finish]])
        rows = pa.Table.from_batches(self.rows).combine_chunks()
        return rows, np.bincount(text, minlength=self.texts), np.unique(pairs, axis=0), spans


def _scan(batches, column: int, windows: Windows):
    shard = Shard()
    for batch in batches:
        offsets, data = common.utf8(batch.column(column))
        for low, high in common.slices(offsets, 2 << 20):
            shard.add(windows, batch.slice(low, high - low), data, offsets[low: high + 1])
            if shard.full:
                yield shard.results(windows)
                shard = Shard()
    if shard.texts:
        yield shard.results(windows)


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _united(before: list, spans: np.ndarray) -> np.ndarray:
    """Spans of earlier blocks of windows and of this one, merged word by word."""
    old = np.array([(i, *(h[k] for k in SPAN)) for i, hits in enumerate(before) for h in hits or ()], np.int64).reshape(-1, 5)
    rows = np.concatenate([old, spans])
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    reach = np.maximum.accumulate(rows[:, 2] + rows[:, 0] * (1 << 40)) - rows[:, 0] * (1 << 40)
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] > reach[:-1])
    at = np.flatnonzero(fresh)
    out = rows[at].copy()
    if len(at):
        out[:, 2], out[:, 4] = np.maximum.reduceat(rows[:, 2], at), np.maximum.reduceat(rows[:, 4], at)
    return out


SPAN = ["word", "word_end", "byte", "byte_end"]
HITS = "array<struct<" + ", ".join(f"{k}: long" for k in SPAN) + ">>"


def _passes(docs: DataFrame, benchmark: DataFrame, size: int, last: str) -> DataFrame:
    """One pass per block of windows over rows that also hold the hits so far; the last one finishes them as ``last`` says."""
    common.ship(docs.sparkSession)
    at, columns = docs.columns.index("text"), len(docs.columns)
    spare = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))       # no column begins so
    held = [spare + "hits", spare + "items"]

    def run(batches, windows, final):
        for rows, n_words, pairs, spans in _scan(batches, at, windows):
            n = rows.num_rows
            if rows.num_columns > columns:
                spans = _united(rows.column(columns).to_pylist(), spans)
                old = [(i, item) for i, items in enumerate(rows.column(columns + 1).to_pylist()) for item in items]
                pairs = np.unique(np.concatenate([np.array(old, np.int64).reshape(-1, 2), pairs]), axis=0)
            own = [rows.column(i).combine_chunks() for i in range(columns)]
            items = _lists(pairs[:, 0], n, pa.array(pairs[:, 1]))
            hits = _lists(spans[:, 0], n, pa.StructArray.from_arrays([pa.array(spans[:, k + 1]) for k in range(4)], SPAN))
            names = rows.column_names[:columns]
            if final and last == "cut":
                own[at] = _cut(own[at], spans)
                made = pa.RecordBatch.from_arrays(own, names)
            elif final:
                n_hit = np.bincount(spans[:, 0], weights=spans[:, 2] - spans[:, 1], minlength=n).astype(np.int64)
                made = pa.RecordBatch.from_arrays([own[0], pa.array(n_words), pa.array(n_hit), items, hits], ["doc_id", "n_words", "n_hit", "items", "hits"])
            else:
                made = pa.RecordBatch.from_arrays([*own, hits, items], [*names, *held])
            yield made

    blocks = window_blocks(benchmark, size)
    now = next(blocks, None) or (Windows([(0, (0,))]) if last == "find" else None)
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    finished = plain if last == "cut" else f"doc_id long, n_words long, n_hit long, items array<long>, hits {HITS}"
    while now is not None:
        following = next(blocks, None)
        schema = finished if following is None else f"{plain}, {held[0]} {HITS}, {held[1]} array<long>"
        docs = docs.mapInArrow(functools.partial(run, windows=now, final=following is None), schema)
        now = following
    return docs


def _cut(texts: pa.Array, spans: np.ndarray) -> pa.Array:
    if not len(spans):
        return texts
    values = texts.to_pylist()
    first = np.flatnonzero(np.diff(spans[:, 0], prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(spans)]):
        i = int(spans[a, 0])
        raw, out, done = values[i].encode("utf-8"), [], 0
        for low, high in spans[a:b, 3:].tolist():
            out.append(raw[done:low])
            done = high
        values[i] = b"".join([*out, raw[done:]]).decode("utf-8")
    return pa.array(values, texts.type)


def find(docs: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ascending item_ids with an occurring window) and hits (spans of words and bytes)."""
    return _passes(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, size, "find")


def removed(docs: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """The documents without the benchmark's words: the hit spans are cut out of ``text``; all rows and columns stay."""
    return _passes(docs, benchmark, size, "cut")
