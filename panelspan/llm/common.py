"""Helpers shared by the corpus operators: shipping code, staged tables, Arrow text access and hashing."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from panelspan.sources.stage import file_system, fresh_path

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="panelspan-code-"), "panelspan_code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES: list[list[DataFrame]] = []


def staged(frame: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``frame`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs its running tasks only, never a finished stage.  The write's own shuffle files
    are dropped as soon as it ends.  Within ``scratch`` the table goes at the end of the block, with ``keep`` it outlives it.
    """
    spark = frame.sparkSession
    path = fresh_path(spark, f"panelspan-{name}")
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        # lists of hashed words hardly repeat within a file: a dictionary of them would be built in vain
        frame.write.options(**{"compression": "zstd", "parquet.enable.dictionary#words.list.element": "false"}).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(frame.schema).parquet(path)
    out._staged = path
    scope = len(_SCOPES) - (2 if keep else 1)
    if scope >= 0:
        _SCOPES[scope].append(out)
    return out


def drop(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for frame in frames:
        system, target = file_system(frame.sparkSession, frame._staged)
        system.delete(target, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables staged in the block are deleted at its end: whatever leaves it must be staged with ``keep``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        drop(*_SCOPES.pop())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


_BYTES = (np.random.default_rng(20260101).integers(0, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


_HELD = 1 << 22             # powers that a worker keeps; longer tables go with the text they were made for


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = _TABLES
    if len(tables["up"]) < n:
        tables = {}
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            table = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            table[0] = 1
            tables[key] = np.cumprod(table)
        if n <= _HELD:
            _TABLES.update(tables)
    return tables["up"][:n], tables["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hash of any byte range of a buffer in constant time (polynomial over random byte values, modulo 2**64)."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _BYTES):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.sums[high] - self.sums[low]) * self.down[low] + (high - low).astype(np.uint64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every maximal run of True."""
    edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers of the ranges [low, high), concatenated."""
    length = high - low
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(low - (ends - length), length)


def whole_groups(batches, keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows from batches sorted by ``keys``; a group never lies in two of them."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            last = np.ones(count, bool)
            for key in keys:
                value = np.array(table.column(key))
                last &= value == value[-1]
            cut = int(last.argmax())                               # the last group may go on
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                count -= cut
    if count:
        yield pa.Table.from_batches(held)
