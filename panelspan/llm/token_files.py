"""Token files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

An id is replaced by its rank among all ids of the corpus (most frequent first, ties by id), so frequent ids take one
byte.  A file is a Parquet folder of blocks in ascending order of doc_id.  A block holds whole documents: their doc_ids
and counts, one control byte per four ranks (two bits each: bytes of the rank less one) and the bytes of the ranks,
little-endian, without padding.  ``vocabulary`` beside it maps ranks to ids.  Reading looks up, for each control byte,
which data bytes go where in a table of 256 rows.

Defined results: null and empty texts hold their end id alone; rows with equal doc_id are ordered by their text; a null
doc_id comes first; an empty table gives empty files; texts of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspan.llm import common, tokens
from panelspan.sources.stage import fresh_path

BLOCK = 500_000             # ids of a block, unless one document has more

_LENGTH = np.array([sum((c >> 2 * k & 3) + 1 for k in range(4)) for c in range(256)], np.int64)
_SOURCE = np.zeros((256, 16), np.int64)
_USED = np.zeros((256, 16), np.uint8)
for _c in range(256):
    _at = 0
    for _k in range(4):
        for _b in range((_c >> 2 * _k & 3) + 1):
            _SOURCE[_c, 4 * _k + _b], _USED[_c, 4 * _k + _b] = _at, 255
            _at += 1


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    padded = np.zeros(-(-len(values) // 4) * 4, "<u4")
    padded[: len(values)] = values
    code = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    groups = code.reshape(-1, 4)
    control = groups[:, 0] | groups[:, 1] << 2 | groups[:, 2] << 4 | groups[:, 3] << 6
    data = padded.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values back, by table lookup."""
    codes = np.frombuffer(control, np.uint8)
    length = _LENGTH[codes]
    first = np.cumsum(length) - length
    raw = np.frombuffer(data, np.uint8)
    where = np.minimum(first[:, None] + _SOURCE[codes], max(len(raw) - 1, 0))
    return (raw[where] & _USED[codes]).view("<u4").ravel()[:count] if len(raw) else np.empty(0, "<u4")


def _tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows in order of doc_id within and across partitions: part, at (ids of the partition before), doc_id, n, ids.

    Rows without ids hold the task's counts instead: an id as doc_id, its count as n.
    """
    def run(batches):
        encoder = tokens.encoder(vocabulary)
        part, at = TaskContext.get().partitionId(), 0
        seen = np.zeros(encoder.size, np.int64)
        for batch in batches:
            for low, high, data, offsets in tokens.texts(batch, 1):
                ids, total = tokens.with_end(*encoder.encode(data, offsets)[:2])
                seen += np.bincount(ids, minlength=encoder.size)
                ends = np.cumsum(total)
                raw = pa.py_buffer(ids.astype("<u4" if encoder.size > 1 << 16 else "<u2").tobytes())
                width = 4 if encoder.size > 1 << 16 else 2
                lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(total), [None, pa.py_buffer(np.concatenate([[0], ends * width]).astype(np.int64).tobytes()), raw])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(total), part)), pa.array(at + ends - total), batch.column(0).slice(low, high - low), pa.array(total), lists.cast(pa.binary())], NAMES)
                at += int(ends[-1])
        used = np.flatnonzero(seen)
        empty = pa.nulls(len(used), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), part)), pa.array(np.zeros(len(used), np.int64)), pa.array(used), pa.array(seen[used]), empty], NAMES)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ranges are found from ids and a hash, so no texts travel to the driver; rows of one doc_id lie in order of that hash
    order = ["doc_id", F.xxhash64("text")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(run, "part long, at long, doc_id long, n long, ids binary")


NAMES = ["part", "at", "doc_id", "n", "ids"]


def write(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encode all texts and write ``path``/blocks and ``path``/vocabulary."""
    spark = docs.sparkSession
    common.ship(spark)
    vocabulary = vocabulary or tokens.default_vocabulary()
    held = common.staged(_tokenised(docs, vocabulary), "ids")
    # as many rows as the vocabulary has ids
    counts = held.where("ids is null").groupBy(F.col("doc_id").alias("id")).agg(F.sum("n").alias("n"))
    ranked = counts.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).cast("long").alias("rank"), "id", "n")
    ranked.write.parquet(f"{path}/vocabulary")
    order = spark.read.parquet(f"{path}/vocabulary").orderBy("rank").select("id").collect()
    ranks = np.zeros(max((r[0] for r in order), default=0) + 1, np.uint32)
    ranks[[r[0] for r in order]] = np.arange(len(order))
    # a partition's first id: as many rows as there are partitions
    sizes = held.where("ids is not null").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    bases = dict(zip([r[0] for r in sizes], np.cumsum([0, *(r[1] for r in sizes)]).tolist()))
    wide = len(ranks) > 1 << 16

    def run(batches):
        rows: list[tuple] = []

        def block():
            ids = ranks[np.frombuffer(b"".join(r[4] for r in rows), "<u4" if wide else "<u2")]
            control, data = encode(ids)
            out = [[bases[rows[0][0]] + rows[0][1]], [[r[2] for r in rows]], [[r[3] for r in rows]], [control], [data]]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, TYPES)], BLOCKS)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if rows and (row[0] != rows[0][0] or row[1] != rows[-1][1] + rows[-1][3] or row[1] + row[3] - rows[0][1] > BLOCK):
                    yield block()
                rows.append(row)
        if rows:
            yield block()

    # staged files are read in any order; the files of the format follow each other
    coded = held.where("ids is not null").mapInArrow(run, BLOCK_SCHEMA)
    coded.repartitionByRange("first").sortWithinPartitions("first").write.option("compression", "zstd").parquet(f"{path}/blocks")
    common.drop(held)


BLOCKS = ["first", "doc_ids", "counts", "control", "data"]
TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
BLOCK_SCHEMA = "first long, doc_ids array<long>, counts array<long>, control binary, data binary"


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if wanted."""
    common.ship(spark)
    order = spark.read.parquet(f"{path}/vocabulary").orderBy("rank").select("id").collect()
    ids_of = np.array([r[0] for r in order], "<u4")

    def run(batches):
        for batch in batches:
            for first, names, counts, control, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                counts = np.array(counts, np.int64)
                ends = np.cumsum(counts)
                ids = ids_of[decode(control, data, int(ends[-1]))]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                columns = [pa.array(names, pa.int64()), pa.array(first + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write token files into the shared folder and read them back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "panelspan-tokens")
    write(docs, path, vocabulary)
    return read(spark, path)
