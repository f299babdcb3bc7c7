"""Exact deduplication by a stream with keyed state on disk.

The files of a table are read as a stream.  Its state, one entry per digest in RocksDB, never expires: it holds the
content locator (file and row within it) and the stable identifier of the first row seen with that digest, and how many
rows had it.  Rows are folded into partial entries before they are shuffled, so a digest that most rows share moves one
small entry per task.  The state lies with the stream's checkpoint; a later call with the same ``state`` folder reads new
files only and keeps the first holders.

Rows whose digest occurs more than once are hits.  Their whole texts are compared, byte by byte, with the text at the
holder's locator; a row whose text differs in spite of an equal digest is grouped by its text instead.  Texts of other
rows are not moved beyond the one join by digest.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays, one without doc_id
only if none has one, and of rows with equal doc_id the one with the largest locator; ``keep_id`` is that row's doc_id
(null if none has one).  An empty table gives no rows.  Other columns of the table are not read, whatever their names.
Rows of files added after the stream ended belong to the next call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspan.llm import common
from panelspan.sources.stage import fresh_path

SHA256 = "sha2(text, 256)"
_STATE = "spark.sql.streaming.stateStore."


def _rows(frame: DataFrame, digest: str) -> DataFrame:
    """doc_id, text, locator and digest of each row."""
    meta = frame.metadataColumn("_metadata")
    return frame.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("at")).alias("locator")).withColumn("digest", F.expr(digest))


def remember(spark: SparkSession, path: str, state: str, digest: str = SHA256, files: int | None = None) -> DataFrame:
    """Bring the state in folder ``state`` up to date with the Parquet files of ``path``: digest, locator, first_id, n.

    ``files`` bounds the files of a micro-batch; None takes what is there in one.  The state has as many partitions as
    ``spark.sql.shuffle.partitions`` says at the first call.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    session = spark.newSession()                                   # leaves the caller's settings alone
    session.conf.set(_STATE + "providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set(_STATE + "rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set(_STATE + "rocksdb.allowFAllocate", "false")    # else 4 MB of disk per partition, however small
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    reader = session.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    path = path.rstrip("/")
    rows = _rows(reader.parquet(f"{path[:-1]}[{path[-1]}]"), digest)       # as a pattern it may also name a single file
    # the time of the micro-batch comes first: what is held is never displaced by a later row
    rows = rows.select("digest", F.struct(F.current_timestamp().alias("since"), "locator", "doc_id").alias("seen"))
    query = rows.groupBy("digest").agg(F.min("seen").alias("holder"), F.count("*").alias("n")).writeStream.format("noop").outputMode("update") \
        .option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    held = spark.read.format("statestore").load(f"{state}/stream")
    return held.select("key.digest", "value.min.locator", F.col("value.min.doc_id").alias("first_id"), F.col("value.count").alias("n"))


def deduplicate(spark: SparkSession, path: str, digest: str = SHA256, state: str | None = None, files: int | None = None) -> DataFrame:
    """One row per row of ``path``: doc_id, digest, keep_id, group_size, kept and, for members of a group, text."""
    state = state or fresh_path(spark, "panelspan-state")
    if not spark.read.parquet(path).limit(1).count():
        return spark.createDataFrame([], "doc_id long, digest string, keep_id long, group_size long, kept boolean, text string")
    shared = common.staged(remember(spark, path, state, digest, files).where("n > 1").select("digest", F.col("locator").alias("holder")), "holders")
    # merged whatever the sizes: where most rows are hits, holders outgrow any broadcast
    rows = _rows(spark.read.parquet(path), digest).join(shared.hint("merge"), "digest", "left") \
        .withColumn("text", F.when(F.col("holder").isNotNull(), F.col("text")))
    rows = common.staged(rows, "hits")
    alone = rows.where("holder is null").selectExpr("doc_id", "digest", "doc_id as keep_id", "1L as group_size", "true as kept", "text")
    members = rows.where("holder is not null")
    held = members.where("locator = holder").select("digest", F.col("text").alias("held"))
    # rows that only share the digest are told apart by their text, which is null for all others
    checked = members.join(held, "digest").withColumn("odd", F.when(F.col("text") != F.col("held"), F.col("text"))) \
        .select("doc_id", "locator", "digest", "odd", "text")
    groups = checked.groupBy("digest", "odd").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size")) \
        .withColumnsRenamed({"digest": "of", "odd": "but"})
    grouped = checked.join(groups, (F.col("digest") == F.col("of")) & F.col("odd").eqNullSafe(F.col("but"))).select(
        "doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("keep.locator")).alias("kept"), "text")
    return alone.unionByName(grouped)
