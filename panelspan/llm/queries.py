"""The registered corpus queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspan.llm import decontaminate, exact_dedup, hard_negatives, html_extract, langid, line_dedup, minhash, packing, prefix_trie, secret_scan, suffix_dedup, token_files, vector_links


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_table(spark, folder, "documents")))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.summary(_table(spark, folder, "documents"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.main_text(_table(spark, folder, "pages"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predict(_table(spark, folder, "documents"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(_table(spark, folder, "documents"))


def op9_vector_links(spark: SparkSession, folder: str) -> DataFrame:
    return vector_links.links(_table(spark, folder, "embeddings"))


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.groups(_table(spark, folder, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.deduplicate(spark, f"{folder}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.rebuilt(_table(spark, folder, "conversations")))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, folder, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_secrets, op2_line_dedup, op3_suffix_dedup, op4_decontaminate, op5_html_extraction, op6_packing, op7_language_id,
    op8_token_files, op9_vector_links, op10_minhash, op11_exact_dedup, op12_prefix_trie, op13_hard_negatives)}

#: The other queries have no SQL counterpart; see the README.
ORACLE: dict[str, str] = {
    "op11_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    # crc32 goes through the half-byte table of its polynomial
    "op12_prefix_trie": """
        WITH named AS (
            SELECT conv_id, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS name,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list(struct_pack(name := name, words := words) ORDER BY turn NULLS FIRST, name) AS turns FROM named GROUP BY conv_id),
        fixed AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580,
                          3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[] AS half),
        hashed AS (
            SELECT conv_id, turns, (4294967295 - list_reduce(
                list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, byte: xor(xor(xor(crc, byte) >> 4, half[1 + (xor(crc, byte) & 15)]) >> 4,
                                   half[1 + (xor(xor(crc, byte) >> 4, half[1 + (xor(crc, byte) & 15)]) & 15)]))) % 4 AS h
            FROM own, fixed),
        built AS (
            SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
            FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
        begun AS (
            SELECT conv_id, list_transform(turns, lambda t: t.name) AS path, turns, unnest(range(len(turns) + 1)) AS depth FROM built),
        node AS (
            SELECT list_slice(path, 1, depth) AS way, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   coalesce(any_value(CASE WHEN depth > 0 THEN turns[depth].words END), 0) AS words,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends
            FROM begun GROUP BY way, depth),
        family AS (
            SELECT p.way, p.depth, p.conv_id, p.n_convs, p.words, p.ends, count(c.way) AS n_children
            FROM node p LEFT JOIN node c ON c.depth = p.depth + 1 AND list_slice(c.way, 1, p.depth) = p.way GROUP BY ALL),
        summed AS (
            SELECT list_slice(way, 1, d) AS way, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved
            FROM (SELECT *, unnest(range(depth + 1)) AS d FROM family) GROUP BY list_slice(way, 1, d))
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves,
               saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
        FROM family f JOIN summed s ON s.way = f.way LEFT JOIN node p ON p.depth = f.depth - 1 AND p.way = list_slice(f.way, 1, f.depth - 1)""",
    "op13_hard_negatives": """
        WITH whole AS (
            SELECT row_number() OVER () AS id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), false)),
        scored AS (
            SELECT a.id AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM whole a JOIN whole b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
        positive AS (
            SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored WHERE same
            QUALIFY place <= 5),
        negative AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id NULLS LAST)::INTEGER AS rank
            FROM positive p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
            QUALIFY rank <= 3)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative""",
}
