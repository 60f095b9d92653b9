"""Queries over the document corpus: scans, splits, budgets, pre-tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import pretokenize, utf8_len
from ..operators.compression import eval_texts_union
from ..operators.corpus import (
    char_budget,
    doc_crop,
    ordered_corpus,
    running_chars,
    shard_stride,
    train_val_split,
    with_row_group,
)
from ..operators.prefix import int_div
from ..operators.vocabulary import adjacent_pair_counts, pretoken_counts
from ..session import scratch_path
from ..sources.corpus import corpus_scan as scan_folder
from ..sources.corpus import download_summary as summarize_downloads
from ..sources.corpus import missing_shards as find_missing
from ..sources.corpus import shard_manifest
from ..sources.row_groups import row_group_scan
from . import fixtures, sql
from .registry import joined, query


@query("""
SELECT 'documents.parquet' AS shard, count(*) AS n_docs, count(*) - 1 AS last_row, sum(length(text))::BIGINT AS n_chars
FROM documents
""")
def corpus_scan(spark, sf_dir):
    return scan_folder(spark, f"{sf_dir}/documents.parquet").groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("row").alias("last_row"), F.sum(F.length("text")).alias("n_chars")
    )


@query("""
SELECT CASE WHEN source = (SELECT max(source) FROM documents) THEN 'val' ELSE 'train' END AS split,
       source AS shard, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars
FROM documents GROUP BY ALL
""", name="train_val_split")
def split_query(spark, sf_dir):
    docs = fixtures.corpus(spark, sf_dir)
    parts = [train_val_split(docs, s).select(F.lit(s).alias("split"), "shard", F.length("text").alias("n"))
             for s in ("train", "val")]
    return parts[0].unionByName(parts[1]).groupBy("split", "shard").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars")
    )


@query(f"""
WITH {sql.RANKED}
SELECT source AS shard, row_group, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM dealt WHERE rank = 1 GROUP BY ALL
""", name="shard_stride")
def stride_query(spark, sf_dir):
    docs = with_row_group(fixtures.corpus(spark, sf_dir), fixtures.ROWS_PER_GROUP)
    return shard_stride(docs, 1, fixtures.WORLD).groupBy("shard", "row_group").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("row").alias("first_doc"), F.max("row").alias("last_doc")
    )


GROUP_ROWS, SHARD_DOCS = 64, 2500


def row_group_corpus(spark, sf_dir):
    """``documents`` as files of ``SHARD_DOCS`` ids with real row groups of ``GROUP_ROWS`` rows."""
    path = scratch_path(spark, "row-groups")
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "shard", F.format_string("%09d", int_div(F.col("doc_id"), SHARD_DOCS))
    )
    sorted_docs = docs.repartition("shard").sortWithinPartitions("shard", "doc_id")
    sorted_docs.write.option("parquet.block.row.count.limit", GROUP_ROWS).partitionBy("shard").parquet(path)
    return path


@query(f"""
WITH placed AS (
  SELECT doc_id, doc_id // {SHARD_DOCS} AS shard, row_number() OVER (PARTITION BY doc_id // {SHARD_DOCS} ORDER BY doc_id) - 1 AS row, text FROM documents
)
SELECT shard, (row // {GROUP_ROWS})::INT AS row_group, count(*) AS n_docs, min(row) AS first_row, min(doc_id) AS first_doc, sum(length(text))::BIGINT AS n_chars
FROM placed WHERE row // {GROUP_ROWS} % {fixtures.WORLD} = 1 GROUP BY ALL
""", name="row_group_stride")
def row_group_query(spark, sf_dir):
    rows = row_group_scan(spark, row_group_corpus(spark, sf_dir), "doc_id bigint, text string", rank=1, world=fixtures.WORLD)
    return rows.groupBy(F.regexp_extract("shard", "shard=([0-9]+)", 1).cast("bigint").alias("shard"), "row_group").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("row").alias("first_row"), F.min("doc_id").alias("first_doc"), F.sum(F.length("text")).alias("n_chars")
    )


def _present(spark, sf_dir):
    """Documents as downloaded shards: every id not divisible by three."""
    docs = fixtures.table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0")
    return docs.select(F.format_string("shard_%05d.parquet", "doc_id").alias("name"))


MANIFEST = """
manifest AS (SELECT i AS shard_index, 'shard_' || lpad(i::VARCHAR, 5, '0') || '.parquet' AS name FROM range(1823) t(i)),
present AS (SELECT DISTINCT 'shard_' || lpad(doc_id::VARCHAR, 5, '0') || '.parquet' AS name FROM documents WHERE doc_id % 3 <> 0)"""


@query(f"""
WITH {MANIFEST}
SELECT shard_index, name FROM manifest WHERE name NOT IN (SELECT name FROM present)
""", name="missing_shards")
def missing_query(spark, sf_dir):
    return find_missing(shard_manifest(spark), _present(spark, sf_dir)).select("shard_index", "name")


@query(f"""
WITH {MANIFEST}
SELECT count(p.name) AS n_done, count(*) AS n_total FROM manifest m LEFT JOIN present p ON p.name = m.name
""", name="download_summary")
def downloads_query(spark, sf_dir):
    return summarize_downloads(shard_manifest(spark), _present(spark, sf_dir))


@query("""
SELECT doc_id, length(substr(text, 1, 500)) AS n_chars, md5(substr(text, 1, 500)) AS digest FROM documents
""", name="doc_crop")
def crop_query(spark, sf_dir):
    return doc_crop(fixtures.corpus(spark, sf_dir), 500).select(
        F.col("row").alias("doc_id"), F.length("text").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("digest")
    )


@query("""
WITH t AS (
  SELECT source AS shard, doc_id, length(substr(text, 1, 10000)) AS n,
         coalesce(sum(length(substr(text, 1, 10000))) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM documents WHERE source <> (SELECT max(source) FROM documents)
)
SELECT shard, count(*) AS n_docs, max(doc_id) AS last_doc, sum(n)::BIGINT AS n_chars FROM t WHERE before <= 1000000 GROUP BY shard
""", name="char_budget")
def budget_query(spark, sf_dir):
    docs = doc_crop(train_val_split(fixtures.corpus(spark, sf_dir), "train"))
    return char_budget(docs, 1_000_000).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("row").alias("last_doc"), F.sum(F.length("text")).alias("n_chars")
    )


@query("""
SELECT doc_id, source AS shard,
       coalesce(sum(length(text)) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before
FROM documents
""", name="running_chars")
def running_query(spark, sf_dir):
    return running_chars(fixtures.corpus(spark, sf_dir)).select(F.col("row").alias("doc_id"), "shard", "chars_before")


@query("""
SELECT doc_id, source AS shard, row_number() OVER (ORDER BY source, doc_id) - 1 AS position FROM documents
""", name="ordered_corpus")
def ordered_query(spark, sf_dir):
    return ordered_corpus(fixtures.corpus(spark, sf_dir)).select(F.col("row").alias("doc_id"), "shard", "position")


@query(f"""
WITH {sql.RANKED},
firsts AS (
  SELECT 'train' AS name, min(source) AS shard FROM documents WHERE source <> (SELECT max(source) FROM documents)
  UNION ALL SELECT 'val', max(source) FROM documents
),
texts AS (
  SELECT 'item' || item_id AS name, text FROM benchmark
  UNION ALL
  SELECT f.name, string_agg(r.text, chr(10) ORDER BY r.doc_id) FROM firsts f JOIN ranked r ON r.source = f.shard
  WHERE r.row_group = 0 GROUP BY f.name
)
SELECT name, length(text) AS n_chars, md5(text) AS digest FROM texts
""", name="eval_texts_union")
def texts_query(spark, sf_dir):
    named = fixtures.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), "text"
    )
    docs = with_row_group(fixtures.corpus(spark, sf_dir), fixtures.ROWS_PER_GROUP)
    return eval_texts_union(named, docs).select(
        "name", F.length("text").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("digest")
    )


def pieces_of_documents(spark, sf_dir):
    return fixtures.corpus(spark, sf_dir).select("row", pretokenize(F.col("text")).alias("p"))


@query(f"""
SELECT doc_id, len(p) AS n_pieces, md5(array_to_string(p, chr(1))) AS digest
FROM (SELECT doc_id, {sql.pieces("text")} AS p FROM documents)
""", name="pretokenize")
def pretokenize_query(spark, sf_dir):
    return pieces_of_documents(spark, sf_dir).select(
        F.col("row").alias("doc_id"), F.size("p").alias("n_pieces"),
        F.md5(F.encode(F.array_join("p", "\x01"), "UTF-8")).alias("digest"),
    )


@query("""
SELECT doc_id, octet_length(encode(text)) AS n_bytes FROM documents
""", name="utf8_len")
def utf8_query(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", utf8_len(F.col("text")).alias("n_bytes"))


TRAIN_PIECES = f"""
SELECT token, count(*) AS n FROM (
  SELECT unnest({sql.pieces("substr(text, 1, 10000)")}) AS token FROM documents
  WHERE source <> (SELECT max(source) FROM documents)
) GROUP BY token"""


def train_words(spark, sf_dir):
    return pretoken_counts(doc_crop(train_val_split(fixtures.corpus(spark, sf_dir), "train")))


@query(TRAIN_PIECES, name="pretoken_counts")
def words_query(spark, sf_dir):
    return train_words(spark, sf_dir)


@query(TRAIN_PIECES + " ORDER BY n DESC, token LIMIT 100", name="top_pretokens")
def top_query(spark, sf_dir):
    return train_words(spark, sf_dir).orderBy(F.desc("n"), "token").limit(100)


@query(f"""
WITH words AS ({TRAIN_PIECES}),
lists AS (SELECT n, {sql.byte_ids("token")} AS s FROM words),
pairs AS (SELECT n, unnest(s[1:len(s) - 1]) AS left_id, unnest(s[2:]) AS right_id FROM lists WHERE len(s) > 1)
SELECT left_id, right_id, sum(n)::BIGINT AS n FROM pairs GROUP BY ALL
""", name="adjacent_pair_counts")
def pairs_query(spark, sf_dir):
    return adjacent_pair_counts(train_words(spark, sf_dir))


@query(f"""
WITH words AS (SELECT DISTINCT unnest({sql.pieces("text")}) AS token FROM documents)
SELECT token, array_to_string({sql.byte_ids("token")}, ',') AS symbols FROM words
""", name="byte_symbols")
def symbols_query(spark, sf_dir):
    """Symbols of the distinct pieces of all documents, whole texts."""
    from ..functions.codec import byte_symbols

    words = pretoken_counts(fixtures.corpus(spark, sf_dir))
    return words.select("token", joined(byte_symbols(F.col("token"))).alias("symbols"))
