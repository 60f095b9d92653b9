"""Streaming queries, run to the end of the given data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocabulary import BYTE_LEVEL
from ..operators import scoring
from ..operators.corpus import train_val_split
from ..operators.vocabulary import token_bytes_table
from ..session import materialize, scratch_path
from ..streaming import chat
from ..streaming import corpus as streams
from . import fixtures, sql
from .conversation_queries import messages
from .evaluation_queries import BYTE_ROWS, V, histogram
from .registry import joined, query
from .token_queries import BATCH, SEQ

N_SLICES = 4


def staged(df, key, n=N_SLICES, files=1):
    """Write ``df`` as a growing folder: ``files`` files per range of ``key``, in order."""
    path = scratch_path(df.sparkSession, "staged")
    edges = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    width = (edges["hi"] - edges["lo"]) // n + 1
    for i in range(n):
        low = edges["lo"] + i * width
        part = df.filter((F.col(key) >= low) & (F.col(key) < low + width))
        part.repartition(files).write.mode("append").parquet(path)
    return path


def documents(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents")
    # The table is a file or a folder of files. A stream takes a plain path as a folder; a pattern may match either.
    return streams.corpus_stream(spark, f"{sf_dir}/{{documents}}.parquet", docs.schema)


@query("SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source", name="corpus_stream")
def stream_query(spark, sf_dir):
    out = scratch_path(spark, "stream")
    streams.append_parquet(documents(spark, sf_dir), f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars")
    )


@query(f"WITH {sql.DOC_IDS}\nSELECT doc_id, md5(array_to_string(ids, ',')) AS digest FROM doc_ids", name="stream_tokenize")
def tokenize_query(spark, sf_dir):
    return tokenized_stream(spark, sf_dir).select("doc_id", F.md5(joined(F.col("ids"))).alias("digest"))


def tokenized_stream(spark, sf_dir):
    out = scratch_path(spark, "stream")
    # one file is one task, so a stream of a single file is spread first
    source = documents(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    tokens = streams.stream_tokenize(source).select("doc_id", "ids")
    streams.append_parquet(tokens, f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/data")


@query(f"""
WITH {sql.DOC_IDS},
stream AS (
  SELECT rank, tok, row_number() OVER (PARTITION BY rank ORDER BY doc_id, pos) - 1 AS g
  FROM (SELECT doc_id % 3 AS rank, doc_id, unnest(ids) AS tok, generate_subscripts(ids, 1) AS pos FROM doc_ids)
),
bins AS (SELECT rank, g // 1025 AS batch, g % 1025 AS k, tok, count(*) OVER (PARTITION BY rank, g // 1025) AS n FROM stream)
SELECT rank, batch, k // 256 AS row_in_batch, md5(string_agg(tok::VARCHAR, ',' ORDER BY k)) AS inputs
FROM bins WHERE n = 1025 AND k < 1024 GROUP BY ALL
""", name="stream_pack")
def pack_query(spark, sf_dir):
    return packed_stream(spark, sf_dir).select(
        "rank", "batch", "row_in_batch", F.md5(joined(F.col("inputs"))).alias("inputs")
    )


def packed_stream(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text")
    path, out = staged(docs, "doc_id", files=8), scratch_path(spark, "stream")
    source = streams.corpus_stream(spark, path, docs.schema, max_files=8)
    tokens = streams.stream_tokenize(source).select(
        (F.col("doc_id") % 3).alias("rank"), F.lit("all").alias("shard"), F.col("doc_id").alias("row"), "ids"
    )
    streams.stream_pack(tokens, f"{out}/data", f"{out}/state", BATCH, SEQ).awaitTermination()
    return streams.read_batches(spark, f"{out}/data")


@query("SELECT doc_id, octet_length(encode(text)) + 1 AS n_tokens, 1 AS n_copies FROM documents", name="resume")
def resume_query(spark, sf_dir):
    """A stream that stops half way and is restarted from its checkpoint."""
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scratch_path(spark, "stream")
    middle = docs.agg(F.expr("max(doc_id) div 2")).first()[0]
    for part in (docs.filter(F.col("doc_id") <= middle), docs.filter(F.col("doc_id") > middle)):
        part.write.mode("append").parquet(f"{out}/source")
        source = streams.corpus_stream(spark, f"{out}/source", docs.schema, max_files=2)
        tokens = streams.stream_tokenize(source).select("doc_id", F.size("ids").alias("n_tokens"))
        streams.append_parquet(tokens, f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("n_copies"))


@query(f"""
WITH {sql.DOC_IDS},
{sql.RANKED},
ends AS (
  SELECT i.shard, d.row_group, len(i.ids) AS n, sum(len(i.ids)) OVER (ORDER BY i.shard, i.doc_id) AS stop
  FROM doc_ids i JOIN dealt d USING (doc_id) WHERE d.rank = 0
),
last AS (SELECT ((max(stop) // 1025 - 1) // 2) * 1025 + 1024 AS place FROM ends),
state AS (SELECT shard, row_group FROM ends, last WHERE stop - n <= place AND place < stop)
SELECT d.source AS shard, d.row_group, d.rank, count(*) AS n_docs FROM dealt d, state s
WHERE d.source > s.shard OR (d.source = s.shard AND d.row_group >= (s.row_group // 3 + 1) * 3) GROUP BY ALL
""", name="resume_after_row_group")
def after_query(spark, sf_dir):
    """What is left for the ranks after the middle batch of rank 0, by the state that came with it."""
    from ..operators.corpus import after_row_group
    from ..operators.packing import loader_state
    from .token_queries import packed_documents

    states = materialize(loader_state(packed_documents(spark, sf_dir), BATCH).filter("rank = 0"), "states")
    middle = states.agg(F.expr("max(batch) div 2")).first()[0]
    state = states.filter(F.col("batch") == middle).first()
    rest = after_row_group(fixtures.ranked_corpus(spark, sf_dir), state["shard"], state["row_group"], fixtures.WORLD)
    return rest.groupBy("shard", "row_group", "rank").agg(F.count(F.lit(1)).alias("n_docs"))


@query(f"""
WITH {BYTE_ROWS}
SELECT lang, sum(val.n)::BIGINT AS n_bytes, round(sum(val.n * nats) / (ln(2) * sum(val.n)), 6) AS bpb
FROM val JOIN model USING (target_id) GROUP BY lang
""", name="stream_bpb")
def bpb_query(spark, sf_dir):
    train = histogram(spark, sf_dir, "train").groupBy("target_id").agg(F.sum("n_targets").alias("n"))
    model = scoring.unigram_scorer(train, V)
    val = train_val_split(fixtures.corpus(spark, sf_dir, "lang"), "val").select("row", "lang", "text")
    path, out = staged(val, "row"), scratch_path(spark, "stream")
    source = streams.corpus_stream(spark, path, val.schema, max_files=1)
    targets = streams.stream_tokenize(source).select("lang", F.explode("ids").alias("target_id"))
    scores = targets.join(F.broadcast(model), "target_id")  # one row per token id
    bpb = streams.stream_bpb(scores, token_bytes_table(spark, BYTE_LEVEL), ["lang"])
    streams.keep_latest(bpb, f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/data").select("lang", "n_bytes", F.round("bpb", 6).alias("bpb"))


@query(f"""
WITH said AS (
  SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body, text FROM conversations WHERE role <> 'system'
),
parts AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN [1] || {sql.byte_ids("body")} || [2, 3] ELSE {sql.byte_ids("text")} || [4] END AS ids
  FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM said WHERE role = 'assistant' OR body <> '')
  WHERE role = 'user' OR before = 'user'
)
SELECT conv_id, turn, 0::BIGINT AS segment, md5(array_to_string(ids, ',')) AS digest,
       (1 + coalesce(sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
FROM parts
""", name="stream_chat_context")
def chat_query(spark, sf_dir):
    rows = messages(spark, sf_dir)
    path, out = staged(rows, "turn", 3), scratch_path(spark, "stream")
    events = chat.chat_events(streams.corpus_stream(spark, path, rows.schema, max_files=1))
    places = chat.stream_chat_context(events)
    streams.append_parquet(places, f"{out}/data", f"{out}/state").awaitTermination()
    placed = chat.placed_events(spark.read.parquet(f"{out}/data"), chat.chat_events(rows))
    return placed.select(
        "conv_id", "turn", "segment", "start", F.md5(joined(F.col("ids"))).alias("digest")
    )
