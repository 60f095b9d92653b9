"""Queries over vocabularies, token ids, packing and compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SPECIAL_TOKENS, special_id
from ..functions.codec import bpe_decode, bpe_encode
from ..functions.vocabulary import BYTE_LEVEL
from ..operators import bpe_training, compression, vocabulary
from ..operators.packing import next_token_targets, pack_sequences
from ..session import materialize, scratch_path
from ..sources.tokenizer_store import load_vocabulary, tokenizer_tables_read, tokenizer_tables_write
from . import fixtures, sql
from .corpus_queries import train_words
from .registry import joined, query, rounded

N_MERGES = 256
SMALL_VOCAB = 265 + N_MERGES
LONG_MERGES = 512  # enough for larger forecasts and a rewrite of the words
BATCH, SEQ = 4, 256
TRAIN_TEXTS = "(SELECT substr(text, 1, 10000) AS text FROM documents WHERE source <> (SELECT max(source) FROM documents))"
BPE = sql.bpe(N_MERGES, TRAIN_TEXTS)
MERGES = "SELECT i - 1 AS rank, left_id, right_id, 264 + i AS new_id FROM merges"


def small_vocab(spark, sf_dir):
    return bpe_training.bpe_train(train_words(spark, sf_dir), SMALL_VOCAB)


@query(f"WITH RECURSIVE {BPE}\n{MERGES}")
def bpe_train(spark, sf_dir):
    return vocabulary.merges_table(spark, small_vocab(spark, sf_dir))


@query(f"WITH RECURSIVE {sql.bpe(LONG_MERGES, TRAIN_TEXTS)}\n{MERGES}")
def bpe_train_512(spark, sf_dir):
    return vocabulary.merges_table(spark, bpe_training.bpe_train(train_words(spark, sf_dir), 265 + LONG_MERGES))


# Documents encoded with the learned merges: the distinct pieces of all documents go through the
# training's replacements, then they are put back in place.
ENCODED = f"""
WITH RECURSIVE {sql.bpe(N_MERGES, TRAIN_TEXTS, "documents")},
doc_pieces AS (
  SELECT doc_id, unnest(p) AS token, generate_subscripts(p, 1) AS pos
  FROM (SELECT doc_id, {sql.pieces("text")} AS p FROM documents)
),
encoded AS (
  SELECT doc_id, string_agg(k.s, '' ORDER BY pos) AS s FROM doc_pieces JOIN learned k USING (token) GROUP BY doc_id
)"""


def encoded_documents(spark, sf_dir, vocab=None):
    vocab = vocab or small_vocab(spark, sf_dir)
    return fixtures.corpus(spark, sf_dir).select("row", bpe_encode(F.col("text"), vocab).alias("ids"))


@query(ENCODED + """
SELECT doc_id, len(s) // 5 AS n_tokens,
       md5(array_to_string(list_transform(regexp_extract_all(s, '[0-9]+'), lambda x: x::INT), ',')) AS digest
FROM encoded
""", name="bpe_encode")
def encode_query(spark, sf_dir):
    return encoded_documents(spark, sf_dir).select(
        F.col("row").alias("doc_id"), F.size("ids").alias("n_tokens"), F.md5(joined(F.col("ids"))).alias("digest")
    )


def decoded_documents(spark, sf_dir, vocab=None):
    vocab = vocab or small_vocab(spark, sf_dir)
    return fixtures.corpus(spark, sf_dir).select(
        "row", bpe_decode(bpe_encode(F.col("text"), vocab), vocab).alias("text")
    )


@query("SELECT doc_id, md5(text) AS digest FROM documents", name="bpe_decode")
def decode_query(spark, sf_dir):
    return decoded_documents(spark, sf_dir).select(
        F.col("row").alias("doc_id"), F.md5(F.encode("text", "UTF-8")).alias("digest")
    )


@query("""
SELECT doc_id, octet_length(encode(text)) AS n_tokens,
       md5(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT), ',')) AS digest
FROM documents
""", name="tokenize_with")
def tokenize_query(spark, sf_dir):
    docs = fixtures.corpus(spark, sf_dir)
    done = vocabulary.tokenize_with(docs, lambda: lambda text: list(text.encode()))
    return done.select(F.col("row").alias("doc_id"), F.size("ids").alias("n_tokens"), F.md5(joined(F.col("ids"))).alias("digest"))


# Tokens of the small vocabulary as hexadecimal bytes, one merge after another.
TOKEN_HEX = f"WITH RECURSIVE {BPE},\n{sql.token_hex(N_MERGES)}"
SPECIAL_ROWS = ", ".join(f"({i}, '{name}')" for i, name in enumerate(SPECIAL_TOKENS))


@query(f"""{TOKEN_HEX}
SELECT token_id, h AS bytes_hex, false AS is_special, (len(h) // 2)::INT AS n_bytes FROM tokens
UNION ALL
SELECT i, hex(encode(name)), true, 0 FROM (VALUES {SPECIAL_ROWS}) t(i, name)
""", name="tokenizer_tables")
def tables_query(spark, sf_dir):
    path = scratch_path(spark, "tokenizer")
    tokenizer_tables_write(spark, small_vocab(spark, sf_dir), path)
    tables = tokenizer_tables_read(spark, path)
    assert load_vocabulary(spark, path).size == SMALL_VOCAB
    return tables["vocab"].join(tables["token_bytes"], "token_id").select(
        "token_id", F.hex("bytes").alias("bytes_hex"), "is_special", "n_bytes"
    )


# A byte that starts or continues a multi-byte character decodes, alone, to the
# three-byte replacement character; whole characters keep their length.
@query(f"""{TOKEN_HEX},
lone AS (
  SELECT token_id, h, len(h) // 2 AS n,
         len(regexp_extract_all(regexp_replace(regexp_replace(h, '(..)', ',\\1', 'g'), ',(C[2-9A-F]|D.),[89AB].', '', 'g'), ',[89A-F].')) AS n_broken
  FROM tokens
)
SELECT token_id, n::INT AS raw_bytes, (n + 2 * n_broken)::INT AS decoded_bytes FROM lone
UNION ALL SELECT i, 0, 0 FROM range(9) t(i)
""", name="token_byte_length")
def byte_length_query(spark, sf_dir):
    vocab = small_vocab(spark, sf_dir)
    raw = vocabulary.token_bytes_table(spark, vocab, "raw").withColumnRenamed("n_bytes", "raw_bytes")
    decoded = vocabulary.token_bytes_table(spark, vocab, "decoded").withColumnRenamed("n_bytes", "decoded_bytes")
    return raw.join(decoded, "token_id")


@query(f"{TOKEN_HEX}\nSELECT token_id FROM tokens", name="vocab_minus_special")
def plain_vocab_query(spark, sf_dir):
    table = vocabulary.vocab_table(spark, small_vocab(spark, sf_dir))
    return vocabulary.vocab_minus_special(table).select("token_id")


@query(f"""
WITH chars AS (
  SELECT c AS token, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) GROUP BY c
)
SELECT token, n, CASE WHEN strlen(token) = 1 THEN {sql.byte_id("ascii(token)")} END AS token_id FROM chars
""", name="vocab_lookup")
def lookup_query(spark, sf_dir):
    chars = fixtures.corpus(spark, sf_dir).select(F.explode(F.split("text", "")).alias("token"))
    counted = chars.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.vocab_lookup(counted, vocabulary.vocab_table(spark, BYTE_LEVEL))


@query("""
SELECT role, count(*) AS n, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 3 END AS start_id FROM conversations GROUP BY role
""", name="special_id")
def special_query(spark, sf_dir):
    ids = F.create_map(*[F.lit(v) for name in SPECIAL_TOKENS for v in (name, special_id(name))])
    marker = F.concat(F.lit("<|"), F.col("role"), F.lit("_start|>"))
    roles = fixtures.table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return roles.select("role", "n", F.try_element_at(ids, marker).alias("start_id"))


def stored_ids(spark, sf_dir):
    return materialize(fixtures.with_ids(fixtures.ranked_corpus(spark, sf_dir)), "pack-ids")


def packed_documents(spark, sf_dir, docs=None):
    return pack_sequences(stored_ids(spark, sf_dir) if docs is None else docs, BATCH, SEQ)


@query(f"""
WITH {sql.DOC_IDS},
{sql.RANKED},
stream AS (
  SELECT rank, tok, row_number() OVER (PARTITION BY rank ORDER BY shard, doc_id, pos) - 1 AS g
  FROM (SELECT d.rank, i.shard, i.doc_id, unnest(i.ids) AS tok, generate_subscripts(i.ids, 1) AS pos
        FROM doc_ids i JOIN dealt d USING (doc_id))
),
bins AS (SELECT rank, g // 1025 AS batch, g % 1025 AS k, tok, count(*) OVER (PARTITION BY rank, g // 1025) AS n FROM stream),
halves AS (
  SELECT rank, batch, k // 256 AS row_in_batch, k, tok, 'i' AS side FROM bins WHERE n = 1025 AND k < 1024
  UNION ALL
  SELECT rank, batch, (k - 1) // 256, k, tok, 't' FROM bins WHERE n = 1025 AND k > 0
)
SELECT rank, batch, row_in_batch,
       md5(string_agg(tok::VARCHAR, ',' ORDER BY k) FILTER (WHERE side = 'i')) AS inputs,
       md5(string_agg(tok::VARCHAR, ',' ORDER BY k) FILTER (WHERE side = 't')) AS targets
FROM halves GROUP BY rank, batch, row_in_batch
""", name="pack_sequences")
def pack_query(spark, sf_dir):
    return packed_documents(spark, sf_dir).select(
        "rank", "batch", "row_in_batch",
        F.md5(joined(F.col("inputs"))).alias("inputs"), F.md5(joined(F.col("targets"))).alias("targets"),
    )


@query(f"""
WITH {sql.TOKENS},
pairs AS (SELECT lang, token_id, lead(token_id) OVER (PARTITION BY doc_id ORDER BY pos) AS target_id FROM tokens)
SELECT lang, token_id, target_id, count(*) AS n FROM pairs WHERE target_id IS NOT NULL GROUP BY ALL
""", name="next_token_targets")
def targets_query(spark, sf_dir):
    docs = fixtures.with_ids(fixtures.corpus(spark, sf_dir, "lang")).select("lang", "ids")
    return next_token_targets(docs).groupBy("lang", "token_id", "target_id").agg(F.count(F.lit(1)).alias("n"))


def stats(spark, sf_dir):
    vocabs = {"bytes": BYTE_LEVEL, "bpe": small_vocab(spark, sf_dir)}
    return compression.compression_stats(fixtures.corpus(spark, sf_dir, "lang"), vocabs, name="lang")


STATS = ENCODED + """,
sizes AS (
  SELECT 'bytes' AS tokenizer, lang, octet_length(encode(text)) AS b, octet_length(encode(text)) AS t FROM documents
  UNION ALL
  SELECT 'bpe', lang, octet_length(encode(text)), coalesce(len(s) // 5, 0) FROM documents LEFT JOIN encoded USING (doc_id)
),
stats AS (SELECT tokenizer, lang, sum(b)::BIGINT AS n_bytes, sum(t)::BIGINT AS n_tokens FROM sizes GROUP BY ALL),
sides AS (
  SELECT lang, b.n_tokens AS base_tokens, o.n_tokens AS ours_tokens, b.n_bytes / b.n_tokens AS base_ratio, o.n_bytes / o.n_tokens AS ours_ratio
  FROM stats b JOIN stats o USING (lang) WHERE b.tokenizer = 'bytes' AND o.tokenizer = 'bpe'
)"""


@query(STATS + """
SELECT tokenizer, lang, n_bytes, n_tokens, round(n_bytes / n_tokens, 6) AS ratio FROM stats
""", name="compression_stats")
def stats_query(spark, sf_dir):
    return stats(spark, sf_dir).withColumn("ratio", rounded(F.col("ratio")))


@query(STATS + """
SELECT lang, base_tokens, ours_tokens, round(base_ratio, 6) AS base_ratio, round(ours_ratio, 6) AS ours_ratio FROM sides
""", name="join_tokenizer_results")
def sides_query(spark, sf_dir):
    return compression.join_tokenizer_results(stats(spark, sf_dir), "bytes", "bpe", name="lang").withColumns({
        "base_ratio": rounded(F.col("base_ratio")), "ours_ratio": rounded(F.col("ours_ratio")),
    })


@query(STATS + """
SELECT lang, round((base_tokens - ours_tokens) / base_tokens * 100, 6) AS relative_diff,
       CASE WHEN base_ratio > ours_ratio THEN 'bytes' WHEN ours_ratio > base_ratio THEN 'bpe' ELSE 'Tie' END AS better
FROM sides
""", name="compression_compare")
def compare_query(spark, sf_dir):
    return compression.compression_compare(stats(spark, sf_dir), "bytes", "bpe", name="lang").select(
        "lang", rounded(F.col("relative_diff")).alias("relative_diff"), "better"
    )


@query("""
SELECT t.tokenizer, lang, count(*) AS n_texts, 0::BIGINT AS n_failed
FROM documents, (VALUES ('bytes'), ('bpe')) t(tokenizer) GROUP BY ALL
""", name="roundtrip_check")
def roundtrip_query(spark, sf_dir):
    vocabs = {"bytes": BYTE_LEVEL, "bpe": small_vocab(spark, sf_dir)}
    return compression.roundtrip_check(fixtures.corpus(spark, sf_dir, "lang"), vocabs, name="lang")
