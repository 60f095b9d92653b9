"""One query per operator, over whole tables, with the columns of the contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, best_fit, byte_bpe, conversation_repair, decision_lists, embedding_dedup, line_crf, merkle, minhash_dedup, prefix_counts, seekable, suffix_dedup, toxicity_chain

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
STATEMENTS: dict[str, str] = {}

VOCABULARY, RANKS = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken")
CAPACITY = 2048
TOKEN_LIMIT = 1024


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            STATEMENTS[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NEAR_VECTORS = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN counts USING (vec_id)
"""


@query(NEAR_VECTORS)
def op1_collision_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


NEAR_COPIES = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM tokens
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
  WHERE 100 * p.both >= 75 * (x.n + y.n - p.both)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT r.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, r.doc_id = r.component_id AS kept
FROM roots r LEFT JOIN sizes s USING (doc_id)
"""


@query(NEAR_COPIES)
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_lists.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    judged = decision_lists.judge(docs, rules)
    return judged.select("doc_id", *decision_lists.BASE, "base_failed", "kept", "rule")


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )
    counted = prefix_counts.token_counts(docs, VOCABULARY, TOKEN_LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars")


@query()
def op5_seekable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = seekable.write_ids(table(spark, sf_dir, "documents"), VOCABULARY)
    return seekable.read_ids(spark, manifest, digest=True)


@query()
def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = best_fit.write_sequences(table(spark, sf_dir, "documents"), VOCABULARY, CAPACITY)
    return best_fit.places(sequences)


@query()
def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    scored = line_crf.score(docs, line_crf.fit(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


@query()
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode_and_decode(docs, RANKS, tokenizers.PATTERN)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has one toxicity flag; low quality, which shouting and junk bring, goes first
    in the chain."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.lit(1) - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity_chain.fit(docs, labels, ["low_quality", "toxic"])
    scored = toxicity_chain.score(docs, chain)
    return scored.select(
        "doc_id", "p_low_quality", F.col("p_toxic").alias("score"), F.when(F.col("p_toxic") >= chain.limits[1], 1).otherwise(0).alias("toxic")
    )


REPEATS = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM bytes, unnest(range(0, len(h) // 2 - 49)) AS t(i)
), firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s
), hits AS (SELECT g.doc_id, g.i FROM strings g JOIN firsts f ON f.s = g.s WHERE f.first < g.doc_id
), steps AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 50 THEN 0 ELSE 1 END AS opens FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps
), runs AS (SELECT doc_id, run, min(i) AS low, max(i) + 50 AS high FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT r.doc_id, r.run, r.high - r.low AS gone,
    substr(b.h, 2 * coalesce(lag(r.high) OVER w, 0) + 1, 2 * (r.low - coalesce(lag(r.high) OVER w, 0))) AS before
  FROM runs r JOIN bytes b USING (doc_id) WINDOW w AS (PARTITION BY r.doc_id ORDER BY r.run)
), sums AS (
  SELECT doc_id, sum(gone) AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY run) AS head FROM gaps GROUP BY doc_id
), ends AS (SELECT doc_id, max(high) AS high FROM runs GROUP BY doc_id)
SELECT b.doc_id, CAST(len(b.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(s.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(s.head, '') || substr(b.h, 2 * coalesce(e.high, 0) + 1))) AS kept_sha256
FROM bytes b LEFT JOIN sums s USING (doc_id) LEFT JOIN ends e USING (doc_id)
"""


@query(REPEATS)
def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.when(F.col("kept").isNull(), F.col("digest")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"),
    )


REPAIRS = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS r(i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS uid,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda ch: CAST(ord(ch) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS harm
  FROM conversations, crc
), rows_after AS (
  SELECT conv_id, turn, uid, c, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed, range(CASE WHEN harm = 0 THEN 0 WHEN harm = 3 THEN 2 ELSE 1 END) AS copies(c)
), numbered AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, uid, c) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM rows_after WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), uid, c)
), faults AS (
  SELECT *, blank OR again AS gone, NOT blank AND again AS repeated, NOT blank AND NOT again AND cut AS short,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS wrong
  FROM numbered
), closure(st, k, mid) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (0, 2, 3), (1, 1, 2), (1, 2, 3), (2, 1, 3), (3, 1, 2)
), shifts(mid, symbol, st2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), moves AS (
  SELECT st, st2, symbol, repeat('I', k) AS ahead, 5 * k AS cost FROM closure JOIN shifts USING (mid)
), fronts(conv_id, i, st, cost, audit) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, 0, '' FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, st, best.cost, best.audit FROM (
    SELECT conv_id, i, st, min(struct_pack(cost := cost, audit := audit)) AS best FROM (
      SELECT f.conv_id, r.i, m.st2 AS st, f.cost + m.cost + m.own + CASE WHEN r.short AND m.letter <> 'D' THEN 5 ELSE 0 END AS cost,
        f.audit || m.ahead || m.letter AS audit
      FROM fronts f JOIN faults r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1
      JOIN (SELECT st, st2, symbol, ahead, cost, 0 AS own, 'K' AS letter FROM moves
        UNION ALL SELECT st, st2, symbol, ahead, cost, 1, 'R' FROM moves WHERE symbol IN ('u', 'a')
        UNION ALL SELECT st, st, NULL, '', 0, 2, 'D' FROM (VALUES (0), (1), (2), (3)) AS every(st)) m
      ON m.st = f.st AND (m.letter = 'D' OR NOT r.gone AND (m.letter = 'R' OR m.symbol = r.initial))
    ) GROUP BY conv_id, i, st)
), lasts AS (SELECT conv_id, coalesce(max(i), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN faults USING (conv_id) GROUP BY conv_id
), ends AS (
  SELECT f.conv_id, min(struct_pack(cost := f.cost + 5 * k, audit := f.audit || repeat('I', CAST(k AS INTEGER)))) AS best
  FROM fronts f JOIN lasts l ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.n = f.i JOIN closure c ON c.st = f.st AND c.mid IN (0, 3) GROUP BY f.conv_id
), letters AS (
  SELECT conv_id, pos, best.audit[pos] AS letter FROM ends, range(1, len(best.audit) + 1) AS t(pos)
), lines AS (
  SELECT conv_id, pos, letter, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER w AS place
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), kept AS (
  SELECT l.conv_id, pos, letter, place, r.role, r.text,
    max(CASE WHEN letter = 'K' AND place = 1 AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
  FROM lines l LEFT JOIN faults r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS repaired FROM kept GROUP BY conv_id
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(repeated) AS duplicate,
    count_if(short) AS truncated, count_if(wrong) AS illegal FROM faults GROUP BY conv_id
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit,
  sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ends e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query(REPAIRS)
def op11_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


MERKLE = r"""
WITH RECURSIVE valued AS (
  SELECT *, coalesce('=' || source, '') AS g, {values} AS head, {tail} AS full_text, {bare} AS bare_text FROM documents
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS r(i))
), leaves AS (
  SELECT doc_id, g, sha256(head || full_text) AS leaf, CASE WHEN
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 THEN sha256(head || bare_text) ELSE sha256(head || full_text) END AS tampered
  FROM valued, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves
), nodes(g, level, i, h, n) AS (
  SELECT g, 0, i, leaf, n FROM placed
  UNION ALL SELECT g, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), max((n + 2) // 3) FROM nodes WHERE n > 1 GROUP BY g, level, i // 3
), subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, i, h, n) AS (
  SELECT 0, i, subroot, n FROM subroots
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), max((n + 2) // 3) FROM tops WHERE n > 1 GROUP BY level, i // 3
), every AS (SELECT g, level, i, h, n FROM nodes UNION ALL SELECT NULL, level, i, h, n FROM tops
), steps AS (
  SELECT g, level, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM every WHERE n > 1 WINDOW w AS (PARTITION BY g, level, i // 3 ORDER BY i)
), paths AS (
  SELECT p.g, p.i, s.level, s.before, s.after FROM placed p JOIN steps s ON s.g = p.g AND s.i = p.i // CAST(3 ** s.level AS BIGINT)
  UNION ALL SELECT p.g, p.i, 100 + s.level, s.before, s.after FROM placed p JOIN subroots r ON r.g = p.g
    JOIN steps s ON s.g IS NULL AND s.i = r.i // CAST(3 ** s.level AS BIGINT)
), lists AS (
  SELECT g, i, list(struct_pack(b := before, a := after) ORDER BY level) AS path, string_agg(before || after, '' ORDER BY level) AS siblings FROM paths GROUP BY g, i
), folds(g, i, k, h) AS (
  SELECT g, i, 0, tampered FROM placed
  UNION ALL SELECT f.g, f.i, f.k + 1, sha256(l.path[f.k + 1].b || f.h || l.path[f.k + 1].a) FROM folds f JOIN lists l ON l.g = f.g AND l.i = f.i WHERE f.k < len(l.path)
), ends AS (SELECT g, i, arg_max(h, k) AS folded_root FROM folds GROUP BY g, i)
SELECT p.doc_id, p.leaf, r.subroot, t.h AS root, sha256(coalesce(l.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
FROM placed p JOIN subroots r ON r.g = p.g JOIN tops t ON t.n = 1 LEFT JOIN lists l ON l.g = p.g AND l.i = p.i JOIN ends e ON e.g = p.g AND e.i = p.i
"""


def _sized(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


@query(MERKLE.format(values=" || ".join(map(_sized, merkle.HASHED[:-1])), tail=_sized("text"), bare=_sized("replace(text, chr(10), '')")))
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))


NEIGHBOURS = """
WITH fine AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM fine q JOIN fine c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query(NEIGHBOURS)
def op13_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"), 5)
