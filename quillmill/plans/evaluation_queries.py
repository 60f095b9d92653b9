"""Queries over score tables, few-shot items and logits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions import logits as lg
from ..functions.codec import bpe_encode
from ..functions.sequences import (
    common_prefix_len,
    common_suffix_len,
    crop_left,
    cropped_index,
    pad_right,
)
from ..functions.vocabulary import BYTE_LEVEL
from ..operators import evaluation as ev
from ..operators import sampling, scoring
from ..operators.corpus import train_val_split
from ..operators.packing import next_token_targets
from ..operators.vocabulary import token_bytes_table
from ..session import scratch_path
from ..sources import items as item_files
from . import fixtures, sql
from .conversation_queries import RENDERED, messages
from .registry import joined, query, rounded

V = BYTE_LEVEL.size
KEYS = ["task", "idx"]


def byte_table(spark):
    return token_bytes_table(spark, BYTE_LEVEL)


def histogram(spark, sf_dir, split):
    """Target tokens of a split, counted per language before anything is joined."""
    docs = fixtures.with_ids(train_val_split(fixtures.corpus(spark, sf_dir, "lang"), split), prepend=None)
    return docs.select("lang", F.explode("ids").alias("target_id")).groupBy("lang", "target_id").agg(
        F.count(F.lit(1)).alias("n_targets")
    )


BYTE_ROWS = f"""
bytes AS (
  SELECT source, lang, unnest({sql.byte_ids("text")}) AS target_id FROM documents
),
train AS (
  SELECT target_id, count(*) AS n FROM bytes WHERE source <> (SELECT max(source) FROM documents) GROUP BY target_id
),
val AS (
  SELECT lang, target_id, count(*) AS n FROM bytes WHERE source = (SELECT max(source) FROM documents) GROUP BY ALL
),
model AS (
  SELECT i AS target_id, -ln((coalesce(n, 0) + 1) / ((SELECT sum(n) FROM train) + 265)) AS nats
  FROM range(265) t(i) LEFT JOIN train ON train.target_id = i
)"""


@query(f"""
WITH {BYTE_ROWS}
SELECT lang, round(sum(val.n * nats), 4) AS nats, sum(val.n)::BIGINT AS n_bytes,
       round(sum(val.n * nats) / (ln(2) * sum(val.n)), 6) AS bpb
FROM val JOIN model USING (target_id) GROUP BY lang
""")
def unigram_bpb_by_lang(spark, sf_dir):
    train = histogram(spark, sf_dir, "train").groupBy("target_id").agg(F.sum("n_targets").alias("n"))
    model = scoring.unigram_scorer(train, V)
    val = histogram(spark, sf_dir, "val").join(F.broadcast(model), "target_id")  # one row per token id
    result = scoring.bits_per_byte(val, byte_table(spark), ["lang"], weight="n_targets")
    return result.select("lang", F.round("nats", 4).alias("nats"), "n_bytes", rounded(F.col("bpb")).alias("bpb"))


@query(f"""
WITH {BYTE_ROWS}
SELECT target_id::INT AS target_id, round(nats, 6) AS nats FROM model
""")
def ngram_scorer(spark, sf_dir):
    train = histogram(spark, sf_dir, "train").groupBy("target_id").agg(F.sum("n_targets").alias("n"))
    return scoring.unigram_scorer(train, V).select("target_id", rounded(F.col("nats")).alias("nats"))


@query(f"""
WITH {sql.TOKENS},
pairs AS (SELECT shard, token_id AS prev_id, lead(token_id) OVER (PARTITION BY doc_id ORDER BY pos) AS target_id FROM tokens),
train AS (SELECT * FROM pairs WHERE target_id IS NOT NULL AND shard <> (SELECT max(source) FROM documents)),
counts AS (SELECT prev_id, target_id, count(*) AS n FROM train GROUP BY ALL),
totals AS (SELECT prev_id, sum(n) AS total FROM counts GROUP BY prev_id),
val AS (SELECT * FROM pairs WHERE target_id IS NOT NULL AND shard = (SELECT max(source) FROM documents)),
scored AS (
  SELECT -ln((coalesce(c.n, 0) + 1) / (coalesce(t.total, 0) + 265)) AS nats
  FROM val v LEFT JOIN counts c ON c.prev_id = v.prev_id AND c.target_id = v.target_id LEFT JOIN totals t ON t.prev_id = v.prev_id
)
SELECT count(*) AS n_bytes, round(sum(nats), 3) AS nats, round(sum(nats) / (ln(2) * count(*)), 6) AS bpb FROM scored
""")
def bits_per_byte(spark, sf_dir):
    counts, heads, val = _bigrams(spark, sf_dir, with_val=True)
    pairs = val.groupBy(F.col("token_id").alias("prev_id"), "target_id").agg(F.count(F.lit(1)).alias("n_targets"))
    scores = scoring.ngram_scores(pairs, counts, heads, V)
    result = scoring.bits_per_byte(scores, byte_table(spark), weight="n_targets")
    return result.select("n_bytes", F.round("nats", 3).alias("nats"), rounded(F.col("bpb")).alias("bpb"))


def _bigrams(spark, sf_dir, with_val=False):
    docs = fixtures.corpus(spark, sf_dir)
    train = next_token_targets(fixtures.with_ids(train_val_split(docs, "train")).select("ids"))
    counts, heads = scoring.bigram_scorer(train)
    if not with_val:
        return counts, heads
    return counts, heads, next_token_targets(fixtures.with_ids(train_val_split(docs, "val")).select("ids"))


@query("""
SELECT lang, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents GROUP BY lang
""", name="join_token_bytes")
def bytes_query(spark, sf_dir):
    docs = fixtures.with_ids(fixtures.corpus(spark, sf_dir, "lang"))
    counted = docs.select("lang", F.explode("ids").alias("target_id")).groupBy("lang", "target_id").agg(
        F.count(F.lit(1)).alias("n"))
    return scoring.join_token_bytes(counted, byte_table(spark)).groupBy("lang").agg(
        F.sum(F.col("n") * F.col("n_bytes")).alias("n_bytes")
    )


def masked_targets(spark, sf_dir):
    """Rendered conversations as score rows: unsupervised targets are ignored, and
    the loss of a target is made up from its id."""
    from ..operators.conversations import render_conversation

    rendered = render_conversation(messages(spark, sf_dir))
    supervised = F.zip_with("ids", "mask", lambda i, m: F.when(m == 1, i).otherwise(-1))
    rows = rendered.select("conv_id", F.explode(F.slice(supervised, F.lit(2), F.size("ids") - 1)).alias("target_id"))
    counted = rows.groupBy("conv_id", "target_id").agg(F.count(F.lit(1)).alias("n"))
    scores = counted.withColumn("nats", F.log(F.col("target_id") + 2))
    return scoring.join_token_bytes(scores, byte_table(spark))


MASKED = RENDERED + """,
whole AS (SELECT conv_id, ([0] || flatten(list(ids ORDER BY turn)))[1:2048] AS ids, ([0] || flatten(list(mask ORDER BY turn)))[1:2048] AS mask
          FROM segs GROUP BY conv_id),
rows AS (SELECT conv_id, unnest(ids[2:]) AS id, unnest(mask[2:]) AS m FROM whole)"""


@query(f"""
WITH {MASKED}
SELECT conv_id, count(*) AS n_targets, count(*) FILTER (WHERE m = 1 AND id >= 9) AS n_bytes,
       round(coalesce(sum(CASE WHEN m = 1 THEN ln(id + 2) END), 0), 6) AS nats
FROM rows GROUP BY conv_id
""", name="mask_ignored_targets")
def mask_query(spark, sf_dir):
    masked = scoring.mask_ignored_targets(masked_targets(spark, sf_dir))
    return masked.groupBy("conv_id").agg(
        F.sum("n").alias("n_targets"), F.sum(F.col("n_bytes") * F.col("n")).alias("n_bytes"),
        rounded(F.sum(F.col("nats") * F.col("n"))).alias("nats"),
    )


@query(f"""
WITH {MASKED}
SELECT conv_id, round(coalesce(sum(CASE WHEN m = 1 AND id >= 9 THEN ln(id + 2) END), 0), 6) AS nats FROM rows GROUP BY conv_id
""", name="drop_special_from_metric")
def special_loss_query(spark, sf_dir):
    kept = scoring.drop_special_from_metric(scoring.mask_ignored_targets(masked_targets(spark, sf_dir)))
    return kept.groupBy("conv_id").agg(rounded(F.sum(F.col("nats") * F.col("n"))).alias("nats"))


@query(f"""
WITH {BYTE_ROWS},
long AS (SELECT doc_id, source, unnest({sql.byte_ids("text")}) AS target_id FROM documents)
SELECT doc_id, count(*) AS n_scored, round(sum(nats), 4) AS nats FROM long JOIN model USING (target_id)
WHERE source = (SELECT max(source) FROM documents) GROUP BY doc_id
""", name="score_with")
def score_query(spark, sf_dir):
    train = histogram(spark, sf_dir, "train").groupBy("target_id").agg(F.sum("n_targets").alias("n"))
    # one number per vocabulary entry
    table = [r["nats"] for r in scoring.unigram_scorer(train, V).orderBy("target_id").collect()]

    def make_scorer():
        nats = np.array(table)
        return lambda ids, lengths: (nats[ids[:, 1:]], np.zeros_like(ids[:, 1:]))

    docs = fixtures.with_ids(train_val_split(fixtures.corpus(spark, sf_dir), "val"))
    scored = scoring.score_with(docs, make_scorer, key="row").filter(F.size("nats") > 0)
    return scored.select(
        F.col("row").alias("doc_id"), F.size("nats").cast("bigint").alias("n_scored"),
        F.round(F.aggregate("nats", F.lit(0.0), lambda a, x: a + x), 4).alias("nats"),
    )


# --- items and prompts ------------------------------------------------------------


@query(f"WITH {sql.ITEMS}\nSELECT item_id, task, idx FROM shuffled", name="seeded_shuffle")
def shuffle_query(spark, sf_dir):
    return sampling.seeded_shuffle(fixtures.halves(spark, sf_dir)).select("item_id", "task", "idx")


@query(f"WITH {sql.ITEMS}\nSELECT item_id, task, idx FROM shuffled WHERE idx < 5", name="limit_per_task")
def limit_query(spark, sf_dir):
    return sampling.limit_per_task(sampling.seeded_shuffle(fixtures.halves(spark, sf_dir)), 5).select("item_id", "task", "idx")


@query(f"WITH {sql.ITEMS}\nSELECT task, idx, count(*) OVER (PARTITION BY task) - 1 AS n_candidates FROM shuffled",
       name="fewshot_candidates")
def candidates_query(spark, sf_dir):
    shuffled = sampling.seeded_shuffle(fixtures.halves(spark, sf_dir)).select("task", "idx")
    return sampling.fewshot_candidates(shuffled)


@query(f"WITH {sql.ITEMS}\nSELECT task, idx, draw, other_idx FROM shot_draws", name="fewshot_sample")
def sample_query(spark, sf_dir):
    return sampling.fewshot_sample(fixtures.eval_items(spark, sf_dir), F.col("num_fewshot"))


@query(f"""
WITH {sql.ITEMS}
SELECT i.task, i.idx, coalesce(string_agg(s.item_id::VARCHAR, ',' ORDER BY s.draw), '') AS shot_items
FROM items i LEFT JOIN shots s ON s.task = i.task AND s.idx = i.idx GROUP BY i.task, i.idx
""", name="fewshot_gather")
def gather_query(spark, sf_dir):
    items = fixtures.eval_items(spark, sf_dir)
    drawn = sampling.fewshot_sample(items, F.col("num_fewshot"))
    shots = sampling.fewshot_gather(items, drawn, ["item_id"])
    return shots.select("task", "idx", joined(F.transform("shots", lambda s: s["item_id"])).alias("shot_items"))


def _render(task_type):
    def run(spark, sf_dir):
        items = fixtures.with_shots(fixtures.eval_items(spark, sf_dir)).filter(F.col("task_type") == task_type)
        return ev.render_prompts(items).select("task", "idx", F.posexplode("prompts").alias("option", "prompt")).select(
            "task", "idx", "option", F.md5(F.encode("prompt", "UTF-8")).alias("digest")
        )
    return run


for _name, _type in (("render_mc", ev.MC), ("render_schema", ev.SCHEMA), ("render_lm", ev.LM)):
    query(f"""
WITH {sql.ITEMS}
SELECT task, idx, option - 1 AS option, md5(prompt) AS digest
FROM (SELECT task, idx, unnest(prompts) AS prompt, generate_subscripts(prompts, 1) AS option FROM prompts WHERE task_type = '{_type}')
""", name=_name)(_render(_type))


def encoded(spark, sf_dir, items=None):
    items = items if items is not None else fixtures.eval_items(spark, sf_dir)
    return ev.encode_prompts(ev.render_prompts(fixtures.with_shots(items)))


def spanned(spark, sf_dir, items=None):
    return ev.continuation_spans(encoded(spark, sf_dir, items))[0]


@query(f"WITH {sql.OPTIONS}\nSELECT DISTINCT task, idx, cpre AS n_shared FROM common", name="common_prefix_len")
def prefix_query(spark, sf_dir):
    return encoded(spark, sf_dir).select("task", "idx", common_prefix_len(F.col("seqs")).alias("n_shared"))


@query(f"WITH {sql.OPTIONS}\nSELECT DISTINCT task, idx, csuf AS n_shared FROM common", name="common_suffix_len")
def suffix_query(spark, sf_dir):
    return encoded(spark, sf_dir).select("task", "idx", common_suffix_len(F.col("seqs")).alias("n_shared"))


@query(f"WITH {sql.OPTIONS}\nSELECT task, idx, option, start_at, end_at FROM spans", name="continuation_span")
def span_query(spark, sf_dir):
    return spanned(spark, sf_dir).select("task", "idx", F.inline("spans")).drop("seq")


@query(f"""
WITH {sql.OPTIONS}
SELECT task, idx, option, md5(array_to_string(seq[greatest(len(seq) - 400, 0) + 1:], ',')) AS digest,
       start_at - greatest(len(seq) - 400, 0) AS start_at, end_at - greatest(len(seq) - 400, 0) AS end_at
FROM spans
""", name="crop_left")
def crop_query(spark, sf_dir):
    rows = spanned(spark, sf_dir).select("task", "idx", F.inline("spans"))
    return rows.select(
        "task", "idx", "option", F.md5(joined(crop_left(F.col("seq"), 400))).alias("digest"),
        cropped_index(F.col("start_at"), F.col("seq"), 400).alias("start_at"),
        cropped_index(F.col("end_at"), F.col("seq"), 400).alias("end_at"),
    )


@query(f"""
WITH {sql.OPTIONS},
widths AS (SELECT *, max(len(seq)) OVER (PARTITION BY task, idx) AS width FROM opts)
SELECT task, idx, option, width, md5(array_to_string(seq || list_transform(range(width - len(seq)), lambda x: 0), ',')) AS digest
FROM widths
""", name="pad_right")
def pad_query(spark, sf_dir):
    padded = encoded(spark, sf_dir).select("task", "idx", F.posexplode(pad_right(F.col("seqs"), 0)).alias("option", "seq"))
    return padded.select("task", "idx", "option", F.size("seq").alias("width"), F.md5(joined(F.col("seq"))).alias("digest"))


# --- scores and decisions ---------------------------------------------------------

MAX_PROMPT = 512  # prompts with several examples are longer and lose their beginning


def scored(spark, sf_dir, items=None):
    counts, heads = _bigrams(spark, sf_dir)
    targets = ev.span_targets(ev.crop_spans(spanned(spark, sf_dir, items), MAX_PROMPT), KEYS)
    return scoring.ngram_scores(targets, counts, heads, V)


def decisions(spark, sf_dir):
    items = fixtures.eval_items(spark, sf_dir)
    return ev.decide_items(scored(spark, sf_dir, items), items, KEYS)


@query(f"""
WITH {sql.SCORES}
SELECT task, idx, option, round(avg(nats), 6) AS mean_loss FROM scores GROUP BY ALL
""", name="option_mean_loss")
def loss_query(spark, sf_dir):
    return ev.option_mean_loss(scored(spark, sf_dir), KEYS).withColumn("mean_loss", rounded(F.col("mean_loss")))


@query(f"""
WITH {sql.DECISIONS}
SELECT task, idx, first(option ORDER BY mean_loss NULLS LAST, option)::INT AS picked FROM losses GROUP BY task, idx
""", name="pick_option")
def pick_query(spark, sf_dir):
    return ev.pick_option(ev.option_mean_loss(scored(spark, sf_dir), KEYS), KEYS)


@query(f"""
WITH {sql.SCORES}
SELECT task, idx, option, bool_and(pred_id = target_id) AS correct, count(*) AS n_tokens FROM scores GROUP BY ALL
""", name="exact_match")
def match_query(spark, sf_dir):
    scores = scored(spark, sf_dir)
    sizes = scores.groupBy(*KEYS, "option").agg(F.count("target_id").alias("n_tokens"))
    return ev.exact_match(scores, [*KEYS, "option"]).join(sizes, [*KEYS, "option"])


@query(f"""
WITH {sql.DECISIONS}
SELECT task, round(avg(correct::INT), 6) AS accuracy, count(*) AS n_items FROM decisions GROUP BY task
""", name="task_accuracy")
def accuracy_query(spark, sf_dir):
    return ev.task_accuracy(decisions(spark, sf_dir)).withColumn("accuracy", rounded(F.col("accuracy")))


def baselines(spark, sf_dir):
    """25 percent for choices, nothing for language modelling."""
    tasks = fixtures.halves(spark, sf_dir).select("task").distinct()
    return tasks.withColumn("baseline", F.when(F.col("task") == "task3", 0.0).otherwise(25.0))


CENTRED = sql.DECISIONS + """,
acc AS (SELECT task, avg(correct::INT) AS accuracy, CASE WHEN task = 'task3' THEN 0.0 ELSE 25.0 END AS baseline
        FROM decisions GROUP BY task),
centred AS (SELECT task, accuracy, baseline, (accuracy - 0.01 * baseline) / (1 - 0.01 * baseline) AS centered FROM acc)"""


@query(f"""
WITH {CENTRED}
SELECT task, round(accuracy, 6) AS accuracy, round(baseline::DOUBLE, 6) AS baseline, round(centered, 6) AS centered FROM centred
""", name="centered_accuracy")
def centred_query(spark, sf_dir):
    result = ev.centered_accuracy(ev.task_accuracy(decisions(spark, sf_dir)), baselines(spark, sf_dir))
    return result.select("task", *[rounded(F.col(c)).alias(c) for c in ("accuracy", "baseline", "centered")])


@query(f"WITH {CENTRED}\nSELECT round(avg(centered), 6) AS core FROM centred", name="core_metric")
def core_query(spark, sf_dir):
    result = ev.centered_accuracy(ev.task_accuracy(decisions(spark, sf_dir)), baselines(spark, sf_dir))
    return ev.core_metric(result).select(rounded(F.col("core")).alias("core"))


@query(f"""
WITH lists AS (SELECT doc_id, {sql.byte_ids("text")} AS ids FROM documents),
long AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos, len(ids) AS n FROM lists),
hits AS (
  SELECT a.doc_id, a.id = b.id AS hit FROM long a JOIN long b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
  WHERE a.pos >= 9 AND a.pos < a.n - 1
)
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE hit) AS n_hits FROM hits GROUP BY doc_id
""", name="join_prediction_target")
def prediction_query(spark, sf_dir):
    # predicts that every token repeats
    rows = fixtures.corpus(spark, sf_dir).select(
        F.col("row").alias("doc_id"), bpe_encode(F.col("text")).alias("ids")
    ).withColumns({"pred_ids": F.col("ids"), "start_at": F.lit(10), "end_at": F.size("ids")})
    # Asked after the comparison, the optimizer would make the steps a second time for the filter.
    compared = ev.join_prediction_target(rows.filter(F.col("end_at") > F.col("start_at")))
    return compared.select(
        "doc_id", F.size("steps").cast("bigint").alias("n_tokens"),
        F.size(F.filter("steps", lambda s: s["hit"])).cast("bigint").alias("n_hits"),
    )


def source_accuracy(spark, sf_dir):
    """Label quality per source as a task accuracy, with toxicity as its baseline."""
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("task"))
    labels = fixtures.table(spark, sf_dir, "labels").join(docs, "doc_id")
    decided = labels.select("task", (F.col("quality") == 1).alias("correct"))
    base = labels.groupBy("task").agg((F.avg("toxic") * 100).alias("baseline"))
    return ev.task_accuracy(decided), base


SOURCES = """
acc AS (
  SELECT source AS task, avg(quality) AS accuracy, avg(toxic) * 100 AS baseline, count(*) AS n_items
  FROM labels JOIN documents USING (doc_id) GROUP BY source
),
centred AS (
  SELECT *, (accuracy - 0.01 * baseline) / (1 - 0.01 * baseline) AS centered FROM acc
)"""


@query(f"""
WITH {SOURCES}
SELECT task, n_items, round(accuracy, 6) AS accuracy, round(baseline, 6) AS baseline FROM centred
""", name="join_baseline")
def baseline_query(spark, sf_dir):
    return ev.join_baseline(*source_accuracy(spark, sf_dir)).select(
        "task", "n_items", rounded(F.col("accuracy")).alias("accuracy"), rounded(F.col("baseline")).alias("baseline")
    )


@query("SELECT DISTINCT source AS task FROM labels JOIN documents USING (doc_id) WHERE source = 'src3'", name="missing_baselines")
def missing_baseline_query(spark, sf_dir):
    accuracy, base = source_accuracy(spark, sf_dir)
    return ev.missing_baselines(accuracy, base.filter("task <> 'src3'"))  # staged: one baseline is withheld


@query(f"""
WITH {SOURCES}
SELECT task AS "Task", printf('%.6f', accuracy) AS "Accuracy", printf('%.6f', centered) AS "Centered" FROM centred
UNION ALL SELECT 'CORE', '', printf('%.6f', avg(centered)) FROM centred
""", name="eval_report_sink")
def report_query(spark, sf_dir):
    report = ev.report_with_total(ev.centered_accuracy(*source_accuracy(spark, sf_dir)))
    path = scratch_path(spark, "report")
    item_files.eval_report_sink(report, path)
    return spark.read.csv(path, header=True).fillna("")


@query(f"""
WITH {sql.ITEMS}
SELECT item_id, CASE WHEN task_type <> 'language_modeling' THEN g END AS gold,
       CASE task_type WHEN 'multiple_choice' THEN array_to_string(choices, '|') END AS choices,
       CASE task_type WHEN 'schema' THEN array_to_string(options, '|') END AS context_options,
       CASE WHEN task_type <> 'multiple_choice' THEN tail END AS continuation
FROM items
""", name="task_items_scan")
def items_query(spark, sf_dir):
    path = scratch_path(spark, "items")
    fixtures.eval_items(spark, sf_dir).write.json(path)
    schema = StructType(list(item_files.ITEM_SCHEMA)).add("item_id", LongType())
    return item_files.task_items_scan(spark, path, schema).select(
        "item_id", "gold", F.array_join("choices", "|").alias("choices"),
        F.array_join("context_options", "|").alias("context_options"), "continuation",
    )


@query(f"""
WITH {sql.TASKS}
SELECT task, task_type, 'items/' || task AS dataset_uri, num_fewshot, delimiter FROM tasks
""", name="task_table")
def task_query(spark, sf_dir):
    return fixtures.tasks(spark, sf_dir)


@query("""
SELECT source AS task, round(avg(toxic) * 100, 6) AS baseline FROM labels JOIN documents USING (doc_id) GROUP BY source
""", name="baseline_scan")
def baseline_file_query(spark, sf_dir):
    path = scratch_path(spark, "baselines")
    _, base = source_accuracy(spark, sf_dir)
    base.select(F.col("task").alias("Eval Task"), F.col("baseline").alias("Random baseline")).write.csv(path, header=True)
    return item_files.baseline_scan(spark, path).withColumn("baseline", rounded(F.col("baseline")))


# --- logits -----------------------------------------------------------------------

LOGITS = """
long AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS logit, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS place FROM long
)"""


@query(f"""
WITH {LOGITS},
capped AS (SELECT vec_id, label, token, 15 * tanh(logit / 15) AS l FROM long),
sums AS (SELECT vec_id, label, ln(sum(exp(l))) AS lse FROM capped GROUP BY ALL)
SELECT vec_id, round(lse - l, 6) AS nats FROM sums JOIN capped USING (vec_id, label) WHERE token = label
""", name="cross_entropy")
def entropy_query(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", rounded(lg.cross_entropy(lg.softcap(F.col("embedding")), F.col("label"))).alias("nats"))


@query(f"""
WITH {LOGITS},
best AS (SELECT *, exp((logit - max(logit) OVER w) / 0.5) AS e FROM ranked WHERE place <= 5 WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, token, place - 1 AS place, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS prob FROM best
""", name="topk_per_group")
def topk_query(spark, sf_dir):
    best = lg.softmax(lg.topk(F.col("embedding"), 5), 0.5)
    return fixtures.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(best).alias("place", "b")).select(
        "vec_id", "place", "b.token", rounded(F.col("b.prob")).alias("prob")
    )


@query(f"""
WITH {LOGITS},
drawn AS (
  SELECT vec_id, token, logit / 0.8 - ln(-ln(({sql.hash32("'42:' || vec_id || ':' || token")} + 0.5) / 4294967296.0)) AS score
  FROM ranked WHERE place <= 20
)
SELECT vec_id, first(token ORDER BY score DESC, token)::INT AS token FROM drawn GROUP BY vec_id
""", name="weighted_draw")
def draw_query(spark, sf_dir):
    drawn = lg.weighted_draw(lg.topk(F.col("embedding"), 20), F.col("vec_id"), seed=42, temperature=0.8)
    return fixtures.table(spark, sf_dir, "embeddings").select("vec_id", drawn.alias("token"))


@query(f"WITH {LOGITS}\nSELECT vec_id, token::INT AS token FROM ranked WHERE place = 1", name="argmax_per_group")
def argmax_query(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "embeddings").select("vec_id", lg.argmax(F.col("embedding")).alias("token"))
