"""Inputs for the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import bpe_encode
from ..functions.hashing import hash32
from ..functions.vocabulary import BYTE_LEVEL, Vocabulary
from ..operators.corpus import with_rank, with_row_group
from ..operators.evaluation import LM, MC, SCHEMA, SHOT_FIELDS
from ..operators.prefix import dense_index
from ..operators.sampling import fewshot_gather, fewshot_sample, seeded_shuffle
from ..session import materialize, scratch_path
from ..sources.corpus import corpus_from_table
from ..sources.items import task_table

ROWS_PER_GROUP = 8
WORLD = 3
CHOICE_SEED = 99
N_CHOICES = 4
# The task file: type, number of examples before an item, delimiter (none: the default).
TASKS = {"task0": (MC, 2, None), "task1": (MC, 0, "\n"), "task2": (SCHEMA, 3, None), "task3": (LM, 1, "\n\n")}
N_TASKS = len(TASKS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``documents`` as a corpus: one shard per source, rows in id order."""
    return corpus_from_table(spark, f"{sf_dir}/documents.parquet", "source", "doc_id", *columns)


def ranked_corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return with_rank(with_row_group(corpus(spark, sf_dir, *columns), ROWS_PER_GROUP), WORLD)


def with_ids(df: DataFrame, vocab: Vocabulary = BYTE_LEVEL, prepend=0) -> DataFrame:
    ids = df.withColumn("ids", bpe_encode(F.col("text"), vocab, prepend=prepend)).drop("text")
    return ids.withColumn("n_ids", F.size("ids"))


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` texts cut at the middle word, with a task label."""
    words = F.split("text", " ", -1)
    middle = F.floor(F.size("w") / 2).cast("int")
    return (
        table(spark, sf_dir, "benchmark")
        .withColumn("w", words)
        .select(
            "item_id",
            F.concat(F.lit("task"), (F.col("item_id") % N_TASKS).cast("string")).alias("task"),
            F.array_join(F.slice("w", F.lit(1), middle), " ").alias("head"),
            F.array_join(F.slice("w", middle + 1, F.size("w")), " ").alias("tail"),
        )
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task table of a task file that names the tasks which have items."""
    number = F.col("item_id") % N_TASKS
    present = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("task"), number.cast("string")).alias("label")).distinct()
    config = spark.createDataFrame(
        [(label, *values) for label, values in TASKS.items()],
        "label string, icl_task_type string, shots int, continuation_delimiter string",
    )
    path = scratch_path(spark, "tasks")
    present.join(F.broadcast(config), "label").select(
        "label", "icl_task_type", F.concat(F.lit("items/"), "label").alias("dataset_uri"),
        F.array("shots").alias("num_fewshot"), "continuation_delimiter",
    ).write.json(path)
    return task_table(spark, path)


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with ``idx`` and what the task table says about their task: its type, ``num_fewshot`` and
    ``delimiter``. Wrong options come from other items of the task."""
    shuffled = seeded_shuffle(halves(spark, sf_dir))
    drawn = fewshot_sample(shuffled, N_CHOICES - 1, seed=CHOICE_SEED)
    mixed = fewshot_gather(shuffled, drawn, ["head", "tail"], out="wrong")
    gold = F.pmod(hash32(7, F.col("item_id")), F.lit(N_CHOICES)).cast("int")

    def placed(field: str):
        others = F.transform("wrong", lambda s: s[field])
        return F.concat(
            F.slice(others, F.lit(1), F.col("gold")), F.array(field),
            F.slice(others, F.col("gold") + 1, F.lit(N_CHOICES)),
        )

    config = tasks(spark, sf_dir).drop("dataset_uri")
    typed = mixed.join(F.broadcast(config), "task").withColumn("gold", gold)  # one row per task
    is_lm = F.col("task_type") == LM
    items = typed.select(
        "task", "idx", "item_id", "task_type", "num_fewshot", "delimiter",
        F.when(F.col("task_type") == MC, F.col("head")).alias("query"),
        F.when(F.col("task_type") == MC, placed("tail")).alias("choices"),
        F.when(~is_lm, F.col("gold")).alias("gold"),
        F.when(F.col("task_type") == SCHEMA, placed("head")).alias("context_options"),
        F.when(is_lm, F.concat("head", F.lit("\n"))).alias("context"),
        F.when(F.col("task_type") != MC, F.col("tail")).alias("continuation"),
    )
    return materialize(items, "items")  # a bundle is prepared once and then read by all tasks


def with_shots(items: DataFrame) -> DataFrame:
    return fewshot_gather(items, fewshot_sample(items, F.col("num_fewshot")), SHOT_FIELDS)


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a step log: one run per user, steps in time order."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "event_id", "value"
    )
    numbered = dense_index(events, "step", by=["run_id"], row="event_id")
    return numbered.select("run_id", "step", F.col("value").alias("loss"), ((F.col("value") + 1) / 1000).alias("dt_s"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint listing: users as model tags, events as saved files."""
    tag = F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string"))
    name = F.format_string("model_%06d.pt", F.col("event_id"))
    return table(spark, sf_dir, "events").select(
        F.concat_ws("/", F.lit("runs"), tag, name).alias("path"), F.col("ts").cast("timestamp").alias("mtime")
    )
