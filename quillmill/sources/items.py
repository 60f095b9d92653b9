"""Reading evaluation bundles and writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEFAULT_DELIMITER

ITEM_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StringType())),
    T.StructField("gold", T.IntegerType()),
    T.StructField("context_options", T.ArrayType(T.StringType())),
    T.StructField("context", T.StringType()),
    T.StructField("continuation", T.StringType()),
])
TASK_SCHEMA = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("icl_task_type", T.StringType()),
    T.StructField("dataset_uri", T.StringType()),
    T.StructField("num_fewshot", T.ArrayType(T.IntegerType())),
    T.StructField("continuation_delimiter", T.StringType()),
])


def task_items_scan(spark: SparkSession, path: str, schema: T.StructType = ITEM_SCHEMA) -> DataFrame:
    """Items of all task types, one JSON object per line, in one nullable schema."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def task_table(spark: SparkSession, path: str) -> DataFrame:
    """Task configuration with its defaults filled in."""
    return spark.read.schema(TASK_SCHEMA).json(path).select(
        F.col("label").alias("task"),
        F.col("icl_task_type").alias("task_type"),
        "dataset_uri",
        F.col("num_fewshot")[0].alias("num_fewshot"),
        F.coalesce("continuation_delimiter", F.lit(DEFAULT_DELIMITER)).alias("delimiter"),
    )


def baseline_scan(spark: SparkSession, path: str) -> DataFrame:
    """Random baselines in percent by task."""
    return spark.read.csv(path, header=True).select(
        F.col("Eval Task").alias("task"), F.col("Random baseline").cast("double").alias("baseline")
    )


def report_lines(report: DataFrame, task: str = "task") -> DataFrame:
    """Report rows as text with six decimals; a missing accuracy stays blank."""
    six = lambda c: F.format_string("%.6f", c)
    return report.select(
        F.col(task).alias("Task"),
        F.when(F.col("accuracy").isNull(), "").otherwise(six("accuracy")).alias("Accuracy"),
        six("centered").alias("Centered"),
    )


def eval_report_sink(report: DataFrame, path: str, task: str = "task") -> None:
    """Write the report as CSV with a header; one row per task."""
    report_lines(report, task).coalesce(1).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)
