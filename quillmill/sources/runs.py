"""Run metadata as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _D = T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# --- fixed values: field names of run metadata -----------------------------------
RUN_METADATA = _struct(
    step=_L,
    val_bpb=_D,
    model_config=_struct(sequence_len=_L, vocab_size=_L, n_layer=_L, n_head=_L, n_kv_head=_L, n_embd=_L),
    user_config=_struct(
        depth=_L, max_seq_len=_L, device_batch_size=_L, total_batch_size=_L, target_param_data_ratio=_L
    ),
    device_batch_size=_L,
    max_seq_len=_L,
    dataloader_state_dict=_struct(pq_idx=_L, rg_idx=_L),
    loop_state=_struct(min_val_bpb=_D, smooth_train_loss=_D, total_training_time=_D),
)


def run_metadata_write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def run_metadata_read(spark: SparkSession, path: str, schema: T.StructType = RUN_METADATA) -> DataFrame:
    """Nested run metadata, one JSON object per line."""
    return spark.read.schema(schema).json(path)
