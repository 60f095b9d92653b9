"""Documents as an unbounded stream: tokenizing, packing, bits per byte."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from ..constants import BOS
from ..functions.codec import bpe_encode
from ..functions.vocabulary import BYTE_LEVEL, Vocabulary
from ..operators.packing import BatchShape
from ..operators.scoring import bits_per_byte


def corpus_stream(
    spark: SparkSession, path: str, schema: StructType | str, max_files: int | None = None, glob: str = "*.parquet"
) -> DataFrame:
    """Documents of Parquet files as they arrive, at most ``max_files`` per
    micro-batch. With a checkpoint location a restart reads exactly what is left."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_tokenize(stream: DataFrame, vocab: Vocabulary = BYTE_LEVEL, text: str = "text") -> DataFrame:
    """Add ``ids`` with a leading BOS; the vocabulary is fixed when the stream starts."""
    return stream.filter(F.col(text).isNotNull()).withColumn("ids", bpe_encode(F.col(text), vocab, prepend=BOS))


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which typed state needs. A query copies
    the settings when it starts and records the store in its checkpoint."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def append_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is available as Parquet and stop; the sink is exactly-once."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    with state_store(stream.sparkSession):
        return writer.start()


# Tokens that are laid end to end at once when batches are cut.
TOKENS_PER_CUT = 1 << 20
FIRST = -(1 << 63)  # place of a row without number


class _Packer(StatefulProcessor):
    """Cuts the stream of one key into batches. Its state is what does not fill a batch, as 4-byte
    ids, and the number of the next batch."""

    def __init__(self, shape: BatchShape, keys: Sequence[str]):
        self.shape, self.keys = shape, list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carry = handle.getValueState("carry", "ids binary, next_batch bigint")

    def handleInputRows(self, key, rows, timerValues):
        carried, batch = self.carry.get() if self.carry.exists() else (b"", 0)
        left = np.frombuffer(carried, dtype="<i4")
        light, tokens = [], []
        for frame in rows:
            tokens.extend(np.asarray(ids, dtype="<i4") for ids in frame["ids"])
            light.append(frame[["shard", "row"]])
        order = pd.concat(light, ignore_index=True).sort_values(["shard", "row"], kind="stable", na_position="first").index
        parts, size = [left], len(left)
        for n, place in enumerate(order, 1):
            parts.append(tokens[place])
            size += len(tokens[place])
            if size >= TOKENS_PER_CUT or n == len(order):
                frame, left = self._cut(key, np.concatenate(parts), batch)
                batch += len(frame) // self.shape.rows
                parts, size = [left], len(left)
                if len(frame):
                    yield frame
        self.carry.update((left.astype("<i4").tobytes(), int(batch)))

    def _cut(self, key, tokens, batch):
        shape = self.shape
        full = max(0, (len(tokens) - shape.batch_tokens + shape.stride) // shape.stride)
        at = [b * shape.stride + r * shape.seq_len for b in range(full) for r in range(shape.rows)]
        frame = {k: [v] * len(at) for k, v in zip(self.keys, key)}
        frame["batch"] = [batch + b for b in range(full) for _ in range(shape.rows)]
        frame["row_in_batch"] = list(range(shape.rows)) * full
        frame["tokens"] = [tokens[a: a + shape.width] for a in at]
        return pd.DataFrame(frame), tokens[full * shape.stride:]

    def close(self) -> None:
        pass


def stream_batches(
    stream: DataFrame, batch_size: int, seq_len: int, by: Sequence[str] = ("rank",), overlap: bool = False
) -> DataFrame:
    """Training batches ``(by, batch, row_in_batch, inputs, targets)`` of a stream of ``(by, shard, row,
    ids)``. Micro-batches follow each other; inside one, documents are ordered by ``(shard, row)``, nulls
    first. Documents without ids add nothing.

    The carry of each ``by`` is value state of less than one batch, and batches go to any append sink. A
    task takes the documents that one ``by`` got in one micro-batch, as 4-byte ids, so limit what a
    micro-batch reads (``max_files``); ranks run side by side. It gives every token once; the rows are dealt
    by batch before inputs and targets are made and written."""
    shape, keys = BatchShape(batch_size, seq_len, overlap), list(by)
    docs = stream.filter(F.col("ids").isNotNull()).select(
        *keys, "shard", F.coalesce(F.col("row").cast("bigint"), F.lit(FIRST)).alias("row"), "ids"
    )
    schema = StructType([stream.schema[k] for k in keys])
    schema = schema.add("batch", LongType()).add("row_in_batch", IntegerType()).add("tokens", ArrayType(IntegerType()))
    rows = docs.groupBy(*keys).transformWithStateInPandas(_Packer(shape, keys), schema, "append", "none")
    return rows.repartition(*keys, "batch").select(
        *keys, "batch", "row_in_batch",
        F.slice("tokens", 1, seq_len).alias("inputs"), F.slice("tokens", 2, seq_len).alias("targets"),
    )


def stream_pack(
    stream: DataFrame, path: str, checkpoint: str, batch_size: int, seq_len: int,
    by: Sequence[str] = ("rank",), overlap: bool = False,
) -> StreamingQuery:
    """Pack a stream into training batches under ``path``, exactly once: see ``stream_batches``."""
    return append_parquet(stream_batches(stream, batch_size, seq_len, by, overlap), path, checkpoint)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches a ``stream_pack`` has written."""
    return spark.read.parquet(path)


def stream_bpb(scores: DataFrame, token_bytes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running nats, bytes and bits per byte of a stream of score rows."""
    return bits_per_byte(scores, token_bytes, by)


def keep_latest(aggregated: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the current result of a streaming aggregate under ``path``."""
    def save(result: DataFrame, epoch: int) -> None:
        result.write.mode("overwrite").parquet(path)

    return (
        aggregated.writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
