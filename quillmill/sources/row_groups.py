"""Parquet corpora by the row groups their files have.

``RowGroups`` is a Python data source: it plans one input partition per (file, row group) from the files'
footers, for one rank of a stride, from a saved position on, and a task reads its row group with the asked columns
only. As a stream its offset is that pair, so a restart goes on behind the last row group it read. Files
that only Spark can open are scanned by Spark, and their rows are matched with the footers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "row_groups"
PLACE = "shard string, row_group int, row bigint"
BEFORE_ALL = ("", -1)


class RowGroup(InputPartition):
    """A row group of a file and where it stands."""

    def __init__(self, file: str, shard: str, group: int, first_row: int, n_rows: int):
        super().__init__((shard, group))
        self.file, self.shard, self.group, self.first_row, self.n_rows = file, shard, group, first_row, n_rows


def _opened(path: str):
    """The file system and the path in it. A path without a scheme is local."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def shard_files(path: str) -> list[tuple[str, str]]:
    """(shard, file) of the Parquet files under a folder, or of one file, by name. A shard is named by
    its path in the folder; hidden and unfinished files are none."""
    from pyarrow import fs

    system, root = _opened(path)
    if system.get_file_info(root).type == fs.FileType.File:
        return [(root.rsplit("/", 1)[-1], root)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    names = [(f.path[len(root) :].lstrip("/"), f.path) for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet")]
    return sorted((name, file) for name, file in names if not any(part.startswith(("_", ".")) for part in name.split("/")))


def footers(path: str, shards: Sequence[tuple[str, str]] | None = None) -> list[RowGroup]:
    """All row groups, in corpus order. Only footers are read."""
    import pyarrow.parquet as pq

    system, _ = _opened(path)
    out = []
    for shard, file in shard_files(path) if shards is None else shards:
        with system.open_input_file(file) as handle:
            metadata = pq.ParquetFile(handle).metadata
            row = 0
            for group in range(metadata.num_row_groups):
                n = metadata.row_group(group).num_rows
                out.append(RowGroup(file, shard, group, row, n))
                row += n
    return out


def strided(groups: list[RowGroup], rank: int, world: int, after: tuple[str, int] | None = None) -> list[RowGroup]:
    """The row groups of a rank: every ``world``-th of each file, and after a saved position those of the
    strides behind the one that holds it, and of all later files."""
    mine = [g for g in groups if g.group % world == rank]
    if after is None or after == BEFORE_ALL:
        return mine
    shard, group = after
    return [g for g in mine if g.shard > shard or (g.shard == shard and g.group >= (group // world + 1) * world)]


class _Reading:
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.path = options["path"]
        self.rank, self.world = int(options.get("rank", 0)), int(options.get("world", 1))
        after = options.get("after")
        self.after = tuple(json.loads(after)) if after else None

    def read(self, partition: RowGroup) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        names = [f.name for f in self.schema.fields if f.name not in ("shard", "row_group", "row")]
        system, _ = _opened(self.path)
        with system.open_input_file(partition.file) as handle:
            row = partition.first_row
            for batch in pq.ParquetFile(handle).iter_batches(batch_size=1000, row_groups=[partition.group], columns=names):
                n = batch.num_rows
                made = {
                    "shard": pa.array([partition.shard] * n), "row_group": pa.array([partition.group] * n, pa.int32()),
                    "row": pa.array(range(row, row + n), pa.int64()), **{name: batch.column(name) for name in names},
                }
                yield pa.RecordBatch.from_arrays([made[f.name] for f in self.schema.fields], names=self.schema.names)
                row += n


class _Reader(_Reading, DataSourceReader):
    def partitions(self) -> list[RowGroup]:
        return strided(footers(self.path), self.rank, self.world, self.after)


class _StreamReader(_Reading, DataSourceStreamReader):
    """Shards are added in the order of their names and are not changed."""

    def initialOffset(self) -> dict:
        shard, group = self.after or BEFORE_ALL
        return {"shard": shard, "row_group": group}

    def latestOffset(self) -> dict:
        files = shard_files(self.path)
        if not files:
            return self.initialOffset()
        groups = footers(self.path, files[-1:])
        return {"shard": files[-1][0], "row_group": groups[-1].group if groups else -1}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        low, high = ((o["shard"], o["row_group"]) for o in (start, end))
        files = [f for f in shard_files(self.path) if low[0] <= f[0] <= high[0]]
        groups = strided(footers(self.path, files), self.rank, self.world)
        if self.after and low == self.after:  # the rest of a stride that was begun is skipped
            groups = strided(groups, self.rank, self.world, self.after)
        return [g for g in groups if low < (g.shard, g.group) <= high]


class RowGroups(DataSource):
    """Options: ``path``, ``columns`` (a DDL list of what is read beside the place), ``rank``, ``world``, and
    ``after``, a JSON pair of shard and row group."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(part for part in (PLACE, self.options.get("columns", "text string")) if part)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, dict(self.options))


def _options(reader, path: str, columns: str, rank: int, world: int, after: tuple[str, int] | None):
    out = reader.format(FORMAT).option("path", path).option("columns", columns).option("rank", rank).option("world", world)
    return out.option("after", json.dumps(list(after))) if after else out


def opens(path: str) -> bool:
    """Whether files can be read without Spark."""
    import pyarrow as pa

    try:
        shard_files(path)
    except (OSError, pa.ArrowException):
        return False
    return True


def footers_table(spark: SparkSession, path: str) -> DataFrame:
    """(shard, starts): the first row of every row group of every file, read by Spark's own file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(conf).listFiles(root, True)
    prefix, rows = None, []
    base = root.getFileSystem(conf).makeQualified(root).toString().rstrip("/")
    while found.hasNext():
        status = found.next()
        name = status.getPath().toString()
        prefix = name[len(base) :].lstrip("/") or name.rsplit("/", 1)[-1]
        if not name.endswith(".parquet") or any(part.startswith(("_", ".")) for part in prefix.split("/")):
            continue
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf))
        starts, row = [], 0
        for block in reader.getRowGroups():
            starts.append(row)
            row += block.getRowCount()
        reader.close()
        rows.append((prefix, name, starts))
    return spark.createDataFrame(rows, "shard string, file string, starts array<bigint>")


def row_group_scan(
    spark: SparkSession, path: str, columns: str = "text string", rank: int = 0, world: int = 1, after: tuple[str, int] | None = None
) -> DataFrame:
    """(shard, row_group, row, columns) of the row groups of one rank, from a saved position on."""
    if opens(path):
        spark.dataSource.register(RowGroups)
        return _options(spark.read, path, columns, rank, world, after).load()
    names = T.StructType.fromDDL(columns).names if columns else []
    scanned = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), *names
    )
    placed = scanned.join(footers_table(spark, path), "file")  # a row per file; the planner knows its size
    group = F.size(F.filter("starts", lambda first: first <= F.col("row"))) - 1
    rows = placed.select("shard", group.alias("row_group"), "row", *names).where(F.col("row_group") % world == rank)
    if after:
        from ..operators.corpus import after_row_group

        rows = after_row_group(rows, after[0], after[1], world)
    return rows


def row_group_stream(
    spark: SparkSession, path: str, columns: str = "text string", rank: int = 0, world: int = 1, after: tuple[str, int] | None = None
) -> DataFrame:
    """The same as an unbounded table; its offset is the last (shard, row_group) read."""
    spark.dataSource.register(RowGroups)
    return _options(spark.readStream, path, columns, rank, world, after).load()
