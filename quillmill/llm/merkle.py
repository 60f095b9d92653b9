"""Merkle manifest of a dataset with a witness for every row, by incremental witnesses.

A tree over consecutive nodes takes every ``ARITY`` of them, the last run as many as there are, to one
parent, until one node is left. ``Appender`` takes nodes one after another. Every open subtree carries the
partial witnesses of its leaves, and as the run it stands in is completed, its siblings extend them: what is to
the left and to the right of the subtree.

Rows of a source are ordered by ranges, so a source of a third of all rows lies in many tasks, and numbered by
the sizes of the ranges. Aligned blocks of ``BLOCK`` (a power of the arity) are then appended in tasks of their
own, and the block roots are treated as further appends, in blocks again, until each source has one root. The
roots of the sources are appended in the same way. A witness is its block's, extended by that of the block root,
and so on; tables above the leaves have one row for each 2,187 below, and Spark joins them as their size
allows.

Defined cases: a null value counts as "-", also a null source, which comes first; a null id comes first and its row is
not tampered with; rows of equal ids are in the order of their leaves; a single row is its own root; an empty table has no
rows; columns other than those that are hashed are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize

ARITY, LEVELS = 3, 7
BLOCK = ARITY**LEVELS
HASHED = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = T.ArrayType(T.StructType([T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())]))

Path = list[tuple[bytes, bytes]]


def parent(nodes: Sequence[bytes]) -> bytes:
    """The digest of nodes, whose digests enter as lower-case hex."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


class Appender:
    """A tree that grows by appending. ``levels`` fixes its height, for a block of a larger tree."""

    def __init__(self, arity: int = ARITY, levels: int | None = None):
        self.arity, self.levels = arity, levels
        self.open: list[list[tuple[bytes, list[Path]]]] = []  # of every level the run that is not complete
        self.paths: list[Path] = []

    def append(self, digest: bytes) -> None:
        self.paths.append([])
        self._add(0, digest, [self.paths[-1]])

    def _add(self, level: int, digest: bytes, paths: list[Path]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((digest, paths))
        if len(self.open[level]) == self.arity and level != self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [digest for digest, _ in run]
        for k, (_, paths) in enumerate(run):
            step = (b"".join(digests[:k]), b"".join(digests[k + 1 :]))
            for path in paths:
                path.append(step)
        self._add(level + 1, parent(digests), [path for _, paths in run for path in paths])

    def root(self) -> bytes:
        """Complete the last runs; the root."""
        level = 0
        while True:
            run = self.open[level]
            above = any(self.open[level + 1 :])
            if level == self.levels or (self.levels is None and not above and len(run) == 1):
                return run[0][0]
            if run:
                self._complete(level)
            level += 1


def value(name: str, text: Column | None = None) -> Column:
    """A value as it is hashed: its bytes in UTF-8, a colon, the value; "-" if there is none."""
    s = F.col(name).cast("string") if text is None else text
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): digests of the row as it is, and with the newlines of its text
    gone where 2 divides the crc32 of its id."""
    whole = F.unhex(F.sha2(F.concat(*(value(c) for c in HASHED)), 256))
    without = F.unhex(F.sha2(F.concat(*(value(c) for c in HASHED[:-1]), value("text", F.replace("text", F.lit("\n"), F.lit("")))), 256))
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return docs.select("doc_id", "source", whole.alias("leaf"), F.when(chosen, without).otherwise(whole).alias("tampered"))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the place in the group by ``order`` (nulls first), and ``total``, the size of the group.
    ``group`` has no nulls."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_first(c) for c in (group, *order)]
    ranged = rows.repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    kept = materialize(ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("range", F.shiftright("place", 33)), "ordered")
    sizes = kept.groupBy(group, "range").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    whole = Window.partitionBy(group)
    ahead = F.sum("n").over(whole.orderBy("range")) - F.col("n")
    starts = materialize(sizes.select(group, "range", (ahead - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total")), "starts")
    return kept.join(starts, [group, "range"]).withColumn("pos", F.col("place") + F.col("shift")).drop("place", "range", "shift")


def _block_witnesses(digest: str):
    """Over the nodes of a block: their paths in it, and its root."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        total = table.column("total")[0].as_py()
        tree = Appender(levels=LEVELS if total > BLOCK else None)
        for d in table.column(digest).to_pylist():
            tree.append(d)
        root = tree.root()
        kind = pa.list_(pa.struct([pa.field("left", pa.binary()), pa.field("right", pa.binary())]))
        paths = pa.array([[{"left": a, "right": b} for a, b in path] for path in tree.paths], kind)
        return table.append_column("path", paths).append_column("root", pa.array([root] * table.num_rows, pa.binary()))

    return run


def witnesses(rows: DataFrame, group: str, order: Sequence[str], digest: str) -> DataFrame:
    """Add ``path``, the siblings (left, right) on every level from the row to the root of its group, and
    ``root``."""
    items, levels = numbered(rows, group, order), []
    while True:
        blocks = items.withColumn("block", F.call_function("div", F.col("pos"), F.lit(BLOCK)))
        schema = T.StructType([*blocks.schema.fields, T.StructField("path", STEP), T.StructField("root", T.BinaryType())])
        done = materialize(blocks.groupBy(group, "block").applyInArrow(_block_witnesses(digest), schema), "witnesses")
        levels.append(done)
        more = done.where((F.col("total") > BLOCK) & (F.col("pos") % BLOCK == 0))
        if more.isEmpty():
            break
        items = more.select(
            group, F.col("block").alias("pos"), F.call_function("div", F.col("total") + (BLOCK - 1), F.lit(BLOCK)).alias("total"), F.col("root").alias("node")
        )
        digest = "node"
    above = levels.pop()
    while levels:
        upper = above.select(group, F.col("pos").alias("block"), F.col("path").alias("_path"), F.col("root").alias("_root"))
        lower = levels.pop()
        joined = lower.join(upper, [group, "block"], "left")
        path = F.concat("path", F.coalesce("_path", F.array().cast(STEP)))
        above = joined.withColumns({"path": path, "root": F.coalesce("_root", "root")}).drop("_path", "_root")
    return above.drop("block", "pos", "total")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, tampered), digests as bytes: the tree and a witness for every row."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key")  # keeps the order, has no nulls
    own = witnesses(leaves(docs).select("doc_id", key, "leaf", "tampered"), "key", ["doc_id", "leaf"], "leaf").withColumnsRenamed({"root": "subroot", "path": "own"})
    roots = own.select("key", F.col("subroot").alias("node")).distinct().withColumn("all", F.lit(0))
    upper = witnesses(roots, "all", ["key"], "node").select("key", "root", F.col("path").alias("upper"))
    return own.join(upper, "key").select("doc_id", "leaf", "subroot", "root", F.concat("own", "upper").alias("path"), "tampered")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to, as hex."""
    return F.aggregate(path, _hex(leaf), lambda node, s: F.sha2(F.concat(_hex(s["left"]), node, _hex(s["right"])), 256))


def verified(made: DataFrame) -> DataFrame:
    """Digests as hex, the digest of each witness, and the root that the row's tampered leaf leads to."""
    siblings = F.aggregate("path", F.lit(""), lambda all_of, s: F.concat(all_of, _hex(s["left"]), _hex(s["right"])))
    out = made.select(
        "doc_id", *(_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("tampered"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
