"""Packing of token sequences into fixed-length training sequences by minimum bin slack.

Texts are encoded and cut into pieces of at most ``capacity`` ids: only longer documents are
cut, and then the first piece takes the remainder. Bins are made one after another: the longest
length left opens a bin, and a bitset subset-sum program over the lengths still available finds
the fullest filling of what is left of it, which is then removed. Only the number of pieces of
each length matters for this, so the program runs on a histogram of at most ``capacity`` rows,
whatever the corpus; the filling found is the fullest for as long as its lengths last, so it is
taken as often as they do. The resulting plan (a few rows per length) is broadcast, and pieces
find their place in it by their number within their length, which Spark counts in blocks.

``write_sequences`` makes the training sequences themselves: pieces are written with their ids and with
their number among those of their length and task; a small table of starts by task and length, joined as
the planner finds best (by broadcast while it is small), completes the number, so ids are shuffled once, to
their sequence. ``places`` reads the sequences back.

Defined cases: a null or empty text is the end id alone; repeated rows and equal ids are packed
as rows of their own; an empty table packs to an empty one; other columns are not used.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, materialize, scratch_path
from .arrow import giving_back, map_arrow, runs_by_size, texts_of
from .codes import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BLOCKS = 64


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def encode_pieces(
    docs: DataFrame, path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = True
) -> DataFrame:
    """Pieces of all documents: place in the document, checksum and, if wanted, the ids."""

    def run(batch: pa.RecordBatch):
        doc_ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        for a, b in runs_by_size([len(t) for t in texts]):
            rows: list[tuple] = []
            for key, ids in zip(doc_ids[a:b], encoder(path).encode(texts[a:b]).each(), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((key, k, start, length, zlib.crc32(part), *([part.tobytes()] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, run, PIECES + ", ids binary" if with_ids else PIECES)


def _dealt_pieces(path: str, capacity: int, end_id: int):
    """Over a partition: its pieces with their ids, narrow where the vocabulary allows, and ``nth``, their
    number among the task's pieces of their length."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for a, b in runs_by_size([len(t) for t in texts]):
                coder = encoder(path)
                rows: list[tuple] = []
                for key, ids in zip(doc_ids[a:b], coder.encode(texts[a:b]).each(), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype(coder.kind)
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append((key, k, start, length, task, int(seen[length]), ids[start : start + length].tobytes()))
                        seen[length] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "task", "nth", "ids"],
                )

    return run


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table of ids written to the shared folder, and its path. Ids are what these tables weigh, and this
    compression takes a quarter less of them than the usual one."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def write_sequences(
    docs: DataFrame, path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", end_id: int = 0
) -> DataFrame:
    """The training sequences, a written table: ``sequence_id``, ``ids`` (little-endian, two bytes an id for
    vocabularies of up to 65,536, else four), ``pieces`` (doc_id, piece, start, length, offset) in order."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, task int, nth long, ids binary"
    kept, pieces_path = _stored(rows.mapInArrow(giving_back(_dealt_pieces(path, capacity, end_id)), schema), "pieces")
    sizes = kept.groupBy("length", "task").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")
    starts = materialize(sizes.select("length", "task", before.alias("ahead")), "starts")
    by_length = places_by_length(kept, capacity)
    numbered_pieces = kept.join(starts, ["length", "task"]).withColumn("number", F.col("nth") + F.col("ahead"))
    placed = with_places(numbered_pieces, by_length)
    part = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    sequences = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    fields = ["doc_id", "piece", "start", "length", "offset"]
    named = F.transform("parts", lambda p: F.struct(*(p[f].alias(f) for f in fields)))
    written, _ = _stored(sequences.select("sequence_id", joined.alias("ids"), named.alias("pieces")), "sequences")
    discard(docs.sparkSession, pieces_path)  # the sequences have all of it
    return written


def places(sequences: DataFrame) -> DataFrame:
    """A row for each piece in the sequences, with the checksum of the ids that stand at its place."""

    def run(batch: pa.RecordBatch):
        rows: list[tuple] = []
        for sequence, packed, pieces in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            total = sum(p["length"] for p in pieces)
            ids = np.frombuffer(packed, f"<u{len(packed) // total}").astype("<u4")
            for p in pieces:
                crc = zlib.crc32(ids[p["offset"] : p["offset"] + p["length"]])
                rows.append((p["doc_id"], p["piece"], p["start"], p["length"], crc, sequence, p["offset"]))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )

    return map_arrow(sequences.select("sequence_id", "ids", "pieces"), run, PIECES + ", sequence_id long, offset long")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of available lengths with the largest sum up to
    ``room``. Bit s of a set tells whether sum s can be made; long lengths are used first."""
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left, size = left - take, size * 2
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, last, bin, times, offset): the pieces of ``length`` numbered first to
    last - 1 go, ``times`` to a bin, into the bins from ``bin`` on, the first at ``offset``."""
    counts = {length: n for length, n in histogram.items() if n}
    taken = dict.fromkeys(counts, 0)
    rows, bins = [], 0
    for longest in sorted(counts, reverse=True):
        while n := counts[longest]:
            counts[longest] = n - 1
            filling = dict(fullest(counts, capacity - longest))
            counts[longest] = n
            filling[longest] = filling.get(longest, 0) + 1
            repeat = min(counts[length] // times for length, times in filling.items())
            offset = 0
            for length, times in sorted(filling.items(), reverse=True):
                rows.append((length, taken[length], taken[length] + repeat * times, bins, times, offset))
                taken[length] += repeat * times
                counts[length] -= repeat * times
                offset += length * times
            bins += repeat
    return rows


def numbered(pieces: DataFrame, key: Column) -> DataFrame:
    """Add ``number``: 0, 1, ... within each length. A length that has a third of all pieces is
    counted in blocks by ``key``, and blocks are put in a row by their sizes."""
    partitions = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64(key), F.lit(BLOCKS * partitions)).cast("int"))
    sizes = blocked.groupBy("length", "block").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count")
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("row")) - 1
    return (
        blocked.withColumn("inside", inside)
        .join(sizes.select("length", "block", before.alias("ahead")), ["length", "block"])
        .select(*pieces.columns, (F.col("inside") + F.col("ahead")).alias("number"))
    )


def places_by_length(pieces: DataFrame, capacity: int) -> DataFrame:
    """The plan, a row per length: ``places`` of its pieces in order of their numbers."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    plan = pieces.sparkSession.createDataFrame(
        plan_bins(histogram, capacity), "length long, first long, last long, bin long, times long, at long"
    )
    return plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "last", "bin", "times", "at"))).alias("places"))


def with_places(pieces: DataFrame, by_length: DataFrame) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have their ``number`` within their length."""
    found = pieces.join(F.broadcast(by_length), "length").withColumn(
        "place", F.filter("places", lambda p: (p["first"] <= F.col("number")) & (F.col("number") < p["last"]))[0]
    )
    k = F.col("number") - F.col("place.first")
    return found.withColumns({
        "sequence_id": (F.col("place.bin") + F.floor(k / F.col("place.times"))).cast("long"),
        "offset": (F.col("place.at") + (k % F.col("place.times")) * F.col("length")).cast("long"),
    }).drop("places", "place")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Place pieces (a table with ``length``, at most ``capacity``): adds ``sequence_id`` and
    ``offset``. The input is written once, so that row numbers stay the same in a rerun."""
    kept = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    by_length = places_by_length(kept, capacity)
    # Pieces carry only their keys through the shuffles; the plan has a few rows per length.
    placed = with_places(numbered(kept.select("row", "length"), F.col("row")), by_length).select("row", "sequence_id", "offset")
    return kept.join(placed, "row").drop("row")
