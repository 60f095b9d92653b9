"""Repair of damaged conversations at least cost, with a generalised LR parser (``role_parser``).

Rows are shuffled once, into ranges of (conversation, turn, role, digest of the text), whatever their number
in one conversation, and read in that order. Which rows repeat an earlier one is found on digests alone;
these come along as marker rows in front of the rows they concern, so texts meet nothing but the one shuffle.

A task parses the conversations that lie wholly in its range. Of the first and last one it also returns
what its rows lead to from every stack of the parser, and such stretches are joined in order, so a conversation
of a third of all rows is parsed in parallel. Its repaired text is hashed by streaming over its rows once more
in order (SHA-256 can only be had that way): the task holds one batch of rows and the audit.

Order: by turn, nulls first; rows of one turn by role, then by digest of the text. Defined cases: rows of a null
conversation are one conversation; a null role or text is one space; a role may begin with any character or none,
such rows can only be reroled or deleted; a conversation without rows has no faults, cost 0 and an empty
text; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import BLANKS
from .role_parser import Replay, RoleParser, joined

KEYS = ["conv_id", "turn", "role", "digest"]
MARKER, ROW = 0, 1  # a marker comes before the rows it is about
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
LEGAL = {"su", "ua", "au"}
FRONTS = "fronts array<struct<start: int, stop: int, cost: long, audit: string>>"
STRETCH = (
    "conv_id long, part int, open boolean, n_rows long, n_turns long, low long, high long, first string, last string, "
    "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, " + FRONTS
)
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damage by crc32 of "conv_id:turn" modulo 20. ``n`` is how often the row is there: not at all, once, or
    twice in a row."""
    conv, at = F.col(conv_id).cast("long"), F.col(turn).cast("long")
    space = F.lit(" ")
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(at.cast("string"), space))
    rows = df.select(
        conv.alias("conv_id"), at.alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"), (F.crc32(key) % 20).alias("harm")
    )
    harmed = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), harmed.alias("text"),
        F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1).alias("n"),
    )


def _fault_columns(rows: DataFrame) -> DataFrame:
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    there = F.col("n") > 0
    return rows.select(
        "conv_id", "turn", F.when(there, F.col("role")).alias("role"),
        F.when(there, F.substring(F.unhex(F.sha2("text", 256)), 1, 16)).alias("digest"), F.lit(ROW).alias("kind"), "n",
        (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"), F.when(there, F.col("text")).alias("text"),
    )


def _turn_order(turn: Column) -> Column:
    """A number that sorts a null before all turns."""
    return F.coalesce(turn.cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))


def _repeats(rows: DataFrame) -> DataFrame:
    """Keys of the rows whose role and text an earlier turn of the conversation has."""
    keys = rows.where("n > 0 and not blank").select(*KEYS).distinct().withColumn("at", _turn_order(F.col("turn")))
    same = ["conv_id", "role", "digest"]
    firsts = keys.groupBy(*same).agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least < most").drop("most")
    firsts = firsts.withColumnsRenamed({k: f"_{k}" for k in same})
    alike = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in same]
    return keys.join(firsts, alike[0] & alike[1] & alike[2]).where(F.col("at") > F.col("least")).select(*KEYS)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows and markers in ranges of the order of conversations."""
    known = _fault_columns(rows)
    markers = _repeats(known).select(
        *KEYS, F.lit(MARKER).alias("kind"), F.lit(0).alias("n"), F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(None).cast("string").alias("text")
    )
    order = [F.asc_nulls_first(k) for k in KEYS]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return known.unionByName(markers).repartitionByRange(partitions, *order).sortWithinPartitions(*order, "kind")


_parsers: list[RoleParser] = []


def parser() -> RoleParser:
    """The worker's parser."""
    if not _parsers:
        _parsers.append(RoleParser())
    return _parsers[0]


class Stretch:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.lines = conv_id, [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.low = self.high = None
        self.marked = self.seen = None  # keys of the last marker and of the last row

    def add(self, turn, role, digest, kind, n, blank, cut, text) -> None:
        key = (turn, role, digest)
        if kind == MARKER:
            self.marked = key
            return
        if n and turn is not None and turn != self.high:
            self.n_turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        for _ in range(n):
            again = not blank and (key in (self.marked, self.seen))
            self.seen = key
            short = not blank and not again and cut
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + short
            initial = role[:1]
            if self.rows and self.rows[-1][0] + initial not in LEGAL:
                self.illegal += 1
            self.rows.append((initial, blank or again, short))
            self.lines.append((role, text))

    def result(self, part: int, is_open: bool) -> tuple:
        own = parser()
        fronts = None
        if is_open:
            fronts = [
                {"start": start, "stop": stop, "cost": cost, "audit": audit}
                for start in own.stacks() for stop, (cost, audit) in own.parse(self.rows, start).items()
            ]
        cost, audit = own.finish(own.parse(self.rows))
        replay, out = Replay(audit), []
        for role, text in self.lines:
            out += replay.row(role, text)
        repaired = "\n".join(out + replay.inserted())
        ends = (self.rows[0][0], self.rows[-1][0]) if self.rows else (None, None)
        return (
            self.conv_id, part, is_open, len(self.rows), self.n_turns, self.low, self.high, *ends, self.blank, self.duplicate, self.truncated,
            self.illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest(), fronts,
        )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _stretches(schema: pa.Schema):
    """Over a range in order: a row for each conversation in it."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at, first, made = None, True, []
        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or conv_id != at.conv_id:
                    if at is not None:
                        made.append(at.result(part, first))
                        first = False
                    at = Stretch(conv_id)
                at.add(*row)
            if len(made) > 500:
                yield _batch(made, schema)
                made = []
        if at is not None:
            made.append(at.result(part, True))
        if made:
            yield _batch(made, schema)

    return run


def _joined(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """One row for a conversation from its stretches. Where there are several, its text is still to be hashed."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    own, first = parser(), rows[0]
    if len(rows) == 1:
        cost, audit, digest = first["cost"], first["audit"], first["repaired_sha256"]
    else:
        fronts = {0: (0, "")}
        for r in rows:
            fronts = joined(fronts, {(f["start"], f["stop"]): (f["cost"], f["audit"]) for f in r["fronts"]})
        (cost, audit), digest = own.finish(fronts), None
    full = [r for r in rows if r["n_rows"]]
    counts = {name: sum(r[name] for r in rows) for name in COUNTS}
    counts["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(full, full[1:], strict=False))
    dated = [r for r in rows if r["n_turns"]]
    turns = sum(r["n_turns"] for r in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:], strict=False))
    gaps = dated[-1]["high"] - dated[0]["low"] + 1 - turns if dated else 0
    return pa.Table.from_pylist([{"conv_id": first["conv_id"], "gaps": gaps, **counts, "cost": cost, "audit": audit, "repaired_sha256": digest}], schema)


def _hashed(schema: pa.Schema):
    """Over whole conversations in order, each led by its audit: the hash of the repaired text."""

    def run(batches):
        state: dict = {}

        def put(lines: list[str]) -> None:
            for line in lines:
                state["hash"].update(("\n" if state["some"] else "").encode() + line.encode())
                state["some"] = True

        def done() -> list[tuple]:
            if not state:
                return []
            put(state["replay"].inserted())
            return [(state["conv_id"], state["hash"].hexdigest())]

        for batch in batches:
            made = []
            for conv_id, audit, n, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit is not None:
                    made += done()
                    state.update(conv_id=conv_id, replay=Replay(audit), hash=hashlib.sha256(), some=False)
                for _ in range(n):
                    put(state["replay"].row(role, text))
            if made:
                yield _batch(made, schema)
        if state:
            yield _batch(done(), schema)

    return run


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def repair(rows: DataFrame) -> DataFrame:
    """The faults, the least cost, the audit and the hash of the repaired text of every conversation of a table
    (conv_id, turn, role, text, n): n is how often a row is there."""
    spark = rows.sparkSession
    stretch_schema, result_schema = _arrow_schema(spark, STRETCH), _arrow_schema(spark, RESULT)
    found = materialize(ordered(rows).mapInArrow(_stretches(stretch_schema), STRETCH), "stretches")
    gaps = F.when(F.col("n_turns") > 0, F.col("high") - F.col("low") + 1 - F.col("n_turns")).otherwise(0).cast("long").alias("gaps")
    whole = found.where("not open").select("conv_id", gaps, *COUNTS, "cost", "audit", "repaired_sha256")
    # At most two rows of each range are open.
    opened = materialize(found.where("open").groupBy("conv_id").applyInArrow(lambda table: _joined(table, result_schema), RESULT), "open")
    several = opened.where("repaired_sha256 is null")
    if several.isEmpty():
        return whole.unionByName(opened)
    asked = several.select(F.col("conv_id").alias("_conv_id"))
    again = _fault_columns(rows).where("n > 0").join(asked, F.col("conv_id").eqNullSafe(F.col("_conv_id")))
    led = again.select(*KEYS, F.lit(None).cast("string").alias("audit"), "n", "text").unionByName(
        several.select(
            "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"),
            "audit", F.lit(0).alias("n"), F.lit(None).cast("string").alias("text"),
        )
    )
    order = [F.asc_nulls_first(k) for k in KEYS]
    # Rows have a role and a digest, so that the row with the audit comes first.
    streamed = led.repartition("conv_id").sortWithinPartitions(*order[:2], *order[2:]).select("conv_id", "audit", "n", "role", "text")
    ddl = "conv_id long, repaired_sha256 string"
    hashes = streamed.mapInArrow(_hashed(_arrow_schema(spark, ddl)), ddl).withColumnsRenamed({"conv_id": "_conv_id"})
    rest = several.drop("repaired_sha256").join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).drop("_conv_id")
    return whole.unionByName(opened.where("repaired_sha256 is not null")).unionByName(rest)
