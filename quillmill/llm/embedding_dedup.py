"""Near-duplicate embeddings by collision-counting projections.

Unit vectors u and v of cosine c lie sqrt(2 - 2c) apart, and their projections on a random
Gaussian direction differ by a normal number of that deviation. Each vector is projected on many
directions. In each direction the values are sorted, and a window around every query value says
which others collide with it there; a pair at the threshold collides in a direction with a known
probability, so the count of collisions that such a pair reaches with probability 1 - ``MISS`` is
a binomial quantile. Pairs that reach it are verified by their cosine in double precision.

Only vectors of one label (and one dimension) meet. A first direction cuts each label into cells
as wide as the window that a pair at the threshold leaves with probability ``MISS``; so partners
lie in the same or the next cell. Cells are cut at random into blocks of ``BLOCK`` vectors, and
every pair of blocks that may hold partners is a task, so no label, however frequent, has to fit
into one. Equal vectors of a label are one class with a count: a group of copies is one vector
here, and its links are counted without being listed. Links do not become rows either: a task gives a
row for each vector that has links in it, with their number and a vector that all linked to it share.

Defined cases: a vector that is null, empty, zero, or has a null or non-finite part, or whose
label is null, links with nothing; a null id never becomes a component; rows of equal ids are
vectors of their own but one node; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .arrow import map_arrow, ranges
from .components import components

COSINE, MISS, BLOCK, DIRECTIONS = 0.98, 1e-5, 2048, 48
WINDOW = 1.645  # in deviations of a pair at the threshold
FIRST_WINDOW = 4.6  # the same for the first direction: left with probability 4e-6
INSIDE = 0.9  # probability of the window, rounded down


def least_collisions(directions: int = DIRECTIONS, inside: float = INSIDE, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold reaches with probability 1 - ``miss``."""
    below, k = 0.0, 0
    while True:
        below += comb(directions, k) * inside**k * (1 - inside) ** (directions - k)
        if below > miss:
            return k
        k += 1


def directions_of(dim: int) -> np.ndarray:
    """The first direction, then those that are counted."""
    return np.random.default_rng([7919, dim]).standard_normal((dim, DIRECTIONS + 1))


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, dim, name, first, vector): ``name`` tells equal vectors, ``first`` is the
    projection on the first direction; both are null for vectors that link with nothing."""

    def run(batch: pa.RecordBatch):
        import xxhash

        names, firsts, kept, dims = [], [], [], []
        for parts, tag in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            v = np.array(parts, np.float64) if parts and tag is not None and None not in parts else np.zeros(0)
            dims.append(len(v))
            norm = np.sqrt(v @ v) if len(v) else 0.0
            if norm > 0 and np.isfinite(norm):
                kept.append(v.astype("<f8").tobytes())
                names.append(xxhash.xxh3_128_digest(kept[-1]))
                firsts.append(float(v @ directions_of(len(v))[:, 0] / norm))
            else:
                kept.append(None)
                names.append(None)
                firsts.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(dims, pa.int32()), pa.array(names, pa.binary()), pa.array(firsts, pa.float64()), pa.array(kept, pa.binary())],
            names=["vec_id", "label", "dim", "name", "first", "vector"],
        )

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    return map_arrow(rows, run, "vec_id long, label string, dim int, name binary, first double, vector binary")


def candidates(left: np.ndarray, right: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two tables of projections whose values collide in ``least`` columns."""
    counts = np.zeros(len(left) * len(right), np.uint8)
    base = np.arange(len(left)) * len(right)
    for k in range(left.shape[1]):
        order = np.argsort(right[:, k], kind="stable")
        values = right[order, k]
        low = np.searchsorted(values, left[:, k] - half, side="left")
        size = np.searchsorted(values, left[:, k] + half, side="right") - low
        counts[np.repeat(base, size) + order[ranges(low, size)]] += 1  # a pair meets once a column
    hit = np.flatnonzero(counts >= least)
    return hit // len(right), hit % len(right)


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the least one that the links (a, b) connect it with."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _linked(key, table: pa.Table, cosine: float) -> pa.Table:
    nodes, side = table.column("node").to_numpy(), table.column("side").to_numpy()
    dim = table.column("dim")[0].as_py()
    v = np.frombuffer(b"".join(table.column("vector").to_pylist()), "<f8").reshape(-1, dim)
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    projected = unit @ directions_of(dim)[:, 1:]
    half = WINDOW * np.sqrt(2 - 2 * cosine)
    alone = key[2].as_py() == "own" and key[4].as_py() == key[5].as_py()  # a block with itself
    one = np.flatnonzero(side == 0)
    two = one if alone else np.flatnonzero(side == 1)
    a, b = candidates(projected[one], projected[two], half, least_collisions())
    a, b = one[a], two[b]
    if alone:
        a, b = a[a < b], b[a < b]
    norms = np.sqrt((v * v).sum(1))
    sure = np.concatenate([(v[a[s : s + 65536]] * v[b[s : s + 65536]]).sum(1) for s in range(0, len(a), 65536)] or [np.zeros(0)])
    keep = sure / (norms[a] * norms[b]) >= cosine
    copies = table.column("copies").to_numpy()
    a, b = a[keep], b[keep]
    partners = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))  # exact below 2^53
    linked = np.flatnonzero(partners)
    return pa.table({"node": nodes[linked], "root": nodes[roots_of(a, b, len(nodes))[linked]], "partners": partners[linked].astype(np.int64)})


def links_of(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(node, root, partners): a row for each class that has links in a pair of blocks, with the vectors
    linked there; roots connect the classes as their links do."""
    width = float(FIRST_WINDOW * np.sqrt(2 - 2 * cosine))
    celled = classes.withColumn("cell", F.floor(F.col("first") / width).cast("int"))
    sizes = celled.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    ordered = Window.partitionBy("label", "dim").orderBy("cell")

    def neighbour(move):
        near = move("cell") - F.col("cell")
        return F.when(F.abs(near) == 1, move("n")).otherwise(0)

    around = sizes.select(
        "label", "dim", "cell", "n", neighbour(lambda c: F.lag(c).over(ordered)).alias("before"), neighbour(lambda c: F.lead(c).over(ordered)).alias("after")
    )
    placed = celled.join(around, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))

    def tasks(count: str, make):
        return F.when(F.coalesce(F.col(count), F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(F.array())

    def task(kind, at, low, high, side):
        return F.struct(F.lit(kind).alias("kind"), at.alias("at"), low.alias("low"), high.alias("high"), side.cast("int").alias("side"))

    cell, part = F.col("cell"), F.col("part")
    own = tasks("n", lambda t: task("own", cell, F.least(part, t), F.greatest(part, t), part > t))
    after = tasks("after", lambda t: task("next", cell, part, t, F.lit(0)))
    before = tasks("before", lambda t: task("next", cell - 1, t, part, F.lit(1)))
    dealt = placed.select("label", "dim", "node", "copies", "vector", F.explode(F.concat(own, after, before)).alias("t")).select(
        "label", "dim", "node", "copies", "vector", "t.*"
    )
    grouped = dealt.groupBy("label", "dim", "kind", "at", "low", "high")
    return grouped.applyInArrow(lambda key, table: _linked(key, table, cosine), "node long, root long, partners long")


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept``, a row per vector."""
    named = materialize(vectors(df, vec_id, embedding, label), "vectors")
    grouped = named.where("name is not null and vec_id is not null").groupBy("label", "name")
    classes = materialize(
        grouped.agg(
            F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("dim").alias("dim"), F.min("first").alias("first"), F.min("vector").alias("vector")
        ), "classes",
    )
    links = materialize(links_of(classes, cosine), "vector-links")
    # A class is known by its smallest id, which two classes share only where ids repeat.
    counts = links.groupBy("node").agg(F.sum("partners").alias("others"))
    found = components(links.select("node", "root"))
    known = classes.join(counts, "node", "left").join(found, "node", "left").select(
        "label", "name", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    rows = named.join(known, ["label", "name"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
