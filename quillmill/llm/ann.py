"""Nearest neighbours by collision-counting hashing with virtual rehashing.

Every vector is projected on many Gaussian directions, and each direction is one sorted array. A
query opens a window around its own projection in every array; vectors inside it collide there. For
a search radius R the windows are ``WINDOW`` deviations of a vector at distance R wide, so such a
vector reaches ``least_collisions()`` collisions with probability 1 - ``MISS``, and what reaches it is
verified by its cosine in double precision. Radii grow by equal steps of cosine; a larger one only widens
the windows over the same arrays (virtual rehashing), no vector is hashed again. The search ends once ``k`` verified
vectors lie within R: whatever is nearer has been verified, each with probability 1 - ``MISS``. There is
no cap on candidates.

The index holds all vectors, dealt by hash into blocks of about ``BLOCK``; the queries are dealt into
blocks too, and every pair of a vector and a query block is a task of bounded memory, which returns its
nearest ``k`` for each query. Spark keeps the best of those by a ranking that it cuts before the shuffle.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite parts, and rows without an
id, take no part; vectors of other dimensions than the query's are no candidates; rows equal in id and
vector count once; rows of one id and different vectors are queries of their own, and a query's candidates are
all rows of other ids; ties go to the smaller id; an empty table gives an empty one; other columns are not read.
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

DIRECTIONS, WINDOW, INSIDE, MISS = 48, 1.1503, 0.75, 2e-4
FIRST_SQUARE, NEXT_SQUARE = 0.01, 0.2  # of the radius; a square is 2 - 2 cos
BLOCK, QUERIES = 16384, 1024
TOGETHER = 1 << 20  # counts that are held at once


def least_collisions(directions: int = DIRECTIONS, inside: float = INSIDE, miss: float = MISS) -> int:
    """The largest count that a vector at the radius reaches with probability 1 - ``miss``."""
    below, k = 0.0, 0
    while True:
        below += comb(directions, k) * inside**k * (1 - inside) ** (directions - k)
        if below > miss:
            return k
        k += 1


def directions_of(dim: int) -> np.ndarray:
    return np.random.default_rng([104729, dim]).standard_normal((dim, DIRECTIONS))


def sound_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, dim, vector): vectors that take part, as little-endian doubles, equal rows once."""

    def run(batch: pa.RecordBatch):
        ids, dims, kept = [], [], []
        for key, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key is None or not parts or None in parts:
                continue
            v = np.array(parts, np.float64)
            if np.isfinite(v).all() and v.any():
                ids.append(key)
                dims.append(len(v))
                kept.append(v.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(kept, pa.binary())], names=["vec_id", "dim", "vector"])

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return map_arrow(rows, run, "vec_id long, dim int, vector binary").distinct()


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length one; their largest parts go first, so that no square overflows or vanishes."""
    scaled = v / np.abs(v).max(1)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of every row with one vector, each row summed alike."""
    products = (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))
    bad = ~np.isfinite(products) | ((v * v).sum(1) < 1e-280)
    if bad.any():  # squares out of range
        products[bad] = (unit(v[bad]) * unit(q[None])).sum(1)
    return products


class Index:
    """A block of vectors: a sorted array for each direction."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v, self.directions = ids, v, directions_of(v.shape[1])
        self.unit = unit(v)
        projected = (self.unit @ self.directions).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.values = np.take_along_axis(projected, order, 1)
        self.places = np.empty(order.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, order, np.arange(len(ids), dtype=self.places.dtype)[None, :], 1)

    def search(self, ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(row of the query, id, cosine): the nearest ``k`` found for each query."""
        out, size = [], max(1, TOGETHER // max(1, len(self.ids)))
        for a in range(0, len(q), size):
            out += [(a + i, key, score) for i, key, score in self._search(ids[a : a + size], q[a : a + size], k)]
        return out

    def _windows(self, centres: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the window around each query (column) in each array (row)."""
        kind = self.places.dtype
        low = np.stack([np.searchsorted(v, c, side="left") for v, c in zip(self.values, centres.T - half, strict=True)])
        high = np.stack([np.searchsorted(v, c, side="right") for v, c in zip(self.values, centres.T + half, strict=True)])
        return low.astype(kind), (high - low).astype(kind)

    def _counted(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """In how many windows each vector lies: a window is a run of places in an array, and a vector is in
        it by its place. Places before it wrap around to large numbers."""
        inside = self.places - low[:, None] < size[:, None]
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)

    def _search(self, ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        n, unit_q = len(self.ids), unit(q)
        centres, fewest = unit_q @ self.directions, least_collisions()
        tried = self.ids[None, :] == ids[:, None]  # the query's own id is no candidate
        left = n - tried.sum(1)
        found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in q]
        live, step = np.arange(len(q)), 0
        while len(live):
            radius = np.sqrt(FIRST_SQUARE + step * NEXT_SQUARE)
            if radius < 2:
                low, size = self._windows(centres[live], WINDOW * radius)
            go_on = []
            for r, i in enumerate(live.tolist()):
                hit = ~tried[i]
                if radius < 2:  # no two directions are farther apart
                    hit &= self._counted(low[:, r], size[:, r]) >= fewest
                fresh = np.flatnonzero(hit)
                tried[i] |= hit
                left[i] -= len(fresh)
                near, score = np.append(found[i][0], fresh), np.append(found[i][1], self.unit[fresh] @ unit_q[i])
                if len(near) > k:  # ties, to rounding, stay for the exact measure
                    best = np.flatnonzero(score >= np.partition(score, -k)[-k] - 1e-9)
                    near, score = near[best], score[best]
                found[i] = near, score
                # A cosine is a distance: 2 - 2 cos = distance ** 2.
                if left[i] and (len(near) < k or 2 - 2 * np.partition(score, -k)[-k] > radius * radius):
                    go_on.append(i)
            live, step = np.array(go_on, np.int64), step + 1
        out = []
        for i, (near, _) in enumerate(found):
            if len(near):
                exact = sorted(zip((-cosines(self.v[near], q[i])).tolist(), self.ids[near].tolist(), strict=True))[:k]
                out += [(i, key, -score) for score, key in exact]
        return out


def _searched(table: pa.Table, k: int) -> pa.Table:
    side = table.column("side").to_numpy()
    ids = table.column("vec_id").to_numpy()
    packed = table.column("vector").to_pylist()
    dim = table.column("dim")[0].as_py()
    v = np.frombuffer(b"".join(packed), "<f8").reshape(-1, dim)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    rows = Index(ids[one], v[one]).search(ids[two], v[two], k) if len(one) and len(two) else []
    at = [two[i] for i, _, _ in rows]
    return pa.table({
        "query_id": pa.array(ids[at] if at else [], pa.int64()), "query": pa.array([packed[i] for i in at], pa.binary()),
        "vec_id": pa.array([key for _, key, _ in rows], pa.int64()), "score": pa.array([s for _, _, s in rows], pa.float64()),
    })


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, query_block: int = QUERIES
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the ``k`` nearest found for each row of ``queries``
    among the rows of ``vectors`` with other ids. A query of fewer candidates gets all of them."""
    indexed = materialize(sound_vectors(vectors, vec_id, embedding), "ann-vectors")
    asked = materialize(sound_vectors(queries, vec_id, embedding), "ann-queries")
    # Blocks of each dimension, a row per dimension.
    sizes = indexed.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"))
    asks = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("n_asks"))
    grid = sizes.join(asks, "dim")

    def dealt(rows: DataFrame, side: int, mine: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("vec_id", "vector"), F.col("n_" + mine)).cast("int").alias(mine)
        every = F.explode(F.sequence(F.lit(0), F.col("n_" + other) - 1)).alias(other)
        return rows.join(F.broadcast(grid), "dim").select("dim", "vec_id", "vector", F.lit(side).alias("side"), part, every)

    met = dealt(indexed, 0, "blocks", "asks").unionByName(dealt(asked, 1, "asks", "blocks"))
    found = met.groupBy("dim", "blocks", "asks").applyInArrow(
        lambda table: _searched(table, k), "query_id long, query binary, vec_id long, score double"
    )
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
