"""Near-duplicate documents by MinHash with sequential Bayesian verification.

A document is the set of its distinct five-word shingles. Documents of equal sets are one class
from the start. Every class has 128 minimum hashes of 16 bits; four in a row make a band, and
classes that agree on a band are candidates. Candidates are compared hash batch by hash batch:
with m of n hashes equal and an even prior, the posterior chance that the similarity reaches
the threshold is an incomplete beta integral, and a pair is dropped once this chance is below
``MISS``. What survives is verified on the full sets of both texts, and the links
that a task returns are confirmed on the words themselves.

Pairs are compared where a bucket's members meet and never become rows: a task returns a
spanning forest of the links it has verified, which has the same components. Buckets with the
same members are compared once. A large bucket is cut at random into blocks of at most ``BLOCK``
members (fewer where texts are long), and every two blocks of it are a task, so memory is bounded
and a hot bucket is spread. Two texts at the threshold share no band with probability
(1 - 0.75**4)**32 = 5e-6.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text of
fewer than five words is one shingle; texts are read whole; equal texts are one class; rows
with equal ids and different texts are documents of their own; a null id is linked with nothing
and kept; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, materialize_at, scratch_path
from .arrow import giving_back, map_arrow, runs_by_size, texts_of
from .components import components
from .shingles import shingle_sets, word_runs

HASHES, BAND, BATCH = 128, 4, 16
SHARE = (75, 100)  # the threshold as a fraction
MISS = 1e-6
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000  # most members of a block, and about how many shingles

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit minimum hashes for every set that is not empty."""
    sizes = [len(s) for s in sets if len(s)]
    if not sizes:
        return np.zeros((0, HASHES), np.uint16)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    bounds = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((x ^ _SHIFTS[k]) * _FACTORS[k], bounds)
    out *= np.uint32(0x9E3779B1)
    return (out >> np.uint32(16)).astype(np.uint16)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, signature); the last two are null for empty sets."""

    def run(batch: pa.RecordBatch):
        import xxhash

        texts = texts_of(batch.column(2))
        for a, b in runs_by_size([len(t) for t in texts], 1_000_000):
            sets = shingle_sets(texts[a:b])
            rows = iter(signatures(sets))
            made = [next(rows).tobytes() if len(s) else None for s in sets]
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(made, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "set_id", "signature"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text)
    return map_arrow(rows, run, "doc_id long, text_hash long, n_shingles long, set_id binary, signature binary")


def bands(classes: DataFrame) -> DataFrame:
    """(key, node, size): a row for each band of each class."""

    def run(batch: pa.RecordBatch):
        for a in range(0, batch.num_rows, 20_000):
            part = batch.slice(a, 20_000)
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64).reshape(-1, HASHES // BAND)
            places = np.arange(HASHES // BAND, dtype=np.int64) * np.int64(0x1D8E4E27C47D124F)
            nodes, sizes = (np.repeat(part.column(k).to_numpy(), HASHES // BAND) for k in (0, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys * np.int64(0x6A09E667F3BCC909) + places).ravel()), pa.array(nodes), pa.array(sizes)], names=["key", "node", "size"]
            )

    return map_arrow(classes.select("node", "signature", "size"), run, "key long, node long, size long")


def chance_at_least(share: float, equal: int, n: int) -> float:
    """Posterior chance that the similarity is at least ``share`` after ``equal`` of ``n``."""
    return sum(comb(n + 1, j) * share**j * (1 - share) ** (n + 1 - j) for j in range(equal + 1))


def least_equal(share: float, miss: float) -> list[tuple[int, int]]:
    """(n, fewest equal hashes to go on with) after every batch."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        out.append((n, next((m for m in range(n + 1) if chance_at_least(share, m, n) >= miss), n)))
    return out


def promising(left: np.ndarray, right: np.ndarray, share: float, miss: float) -> np.ndarray:
    """Which pairs (row of ``left``, row of ``right``) of signatures may reach the share."""
    rows, columns = np.indices((len(left), len(right))).reshape(2, -1)
    equal = np.zeros(len(rows), np.int64)
    out = np.zeros((len(left), len(right)), bool)
    for n, fewest in least_equal(share, miss):
        part = slice(n - BATCH, n)
        equal += (left[rows, part] == right[columns, part]).sum(1)
        go_on = equal >= fewest
        rows, columns, equal = rows[go_on], columns[go_on], equal[go_on]
    out[rows, columns] = True
    return out


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every two sets, from their incidence table in pieces."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    inside = shared[column]
    owner, column = owner[inside], place[column[inside]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)  # a piece is exact in single precision, their sum is not
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        table = np.zeros((len(sets), width), np.float32)
        table[owner[a:b], column[a:b] - low] = 1
        out += table @ table.T
    return out.astype(np.int64)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric table of links connects."""
    fresh, edges = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not fresh[start]:
            continue
        fresh[start], queue = False, [start]
        while queue:
            at = queue.pop()
            found = np.flatnonzero(linked[at] & fresh)
            fresh[found] = False
            edges += [(at, k) for k in found.tolist()]
            queue += found.tolist()
    return edges


def confirmed(linked: np.ndarray, texts: list[str], share: tuple[int, int]) -> list[tuple[int, int]]:
    """A forest of the links, every edge of it confirmed on the words of both texts; an edge that
    only equal hashes made is taken out, and the forest is made anew."""
    runs: dict[int, set[bytes]] = {}
    held = 0
    sure: set[tuple[int, int]] = set()
    while True:
        edges, wrong = forest(linked), []
        for a, b in edges:
            if (a, b) in sure:
                continue
            if held > BLOCK_SHINGLES:
                runs, held = {}, 0
            for k in (a, b):
                if k not in runs:
                    runs[k] = word_runs(texts[k])
                    held += len(runs[k])
            one, two = runs[a], runs[b]
            both = len(one & two)
            if share[1] * both >= share[0] * (len(one) + len(two) - both):
                sure.add((a, b))
            else:
                wrong.append((a, b))
        if not wrong:
            return edges
        for a, b in wrong:
            linked[a, b] = linked[b, a] = False


def links_in(
    nodes: np.ndarray, sides: np.ndarray, signed: np.ndarray, sets: list[np.ndarray], texts: list[str], share: tuple[int, int], miss: float
) -> list[tuple[int, int]]:
    """A forest of the verified links of one bucket (all sides 0), or between its two blocks."""
    one = np.flatnonzero(sides == 0)
    two = np.flatnonzero(sides == 1)
    if not len(two):
        two = one
    hopeful = np.zeros((len(nodes), len(nodes)), bool)
    for a in range(0, len(one), 256):  # bounds the table of pairs
        some = one[a : a + 256]
        hopeful[np.ix_(some, two)] = promising(signed[some], signed[two], share[0] / share[1], miss)
    hopeful |= hopeful.T
    np.fill_diagonal(hopeful, False)
    which = np.flatnonzero(hopeful.any(1))
    if not len(which):
        return []
    sizes = np.array([len(sets[k]) for k in which])
    both = overlaps([sets[k] for k in which])
    sure = share[1] * both >= share[0] * (sizes[:, None] + sizes[None, :] - both)
    edges = confirmed(sure & hopeful[np.ix_(which, which)], [texts[k] for k in which], share)
    return [(int(nodes[which[a]]), int(nodes[which[b]])) for a, b in edges]


def _compared(share: tuple[int, int], miss: float):
    """Over a partition sorted by task: the links of every task."""

    def flush(held: list[dict]):
        sets = []
        for a, b in runs_by_size([len(r["text"]) for r in held], 1_000_000):
            sets += shingle_sets([r["text"] for r in held[a:b]])
        signed = np.frombuffer(b"".join(r["signature"] for r in held), np.uint16).reshape(-1, HASHES)
        nodes, sides = np.array([r["node"] for r in held]), np.array([r["side"] for r in held])
        names = [(r["key"], r["low"], r["high"]) for r in held]
        edges = [k for k in range(len(held)) if not k or names[k] != names[k - 1]] + [len(held)]
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            if names[a][1] == names[a][2] or 0 < sides[a:b].sum() < b - a:  # two blocks, and one has no members
                out += links_in(nodes[a:b], sides[a:b], signed[a:b], sets[a:b], [r["text"] for r in held[a:b]], share, miss)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        held: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                name = (row["key"], row["low"], row["high"])
                if name != last and size > 2_000_000:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row["text"]), name
        if held:
            yield flush(held)

    return run


def verified_links(classes: DataFrame, texts: DataFrame, share: tuple[int, int] = SHARE, miss: float = MISS) -> DataFrame:
    """(a, b): links that connect the classes as all links do."""
    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bands(classes)
    member = F.xxhash64("node")
    buckets = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(member).alias("h"), F.bit_xor(F.xxhash64(member, F.lit(1))).alias("g"), F.sum("size").alias("size")
    ).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    distinct = buckets.groupBy("n", "h", "g", "size").agg(F.min("key").alias("key")).select("key", parts.alias("parts"))
    keys = rows.join(distinct, "key").groupBy("node").agg(F.collect_list(F.struct("key", "parts")).alias("keys"))  # at most one per band
    # Texts of candidates are written once, with all their buckets.
    source = ["doc_id", "text_hash"]
    folder = scratch_path(classes.sparkSession, "candidates")
    candidates = materialize_at(
        keys.join(classes.select("node", "signature", "first.*"), "node").join(texts.dropDuplicates(source), source), folder
    )
    part = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")
    dealt = (
        candidates.select("node", "signature", "text", F.inline("keys")).withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
            (F.col("part") > F.col("other")).cast("int").alias("side"), "node", "signature", "text",
        )
    )
    together = dealt.repartition(partitions, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    links = materialize(together.mapInArrow(giving_back(_compared(share, miss)), "a long, b long").distinct(), "links")
    discard(classes.sparkSession, folder)
    return links


def grouped(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: tuple[int, int] = SHARE, miss: float = MISS
) -> DataFrame:
    """The columns of ``near_duplicates``, the xxhash64 ``text_hash`` of the text and ``group``, the
    component (null where nothing can be linked), a row per document."""
    sketched = materialize(sketches(docs, doc_id, text), "sketches")
    linkable = sketched.where("set_id is not null and doc_id is not null")
    # A class has a number of its own: its smallest id may also be that of another class.
    made = linkable.groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("signature").alias("signature"), F.min("n_shingles").alias("size")
    )
    classes = materialize(made.withColumn("node", F.monotonically_increasing_id()), "classes")
    texts = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")
    ).where("doc_id is not null and text is not null")
    found = components(verified_links(classes, texts, share, miss))
    linked = classes.select("set_id", "node", F.col("first.doc_id").alias("least")).join(found, "node", "left")
    smallest = linked.where("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    roots = linked.join(smallest, "component", "left").select(
        "set_id", F.coalesce("component", "node").alias("group"), F.coalesce("smallest", "least").alias("component_id")
    )
    placed = sketched.join(roots, "set_id", "left").withColumns({
        "group": F.when(F.col("doc_id").isNotNull(), F.col("group")),
        "component_id": F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")),
    })
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return placed.select("doc_id", "text_hash", "n_shingles", "group", "component_id", kept)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: tuple[int, int] = SHARE, miss: float = MISS
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and
    ``kept`` (whether that is the document's own), a row per document."""
    return grouped(docs, doc_id, text, share, miss).select("doc_id", "n_shingles", "component_id", "kept")
