"""Removal of long repeated byte strings, found with suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document of a
smaller id. Texts are compared as UTF-8 bytes and as they came in.

1. Texts that occur more than once are one class; all documents of it but the smallest are
   repeats from end to end and need no search.
2. Each string of ``length`` bytes picks one of its ``ANCHOR``-byte parts by its content alone:
   the least hash of its 5-byte parts, taken modulo the number of places. So equal strings pick
   equal anchors; about one place in sixteen is one. Anchors go, packed by document, to the
   task of their hash, which returns the places of those that two classes have.
3. The surroundings of these places go to the task of their anchor. There equal surroundings
   are merged, a suffix array is built over the others by two-stage sorting, and neighbours
   with a common prefix of ``length`` bytes give, for every start, the smallest document that
   has the string. Starts that a smaller document has too become intervals. A suffix array holds
   the surroundings of whole anchors, about ``STEP_BYTES`` of them. Where one anchor alone has
   more, the suffixes from one place relative to it are sorted at a time: equal strings pick
   equal anchors at the same place, so they are still neighbours.
4. Intervals are joined with the texts they concern and united.

The suffix comparison works on bytes; hashes only decide what meets where, and which whole
surroundings or texts are equal. Rows of one anchor meet in one task: a passage that very many
documents hold sends at most three rows of 72 bytes for each document that has it there, and the
equal inner ones are merged first. A worker holds an Arrow batch, the surroundings of one bucket
and the arrays of one step, which take about a hundred bytes for each byte of it.

Defined cases: null and empty texts and texts shorter than ``length`` lose nothing; equal ids
do not remove from each other; a null id loses nothing and removes nothing; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .arrow import giving_back, map_arrow, ranges, runs_by_size
from .suffix_array import adjacent_common, sort_strings, suffix_array
from .words import mixed, span_hashes

LENGTH, ANCHOR, SMALL = 50, 28, 5
HASH_BYTES = 6  # of an anchor's hash, which is compared inside its bucket only
BATCH_BYTES = 2_000_000
STEP_BYTES = 500_000  # that array operations work on at a time
STEP_PLACES = 50_000
HELD_BYTES = 16_000_000  # of surroundings that are sent together
FINER = 2  # buckets of surroundings for each partition; one at a time is in memory
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def anchors_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places of the anchors of all strings of ``length`` bytes inside the documents."""
    chosen, ends = np.zeros(len(data), bool), starts + sizes
    for low in range(0, len(data), STEP_BYTES):  # strings that start in a step; the bytes of the last one go beyond it
        high = min(low + STEP_BYTES + length - 1, len(data))
        part = slice(np.searchsorted(ends, low, side="right"), np.searchsorted(starts, high))
        begins = np.maximum(starts[part], low)
        _choose(data[low:high], begins - low, np.minimum(ends[part], high) - begins, length, chosen[low:high])
    return np.flatnonzero(chosen)


def _choose(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, chosen: np.ndarray) -> None:
    places = length - ANCHOR + 1
    n = len(data)
    if n < length:
        return
    x = data.astype(np.uint64)
    part = x[: n - SMALL + 1].copy()
    for k in range(1, SMALL):
        part = (part << np.uint64(8)) | x[k : n - SMALL + 1 + k]
    # A hash in the upper half, the place in the lower: the least is the leftmost of the least.
    key = ((part + np.uint64(1)) * _MIX) & np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(key), dtype=np.uint64)
    span, low = length - SMALL + 1, key
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(key) - span + 1], low[span - width :][: len(key) - span + 1])
    first = ranges(starts[sizes >= length], sizes[sizes >= length] - length + 1)
    found = (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    chosen[first + (found - first) % places] = True


def hashes_of(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of short spans in the order of their starts, a step at a time."""
    out = np.empty(len(low), np.uint64)
    k = 0
    while k < len(low):
        base = low[k]
        end = int(np.searchsorted(low, base + STEP_BYTES))
        out[k:end] = span_hashes(_BYTES[data[base : high[k:end].max()]], low[k:end] - base, high[k:end] - base)
        k = end
    return out


def pieces_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all pieces, one after another, taken a step at a time."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    a = done = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, done + STEP_BYTES, side="right")))
        out[done : ends[b - 1]] = data[ranges(starts[a:b], sizes[a:b])]
        a, done = b, int(ends[b - 1])
    return out


def _batches(column: pa.Array):
    """(first row, last row, bytes, starts, sizes) of runs of documents. The bytes are those of
    the column, which are not copied."""
    _, edges, held = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    edges = np.frombuffer(edges, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count and np.diff(edges)[column.is_null().to_numpy(zero_copy_only=False)].any():
        yield from _batches(column.fill_null(""))
        return
    every = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    for a, b in runs_by_size(np.diff(edges).tolist(), BATCH_BYTES):
        yield a, b, every[edges[a] : edges[b]], edges[a:b] - edges[a], np.diff(edges[a : b + 1])


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def anchor_rows(docs: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """(bucket, classes, counts, hashes, places): per bucket of hashes and batch of documents
    the anchors, document after document."""

    def run(batch: pa.RecordBatch):
        classes = batch.column(0).to_numpy()
        for a, b, data, starts, sizes in _batches(batch.column(1)):
            at = anchors_of(data, starts, sizes, length)
            if not len(at):
                continue
            hashes = hashes_of(data, at, at + ANCHOR)
            owner = np.searchsorted(starts, at, side="right") - 1
            bucket = (hashes >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = _runs(bucket[order])
            rows = []
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
                part = order[s:e]
                own = owner[part]
                firsts = _runs(own)
                counts = np.diff(np.append(firsts, len(own)))
                rows.append((
                    int(bucket[part[0]]), planes(classes[a:b][own[firsts]], "<i8"), planes(counts, "<u4"),
                    planes(hashes[part], "<u8", HASH_BYTES), planes(at[part] - starts[own], "<u4"),
                ))
            names = ["bucket", "classes", "counts", "hashes", "places"]
            kinds = [pa.int32()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(docs.select("class", "text"), run, "bucket int, classes binary, counts binary, hashes binary, places binary")


def _by_bucket(batches):
    """Rows of each bucket together; the partition is sorted by bucket."""
    held: list[dict] = []
    last = None
    for batch in batches:
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        for i, bucket in enumerate(columns.pop("bucket").to_pylist()):
            if held and bucket != last:
                yield held
                held = []
            last = bucket
            held.append({name: column[i].as_buffer() for name, column in columns.items()})  # of the batch, not a copy
        del batch, columns
    if held:
        yield held


def planes(values: np.ndarray, kind: str, width: int | None = None) -> bytes:
    """Numbers byte by byte (all lowest bytes first), which shuffles in less space; only the
    lowest ``width`` bytes of each if given."""
    size = np.dtype(kind).itemsize
    return values.astype(kind).view(np.uint8).reshape(-1, size)[:, :width].T.tobytes()


def _joined(rows: list[dict], name: str, kind: str, width: int | None = None) -> np.ndarray:
    size = np.dtype(kind).itemsize
    parts = []
    for row in rows:
        table = np.frombuffer(row[name], np.uint8).reshape(width or size, -1)
        wide = np.zeros((table.shape[1], size), np.uint8)
        wide[:, : width or size] = table.T
        parts.append(wide.view(kind).ravel())
    return np.concatenate(parts)


def shared_places(packed: DataFrame, partitions: int) -> DataFrame:
    """(class, places): places of the anchors whose hash at least two classes have."""

    def run(batches):
        for rows in _by_bucket(batches):
            hashes, places = _joined(rows, "hashes", "<u8", HASH_BYTES), _joined(rows, "places", "<u4")
            classes = np.repeat(_joined(rows, "classes", "<i8"), _joined(rows, "counts", "<u4"))
            shared = np.zeros(len(hashes), bool)
            parts = np.uint64(len(hashes) // STEP_BYTES + 1)
            for k in range(int(parts)):
                part = np.flatnonzero(hashes % parts == np.uint64(k))
                part = part[np.argsort(hashes[part], kind="stable")]
                edges, own = _runs(hashes[part]), classes[part]
                if len(edges):
                    several = np.minimum.reduceat(own, edges) != np.maximum.reduceat(own, edges)
                    shared[part] = np.repeat(several, np.diff(np.append(edges, len(part))))
            which = np.flatnonzero(shared)
            which = which[np.argsort(classes[which], kind="stable")]
            own, at = classes[which], places[which]
            edges = _runs(own)
            for k in range(0, len(edges), STEP_PLACES):
                some = edges[k : k + STEP_PLACES]
                to = np.append(some, edges[k + STEP_PLACES] if k + STEP_PLACES < len(edges) else len(own))
                made = [None, pa.py_buffer(((to - to[0]) * at.itemsize).astype(np.int32)), pa.py_buffer(at[to[0] : to[-1]])]
                yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.Array.from_buffers(pa.binary(), len(some), made)], names=["class", "places"])

    dealt = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(giving_back(run), "class long, places binary")


def surroundings(texts: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """(bucket, docs, tags, froms, kinds, sizes, backs, bytes): what lies around the shared anchors
    of each text, and how far into it the anchor begins. Of those sent together equal
    surroundings of a bucket are sent once; ``kinds`` tells which one each place has."""
    back = length - ANCHOR

    def run(batch: pa.RecordBatch):
        doc_ids, own_tags, lists = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(2)
        found: list[tuple] = []
        held = 0
        for a, b, data, starts, sizes in _batches(batch.column(1)):
            each = [np.unique(np.concatenate([np.frombuffer(p, "<u4") for p in parts])).astype(np.int64) for parts in lists.slice(a, b - a).to_pylist()]
            owners = np.repeat(np.arange(b - a), [len(e) for e in each])
            places = np.concatenate(each) + starts[owners]
            for k in range(0, len(places), STEP_PLACES):
                owner, place = owners[k : k + STEP_PLACES], places[k : k + STEP_PLACES]
                low, high = np.maximum(place - back, starts[owner]), np.minimum(place + length, (starts + sizes)[owner])
                bucket = (hashes_of(data, place, place + ANCHOR) >> np.uint64(24)) % np.uint64(buckets)
                # Equal surroundings of one bucket, with the anchor at the same place.
                names = hashes_of(data, low, high) ^ bucket ^ ((place - low).astype(np.uint64) << np.uint64(32))
                _, first = np.unique(names, return_index=True)
                n = (high - low)[first]
                found.append((
                    bucket, doc_ids[a:b][owner], own_tags[a:b][owner], low - starts[owner], names,
                    names[first], n, pieces_of(data, low[first], n), bucket[first], (place - low)[first],
                ))
                held += int(n.sum()) + 8 * len(place)
                if held >= HELD_BYTES:
                    yield from _sent(found)
                    found, held = [], 0
        if found:
            yield from _sent(found)

    return map_arrow(
        texts.select("doc_id", "text", "lists", "tag"), run,
        "bucket int, docs binary, tags binary, froms binary, kinds binary, sizes binary, backs binary, bytes binary",
    )


def _sent(found: list[tuple]):
    """The rows of ``surroundings``, by bucket."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    bucket, docs, tags, froms, names = (np.concatenate([f[k] for f in found]) for k in range(5))
    kept_names, first = np.unique(np.concatenate([f[5] for f in found]), return_index=True)
    n = np.concatenate([f[6] for f in found])
    at, data = np.cumsum(n) - n, np.concatenate([f[7] for f in found])
    home = np.concatenate([f[8] for f in found])[first]
    backs = np.concatenate([f[9] for f in found])
    of_bucket = np.argsort(home, kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[of_bucket] = np.arange(len(first))
    kind = rank[np.searchsorted(kept_names, names)]
    first, home = first[of_bucket], home[of_bucket]
    order = np.argsort(bucket, kind="stable")
    edges = _runs(bucket[order])
    columns = ["bucket", "docs", "tags", "froms", "kinds", "sizes", "backs", "bytes"]
    types = [pa.int32()] + [pa.binary()] * 7
    rows, packed = [], 0
    for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        part = order[s:e]
        number = bucket[part[0]]
        low, high = np.searchsorted(home, [number, number + np.uint64(1)])
        some = first[low:high]
        rows.append((
            int(number), planes(docs[part], "<i8"), planes(tags[part], "<u4"), planes(froms[part], "<u4"), planes(kind[part] - low, "<u4"),
            planes(n[some], "<u4"), planes(backs[some], "<u4"), packer.compress(pieces_of(data, at[some], n[some])),
        ))
        packed += sum(map(len, rows[-1][1:]))
        if e == len(order) or len(rows) == 512 or packed >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=columns)
            rows, packed = [], 0


def first_owners(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int = LENGTH):
    """Over pieces of text: (piece, place in it, smallest owner of a piece that holds the string
    of ``length`` bytes from there) for every such place, from a suffix array of all pieces."""
    # Bytes of UTF-8 are below 255: one more leaves zero for the end of a piece.
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.uint8)
    text[ranges(begins, sizes)] = data[ranges(starts, sizes)] + np.uint8(1)
    piece = np.repeat(np.arange(len(sizes)), sizes + 1)
    left = np.repeat(begins + sizes, sizes + 1) - np.arange(len(text))
    order = suffix_array(text, length)
    order = order[left[order] >= length]
    edges = np.flatnonzero(adjacent_common(text, order, length) < length)
    least = np.minimum.reduceat(owners[piece[order]], edges) if len(order) else np.zeros(0, np.int64)
    first = np.empty(len(text), np.int64)
    first[order] = np.repeat(least, np.diff(np.append(edges, len(order))))
    places = np.sort(order)
    return piece[places], places - begins[piece[places]], first[places]


def owners_beside(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, backs: np.ndarray, owners: np.ndarray, length: int = LENGTH):
    """Over pieces with one anchor, for each place relative to it: (pieces, places in them, smallest
    owner of a piece that has the string of ``length`` bytes there), from the sorted suffixes."""
    for ahead in range(length - ANCHOR + 1):
        at = backs - ahead
        which = np.flatnonzero((at >= 0) & (at + length <= sizes))
        if not len(which):
            continue
        order, opens = sort_strings(data, starts[which] + at[which], length)
        edges = np.flatnonzero(opens)
        least = np.minimum.reduceat(owners[which[order]], edges)
        first = np.empty(len(which), np.int64)
        first[order] = np.repeat(least, np.diff(np.append(edges, len(order))))
        yield which, at[which], first


def _hits(docs: np.ndarray, kind: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, backs: np.ndarray, length: int):
    """(places, for each the starts in its piece that a smaller document has too), a step at a time.
    ``kind`` is the piece of each place; the pieces are distinct."""
    least = np.full(len(starts), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, docs)
    names = hashes_of(data, starts + backs, starts + backs + ANCHOR)
    by_name = np.argsort(names, kind="stable").astype(np.int32)
    edges = _runs(names[by_name])
    del names
    steps = list(runs_by_size(np.add.reduceat(sizes[by_name], edges).tolist(), STEP_BYTES))
    bounds = np.append(edges, len(by_name))
    step_of = np.empty(len(starts), np.int32)
    for k, (a, b) in enumerate(steps):
        step_of[by_name[bounds[a] : bounds[b]]] = k
    of_step = step_of[kind]
    order = np.argsort(of_step, kind="stable").astype(np.int32)
    cuts = np.append(0, np.cumsum(np.bincount(of_step, minlength=len(steps))))
    del step_of, of_step
    width = length - ANCHOR + 1
    local = np.empty(len(starts), np.int32)
    for k, (a, b) in enumerate(steps):
        piece, place = by_name[bounds[a] : bounds[b]], order[cuts[k] : cuts[k + 1]]
        local[piece] = np.arange(len(piece))
        if b == a + 1 and sizes[piece].sum() > STEP_BYTES:
            hit = np.zeros((len(place), width), bool)
            of = local[kind[place]]
            for which, at, first in owners_beside(data, starts[piece], sizes[piece], backs[piece], least[piece], length):
                firsts, column = np.full(len(piece), np.iinfo(np.int64).max), np.zeros(len(piece), np.int64)
                firsts[which], column[which] = first, at
                rows = np.flatnonzero(firsts[of] < docs[place])
                hit[rows, column[of[rows]]] = True
            for n in range(0, len(place), STEP_PLACES):
                yield place[n : n + STEP_PLACES], hit[n : n + STEP_PLACES]
            continue
        firsts = np.full((len(piece), width), np.iinfo(np.int64).max)
        which, at, first = first_owners(data, starts[piece], sizes[piece], least[piece], length)
        firsts[which, at] = first
        for n in range(0, len(place), STEP_PLACES):
            some = place[n : n + STEP_PLACES]
            yield some, firsts[local[kind[some]]] < docs[some, None]


def repeated_intervals(packed: DataFrame, partitions: int, length: int = LENGTH) -> DataFrame:
    """(doc_id, tag, low, high): bytes covered by strings that a smaller document has."""

    def run(batches):
        import zstandard

        for rows in _by_bucket(batches):
            docs, froms, tags = _joined(rows, "docs", "<i8"), _joined(rows, "froms", "<u4"), _joined(rows, "tags", "<u4")
            sizes, backs = (_joined(rows, name, "<u4").astype(np.int64) for name in ("sizes", "backs"))
            # Numbers of surroundings in each row, as numbers in the bucket, then among distinct ones.
            ahead = np.cumsum([0] + [len(r["sizes"]) // 4 for r in rows[:-1]])
            sent = _joined(rows, "kinds", "<u4").astype(np.int64) + np.repeat(ahead, [len(r["kinds"]) // 4 for r in rows])
            opener, data, filled = zstandard.ZstdDecompressor(), np.empty(int(sizes.sum()), np.uint8), 0
            for row in rows:
                part = np.frombuffer(opener.decompress(row["bytes"]), np.uint8)
                data[filled : filled + len(part)] = part
                filled += len(part)
            starts = np.cumsum(sizes) - sizes
            names = hashes_of(data, starts, starts + sizes) ^ (backs.astype(np.uint64) << np.uint64(32))
            _, one, kind = np.unique(names, return_index=True, return_inverse=True)
            rank = np.empty(len(one), np.int32)
            rank[np.argsort(one)] = np.arange(len(one))
            one, kind = np.sort(one), rank[kind][sent]  # in the order of the bytes
            del names, rank, sent
            for place, hit in _hits(docs, kind, data, starts[one], sizes[one], backs[one], length):
                turns = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
                (which, low), (_, end) = np.nonzero(turns > 0), np.nonzero(turns < 0)
                if not len(which):
                    continue
                which, base = place[which], froms[place[which]].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[which]), pa.array(tags[which].astype(np.int64)), pa.array(base + low), pa.array(base + end - 1 + length)],
                    names=["doc_id", "tag", "low", "high"],
                )

    dealt = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(giving_back(run), "doc_id long, tag long, low long, high long")


def united(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of intervals; runs that touch are one."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    opens = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    return low[opens], high[np.append(opens[1:], len(low)) - 1]


SPANS = T.ArrayType(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))


def _cut(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Rows (doc_id, n_bytes, digest, whole, text, intervals, carried): the text may be left
    out where nothing of it goes."""
    made = [("n_removed", T.LongType()), ("spans", SPANS), ("kept", T.BinaryType()), ("kept_text", T.StringType())]
    kept_fields = [rows.schema[c] for c in ["doc_id", "n_bytes", "digest", *carried]]
    schema = T.StructType(kept_fields + [T.StructField(n, t) for n, t in made])
    names = [f.name for f in kept_fields]

    def run(batch: pa.RecordBatch):
        for a, b, *_ in _batches(batch.column("text")):
            yield cut(batch.slice(a, b - a))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        lists = column["intervals"]
        flat = lists.flatten()
        lows, highs = (flat.field(k).to_numpy() for k in (0, 1))
        edges_of = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        removed, spans, kept, texts = [], [], [], []
        for k, (text, whole, n) in enumerate(zip(column["text"].to_pylist(), column["whole"].to_pylist(), column["n_bytes"].to_pylist(), strict=True)):
            part = slice(edges_of[k], edges_of[k + 1])
            if part.start == part.stop:
                removed.append(n if whole else 0)
                spans.append([{"low": 0, "high": n}] if whole else [])
                kept.append(b"" if whole else None)
                texts.append("" if whole else text)
                continue
            data = text.encode()
            low, high = united(lows[part], highs[part])
            removed.append(int((high - low).sum()))
            spans.append([{"low": int(x), "high": int(y)} for x, y in zip(low, high, strict=True)])
            edges = [0, *np.stack([low, high], 1).ravel().tolist(), len(data)]
            kept.append(b"".join(data[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)))
            texts.append(kept[-1].decode("utf-8", "ignore"))
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        values = [pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([column[n] for n in names] + values, names=schema.names)

    return map_arrow(rows, run, schema)


def repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, carried: list[str] | None = None,
    all_texts: bool = False,
) -> DataFrame:
    """A row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (removed runs),
    ``kept``, the remaining bytes, and ``kept_text``, the whole characters among them, which are
    null where nothing was removed; ``digest`` is the SHA-256 of the whole text. ``carried``
    columns come along. With ``all_texts``, ``kept_text`` also has the unchanged texts."""
    spark, carried = docs.sparkSession, carried or []
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = doc_id == "doc_id" and docs.schema[doc_id].dataType == T.LongType()  # an alias would hide that both joins shuffle alike
    rows = docs.select(*carried, F.col(doc_id) if plain else F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("class", F.xxhash64("text")).withColumn("tag", F.col("class").bitwiseAND(F.lit(0xFFFFFFFF)))  # tells rows of one id apart
    keys = materialize(rows.select("doc_id", "class", "tag", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "keys")
    long_keys = keys.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= length))
    firsts = long_keys.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("class").alias("class"), F.min("tag").alias("tag"))

    searchable = F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)
    searched = rows.where(searchable).select(*carried, "doc_id", "class", "tag", "text")
    shared = shared_places(anchor_rows(searched, partitions, length), partitions).groupBy("class").agg(F.collect_list("places").alias("lists"))
    wanted = firsts.join(shared, "class").select(F.col("first").alias("doc_id"), "tag", "lists")
    # Both joins with texts ask for the same shuffle of them, which is done once.
    dealt = searched.select(*carried, "doc_id", "tag", "text")
    around = surroundings(dealt.join(wanted, ["doc_id", "tag"]), partitions * FINER, length)
    intervals = repeated_intervals(around, partitions, length).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("low", "high")).alias("intervals"))

    copies = long_keys.join(firsts.select("digest", "first"), "digest").where("doc_id > first").select("doc_id", "tag").distinct()
    kind = intervals.schema["intervals"].dataType
    fate = intervals.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("whole", F.lit(True)).withColumn("intervals", F.lit(None).cast(kind)))
    other = rows.where(~searchable | F.col("doc_id").isNull()).select(*carried, "doc_id", "tag", "text").withColumn("intervals", F.lit(None).cast(kind)).withColumn("whole", F.lit(False))
    judged = dealt.join(fate, ["doc_id", "tag"], "left").unionByName(other).select(
        *carried, "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"),
        F.coalesce("whole", F.lit(False)).alias("whole"), F.when(F.col("intervals").isNotNull() | F.lit(all_texts), F.col("text")).alias("text"), "intervals",
    )
    return _cut(judged, carried)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with their repeated passages taken out of ``text``; all rows and columns
    stay, and a null text stays null."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("_row"), F.col(text).isNull().alias("_null"), doc_id, text)
    cut = repeats(rows, doc_id, text, length, ["_row", "_null"], all_texts=True)
    new = F.when(~F.col("_null"), F.col("kept_text"))
    return cut.select(*[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
