"""N-gram Jaccard self-join by prefix trees.

A document's set holds the hashes of its distinct word 5-grams. Sets are put in one global order, common n-grams last,
and their prefixes (of which any partner of similarity 0.75 must share a part) are stored in tries, one for each slice of
the hash range, so that Spark shuffles slices and no task needs the whole order. N-grams that the same sets pass are one
node with their number as weight: an overlap is counted once for all sets below. From then on the tries are a table (node, weight, set).

1. A star instead of pairs: at every node the set that shares most n-grams with others is the centre, and each set tries the centre that
   it shares most with. Verified links are joined into components.
2. Nodes whose sets lie in one component are done. At the others, pairs of sets of different components are held against the
   remaining-length bounds (``_may_link``): what both share in their prefixes, and what can follow after the prefix that ends first.
   Pairs are not listed: what survives is named under pairs of tiles (groups of near sets), very many sets by their tile, and they
   meet in one task, which multiplies 0-1 matrices of their n-grams and returns a forest.

No pair that could join two components is skipped, so the result is exact.

Skew. Documents with equal sets are one class from the start. A node that more than ``HOT`` sets pass is split into blocks by size
and hash, and every pair of blocks whose sizes allow a link is a unit of work of its own; its sets of one component are never compared.

The global order comes from a counting sketch of fixed size (``SKETCH_BITS``): only n-grams that stand
out are moved back, all others are ordered by hash. Any order gives the same, exact result. Hashes have 64 bits.

Defined results: null and empty texts have an empty set and link with nothing; a text with fewer than five
words is one n-gram; rows with equal texts are linked; a null id never becomes a component's id unless
nothing else is there; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import Scratch, connected_components, partitions, read, text_batches

N = 5
#: Similarity as a ratio of integers.
PERCENT = 75
SKETCH_BITS = 20
CHUNKS = 16
#: Sets below a node up to which they are compared in one task; more are split into blocks of about so many.
HOT = 1024
#: Sets of a group that are multiplied at once, with as many of another group.
TILE = 128
#: Sets under a pair of tiles from which both tiles are named whole.
DENSE = 24
#: Entries that a task deals out at once: small pieces, which neither Arrow nor the heap of the JVM has to hold whole.
FLUSH = 400_000
#: Entries of a slice, about.
SLICE = 600_000


class _WordHash(dict):
    """Word -> 64-bit hash, remembered for frequent words; starts anew when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, hashes: _WordHash) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text, A-Z in lower case."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(N, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return np.unique(_mix(acc))


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).view(np.int64))


def required(na, nb):
    """The least overlap of linked sets: 100 * o >= 75 * (na + nb - o)."""
    return -(-PERCENT * (na + nb) // (100 + PERCENT))


def prefix_length(n):
    return n - (PERCENT * n + 99) // 100 + 1


TEXTS = ("doc_id", "th", "text")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, text as bytes); key and th together name a document."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_hash(text).alias("th"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and fingerprint of every set, and at the end the task's counts of hash prefixes."""
    hashes, counts = _WordHash(), np.zeros(1 << SKETCH_BITS, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
    for batch in batches:
        n, fp = [], []
        for text in batch.column(2):
            s = shingle_set(text.as_py(), hashes)
            n.append(len(s))
            fp.append(set_id(s))
            np.add.at(counts, s >> np.uint64(64 - SKETCH_BITS), np.uint32(1))
        none = pa.nulls(len(n), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), none, pa.nulls(len(n), pa.binary())], schema=schema)
    parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, CHUNKS)]
    null = pa.nulls(CHUNKS, pa.int64())
    yield pa.RecordBatch.from_arrays([null, null, pa.nulls(CHUNKS, pa.int32()), null, pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(part), np.uint32)
            sums[chunk] = sums[chunk] + x if chunk in sums else x.astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])


def _heaviness(first: DataFrame, spark: SparkSession) -> np.ndarray:
    """A byte for each hash prefix: 0, or how far its count stands out. Fixed size: 2 ** SKETCH_BITS."""
    rows = first.where("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(_add_counts, "chunk int, counts binary").collect()
    counts = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.float64)
    for r in rows:
        counts[r.chunk] += np.frombuffer(r.counts, np.uint64)
    counts = counts.ravel()
    mean = counts.mean()
    out = np.zeros(len(counts), np.uint8)
    high = counts > mean + 8 * np.sqrt(mean) + 16
    out[high] = np.clip(np.log2(counts[high]), 1, 62).astype(np.uint8)
    return out


#: An n-gram of the prefix of set fp; low: it stands before the last threshold that the prefix reaches.
ENTRY = np.dtype([("token", "<u8"), ("fp", "<i8"), ("low", "u1")])
#: Places in the global order, below which every set counts its n-grams: around a quarter of the common range of hashes, where
#: prefixes end, then the end of that range and steps of heaviness.
THRESHOLDS = np.concatenate([np.linspace(0.14, 0.4, 15) * 2.0**56, np.linspace(0.45, 0.95, 11) * 2.0**56, np.array([1, *range(7, 21)]) * 2.0**56]).astype(np.uint64)
#: A set: its size, how many of the thresholds its prefix reaches, and its n-grams in the range before each of them.
CLASS = np.dtype([("fp", "<i8"), ("n", "<u4"), ("reach", "<u4"), ("ranges", "<u2", (len(THRESHOLDS),))])
#: A range with so many n-grams or more counts as boundless, which only weakens bounds.
MANY = 65_535
SLICES = "part int, entries binary"


def described(s: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(prefix, thresholds that it reaches, n-grams below each threshold) of a sorted set.

    The global order is by heaviness, then by hash.
    """
    weight = heavy[s >> np.uint64(64 - SKETCH_BITS)]
    order = np.argsort(weight, kind="stable")
    place = (weight[order].astype(np.uint64) << np.uint64(56)) | (s[order] >> np.uint64(8))
    p = int(prefix_length(len(s)))
    return s[order[:p]], int(np.searchsorted(THRESHOLDS, place[p - 1], side="right")), np.searchsorted(place, THRESHOLDS)


def _second_pass(heavy, parts: int):
    """Prefixes of the distinct sets as packed entries, dealt by slices of the hash range; the sets themselves in slice -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weight = _WordHash(), heavy.value
        held: list[np.ndarray] = []
        classes: list[tuple] = []
        seen: set[int] = set()
        size = 0
        for batch in batches:
            for text in batch.column(2):
                s = shingle_set(text.as_py(), hashes)
                if not len(s) or (fp := set_id(s)) in seen:
                    continue
                seen.add(fp)
                first, reach, below = described(s, weight)
                classes.append((fp, len(s), reach, np.minimum(np.diff(below, prepend=0), MANY)))
                e = np.empty(len(first), ENTRY)
                e["token"], e["fp"], e["low"] = first, fp, np.arange(len(first)) < (below[reach - 1] if reach else 0)
                held.append(e)
                size += len(e)
                if size >= FLUSH:
                    yield _dealt(held, parts)
                    held, size = [], 0
            if len(classes) > 20_000:
                yield _dealt([np.array(classes, CLASS)], parts)
                classes = []
                seen.clear()
        if classes:
            yield _dealt([np.array(classes, CLASS)], parts)
        if held:
            yield _dealt(held, parts)

    return run


def _dealt(held: list[np.ndarray], parts: int) -> pa.RecordBatch:
    e = np.concatenate(held)
    of_sets = e.dtype == CLASS
    part = (e["fp"].view(np.uint64) if of_sets else e["token"]) % np.uint64(parts)
    part = part.astype(np.int32) + parts * of_sets
    order = np.argsort(part, kind="stable")
    at, starts = np.unique(part[order], return_index=True)
    blobs = [e[rows].tobytes() for rows in np.split(order, starts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "entries"])


#: The set fp below a node of a trie, which stands for w n-grams in a row with the same sets below them, of which ``low``
#: stand before the last threshold that the set's prefix reaches; without a node: the set itself.
NODES = "node long, w int, low int, fp long, n int, reach int, below binary"


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, np.int64)


def trie(e: np.ndarray) -> np.ndarray:
    """The nodes of one slice that two sets or more pass, as rows (node, w, low, fp)."""
    out = np.dtype([("node", "<i8"), ("w", "<i4"), ("low", "<i4"), ("fp", "<i8")])
    # one row for each n-gram and set, by n-gram; n-grams of one set alone end no path
    e = e[np.lexsort((e["fp"], e["token"]))]
    e = e[np.r_[True, (e["fp"][1:] != e["fp"][:-1]) | (e["token"][1:] != e["token"][:-1])]] if len(e) else e
    start = _starts(e["token"])
    width = np.diff(np.r_[start, len(e)])
    e, width = e[np.repeat(width > 1, width)], width[width > 1]
    if not len(e):
        return np.empty(0, out)
    start = np.cumsum(width) - width
    # n-grams that the same sets hold are one node
    below = np.add.reduceat(_mix(e["fp"].view(np.uint64)), start) + width.astype(np.uint64)
    _, first, node, same = np.unique(below, return_index=True, return_inverse=True, return_counts=True)
    into = np.cumsum(width[first]) - width[first]
    rows = np.repeat(start[first] - into, width[first]) + np.arange(width[first].sum())
    # the rows of such n-grams are in the same order: by set
    low = np.bincount(np.repeat(into[node.ravel()] - start, width) + np.arange(len(e)), e["low"], len(rows))
    nodes = np.empty(len(rows), out)
    nodes["node"], nodes["w"] = np.repeat(e["token"][start[first]].view(np.int64), width[first]), np.repeat(same, width[first])
    nodes["fp"], nodes["low"] = e["fp"][rows], low
    return nodes


def _node_rows(x: np.ndarray) -> pa.RecordBatch:
    n = len(x)
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())]
    of = lambda c, t: pa.array(np.ascontiguousarray(x[c]).astype(t))
    if x.dtype == CLASS:
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * len(THRESHOLDS)), n, [None, pa.py_buffer(x["ranges"].tobytes())]).cast(pa.binary())
        columns = [*none[:3], of("fp", np.int64), of("n", np.int32), of("reach", np.int32), flat]
    else:
        columns = [of("node", np.int64), of("w", np.int32), of("low", np.int32), of("fp", np.int64), *none[3:]]
    return pa.RecordBatch.from_arrays(columns, names=["node", "w", "low", "fp", "n", "reach", "below"])


def _tries(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by slice: part, entries."""
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            x = np.concatenate(held)
            x = x[np.unique(x["fp"], return_index=True)[1]] if x.dtype == CLASS else trie(x)
            for k in range(0, len(x), 50_000):
                yield _node_rows(x[k : k + 50_000])

        for batch in batches:
            for part, entries in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now:
                    yield from done()
                    now, held = part, []
                held.append(np.frombuffer(entries.as_buffer(), ENTRY if part < parts else CLASS))
        yield from done()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHash()
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            s = [shingle_set(x.as_py(), hashes) for x in batch.column(0)[k : k + 500]]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())], names=["fp", "s"])


def _below(blobs: pa.Array) -> np.ndarray:
    """Counts below each threshold, after a column of zeros; behind a boundless range they are less than the truth."""
    x = np.frombuffer(b"".join(x.as_py() for x in blobs), np.uint16).reshape(len(blobs), -1)
    return np.concatenate([np.zeros((len(x), 1), np.int32), np.cumsum(x, axis=1, dtype=np.int32)], axis=1)


def _ranges(below: np.ndarray, n: np.ndarray) -> np.ndarray:
    """No less than the n-grams of each range between thresholds, the one behind the last included."""
    x = np.diff(below, axis=1, append=n[:, None])
    x[x >= MANY] = np.iinfo(np.int32).max
    return x


def _may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, s: np.ndarray, reach: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (a, b) the remaining-length bounds let be linked.

    n: n-grams, s: those before the last threshold that the prefix reaches which another prefix holds. Up to the last threshold that
    both reach, what is common is in both prefixes, so no more than the lesser s; beyond it, each range between thresholds gives the lesser of two counts.
    """
    fits = np.flatnonzero(100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b]))
    x, y = a[fits], b[fits]
    at = np.minimum(reach[x], reach[y])
    least = required(n[x], n[y]) - np.minimum(s[x], s[y])
    more = np.minimum(n[x] - below[x, at], n[y] - below[y, at]) >= least
    fits, x, y, at, least = fits[more], x[more], y[more], at[more], least[more]
    out = np.zeros(len(a), bool)
    for k in range(0, len(fits), 20_000):
        i, j, t = x[k : k + 20_000], y[k : k + 20_000], at[k : k + 20_000]
        rest = np.minimum(_ranges(below[i], n[i]), _ranges(below[j], n[j]))
        rest[np.arange(rest.shape[1]) < t[:, None]] = 0
        out[fits[k : k + 20_000]] = rest.sum(axis=1) >= least[k : k + 20_000]
    return out


def _tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp, z and both sides' n, s, reach, below -> the pairs (fp, z) that may be linked."""
    for batch in batches:
        k = batch.num_rows
        n, s, reach = (np.concatenate([batch.column(c).to_numpy(), batch.column(c + 4).to_numpy()]).astype(np.int64) for c in (2, 3, 4))
        below = np.concatenate([_below(batch.column(5)), _below(batch.column(9))]) if k else np.zeros((0, len(THRESHOLDS) + 1), np.int32)
        keep = pa.array(_may_link(np.arange(k), np.arange(k) + k, n, s, reach, below))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["fp", "z"])


UNITS = ("unit", "fp", "n", "s", "reach", "comp", "tile", "side", "below")


def _unit_pairs(start: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each unit, in blocks of bounded size."""
    for g in np.unique(width).tolist():
        at = start[width == g]
        if g <= 64:
            i, j = np.triu_indices(g, 1)
            for some in np.array_split(at, max(1, len(at) * len(i) // 250_000)):
                yield (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
            continue
        step = max(1, 250_000 // g)
        for s in at.tolist():
            for k in range(0, g, step):
                i, j = np.meshgrid(np.arange(k, min(k + step, g)), np.arange(k, g), indexing="ij")
                later = j > i
                yield s + i[later], s + j[later]


#: Under the pair of tiles ``key``: a set of ``tile``, or without a set (whole) all of that tile.
LATE = "key long, tile long, whole boolean, fp long, comp long"


def _whole_tiles(rows: np.ndarray) -> np.ndarray:
    """Distinct rows; where very many sets are named under a key, its tiles instead."""
    rows = np.unique(rows)
    _, at, many = np.unique(rows["key"], return_inverse=True, return_counts=True)
    dense = rows["whole"] | (many[at.ravel()] > DENSE)
    rows["fp"][dense], rows["comp"][dense], rows["whole"][dense] = 0, 0, True
    return np.unique(rows)


def _late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of different components that may be linked, both sets or their tiles. Rows come sorted by unit."""
    found = np.dtype([("key", "<i8"), ("tile", "<i8"), ("whole", "?"), ("fp", "<i8"), ("comp", "<i8")])
    held: list[tuple] = []
    out = np.empty(0, found)

    def pairs(x: tuple) -> np.ndarray:
        unit, fp, n, s, reach, comp, tile, side, below = x
        start = _starts(unit)
        got = [np.empty(0, found)]
        for a, b in _unit_pairs(start, np.diff(np.r_[start, len(unit)])):
            # 1 and 2 are the two blocks of a split node, 3 is the whole node or a block with itself
            cross = (comp[a] != comp[b]) & ((side[a] == 3) | (side[a] != side[b]))
            a, b = a[cross], b[cross]
            may = _may_link(a, b, n, s, reach, below)
            a, b = a[may], b[may]
            low, high = np.minimum(tile[a], tile[b]).view(np.uint64), np.maximum(tile[a], tile[b]).view(np.uint64)
            rows = np.empty(2 * len(a), found)
            rows["key"] = np.tile(_mix(_mix(low) ^ high).view(np.int64), 2)
            both = np.r_[a, b]
            rows["tile"], rows["fp"], rows["comp"], rows["whole"] = tile[both], fp[both], comp[both], False
            got.append(_whole_tiles(rows))
        return _whole_tiles(np.concatenate(got))

    def batches_of(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(x), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[k : k + 50_000][c])) for c in found.names], names=list(found.names))

    def joined() -> tuple:
        return tuple(np.concatenate([x[c] for x in held]) for c in range(len(UNITS)))

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((*(batch.column(c).to_numpy().astype(np.int64) for c in range(8)), _below(batch.column(8))))
        size += batch.num_rows
        if size < 50_000:
            continue
        x = joined()
        last = int(_starts(x[0])[-1])  # the last unit may go on
        out = _whole_tiles(np.concatenate([out, pairs(tuple(c[:last] for c in x))]))
        held, size = [tuple(c[last:] for c in x)], len(x[0]) - last
        if len(out) > 500_000:
            yield from batches_of(out)
            out = np.empty(0, found)
    if held:
        out = _whole_tiles(np.concatenate([out, pairs(joined())]))
    yield from batches_of(out)


def _all_overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0-1 matrices over slices of the n-grams that two sets share."""
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    start = _starts(token)
    width = np.diff(np.r_[start, len(token)])
    column = np.repeat(np.arange(len(start)), width)[np.repeat(width > 1, width)]
    owner = owner[np.repeat(width > 1, width)]
    out = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        column = np.cumsum(np.r_[0, column[1:] != column[:-1]])
        step = min(8192, int(column[-1]) + 1)
        for k in range(0, int(column[-1]) + 1, step):
            s, t = np.searchsorted(column, [k, k + step])
            x = np.zeros((len(sets), step), np.float32)
            x[owner[s:t], column[s:t] - k] = 1
            out += x @ x.T
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All linked sets of different components under one key, as a forest: rows come sorted by key: key, fp, comp, s."""
    now, held = None, {}

    def done() -> pa.RecordBatch:
        fp, comp = list(held), np.array([c for c, _ in held.values()], np.int64)
        sets = [np.frombuffer(s, np.uint64) for _, s in held.values()]
        n = np.array([len(x) for x in sets])
        links = (_all_overlaps(sets) >= required(n[:, None], n[None, :])) & (comp[:, None] != comp[None, :])
        root, a, b = {c: c for c in comp.tolist()}, [], []

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(links))), strict=True):
            u, v = find(int(comp[i])), find(int(comp[j]))
            if u != v:
                root[u] = v
                a.append(fp[i])
                b.append(fp[j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for key, fp, comp, s in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != now:
                if held:
                    yield done()
                now, held = key, {}
            held[fp] = comp, s
    if held:
        yield done()


#: Lists of ids (24 bytes a row at most) up to this many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def _links(wanted: DataFrame, rows: DataFrame, texts: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Links (a, b) among the sets under each key of ``wanted`` (key, fp, comp), as forests. A set is made once, from one of its texts."""
    involved = wanted.select("fp").distinct()
    chosen = rows.join(involved, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("r.*")
    chosen = _small(scratch.save(chosen, f"{tag}-chosen"))
    one = texts.alias("t").join(chosen.alias("c"), F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.th") == F.col("c.th")), "left_semi")
    sets = scratch.save(one.select("text").mapInArrow(_sets, "fp long, s binary"), f"{tag}-sets")
    full = sets.join(_small(wanted), "fp").select("key", "fp", "comp", "s").repartition(partitions(sets.sparkSession), "key").sortWithinPartitions("key")
    return scratch.save(full.mapInArrow(_linked, "a long, b long"), f"{tag}-links")


def _dealt_tiles(groups: DataFrame) -> DataFrame:
    """(fp, group) -> with ``tile``: a group is dealt into tiles of about ``TILE`` sets."""
    size = groups.groupBy("group").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    return groups.join(size, "group").withColumn("tile", F.xxhash64("group", F.pmod(F.xxhash64("fp"), F.col("tiles")))).drop("tiles")


def _units(members: DataFrame) -> DataFrame:
    """Members of nodes by units of work: a whole node, or a pair of blocks of a hot one whose sizes allow a link."""
    whole = members.where(F.col("k") <= HOT).withColumn("unit", F.col("node")).withColumn("side", F.lit(3))
    # partners differ by a third of their size at most: they are in the same range of sizes or the next
    blocks = F.ceil(F.col("k") / HOT)
    x = members.where(F.col("k") > HOT).withColumn("blocks", blocks).withColumn("range", F.floor(F.ln("n") / F.lit(float(np.log(1.35)))))
    x = x.withColumn("own", F.col("range") * F.col("blocks") + F.pmod(F.xxhash64("fp"), F.col("blocks")))
    x = x.withColumn("other", F.explode(F.sequence((F.col("range") - 1) * F.col("blocks"), (F.col("range") + 2) * F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    split = x.withColumn("unit", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", side)
    return whole.select(*UNITS).union(split.select(*UNITS))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, and if ``hashed`` the hash ``th`` of the text (see ``text_hash``)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts = _texts(text_batches(docs), key, text)
    first = scratch.save(texts.mapInArrow(_first_pass, "doc_id long, th long, n int, fp long, chunk int, counts binary"), "first")
    heavy = spark.sparkContext.broadcast(_heaviness(first, spark))
    rows = first.where("chunk is null").select("doc_id", "th", "n", "fp")
    parts = max(4 * partitions(spark), (rows.agg(F.sum("n")).first()[0] or 0) // (4 * SLICE))
    slices = texts.mapInArrow(_second_pass(heavy, parts), SLICES).repartition(partitions(spark), "part").sortWithinPartitions("part")
    found = scratch.save(slices.mapInArrow(_tries(parts), NODES), "found")
    nodes = found.where("node is not null").select("node", "w", "low", "fp")
    shared = nodes.groupBy("fp").agg(F.sum("low").alias("s"), F.sum("w").alias("spread"))
    known = scratch.save(found.where("node is null").select("fp", "n", "reach", "below").join(shared, "fp").select("fp", "n", "s", "reach", "below", "spread"), "known")
    told = known.columns[1:5]

    # an original shares more with each copy than copies with each other: it is the centre
    centre = nodes.join(known.select("fp", "spread"), "fp").groupBy("node").agg(F.max(F.struct("spread", "fp"))["fp"].alias("z"))
    # tables of their own, so that Spark can split joins at hot keys
    centre = scratch.save(centre, "centre")
    star = nodes.join(centre, "node").where("fp <> z").groupBy("fp", "z").agg(F.sum("w").alias("c"))
    star = scratch.save(star.groupBy("fp").agg(F.max_by("z", F.struct("c", "z")).alias("z")), "star")
    tried = star.join(known, "fp").join(known.select(F.col("fp").alias("z"), *[F.col(c).alias(f"{c}_z") for c in told]), "z")
    tried = tried.select("fp", "z", *told, *[f"{c}_z" for c in told]).mapInArrow(_tried, "fp long, z long")
    tried = scratch.save(_dealt_tiles(tried.withColumnRenamed("z", "group")), "tried")
    wanted = tried.select("tile", "fp").union(tried.select("tile", "group")).distinct().select(F.col("tile").alias("key"), "fp", F.col("fp").alias("comp"))
    links = _links(scratch.save(wanted, "wanted1"), rows, texts, scratch, "r1")
    comps = scratch.save(connected_components(links, scratch, "round1"), "comps1")

    # near sets share a tile: those of a large component, or those that tried the same centre
    large = comps.groupBy("comp").agg(F.count("*").alias("k")).where(F.col("k") * 8 >= TILE).select("comp", F.lit(True).alias("large"))
    of = known.select("fp").join(comps.withColumnRenamed("node", "fp"), "fp", "left").join(star, "fp", "left")
    of = of.withColumn("comp", F.coalesce("comp", "fp")).join(large, "comp", "left")
    of = of.select("fp", "comp", F.when(F.col("large"), F.xxhash64("comp")).otherwise(F.xxhash64(F.coalesce("z", "fp"), F.lit(1))).alias("group"))
    of = scratch.save(_dealt_tiles(of).select("fp", "comp", "tile"), "of")
    mixed = nodes.join(of.select("fp", "comp"), "fp").groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"))
    mixed = scratch.save(mixed.where("lo <> hi").select("node", "k"), "mixed")
    members = nodes.join(mixed, "node").join(of, "fp").join(known.select("fp", *told), "fp")
    units = _units(members).repartition(partitions(spark), "unit").sortWithinPartitions("unit")
    late = scratch.save(units.mapInArrow(_late, LATE).distinct(), "late")
    whole = late.where("whole").select("key", "tile").join(of, "tile").select("key", "fp", "comp")
    wanted = scratch.save(late.where("not whole").select("key", "fp", "comp").union(whole).distinct(), "wanted2")
    links = links.union(_links(wanted, rows, texts, scratch, "r2"))
    comps = scratch.save(connected_components(links, scratch, "round2"), "comps2")
    scratch.drop("found", "known", "centre", "star", "tried", "wanted1", "r1-chosen", "r1-sets", "r1-links", "comps1", "of", "mixed", "late", "wanted2", "r2-chosen", "r2-sets", "r2-links")

    smallest = rows.join(comps, rows["fp"] == comps["node"]).groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = comps.join(smallest, "comp").select(F.col("node").alias("fp"), "component_id")
    copies = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = copies.join(linked, "fp", "left").select("fp", F.least("least", "component_id").alias("component_id"))
    return rows.join(ids, "fp", "left").select("doc_id", *["th"] * hashed, F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the smallest id that it reaches by links."""
    return join(read(spark, sf_dir, "documents"))
