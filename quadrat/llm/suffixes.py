"""Removal of long byte strings that repeat, by sorting suffixes at content-chosen places.

Every string of ``LENGTH`` bytes has an anchor: the least-hashed (of equals the first) of its grams of ``GRAM`` bytes. Equal strings have equal
anchors at equal offsets, so only suffixes that begin at anchors need to be sorted, about one for each 170 bytes, and only
against those of the same gram. The strings with one anchor are a stretch: the text from the first string's beginning to the last one's end.
Stretches travel as hashes (128 bits) and places; stretches whose gram stands nowhere else are dropped, equal ones become one.

The bytes of the stretches left, one for each text of a stretch, are fetched and dealt by gram, and both the suffixes at the anchors and the reversed
texts before them are put in order by deep-shallow sorting: multikey quicksort on words of eight bytes to ``SHALLOW`` bytes, then a blind trie
for each group that still agrees. It stores branching depths and one byte for each branch only, finds a place by one comparison, and
yields the common prefixes of neighbours on the way out. Strings that begin d bytes before their anchors are equal exactly
if the reversed texts agree on d bytes and the suffixes on ``LENGTH`` - d, which two sums over those common prefixes tell for all stretches of
a batch at once. Nothing is compared pair by pair.

A gram with more than ``HOT`` different stretches is not sent to one task: its strings are counted by 128-bit hashes with map-side sums.

Defined results: a null text is empty; a text shorter than ``LENGTH`` bytes loses nothing; rows that agree in doc_id and text count as
two documents (each loses what the other has) with the same result; a very long text is cut into overlapping pieces; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from quadrat.llm.common import Scratch, partitions, read, text_batches

LENGTH = 400
GRAM = 64
SHALLOW = 32
#: Starts of strings that are looked at together; positions take 24 bits.
PIECE = 1 << 18
#: Stretches that are sorted together, and different stretches of a gram from which its strings are counted instead.
FLUSH = 4000
HOT = 50_000

_POSITION = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram (a power of two long) at every place."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < gram:
        factor = np.uint64(0x9E3779B97F4A7C15 ^ (width * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFE))
        h = h[:-width] * factor + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def stretches(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, begin, end, anchor, hash of the anchor's gram) of texts one after another; fewer than 2^24 bytes."""
    empty = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    if len(data) < length:
        return empty
    h = gram_hashes(data, gram)
    # of each string: the least of its grams' hashes, whose low bits are the place
    v = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    width = length - gram + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(data) - length + 1
    place = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & _POSITION).astype(np.int64)
    stop = np.cumsum(sizes)
    inside = np.flatnonzero(np.arange(starts) + length <= np.repeat(stop, sizes)[:starts])
    if not len(inside):
        return empty
    place = place[inside]
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    begin, last = inside[new], inside[np.r_[new[1:] - 1, len(inside) - 1]]
    anchor = place[new]
    text = np.searchsorted(stop, begin, side="right")
    first = (stop - sizes)[text]
    return text, begin - first, last + length - first, anchor - first, h[anchor]


#: A stretch of a text, n times in it; without a hash: a part of the text that repeats within the text itself.
PLACES = "h long, g1 long, g2 long, n int, doc_id long, th long, at long, size long, a int"


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, offset, bytes) of about PIECE starts each."""
    held, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), PIECE):
            part = t if at == 0 and len(t) < PIECE + length else t[at : at + PIECE + length - 1]
            held.append((k, at, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the intervals cover."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    return begin[new], reach[np.r_[new[1:] - 1, len(begin) - 1]]


def _places(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            found = []
            for held in _pieces(texts, length):
                joined = b"".join(p for _, _, p in held)
                part, begin, end, anchor, h = stretches(np.frombuffer(joined, np.uint8), np.array([len(p) for _, _, p in held]), length, gram)
                start = np.cumsum([0] + [len(p) for _, _, p in held])[part]
                digests = b"".join(xxhash.xxh3_128_digest(joined[s:e]) for s, e in zip((start + begin).tolist(), (start + end).tolist(), strict=True))
                g = np.frombuffer(digests, np.int64).reshape(-1, 2)
                text, offset = (np.array([x[c] for x in held])[part] for c in (0, 1))
                found.append((text, h.view(np.int64), g[:, 0], g[:, 1], offset + begin, end - begin, anchor - begin))
            if not found:
                continue
            text, h, g1, g2, at, size, a = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((at, h, g2, g1, text))
            text, h, g1, g2, at, size, a = (x[order] for x in (text, h, g1, g2, at, size, a))
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]) | (h[1:] != h[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.r_[first, len(text)])
            yield _place_rows(batch, text[first], h[first], g1[first], g2[first], n, at[first], size[first], a[first])
            again = np.repeat(n > 1, n)
            if again.any():
                # places of different texts are kept apart by an offset
                apart = np.int64(1 << 40)
                begin, end = merged(text[again] * apart + at[again], text[again] * apart + at[again] + size[again])
                zero = np.zeros(len(begin), np.int64)
                yield _place_rows(batch, begin // apart, None, zero, zero, zero, begin % apart, end - begin, zero)

    return run


def _place_rows(batch: pa.RecordBatch, text, h, g1, g2, n, at, size, a) -> pa.RecordBatch:
    rows = pa.array(text)
    columns = [pa.nulls(len(text), pa.int64()) if h is None else pa.array(h), pa.array(g1), pa.array(g2), pa.array(n.astype(np.int32))]
    columns += [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int64)), pa.array(size.astype(np.int64)), pa.array(a.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["h", "g1", "g2", "n", "doc_id", "th", "at", "size", "a"])


def common_prefix(s: bytes, t: bytes) -> int:
    m = min(len(s), len(t))
    x = int.from_bytes(s[:m], "big") ^ int.from_bytes(t[:m], "big")
    return m - (x.bit_length() + 7) // 8


class _Node:
    """A branch of a blind trie: its depth, and by the next byte (-1: the string ends) a branch or a list of equal strings."""

    __slots__ = ("depth", "next")

    def __init__(self, depth: int):
        self.depth, self.next = depth, {}


def blind_order(group: list[int], strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Strings of a group in order, and the common prefix of each with the one before (the first: 0)."""
    root: _Node | list[int] = [group[0]]
    for k in group[1:]:
        s = strings[k]
        node = root
        while isinstance(node, _Node):  # blind: bytes between branches are not looked at
            node = node.next.get(s[node.depth] if node.depth < len(s) else -1) or next(iter(node.next.values()))
        t = strings[node[0]]
        if s == t:
            node.append(k)
            continue
        depth = common_prefix(s, t)
        above, node = None, root
        while isinstance(node, _Node) and node.depth < depth:
            above, node = node, node.next[s[node.depth]]
        mine = s[depth] if depth < len(s) else -1
        if isinstance(node, _Node) and node.depth == depth:
            node.next[mine] = [k]
            continue
        branch = _Node(depth)
        branch.next[mine], branch.next[t[depth] if depth < len(t) else -1] = [k], node
        if above is None:
            root = branch
        else:
            above.next[s[above.depth]] = branch
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, before = stack.pop()
        if isinstance(node, _Node):
            keys = sorted(node.next, reverse=True)
            stack.extend((node.next[c], before if c == keys[-1] else node.depth) for c in keys)
        else:
            order += node
            common += [before] + [len(strings[node[0]])] * (len(node) - 1)
    return order, common


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of strings, and the common prefix of each with the one before."""
    words = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(-1, SHALLOW // 8).astype(np.uint64)
    order: list[int] = []
    common: list[int] = []

    def deep(group: list[int]) -> None:
        o, c = blind_order(group, strings)
        if order:
            c[0] = common_prefix(strings[order[-1]], strings[o[0]])
        order.extend(o)
        common.extend(c)

    stack = [(np.arange(len(strings)), 0)]
    while stack:
        rows, at = stack.pop()
        if len(rows) == 1 or at == words.shape[1]:
            deep(rows.tolist())
            continue
        w = words[rows, at]
        pivot = np.sort(w[:: max(1, len(w) // 9)])[min(len(w), 9) // 2]
        less, more = w < pivot, w > pivot
        # the stack gives them back in order
        if more.any():
            stack.append((rows[more], at))
        stack.append((rows[~(less | more)], at + 1))
        if less.any():
            stack.append((rows[less], at))
    return np.array(order, np.int64), np.array(common, np.int64)


def repeated(members: list[tuple[int, bytes]], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches (anchor, bytes), the part that strings equal to another stretch's strings cover; (0, 0) if none is."""
    n = len(members)
    a = np.array([x for x, _ in members])
    after = np.array([len(b) for _, b in members]) - a
    rank = np.empty((2, n), np.int64)
    common = []
    for k, strings in enumerate(([b[x:] for x, b in members], [b[:x][::-1] for x, b in members])):
        order, c = deep_shallow(strings)
        rank[k, order] = np.arange(n)
        common.append(c)
    least, most = np.full(n, -1), np.full(n, -1)
    for d in range(length - gram + 1):
        rows = np.flatnonzero((a >= d) & (after >= length - d))
        if len(rows) < 2:
            continue
        right = np.cumsum(common[0] < length - d)[rank[0, rows]]
        left = np.cumsum(common[1] < d)[rank[1, rows]]
        key = right * (n + 1) + left
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        again = rows[order[np.r_[equal, False] | np.r_[False, equal]]]
        most[again] = d
        least[again] = np.where(least[again] < 0, d, least[again])
    has = most >= 0
    return np.where(has, a - most, 0), np.where(has, a - least + length, 0)


SLICES = "h long, g1 long, g2 long, a int, bytes binary"
COVERED = "h long, g1 long, g2 long, lo long, hi long"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the stretches wanted of them -> the stretches' bytes."""
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            data = text.as_py()
            w = wanted.values
            h, g1, g2, at, size, a = (w.field(k) for k in ("h", "g1", "g2", "at", "size", "a"))
            for k in range(0, len(w), 10_000):
                spans = zip(at[k : k + 10_000].to_pylist(), size[k : k + 10_000].to_pylist(), strict=True)
                part = [x[k : k + 10_000] for x in (h, g1, g2, a)]
                yield pa.RecordBatch.from_arrays([*part, pa.array([data[s : s + n] for s, n in spans], pa.binary())], names=["h", "g1", "g2", "a", "bytes"])


def _sorted(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches sorted by gram -> what is covered of each."""
        keys: list[tuple[int, int, int]] = []
        members: list[tuple[int, bytes]] = []

        def done() -> Iterator[pa.RecordBatch]:
            if len(members) > 1:
                lo, hi = repeated(members, length, gram)
                has = np.flatnonzero(hi > 0)
                h, g1, g2 = (pa.array([keys[k][c] for k in has], pa.int64()) for c in range(3))
                yield pa.RecordBatch.from_arrays([h, g1, g2, pa.array(lo[has]), pa.array(hi[has])], names=["h", "g1", "g2", "lo", "hi"])
            keys.clear()
            members.clear()

        for batch in batches:
            for h, g1, g2, a, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if len(members) >= FLUSH and h != keys[-1][0]:
                    yield from done()
                keys.append((h, g1, g2))
                members.append((a, data))
        yield from done()

    return run


def _strings(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches -> a 128-bit hash of each of their strings."""
        for batch in batches:
            for h, g1, g2, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                n = len(data) - length + 1
                w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[s : s + length]) for s in range(n)), np.int64).reshape(-1, 2)
                same = [pa.array(np.full(n, x)) for x in (h, g1, g2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), pa.array(np.arange(n))], names=["h", "g1", "g2", "w1", "w2", "s"])

    return run


def _named(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts with the lists that (doc_id, th) name."""
    lists = lists.withColumnsRenamed({"doc_id": "id", "th": "hash"})
    return texts.join(lists, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("hash")), how)


def spans(texts: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, th, list of begin and end) of the texts that lose bytes; texts: doc_id, th, text as bytes."""
    places = scratch.save(texts.mapInArrow(_places(length, gram), PLACES), "places")
    known = places.where("h is not null")
    # grams that stand in one place only belong to no repeated string
    often = scratch.save(known.groupBy("h").agg(F.sum("n").alias("k")).where("k > 1").select("h"), "often")
    met = scratch.save(known.join(often, "h", "left_semi"), "met")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "at", "size", "a")).alias("rep")
    groups = scratch.save(met.groupBy("h", "g1", "g2").agg(F.sum("n").alias("n"), rep), "groups")
    several = scratch.save(groups.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "several")

    def wanted(part: DataFrame, name: str) -> DataFrame:
        x = groups.join(part.select("h"), "h", "left_semi")
        x = x.groupBy("rep.doc_id", "rep.th").agg(F.collect_list(F.struct("h", "g1", "g2", "rep.at", "rep.size", "rep.a")).alias("list"))
        lists = scratch.save(x, name)
        return _named(texts, lists, "inner").select("text", "list").mapInArrow(_slices, SLICES)

    dealt = wanted(several.where(F.col("k") <= hot), "wanted").repartition(4 * partitions(texts.sparkSession), "h").sortWithinPartitions("h")
    covered = dealt.mapInArrow(_sorted(length, gram), COVERED)
    very = several.where(F.col("k") > hot)
    if not very.isEmpty():
        strings = scratch.save(wanted(very, "hot").mapInArrow(_strings(length, gram), "h long, g1 long, g2 long, w1 long, w2 long, s long"), "strings")
        again = scratch.save(strings.groupBy("w1", "w2").agg(F.count("*").alias("k")).where("k > 1").select("w1", "w2"), "again")
        both = strings.join(again, ["w1", "w2"], "left_semi").groupBy("h", "g1", "g2")
        covered = covered.union(both.agg(F.min("s").alias("lo"), (F.max("s") + length).alias("hi")))
    whole = groups.where("n > 1").select("h", "g1", "g2", F.lit(0).cast("long").alias("lo"), F.col("rep.size").alias("hi"))
    covered = scratch.save(covered.union(whole).groupBy("h", "g1", "g2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "covered")
    found = met.join(covered, ["h", "g1", "g2"]).select("doc_id", "th", (F.col("at") + F.col("lo")).alias("b"), (F.col("at") + F.col("hi")).alias("e"))
    found = found.union(places.where("h is null").select("doc_id", "th", "at", F.col("at") + F.col("size")))
    out = scratch.save(found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("b", "e")).alias("list")), "spans")
    scratch.drop("places", "often", "met", "groups", "several", "wanted", "hot", "strings", "again", "covered")
    return out


def cut(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed and maximal runs removed."""
    begin, end = merged(begin, end)
    edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(data)]
    return b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)), int((end - begin).sum()), len(begin)


@F.arrow_udf(StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())]))
def _digest(text: pa.Array, lists: pa.Array) -> pa.Array:
    rows = []
    for data, spans in zip(text, lists, strict=True):
        if not spans.is_valid:
            rows.append(None)
            continue
        kept, n_removed, n_spans = cut(data.as_py(), *(spans.values.field(k).to_numpy() for k in ("b", "e")))
        rows.append({"n_removed": n_removed, "n_spans": n_spans, "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return pa.array(rows, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


@F.arrow_udf(BinaryType())
def _kept(text: pa.Array, lists: pa.Array) -> pa.Array:
    return pa.array([cut(t.as_py(), *(s.values.field(k).to_numpy() for k in ("b", "e")))[0] if s.is_valid else None for t, s in zip(text, lists, strict=True)], pa.binary())


def _bytes(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"))


def _with_spans(docs: DataFrame, key: str, text: str, length: int, gram: int, hot: int) -> DataFrame:
    spark = text_batches(docs).sparkSession
    texts = _bytes(docs, key, text)
    return _named(texts, spans(texts, Scratch(spark), length, gram, hot), "left")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, bytes kept), one row per document."""
    x = _with_spans(docs, key, text, length, gram, hot)
    lost = F.col("list").isNotNull()
    return x.select("doc_id", F.coalesce(_kept(F.when(lost, F.col("text")), "list"), "text").alias("kept"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is kept, one row per document."""
    x = _with_spans(docs, key, text, length, gram, hot)
    lost = F.col("list").isNotNull()
    # only texts that lose bytes go to Python
    x = x.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _digest(F.when(lost, F.col("text")), "list").alias("r"), F.when(~lost, F.sha2("text", 256)).alias("sha"))
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c)
    return x.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("sha", "r.kept_sha256").alias("kept_sha256"))


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest after long repeated strings are removed."""
    return digests(read(spark, sf_dir, "documents"))
