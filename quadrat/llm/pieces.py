r"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

A text's segmentations are the paths of a lattice over its characters, whose edges are the pieces of a
public vocabulary file. The file holds a BPE model, whose scores are ranks; a piece of rank r gets the
probability of Zipf's law, proportional to 1 / (r + 2), so no tokenizer is trained. A path's
probability is the product of its pieces' over the sum of all paths.

Top-k sampling perturbs every path's log probability with Gumbel noise and keeps the k largest. It is done as
an A-star search from the top: the best path below a node is known to have the node's own perturbed
value, so a subtree is opened only when it is the best of the queue. Opening one walks down to a path,
drawing each edge by its conditional probability, and puts the unchosen edges of every step on the
queue as one subtree, with the first arrival of its mass after the parent's (the Gumbel value in the
form of exponential clocks, ``-log(clock)``). Every emitted path is distinct. The inclusion score is the log
of the probability to be among the top k given the clock of the (k+1)-th, 1 - exp(-p * clock).

All draws hash the row's key, the sample's number and the character's position: reruns agree, whatever
the partitioning. No piece crosses a line feed, the start of a run of spaces or (if the vocabulary says so) a letter's end before a
full stop or comma, so the lattice falls into units that are built once for each distinct unit of a task and drawn for a whole
batch at once with numpy. Tables are cleared at ``CACHE`` units; the memory of a task does not grow with its input.

Unknown characters, line feeds and a literal U+2581 become byte pieces; decoding gives back each text
exactly. Defined results: null counts as the empty text; the empty text has one segmentation without
pieces; a text with fewer than k segmentations gives as many samples as it has; rows with equal keys draw the same numbers;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import read, text_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 2
SEED = 17
CACHE = 320_000
BATCH_CHARS = 300_000

SPACE = 0x2581
#: Stands for a literal U+2581 within a lattice; no piece has it.
LITERAL = 0x110000
UNIT = re.compile(r" *[^ \n]+| +|\n")
LETTER = "[a-zA-Z\u00c0-\u024f]"
#: As UNIT, and a word ends before a full stop or comma: for vocabularies without a piece that goes on there.
FINE_UNIT = re.compile(rf" *+(?>[^ \n.,]+)(?<={LETTER})(?=[.,])| *[^ \n]+| +|\n")


class Vocabulary:
    """Pieces with Zipf log probabilities, as a trie of sorted transitions."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes = np.full(256, -1, np.int64)
        self.text: list[bytes] = [b""] * n
        rank = np.zeros(n)
        normal = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.text[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                normal.append((i, piece))
                rank[i] = min(-sp.get_score(i), n)
                self.text[i] = piece.replace("▁", " ").encode()
        self.binary = pa.array(self.text, pa.binary())
        crossing = re.compile(f"{LETTER}[.,]")
        self.unit = UNIT if any(crossing.search(piece) for _, piece in normal) else FINE_UNIT
        weight = 1 / (rank + 2)
        total = weight[[i for i, _ in normal]].sum() * 1.01
        self.logp = np.log(weight / total)
        #: Of a byte piece: what is left over, shared by all of them.
        self.byte_logp = float(np.log(0.01 / 256))
        states: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, piece in normal:
            at = 0
            for c in map(ord, piece):
                at = states.setdefault((at, c), len(states) + 1)
            ends[at] = i
        keys = np.array([(s << 21) | c for s, c in states], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(states.values()), np.int64)[order]
        # the first step of every walk by a table of all characters
        self.root = np.full(LITERAL + 1, -1, np.int64)
        first = self.keys < 1 << 21
        self.root[self.keys[first]] = self.next[first]
        self.end = np.full(len(states) + 1, -1, np.int64)
        self.end[list(ends)] = list(ends.values())

    def decode(self, ids) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw else ""

    def decode_all(self, ids: np.ndarray, end: np.ndarray) -> list[bytes]:
        """UTF-8 of many texts whose ids stand in a row, each up to its ``end``."""
        if not len(ids):
            return [b""] * len(end)
        found = self.binary.take(pa.array(ids))
        _, at, data = found.buffers()
        at = np.frombuffer(at, np.int32, len(ids) + 1, 4 * found.offset)[np.r_[0, end]].tolist()
        data = data.to_pybytes()
        return [data[a + 1 : b] for a, b in zip(at, at[1:])]  # noqa: B905


def _logsumexp_by(values: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(values, start)
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, width)), start))


class Lattices:
    """Lattices of distinct units in flat arrays: nodes are characters, edges are sorted by node."""

    def __init__(self, vocabulary: Vocabulary, most: int = CACHE):
        self.v, self.most = vocabulary, most
        self.clear()

    #: Of a unit: its first node and its characters; of a node: the log mass of all paths to the unit's end and the
    #: first edge; of an edge: cumulative and log conditional probability, piece, the node it leads to or -1, and its own.
    FIELDS = {"start": np.int64, "chars": np.int64, "beta": np.float64, "first": np.int64, "cum": np.float32, "logq": np.float64, "piece": np.int32, "to": np.int32, "src": np.int32}

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.room = {name: np.zeros(1024, kind) for name, kind in self.FIELDS.items()}
        for name in self.FIELDS:
            setattr(self, name, self.room[name][:0])

    def append(self, **new: np.ndarray) -> None:
        """Grows arrays in place; room is doubled when it runs out."""
        for name, x in new.items():
            n = len(getattr(self, name))
            if n + len(x) > len(self.room[name]):
                room = np.empty(max(n + len(x), 2 * len(self.room[name])), self.room[name].dtype)
                room[:n] = self.room[name][:n]
                self.room[name] = room
            self.room[name][n : n + len(x)] = x
            setattr(self, name, self.room[name][: n + len(x)])

    def add(self, units: list[str]) -> None:
        """units: new and distinct."""
        v, base = self.v, len(self.beta)
        size = np.fromiter(map(len, units), np.int64, len(units))
        end = np.cumsum(size)
        c = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        c[c == SPACE] = LITERAL
        c[c == 0x20] = SPACE
        last = np.repeat(end, size)
        src, to, piece = [], [], []
        state = v.root[c]
        at = np.flatnonzero(state >= 0)
        state, reach = state[at], at + 1
        while True:
            p = v.end[state]
            whole = p >= 0
            src.append(at[whole])
            to.append(reach[whole])
            piece.append(p[whole])
            more = reach < last[at]
            at, reach, state = at[more], reach[more], state[more]
            if not len(at):
                break
            key = (state << 21) | c[reach]
            found = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
            ok = v.keys[found] == key
            at, reach, state = at[ok], reach[ok] + 1, v.next[found[ok]]
        single = np.zeros(len(c), bool)
        single[src[0]] = True
        bare = np.flatnonzero(~single)
        src.append(bare)
        to.append(bare + 1)
        piece.append(-1 - np.where(c[bare] == LITERAL, SPACE, c[bare]))
        # the longest piece of a node first: it is the likeliest as a rule, and a draw looks from the front
        src, to, piece = (np.concatenate(x[::-1]) for x in (src, to, piece))
        order = np.argsort(src, kind="stable")
        src, to, piece = src[order], to[order], piece[order]
        logp = v.logp[np.maximum(piece, 0)]
        logp[piece < 0] = v.byte_logp * _utf8_length(-1 - piece[piece < 0])
        begin = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])  # every character begins an edge
        width = np.diff(np.r_[begin, len(src)])
        # masses from the end of each unit backwards, all units at once; beta has a zero for every unit's end
        final = to == last[src]
        target = np.where(final, len(c), to)
        beta = np.zeros(len(c) + 1)
        by_size = np.argsort(-size, kind="stable")
        ends, many = end[by_size], np.cumsum(np.bincount(size)[::-1])[::-1]
        for left in range(1, int(size.max()) + 1):
            nodes = ends[: many[left]] - left
            w = width[nodes]
            at = np.cumsum(w) - w
            e = np.arange(int(w.sum())) + np.repeat(begin[nodes] - at, w)
            beta[nodes] = _logsumexp_by(logp[e] + beta[target[e]], at, w)
        logq = logp + beta[target] - beta[src]
        q = np.exp(logq)
        total = np.cumsum(q)
        cum = total - np.repeat(total[begin] - q[begin], width)
        cum[np.r_[begin[1:] - 1, len(q) - 1]] = 2.0  # the last edge of a node takes what rounding leaves
        self.ids.update(zip(units, range(len(self.start), len(self.start) + len(units)), strict=True))
        self.append(start=end - size + base, chars=size, first=begin + len(self.cum), beta=beta[:-1])
        self.append(cum=cum, logq=logq, piece=piece, to=np.where(final, -1, to + base), src=src + base)


def _utf8_length(c: np.ndarray) -> np.ndarray:
    return 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)


def _uniform(seed: np.ndarray, stream: int, at: np.ndarray) -> np.ndarray:
    """Hash-based draws in (0, 1), one for each position."""
    x = seed + (at.astype(np.uint64) * np.uint64(64) + np.uint64(stream)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Batch:
    """The units of some texts in a row; a path is an array of edges with, for each edge, its unit's place."""

    def __init__(self, texts: list[str], seeds: np.ndarray, lattices: Lattices):
        split = [lattices.v.unit.findall(" " + t) if t else [] for t in texts]
        coded = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [u for u in units if u not in lattices.ids]
        if len(lattices.ids) + len(new) > lattices.most:
            lattices.clear()
            new = units
        if new:
            lattices.add(new)
        found = np.fromiter(map(lattices.ids.__getitem__, units), np.int64, len(units))
        self.l = lattices
        self.count = np.array([len(s) for s in split], np.int64)
        self.end = np.cumsum(self.count)
        self.unit = found[coded.indices.to_numpy()]
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.seed = seeds[self.text]
        upto = np.cumsum(lattices.chars[self.unit]) if len(self.unit) else np.zeros(0, np.int64)
        # positions count from the start of the text
        head = np.r_[0, upto][self.end - self.count]
        self.char = upto - lattices.chars[self.unit] - head[self.text] if len(self.unit) else upto

    def position(self, place: np.ndarray, node: np.ndarray) -> np.ndarray:
        return self.char[place] + node - self.l.start[self.unit[place]]

    def walk(self, place: np.ndarray, node: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Paths from the nodes to the ends of their units: (place, edge), in order of places."""
        l, count, steps = self.l, np.zeros(len(place), np.int64), []
        k, seed, position = np.arange(len(place)), self.seed[place], self.position(place, node)
        while len(k):
            u = _uniform(seed, 2 * sample, position)
            edge = l.first[node]
            wrong = np.flatnonzero(u > l.cum[edge])
            while len(wrong):
                edge[wrong] += 1
                wrong = wrong[u[wrong] > l.cum[edge[wrong]]]
            steps.append((k, edge))
            count[k] += 1
            to = l.to[edge]
            on = np.flatnonzero(to >= 0)
            to = to[on]
            k, seed, position, node = k[on], seed[on], position[on] + to - node[on], to
        offset = np.cumsum(count) - count
        out = np.empty(count.sum(), np.int64)
        for step, (k, edge) in enumerate(steps):
            out[offset[k] + step] = edge
        return np.repeat(place, count), out


def sample(texts: list[str], seeds: np.ndarray, lattices: Lattices, k: int = K) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct paths, best first: (ids, log probability, clock, inclusion score)."""
    b = Batch(texts, seeds, lattices)
    l, n = b.l, len(texts)
    zero = np.zeros(n, np.int64)
    clock = [-np.log(_uniform(seeds, 63, zero + (1 << 40)))]
    place, edge = b.walk(np.arange(len(b.unit)), l.start[b.unit], 1)
    paths = [[x] for x in _by_text(b, place, edge)]
    clocks = [[float(x)] for x in clock[0]]
    queue: list[list[tuple[float, int, int, tuple[int, ...]]]] = [[] for _ in range(n)]

    def open_siblings(fresh: list[tuple[int, int, int]]) -> None:
        """Queues the unchosen edges of new paths: (text, path, first step that is its own)."""
        if not fresh:
            return
        own = [paths[t][p] for t, p, _ in fresh]
        size = np.array([len(x[1]) for x in own])
        end = np.cumsum(size)
        pl, ed = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])
        logq = l.logq[ed]
        before = np.cumsum(logq) - logq
        before -= np.repeat(np.r_[before, 0.0][end - size], size)
        # beyond this, a subtree's mass is zero in double precision
        at = np.flatnonzero(before > -690)
        mass = np.exp(before[at]) * -np.expm1(np.minimum(logq[at], 0.0))
        at, mass = at[mass > 1e-300], mass[mass > 1e-300]
        # a walk's streams are even, a queue's odd
        stream = np.repeat(np.array([2 * p + 3 for _, p, _ in fresh], np.uint64), size)[at]
        u = _uniform(b.seed[pl[at]] ^ stream, 1, b.position(pl[at], l.src[ed[at]]))
        wait = -np.log(u) / mass
        low, high = np.searchsorted(at, end - size).tolist(), np.searchsorted(at, end).tolist()
        for i, (t, p, own_from) in enumerate(fresh):
            s = int(end[i] - size[i])
            own_wait, step = wait[low[i] : high[i]], at[low[i] : high[i]] - s
            own_wait, step = own_wait[step >= own_from], step[step >= own_from]
            # at most k subtrees are opened after this one, and one more gives the last clock
            first = np.argpartition(own_wait, k)[: k + 1] if len(own_wait) > k + 1 else np.arange(len(own_wait))
            for x in first.tolist():
                queue[t].append((clocks[t][p] + float(own_wait[x]), p, int(step[x]), (int(ed[s + step[x]]),)))

    open_siblings([(t, 0, 0) for t in range(n) if b.count[t]])
    for j in range(2, k + 1):
        chosen = []
        for t in range(n):
            if len(paths[t]) == j - 1 and queue[t]:
                best = min(queue[t])
                queue[t].remove(best)
                chosen.append((t, *best))
        forced, tails = [], []
        for t, s, p, step, gone in chosen:
            pl, ed = paths[t][p]
            node = int(l.src[ed[step]])
            lo, hi = int(l.first[node]), int(l.first[node + 1]) if node + 1 < len(l.first) else len(l.cum)
            left = np.array([e for e in range(lo, hi) if e not in gone])
            q = np.exp(l.logq[left])
            u = float(_uniform(seeds[t : t + 1], 2 * j, np.array([1 << 41 | step]))[0])
            pick = int(left[min(int(np.searchsorted(np.cumsum(q), u * q.sum())), len(left) - 1)])
            forced.append(pick)
            rest = np.arange(pl[step] + 1, b.end[t])
            nodes = l.start[b.unit[rest]]
            if l.to[pick] >= 0:
                rest, nodes = np.r_[pl[step], rest], np.r_[l.to[pick], nodes]
            tails.append((rest, nodes))
            if len(left) > 1:  # what remains beside the edges taken so far
                before = float(l.logq[ed[:step]].sum())
                mass = np.exp(before) * (q.sum() - np.exp(l.logq[pick]))
                if mass > 1e-300:
                    u = float(_uniform(seeds[t : t + 1], 2 * j + 1, np.array([1 << 42 | step]))[0])
                    queue[t].append((s - float(np.log(u)) / float(mass), p, step, (*gone, pick)))
        if not chosen:
            break
        pl, ed = b.walk(np.concatenate([x for x, _ in tails]), np.concatenate([x for _, x in tails]), j)
        found = _by_text(b, pl, ed)
        fresh = []
        for (t, s, p, step, _), pick in zip(chosen, forced, strict=True):
            old, new = paths[t][p], found[t]
            paths[t].append((np.concatenate([old[0][: step + 1], new[0]]), np.concatenate([old[1][:step], [pick], new[1]])))
            clocks[t].append(s)
            fresh.append((t, len(paths[t]) - 1, step + 1))
        open_siblings(fresh)
    edges = [ed for one in paths for _, ed in one]
    end = np.cumsum([len(ed) for ed in edges])
    ed = np.concatenate(edges)
    total = np.zeros(len(edges))
    some = np.flatnonzero(np.diff(end, prepend=0))  # the empty text has no edge and log probability 0
    if len(some):
        total[some] = np.add.reduceat(l.logq[ed], np.r_[0, end[:-1]][some])
    ids, total, out = iter(_ids(l, ed, end)), iter(total.tolist()), []
    for t in range(n):
        beyond = min((x[0] for x in queue[t]), default=np.inf)
        one = []
        for c in clocks[t]:
            logp = next(total)
            one.append((next(ids), logp, c, _log_inclusion(logp, beyond)))
        out.append(one)
    return out


def _log_inclusion(logp: float, beyond: float) -> float:
    """log(1 - exp(-p * clock)): all paths are in if no clock is left."""
    if not np.isfinite(beyond):
        return 0.0
    x = logp + np.log(beyond)
    return float(x if x < -30 else np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def _by_text(b: Batch, place: np.ndarray, edge: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    cut = np.searchsorted(place, b.end[:-1]) if len(b.end) else []
    return list(zip(np.split(place, cut), np.split(edge, cut), strict=True))


def _ids(l: Lattices, edge: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Piece ids of paths that stand in a row, each up to its ``end``; unknown characters become their bytes."""
    piece = l.piece[edge]
    bare = np.flatnonzero(piece < 0)
    if len(bare):
        c = -1 - piece[bare]
        n = np.ones(len(piece), np.int64)
        n[bare] = _utf8_length(c)
        raw = np.frombuffer("".join(map(chr, c.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        out = np.repeat(piece, n)
        out[out < 0] = l.v.bytes[raw]
        piece, end = out, np.r_[0, np.cumsum(n)][end]
    return np.split(piece, end[:-1])


#: Of a worker process, for all its tasks; some ten MB.
_held: dict[str, Vocabulary] = {}

SAMPLES = "key long, sample int, ids array<int>, log_p double, clock double, log_inclusion double, exact boolean"


def _encode(model: str, k: int, copies: bool = False, cache: int = CACHE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _held:
            _held[model] = Vocabulary(model)
        vocabulary = _held[model]
        # of this task: a worker that keeps its lattices would hold their memory through other stages
        lattices = Lattices(vocabulary, cache)

        def flush(rows: list[tuple[int | None, int, str]]) -> pa.RecordBatch:
            found = sample([t for _, _, t in rows], np.array([s for _, s, _ in rows], np.int64).view(np.uint64), lattices, k)
            key, number, logp, clock, inclusion, want, ids = [], [], [], [], [], [], []
            for (doc, _, text), paths in zip(rows, found, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for j, (i, p, c, s) in enumerate(paths):
                    key.append(doc)
                    number.append(j + 1)
                    ids.append(i)
                    logp.append(p)
                    clock.append(c)
                    inclusion.append(s)
                    want.append(raw)
            end, flat = np.cumsum([len(i) for i in ids], dtype=np.int64), np.concatenate(ids)
            exact = [a == b for a, b in zip(vocabulary.decode_all(flat, end), want, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, end].astype(np.int32)), pa.array(flat))
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(number, pa.int32()), lists, pa.array(logp), pa.array(clock), pa.array(inclusion), pa.array(exact)], names=["key", "sample", "ids", "log_p", "clock", "log_inclusion", "exact"])

        held: list[tuple[int | None, int, str]] = []
        chars, again, last = 0, 0, None
        for batch in batches:
            for doc, seed, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                now = doc.as_py(), text.as_py()
                again = again + 1 if copies and now == last else 0
                last = now
                # the number of the copy is mixed into the seed: the first one draws as a row alone does
                held.append((now[0], seed.as_py() ^ (again * 0x5851F42D4C957F2D & 0x7FFFFFFFFFFFFFFF), now[1]))
                chars += len(held[-1][2]) + 50
                if chars >= BATCH_CHARS:
                    yield flush(held)
                    held, chars = [], 0
        if held:
            yield flush(held)

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, model: str = MODEL, copies: bool = False, cache: int = CACHE) -> DataFrame:
    """One row per sampled segmentation: key, sample (1 is the best), ids, log_p, clock, log_inclusion, and whether
    decoding the ids gave back the text. No shuffle.

    ``copies``: equal rows that follow each other in a file, as a mixture's repetitions do, draw samples of their own.
    ``cache``: units whose lattices a task keeps; fewer cost time and save memory, and the samples are the same.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.lit(SEED), F.col(key)).alias("seed"), t.alias("text"))
    return text_batches(rows).mapInArrow(_encode(model, k, copies, cache), SAMPLES)


def decode(samples: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``samples`` with the decoded text in the column ``decoded``."""
    held: list[Vocabulary] = []

    @F.pandas_udf("string")
    def text_of(column):
        if not held:
            held.append(Vocabulary(model))
        return column.map(lambda i: None if i is None else held[0].decode(i.tolist()))

    return samples.withColumn("decoded", text_of(F.col(ids)))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document."""
    return encode(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("key", "doc_id")
