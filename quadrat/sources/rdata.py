"""R data files, as ``save`` writes them: read as cells, written as data frames.

``spark.read.format("rdata")`` gives one row per cell of every matrix, data frame and vector of the files, named by its
path in nested lists (``set$proteome``). A file's columns are shared out over as many tasks as its size asks for. Every
task reads the stream twice, since R puts a matrix's dimensions behind its numbers: an outline first, which steps over
values, then the task's own columns in blocks. So a task holds names and one block, whatever the file's size (but numbers that R
kept as deferred strings are held whole); a compressed stream can only be stepped over by decompressing it.

Nulls (``NA``) are cells without value and text; NaN stays NaN. Factors give their levels. Functions compiled to byte code and
external pointers, which are no data, are refused. Paths are those that pyarrow's file systems open.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Item types and constants of R's serialisation format.
NIL, GLOBAL, UNBOUND, MISSING, BASE_NAMESPACE, EMPTY_ENV, BASE_ENV = 254, 253, 252, 251, 250, 242, 241
SYMBOL, PAIRS, CLOSURE, ENVIRONMENT, PROMISE, CALL, CHARS, LOGICAL, INTEGER, REAL, COMPLEX, STRINGS, DOTS, LIST, EXPRESSIONS, RAW, S4 = 1, 2, 3, 4, 5, 6, 9, 10, 13, 14, 15, 16, 17, 19, 20, 24, 25
REFERENCE, ALTERNATIVE = 255, 238
OBJECT, ATTRIBUTES, TAG = 0x100, 0x200, 0x400
NA_INTEGER, NA_REAL, NA_LOW_WORD = -(2**31), 0x7FF00000000007A2, 1954
WIDTH = {LOGICAL: 4, INTEGER: 4, REAL: 8, COMPLEX: 16, RAW: 1}
BLOCK = 50_000

CELLS = "file string, object string, row long, row_name string, place int, column string, value double, text string"
ARROW = pa.schema([("file", pa.string()), ("object", pa.string()), ("row", pa.int64()), ("row_name", pa.string()), ("place", pa.int32()), ("column", pa.string()), ("value", pa.float64()), ("text", pa.string())])


@dataclass
class Vector:
    """A vector of the stream: where its values begin, or the values if kept, or the sequence they form."""

    kind: int
    n: int
    at: int = 0
    values: list | None = None
    items: list = field(default_factory=list)
    sequence: tuple[float, float] | None = None
    attributes: dict = field(default_factory=dict)

    def attribute(self, name: str) -> list | None:
        v = self.attributes.get(name)
        if not isinstance(v, Vector):
            return None
        if v.sequence is not None:
            return [v.sequence[0] + k * v.sequence[1] for k in range(v.n)]
        return v.values


@dataclass
class Column:
    object: str
    place: int
    name: str | None
    rows: int
    start: int
    vector: Vector
    row_names: list | None


def _open(path: str):
    files, name = fs.FileSystem.from_uri(path)
    raw = files.open_input_file(name)
    magic = raw.read(6)
    raw.seek(0)
    for start, opener in ((b"\x1f\x8b", gzip.open), (b"BZh", bz2.open), (b"\xfd7zXZ\0", lzma.open)):
        if magic.startswith(start):
            return opener(raw, "rb")
    return raw


class Outline:
    """Walks the stream and notes every vector; values are kept where asked, as for names and dimensions, and stepped over elsewhere."""

    def __init__(self, stream):
        self.stream, self.known = stream, []
        head = stream.read(7)
        if head not in (b"RDX2\nX\n", b"RDX3\nX\n"):
            raise ValueError(f"not a binary R data file: {head!r}")
        version = self.int()
        self.int(), self.int()
        if version == 3:
            self.take(self.int())
        self.objects = [(tag, value) for tag, value in self.item(False)]

    def take(self, n: int) -> bytes:
        data = self.stream.read(n)
        if len(data) < n:
            raise EOFError("the R data file ends early")
        return data

    def int(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def length(self) -> int:
        n = self.int()
        return n if n >= 0 else (self.int() << 32) + (self.int() & 0xFFFFFFFF)

    def item(self, keep: bool):
        flags = self.int()
        kind = flags & 0xFF
        if kind == NIL:
            return []
        if kind in (GLOBAL, UNBOUND, MISSING, BASE_NAMESPACE, EMPTY_ENV, BASE_ENV):
            return None
        if kind == REFERENCE:
            return self.known[(flags >> 8 or self.int()) - 1]
        if kind == SYMBOL:
            at = len(self.known)
            self.known.append(None)
            self.known[at] = self.item(True)
            return self.known[at]
        if kind == CHARS:
            n = self.int()
            return None if n < 0 else self.take(n).decode("utf-8" if flags >> 12 & 0x48 else "latin-1")
        if kind in (PAIRS, CALL, DOTS, CLOSURE, PROMISE):
            return self.pairs(flags, keep)
        if kind == ENVIRONMENT:
            self.known.append(None)
            self.int()
            for _ in range(4):
                self.item(False)
            return None
        if kind == ALTERNATIVE:
            return self.alternative(keep)
        if kind == S4:
            v = Vector(S4, 0)
        elif kind in (LIST, EXPRESSIONS):
            n = self.length()
            v = Vector(kind, n, items=[self.item(keep) for _ in range(n)])
        elif kind == STRINGS:
            n = self.length()
            v = Vector(kind, n, self.stream.tell())
            if keep:
                v.values = [self.string(True) for _ in range(n)]
            else:
                for _ in range(n):
                    self.string(False)
        elif kind in WIDTH:
            n = self.length()
            v = Vector(kind, n, self.stream.tell())
            if keep and kind in (LOGICAL, INTEGER, REAL):
                v.values = np.frombuffer(self.take(n * WIDTH[kind]), ">f8" if kind == REAL else ">i4").tolist()
            else:
                self.skip(n * WIDTH[kind])
        else:
            raise ValueError(f"R data of type {kind} is not supported")
        if flags & ATTRIBUTES:
            v.attributes = dict(self.item(True) or [])
        return v

    def string(self, keep: bool) -> str | None:
        flags, n = struct.unpack(">ii", self.take(8))
        if n < 0:
            return None
        if not keep:
            self.skip(n)
            return None
        return self.take(n).decode("utf-8" if flags >> 12 & 0x48 else "latin-1")

    def skip(self, n: int) -> None:
        while n > 0:
            step = min(n, 1 << 20)
            self.take(step)
            n -= step

    def pairs(self, flags: int, keep: bool) -> list:
        """(tag, value) of a pair list; its end is whatever is no pair."""
        out = []
        while flags & 0xFF in (PAIRS, CALL, DOTS, CLOSURE, PROMISE):
            if flags & ATTRIBUTES:
                self.item(True)
            tag = self.item(True) if flags & TAG else None
            out.append((tag, self.item(keep)))
            flags = self.int()
        if flags & 0xFF == REFERENCE:
            flags >> 8 or self.int()
        elif flags & 0xFF not in (NIL, GLOBAL, UNBOUND, MISSING, BASE_NAMESPACE, EMPTY_ENV, BASE_ENV):
            raise ValueError(f"a pair list ends in type {flags & 0xFF}")
        return out

    def alternative(self, keep: bool) -> Vector:
        """Compact sequences and wrapped vectors; names of classes come first, their state and attributes after."""
        name = self.item(True)[0][1]
        state = self.item(keep or not name.startswith("wrap_"))
        attributes = dict(self.item(True) or [])
        if name in ("compact_intseq", "compact_realseq"):
            n, start, step = state.values
            v = Vector(INTEGER if name == "compact_intseq" else REAL, int(n), sequence=(start, step))
        elif name == "deferred_string":
            inner = state[0][1]
            v = Vector(STRINGS, inner.n, values=[_label(x) for x in inner.values or [inner.sequence[0] + k * inner.sequence[1] for k in range(inner.n)]])
        elif name.startswith("wrap_"):
            v = state.items[0] if isinstance(state, Vector) else state[0][1]
        else:
            raise ValueError(f"R's compact form {name} is not supported")
        v.attributes |= attributes
        return v


def _label(x) -> str | None:
    if x is None or x == NA_INTEGER or x != x:
        return None
    return str(int(x)) if x == int(x) else repr(x)


def columns_of(name: str, v) -> Iterator[Column]:
    """Columns in the order of the stream; lists are walked, and what holds no values is passed over."""
    if isinstance(v, list):
        for k, (tag, value) in enumerate(v):
            yield from columns_of(f"{name}${tag or k + 1}", value)
        return
    if not isinstance(v, Vector):
        return
    names, dims = v.attribute("names"), v.attribute("dim")
    if v.kind in (LIST, EXPRESSIONS):
        frame = "data.frame" in (v.attribute("class") or [])
        rows = v.attribute("row.names")
        labels = None if not rows or rows[0] == NA_INTEGER else [r if isinstance(r, str) else _label(r) for r in rows]
        for k, x in enumerate(v.items):
            label = names[k] if names and names[k] else None
            if frame and isinstance(x, Vector) and x.kind not in (LIST, EXPRESSIONS):
                yield Column(name, k, label, x.n, 0, x, labels)
            else:
                yield from columns_of(f"{name}${label or k + 1}", x)
    elif v.kind in (LOGICAL, INTEGER, REAL, STRINGS):
        if dims and len(dims) == 2:
            outer = v.attributes.get("dimnames")
            of = [x.values if isinstance(x, Vector) else None for x in outer.items] if isinstance(outer, Vector) else [None, None]
            for c in range(int(dims[1])):
                yield Column(name, c, of[1][c] if of[1] else None, int(dims[0]), c * int(dims[0]), v, of[0])
        else:
            yield Column(name, 0, None, v.n, 0, v, names)


class Values:
    """Values of columns, block by block, from a stream that is only stepped forward as long as columns come in its order."""

    def __init__(self, stream):
        self.stream, self.reached = stream, {}

    def blocks(self, c: Column) -> Iterator[tuple[int, list | np.ndarray | None, list | None]]:
        """(first row, numbers, texts): one of both is given."""
        v = c.vector
        levels = v.attribute("levels")
        for lo in range(0, c.rows, BLOCK):
            first, n = c.start + lo, min(BLOCK, c.rows - lo)
            if v.kind == STRINGS:
                yield lo, None, self.strings(v, first, n)
            elif levels is not None:
                yield lo, None, [levels[int(k) - 1] if k == k else None for k in self.numbers(v, first, n)[0]]
            else:
                x, null = self.numbers(v, first, n)
                yield lo, pa.array(x, pa.float64(), mask=null), None

    def numbers(self, v: Vector, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if v.sequence is not None:
            return v.sequence[0] + v.sequence[1] * np.arange(first, first + n, dtype="f8"), np.zeros(n, bool)
        if v.values is not None:
            raw = np.array(v.values[first : first + n], ">f8" if v.kind == REAL else ">i4")
        else:
            self.stream.seek(v.at + WIDTH[v.kind] * first)
            raw = np.frombuffer(self.stream.read(WIDTH[v.kind] * n), ">f8" if v.kind == REAL else ">i4")
        if v.kind == REAL:
            null = np.isnan(raw) & (raw.astype("f8").view("u8") & 0xFFFFFFFF == NA_LOW_WORD)
            return raw.astype("f8"), null
        null = raw == NA_INTEGER
        return np.where(null, np.nan, raw.astype("f8")), null

    def strings(self, v: Vector, first: int, n: int) -> list:
        if v.values is not None:
            return v.values[first : first + n]
        k, at = self.reached.get(v.at, (0, v.at))
        if k > first:
            k, at = 0, v.at
        self.stream.seek(at)
        out = []
        while k < first + n:
            flags, size = struct.unpack(">ii", self.stream.read(8))
            data = self.stream.read(size) if size > 0 else b""
            if k >= first:
                out.append(None if size < 0 else data.decode("utf-8" if flags >> 12 & 0x48 else "latin-1"))
            k += 1
        self.reached[v.at] = (k, self.stream.tell())
        return out


@dataclass
class Part(InputPartition):
    file: str
    part: int
    parts: int


class RDataReader(DataSourceReader):
    def __init__(self, path: str, bytes_per_part: int):
        self.path, self.bytes_per_part = path, bytes_per_part

    def partitions(self) -> list[Part]:
        files, name = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(name)
        prefix = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        if info.type == fs.FileType.Directory:
            found = files.get_file_info(fs.FileSelector(name, recursive=True))
            found = [f for f in found if f.is_file and f.base_name.lower().endswith((".rdata", ".rda")) and "/_" not in f.path[len(name) :]]
        elif info.type == fs.FileType.File:
            found = [info]
        else:
            raise FileNotFoundError(self.path)
        out = []
        for f in sorted(found, key=lambda f: f.path):
            parts = max(1, -(-f.size // self.bytes_per_part))
            out += [Part(prefix + f.path, k, parts) for k in range(parts)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with _open(partition.file) as stream:
            columns = [c for name, v in Outline(stream).objects for c in columns_of(name, v)]
        cells, before = max(1, sum(c.rows for c in columns)), 0
        with _open(partition.file) as stream:
            values = Values(stream)
            for c in columns:
                mine = before * partition.parts // cells == partition.part
                before += c.rows
                if not mine:
                    continue
                for lo, numbers, texts in values.blocks(c):
                    n = len(texts if numbers is None else numbers)
                    names = c.row_names[lo : lo + n] if c.row_names else [None] * n
                    constant = lambda x, t: pa.repeat(pa.scalar(x, t), n)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [
                            constant(partition.file, pa.string()),
                            constant(c.object, pa.string()),
                            pa.array(np.arange(lo, lo + n)),
                            pa.array(names, pa.string()),
                            constant(c.place, pa.int32()),
                            constant(c.name, pa.string()),
                            pa.nulls(n, pa.float64()) if numbers is None else numbers,
                            pa.nulls(n, pa.string()) if texts is None else pa.array(texts, pa.string()),
                        ],
                        schema=ARROW,
                    )


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


def _strings(values: list) -> bytes:
    out = [struct.pack(">ii", STRINGS, len(values))]
    for x in values:
        data = b"" if x is None else x.encode()
        out.append(struct.pack(">ii", CHARS | (0 if x is None else (64 if x.isascii() else 8) << 12), -1 if x is None else len(data)) + data)
    return b"".join(out)


def _vector(x: pa.ChunkedArray) -> bytes:
    if pa.types.is_string(x.type) or pa.types.is_large_string(x.type):
        return _strings(x.to_pylist())
    null = np.asarray(x.is_null())
    if pa.types.is_boolean(x.type) or pa.types.is_int32(x.type):
        values = np.asarray(x.cast(pa.int32()).fill_null(0)).astype(">i4")
        values[null] = NA_INTEGER
        return struct.pack(">ii", LOGICAL if pa.types.is_boolean(x.type) else INTEGER, len(values)) + values.tobytes()
    values = np.asarray(x.cast(pa.float64(), safe=False).fill_null(0)).astype("f8")
    values.view("u8")[null] = NA_REAL
    return struct.pack(">ii", REAL, len(values)) + values.astype(">f8").tobytes()


def encode_frame(name: str, table: pa.Table) -> bytes:
    """A data frame as ``save`` writes it: integers beyond 32 bits become doubles, as R has no others."""
    symbol = lambda s: struct.pack(">iii", SYMBOL, CHARS | 64 << 12, len(s.encode())) + s.encode()
    pair = lambda tag, value: struct.pack(">i", PAIRS | TAG) + symbol(tag) + value
    end = struct.pack(">i", NIL)
    frame = struct.pack(">ii", LIST | OBJECT | ATTRIBUTES, table.num_columns) + b"".join(_vector(c) for c in table.columns)
    rows = struct.pack(">iiii", INTEGER, 2, NA_INTEGER, -table.num_rows)
    frame += pair("names", _strings(table.column_names)) + pair("class", _strings(["data.frame"])) + pair("row.names", rows) + end
    return b"RDX2\nX\n" + struct.pack(">iii", 2, 0x00040000, 0x00020300) + pair(name, frame) + end


class FrameWriter(DataSourceArrowWriter):
    """Tasks write files beside the target; only those of tasks that Spark accepts are moved into it."""

    def __init__(self, path: str, schema: T.StructType, name: str, rows: int, overwrite: bool):
        allowed = (T.StringType, T.BooleanType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.FloatType, T.DoubleType)
        bad = [f.name for f in schema.fields if not isinstance(f.dataType, allowed)]
        if bad:
            raise ValueError(f"cast these columns to strings, booleans or numbers first: {bad}")
        self.path, self.name, self.rows, self.overwrite = path, name, rows, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        files, path = fs.FileSystem.from_uri(self.path)
        files.create_dir(f"{path}/_writing", recursive=True)
        names, held, n = [], [], 0

        def flush() -> None:
            names.append(f"part-{uuid.uuid4().hex}.RData")
            with files.open_output_stream(f"{path}/_writing/{names[-1]}", compression=None) as out:
                out.write(gzip.compress(encode_frame(self.name, pa.Table.from_batches(held)), 6))

        for batch in iterator:
            for lo in range(0, batch.num_rows, self.rows):
                piece = batch.slice(lo, self.rows)
                if held and n + piece.num_rows > self.rows:
                    flush()
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if held:
            flush()
        return Files(names)

    def commit(self, messages: list[Files | None]) -> None:
        files, path = fs.FileSystem.from_uri(self.path)
        files.create_dir(path, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(path)):
                if f.is_file and f.base_name.endswith(".RData"):
                    files.delete_file(f.path)
        for m in messages:
            for name in m.names if m else []:
                files.move(f"{path}/_writing/{name}", f"{path}/{name}")
        self._clear(files, path)

    def abort(self, messages: list[Files | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, files: fs.FileSystem, path: str) -> None:
        if files.get_file_info(f"{path}/_writing").type == fs.FileType.Directory:
            files.delete_dir(f"{path}/_writing")


class RData(DataSource):
    """Options: ``bytes`` of a file for each reading task (32 MiB); ``object``, the name written (frame); ``rows`` of a written file (200,000)."""

    @classmethod
    def name(cls) -> str:
        return "rdata"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: T.StructType) -> RDataReader:
        return RDataReader(self.options["path"], int(self.options.get("bytes", 32 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"], schema, self.options.get("object", "frame"), int(self.options.get("rows", 200_000)), overwrite)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Cells of the R data file, or of all such files below the folder."""
    spark.dataSource.register(RData)
    return spark.read.format("rdata").options(**options).load(path)


def write_frames(df: DataFrame, path: str, **options: str) -> None:
    """``df`` as R data frames in files of a bounded number of rows, which ``load`` reads one by one."""
    df.sparkSession.dataSource.register(RData)
    df.write.format("rdata").mode("append").options(**options).save(path)


def matrix(cells: DataFrame, name: str) -> DataFrame:
    """(row_name, column, value) of a matrix; transposing it is a matter of names."""
    return cells.where(F.col("object") == name).select("row_name", "column", "value")


def frame(cells: DataFrame, name: str, schema: str) -> DataFrame:
    """Rows of a data frame: its cells meet by file and row, in one shuffle. Columns that the frame lacks are null."""
    fields = T.StructType.fromDDL(schema).fields
    cell = lambda f: F.col("text" if isinstance(f.dataType, T.StringType) else "value").cast(f.dataType)
    rows = cells.where(F.col("object") == name).groupBy("file", "row")
    return rows.agg(*[F.max(F.when(F.col("column") == f.name, cell(f))).alias(f.name) for f in fields]).drop("file", "row")


def modalities(cells: DataFrame, name: str, samples_are_rows: dict[str, bool]) -> DataFrame:
    """Long cells (sample_id, modality, feature, value) of a list of matrices, each turned so that samples come first."""
    out = None
    for modality, rows in samples_are_rows.items():
        m = matrix(cells, f"{name}${modality}")
        sample, feature = ("row_name", "column") if rows else ("column", "row_name")
        m = m.select(F.col(sample).alias("sample_id"), F.lit(modality).alias("modality"), F.col(feature).alias("feature"), "value")
        out = m if out is None else out.union(m)
    return out
