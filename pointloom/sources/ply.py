"""PLY files (ascii, binary little- and big-endian) as a Spark data source, with column pruning by the schema asked for."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from pointloom.sources import files

# Fixed names and sizes of the format.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
SQL = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
NAMES = {"i1": "char", "u1": "uchar", "i2": "short", "u2": "ushort", "i4": "int", "u4": "uint", "f4": "float", "f8": "double"}
ROWS = 1_000_000  # of one partition


@dataclass
class Element:
    name: str
    count: int
    properties: list[tuple[str, str, str | None]]  # name, type, type of a list's length


def header(data: bytes) -> tuple[str, list[Element], int]:
    """(format, elements, where the data begin)."""
    end = data.index(b"end_header")
    at = data.index(b"\n", end) + 1
    lines = data[:end].decode("ascii").split("\n")
    if lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    kind, elements = "", []
    for line in (x.split() for x in lines[1:]):
        if not line or line[0] in ("comment", "obj_info"):
            continue
        if line[0] == "format":
            kind = line[1]
        elif line[0] == "element":
            elements.append(Element(line[1], int(line[2]), []))
        elif line[0] == "property":
            elements[-1].properties.append((line[4], TYPES[line[3]], TYPES[line[2]]) if line[1] == "list" else (line[2], TYPES[line[1]], None))
    return kind, elements, at


def read_element(data: bytes, name: str, wanted: list[str] | None = None, lo: int = 0, hi: int | None = None) -> dict[str, list]:
    """The wanted properties of rows lo to hi of an element; a property that is missing is an error."""
    kind, elements, at = header(data)
    if kind == "ascii":
        lines = data[at:].decode("ascii").split("\n")
        row = 0
        for e in elements:
            if e.name == name:
                part = [x.split() for x in lines[row : row + e.count]][lo:hi]
                return _pick(_ascii(e, part), wanted)
            row += e.count
        raise KeyError(name)
    order = "<" if kind == "binary_little_endian" else ">"
    for e in elements:
        fixed = all(p[2] is None for p in e.properties)
        if fixed:
            dtype = np.dtype([(p[0], order + p[1]) for p in e.properties])
            if e.name == name:
                rows = np.frombuffer(data, dtype, e.count, at)[lo:hi]
                return _pick({p[0]: rows[p[0]].tolist() for p in e.properties}, wanted)
            at += dtype.itemsize * e.count
        else:
            out: dict[str, list] = {p[0]: [] for p in e.properties}
            for i in range(e.count):
                for p, t, size in e.properties:
                    n = 1
                    if size:
                        n = int(np.frombuffer(data, order + size, 1, at)[0])
                        at += np.dtype(size).itemsize
                    v = np.frombuffer(data, order + t, n, at).tolist()
                    at += n * np.dtype(t).itemsize
                    if lo <= i < (e.count if hi is None else hi):
                        out[p].append(v if size else v[0])
            if e.name == name:
                return _pick(out, wanted)
    raise KeyError(name)


def _ascii(e: Element, rows: list[list[str]]) -> dict[str, list]:
    out: dict[str, list] = {p[0]: [] for p in e.properties}
    for r in rows:
        at = 0
        for p, t, size in e.properties:
            to = float if t[0] == "f" else int
            if size:
                n = int(r[at])
                out[p].append([to(x) for x in r[at + 1 : at + 1 + n]])
                at += n + 1
            else:
                out[p].append(to(r[at]))
                at += 1
    return out


def _pick(columns: dict[str, list], wanted: list[str] | None) -> dict[str, list]:
    missing = set(wanted or []) - set(columns)
    if missing:
        raise KeyError(f"no property {sorted(missing)}")
    return {k: columns[k] for k in (wanted or columns)}


def file_header(path: str) -> tuple[str, list[Element], int]:
    """header() of a file, of which only the first pieces are read."""
    size, data = 1 << 14, b""
    whole = files.file_size(path)
    while b"end_header" not in data or b"\n" not in data[data.index(b"end_header") :]:
        if len(data) == whole:
            raise ValueError("no end of the PLY header")
        data = files.read_raw(path, 0, size)
        size *= 4
    return header(data)


def read_rows(path: str, name: str, wanted: list[str] | None, lo: int, hi: int) -> dict[str, list]:
    """Rows lo to hi of an element. Binary rows of fixed size are read by their bytes alone, text line by line; elements with lists, or behind such, from the whole file."""
    kind, elements, at = file_header(path)
    if kind == "ascii":
        skip = sum(e.count for e in elements[: next(i for i, e in enumerate(elements) if e.name == name)])
        element = next(e for e in elements if e.name == name)
        rows = islice(files.lines(path, at), skip + lo, skip + min(hi, element.count))
        return _pick(_ascii(element, [x.decode("ascii").split() for x in rows]), wanted)
    order = "<" if kind == "binary_little_endian" else ">"
    for e in elements:
        if any(p[2] is not None for p in e.properties):
            break
        dtype = np.dtype([(p[0], order + p[1]) for p in e.properties])
        if e.name == name:
            hi = min(hi, e.count)
            rows = np.frombuffer(files.read_raw(path, at + lo * dtype.itemsize, max(0, hi - lo) * dtype.itemsize), dtype)
            return _pick({p[0]: rows[p[0]].tolist() for p in e.properties}, wanted)
        at += dtype.itemsize * e.count
    return read_element(files.read_raw(path), name, wanted, lo, hi)


class _Part(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.path, self.element, self.wanted = options["path"], options.get("element", "vertex"), [f.name for f in schema if f.name != "id"]
        self.ids = "id" in schema.names

    def partitions(self):
        _, elements, _ = file_header(self.path)
        count = next(e.count for e in elements if e.name == self.element)
        listed = any(p[2] is not None for e in elements[: [e.name for e in elements].index(self.element) + 1] for p in e.properties)
        step = max(count, 1) if listed else ROWS
        return [_Part(lo, min(count, lo + step)) for lo in range(0, max(count, 1), step)]

    def read(self, part) -> Iterator[tuple]:
        columns = read_rows(self.path, self.element, self.wanted, part.lo, part.hi)
        for i, row in enumerate(zip(*columns.values(), strict=True)):
            yield (part.lo + i, *row) if self.ids else row


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    rows: int
    path: str


class _Writer(DataSourceWriter):
    """Each task writes its rows beside the target; the commit joins them behind the header, in the order of partitions."""

    def __init__(self, schema, options, overwrite: bool):
        self.path, self.names = options["path"], [f.name for f in schema]
        self.kind, self.scalar = options.get("kind", "binary_little_endian"), options.get("scalar", "f4")
        self.types = ["u1" if n in ("red", "green", "blue") else self.scalar for n in self.names]
        if not overwrite and files.exists(self.path):
            raise FileExistsError(self.path)

    def write(self, rows) -> _Written:
        part = TaskContext.get().partitionId()
        name = f"{self.path}.part-{part}-{uuid.uuid4().hex}"
        mark = (">" if self.kind == "binary_big_endian" else "<") + "".join({"f4": "f", "f8": "d", "u1": "B"}[t] for t in self.types)
        where, at = files.locate(name)
        count = 0
        with where.open_output_stream(at) as out:
            for r in rows:
                v = [int(x) if t == "u1" else float(x) for x, t in zip(r, self.types, strict=True)]
                if self.kind == "ascii":
                    v = [repr(np.float32(x).item()) if t == "f4" else repr(x) for x, t in zip(v, self.types, strict=True)]
                    out.write((" ".join(v) + "\n").encode())
                else:
                    out.write(struct.pack(mark, *v))
                count += 1
        return _Written(part, count, name)

    def commit(self, messages) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        lines = ["ply", f"format {self.kind} 1.0", f"element vertex {sum(m.rows for m in done)}", *(f"property {NAMES[t]} {n}" for n, t in zip(self.names, self.types, strict=True)), "end_header", ""]
        files.join_files(self.path, "\n".join(lines).encode(), [m.path for m in done])

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                where, at = files.locate(m.path)
                where.delete_file(at)


class PlySource(DataSource):
    """spark.read.format("ply").option("element", "vertex").load(path), id being the row's place in the file; df.write.format("ply").save(path).

    Any path or URI that driver and executors can open.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        e = next(e for e in file_header(self.options["path"])[1] if e.name == self.options.get("element", "vertex"))
        return "id bigint, " + ", ".join(f"{n} " + (f"array<{SQL[t]}>" if size else SQL[t]) for n, t, size in e.properties)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, self.options, overwrite)


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """(id, p[, n][, c]) of the vertices; colors as parts of 255."""
    spark.dataSource.register(PlySource)
    df = spark.read.format("ply").load(path)
    take = lambda names, kind: F.array(*(F.col(x).cast(kind) for x in names))
    cols = [F.col("id"), take("xyz", "double").alias("p")]
    if "nx" in df.columns:
        cols.append(take(("nx", "ny", "nz"), "double").alias("n"))
    if "red" in df.columns:
        cols.append(F.array(*((F.col(x) / 255.0).cast("float") for x in ("red", "green", "blue"))).alias("c"))
    return df.select(*cols)


def write_cloud(df: DataFrame, path: str, binary: bool = True, big_endian: bool = False, scalar: str = "f4") -> None:
    """One file, rows in the order of id, written by all tasks and joined; colors are cut to bytes, not rounded."""
    df.sparkSession.dataSource.register(PlySource)
    cols = [F.col("p")[i].cast("double").alias(n) for i, n in enumerate("xyz")]
    cols += [F.col("n")[i].cast("double").alias(n) for i, n in enumerate(("nx", "ny", "nz"))] if "n" in df.columns else []
    cols += [F.floor(F.col("c")[i] * 255).cast("int").alias(n) for i, n in enumerate(("red", "green", "blue"))] if "c" in df.columns else []
    kind = "ascii" if not binary else "binary_big_endian" if big_endian else "binary_little_endian"
    df.orderBy("id").select(*cols).write.format("ply").option("kind", kind).option("scalar", scalar).mode("overwrite").save(path)
