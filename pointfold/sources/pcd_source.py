"""Point-cloud files as a Spark data source, to read and to write: a header of text, then a body of text, of records, or of compressed columns.

    spark.dataSource.register(PointClouds)
    spark.read.format("pointcloud").load(folder)
    df.write.format("pointcloud").option("encoding", "binary").save(folder)

A header is read once for each file, when the read is planned; bodies of text and of records are split, so that a large file spreads over tasks. A
field with a count above one is an array. Columns: file, row (the point's number in its file), and the fields of the schema given, or
else of the first file; a field that a file lacks is null, as is a text that is no number. Files are opened by their
URI through Arrow's file systems, so on a cluster they lie where all executors reach them.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

#: Bytes of a body that one task reads; points of a file that a task writes, and of a batch that it reads, at most.
SPLIT, POINTS = 64 << 20, 50_000
#: Type letter and size of a field, by Spark's types; unsigned ones need the next larger type.
KINDS = {("F", 4): FloatType(), ("F", 8): DoubleType(), ("I", 1): ByteType(), ("I", 2): ShortType(), ("I", 4): IntegerType(), ("I", 8): LongType(), ("U", 1): ShortType(), ("U", 2): IntegerType(), ("U", 4): LongType(), ("U", 8): LongType()}
WRITTEN = {FloatType: ("F", 4), DoubleType: ("F", 8), ByteType: ("I", 1), ShortType: ("I", 2), IntegerType: ("I", 4), LongType: ("I", 8)}


@dataclass
class Header:
    fields: list[str]
    sizes: list[int]
    types: list[str]
    counts: list[int]
    points: int
    encoding: str
    begin: int  # of the body, in bytes

    def record(self) -> np.dtype:
        return np.dtype([(f"f{i}", f"<{t.lower()}{s}", (c,)) for i, (t, s, c) in enumerate(zip(self.types, self.sizes, self.counts, strict=True))])

    def schema(self) -> list[StructField]:
        kinds = [KINDS[t, s] for t, s in zip(self.types, self.sizes, strict=True)]
        return [StructField(n, ArrayType(k) if c > 1 else k) for n, k, c in zip(self.fields, kinds, self.counts, strict=True) if n != "_"]


def header(file: pa.NativeFile) -> Header:
    """Of an open file, which is left at its body. Lines whose first word begins with # are comments."""
    said: dict[str, list[str]] = {}
    buffer, at = b"", 0
    while "DATA" not in said:
        while b"\n" not in buffer[at:]:
            more = file.read(4096)
            if not more:
                raise ValueError("no DATA line")
            buffer += more
        end = buffer.index(b"\n", at)
        words = buffer[at:end].decode("ascii", "replace").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            said[words[0].upper()] = words[1:]
    n = len(said["FIELDS"])
    return Header(said["FIELDS"], [int(x) for x in said["SIZE"]], said["TYPE"], [int(x) for x in said.get("COUNT", ["1"] * n)], int(said["POINTS"][0]) if "POINTS" in said else int(said["WIDTH"][0]) * int(said["HEIGHT"][0]), said["DATA"][0].lower(), at)


def expanded(data: bytes, size: int) -> bytes:
    """Of runs of literals (a byte below 32: how many, less one) and of references back (three bits of length and 13 of distance)."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i : i + c + 1]
            i += c + 1
            continue
        length = c >> 5
        if length == 7:
            length += data[i]
            i += 1
        back = ((c & 31) << 8 | data[i]) + 1
        i += 1
        length += 2
        start = len(out) - back
        if back >= length:
            out += out[start : start + length]
        else:  # overlaps itself
            run = bytes(out[start:])
            out += (run * (length // back + 1))[:length]
    if len(out) != size:
        raise ValueError("a compressed body of another size than it says")
    return bytes(out)


def compressed(data: bytes) -> bytes:
    """Runs of literals, and references to where the same three bytes were last."""
    out, last, i, since = bytearray(), {}, 0, 0

    def literals(end: int) -> None:
        for lo in range(since, end, 32):
            part = data[lo : min(lo + 32, end)]
            out.append(len(part) - 1)
            out.extend(part)

    while i + 2 < len(data):
        key = data[i : i + 3]
        at = last.get(key, -1)
        last[key] = i
        if at < 0 or i - at > 8192:
            i += 1
            continue
        n = 3
        while i + n < len(data) and n < 264 and data[at + n] == data[i + n]:
            n += 1
        literals(i)
        back = i - at - 1
        out.append(min(n - 2, 7) << 5 | back >> 8)
        if n - 2 >= 7:
            out.append(n - 9)
        out.append(back & 255)
        i += n
        since = i
    literals(len(data))
    return bytes(out)


@dataclass
class Part(InputPartition):
    file: str
    head: Header
    row: int  # of the first record; of a text unknown, as lines are counted by byte
    begin: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a path on this machine, and the path there."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int) -> None:
        self.path, self.wanted, self.split = path, schema, split

    def partitions(self) -> list[Part]:
        out = []
        system, files = listed(self.path)
        for name, size in files:
            with system.open_input_file(name) as f:
                h = header(f)
            width = h.record().itemsize
            step = max(self.split // width, 1) * width if h.encoding == "binary" else self.split
            end = min(size, h.begin + h.points * width) if h.encoding == "binary" else size
            if h.encoding == "binary_compressed":
                out.append(Part(name, h, 0, h.begin, size))
                continue
            out += [Part(name, h, (lo - h.begin) // width if h.encoding == "binary" else -1, lo, min(lo + step, end)) for lo in range(h.begin, end, step)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with system.open_input_file(part.file) as f:
            if part.head.encoding == "ascii":
                records = texts(f, part)
            elif part.head.encoding == "binary":
                f.seek(part.begin)
                records = [(part.row, np.frombuffer(f.read(part.end - part.begin), part.head.record()))]
            else:
                records = [(0, columns(f, part.head))]
            for row, r in records:
                for lo in range(0, len(r), POINTS):
                    at = row + lo if isinstance(row, int) else row[lo : lo + POINTS]
                    yield self.batch(part, at, r[lo : lo + POINTS])

    def batch(self, part: Part, row: int | np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        kinds = {"float": pa.float32(), "double": pa.float64(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
        names, out = {n: i for i, n in enumerate(part.head.fields)}, []
        for field in self.wanted.fields:
            if field.name == "file":
                out.append(pa.array([part.file] * len(r), pa.string()))
            elif field.name == "row":
                out.append(pa.array(row + np.arange(len(r)) if isinstance(row, int) else row, pa.int64()))
            else:
                array = isinstance(field.dataType, ArrayType)
                kind = kinds[(field.dataType.elementType if array else field.dataType).simpleString()]
                if field.name not in names:
                    out.append(pa.nulls(len(r), pa.list_(kind) if array else kind))
                    continue
                i = names[field.name]
                values = r[f"f{i}"]
                flat = values.ravel() if array else values[:, 0]
                flat = pa.array(flat.astype(kind.to_pandas_dtype()), mask=np.isnan(flat) if flat.dtype.kind == "f" else None)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, values.shape[1], dtype=np.int32)), flat) if array else flat)
        return pa.RecordBatch.from_arrays(out, names=[f.name for f in self.wanted.fields])


def texts(f: pa.NativeFile, part: Part, block: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Records of the lines that begin in the part. Their row is the byte where they begin."""
    kind = part.head.record()
    width = sum(part.head.counts)
    wide = np.dtype([(n, "<f8" if kind[n].base.kind == "f" else kind[n].base.str, kind[n].shape) for n in kind.names])
    f.seek(part.begin - 1)
    rest = f.read(1)
    at = part.begin - 1
    if rest != b"\n":  # in the middle of a line that the part before reads
        while rest and b"\n" not in rest:
            at += len(rest)
            rest = f.read(4096)
    cut = rest.find(b"\n") + 1
    at, held = at + cut, rest[cut:]
    while at < part.end:
        more = f.read(block)
        held += more
        end = held.rfind(b"\n") + 1 if more else len(held)
        rows, out = [], []
        for line in held[:end].split(b"\n"):
            if at >= part.end:
                break
            cells = line.split()
            if cells and not cells[0].startswith(b"#"):
                out.append(record(cells, part.head, width))
                rows.append(at)
            at += len(line) + 1
        held = held[end:]
        if out:
            yield np.array(rows), np.array(out, wide)
        if not more:
            return


def record(cells: list[bytes], h: Header, width: int) -> tuple:
    """One point's values by field; what isn't a number is nan, or 0 in a field of whole numbers."""
    cells, out, i = cells + [b"nan"] * (width - len(cells)), [], 0
    for t, c in zip(h.types, h.counts, strict=True):
        values = []
        for cell in cells[i : i + c]:
            try:
                values.append(float(cell) if t == "F" else int(float(cell)) if b"." in cell or b"e" in cell else int(cell))
            except ValueError:
                values.append(float("nan") if t == "F" else 0)
        out.append(values)
        i += c
    return tuple(out)


def columns(f: pa.NativeFile, h: Header) -> np.ndarray:
    """Records of a compressed body, which holds one field after another."""
    f.seek(h.begin)
    packed, size = struct.unpack("<II", f.read(8))
    data = expanded(f.read(packed), size)
    kind, out, at = h.record(), np.zeros(h.points, h.record()), 0
    for name in kind.names:
        n = kind[name].itemsize * h.points
        out[name] = np.frombuffer(data[at : at + n], kind[name].base).reshape(h.points, -1)
        at += n
    return out


def listed(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """Files below path, or path itself, but for those whose names begin with _ or a dot."""
    system, at = opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return system, sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


@dataclass
class Saved(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceWriter):
    """Files of at most `most` points, one after another, so that a task holds no more than those. A task's files get their names when all are done, so one that failed leaves none behind."""

    def __init__(self, path: str, schema: StructType, encoding: str, overwrite: bool, most: int) -> None:
        self.path, self.given, self.encoding, self.overwrite, self.most = path, schema, encoding, overwrite, most
        if encoding not in ("ascii", "binary", "binary_compressed"):
            raise ValueError(f"unknown encoding {encoding}")

    def write(self, rows: Iterator) -> Saved:
        files = []
        try:
            while some := [tuple(r) for r in islice(rows, self.most)]:
                files.append(self.saved(some))
        except BaseException:
            self.abort([Saved(files)])
            raise
        return Saved(files)

    def saved(self, rows: list[tuple]) -> str:
        """The file that it writes these rows to."""
        system, at = opened(self.path)
        names = [f.name for f in self.given.fields]
        of = [f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType for f in self.given.fields]
        counts = [len(next((r[i] for r in rows if r[i] is not None), [0])) if isinstance(f.dataType, ArrayType) else 1 for i, f in enumerate(self.given.fields)]
        kinds = [WRITTEN[type(k)] for k in of]
        h = Header(names, [s for _, s in kinds], [t for t, _ in kinds], counts, len(rows), self.encoding, 0)
        body = np.zeros(len(rows), h.record())
        for i, (t, c) in enumerate(zip(h.types, counts, strict=True)):
            blank = float("nan") if t == "F" else 0
            body[f"f{i}"] = np.array([[blank if v is None else v for v in (r[i] if c > 1 else [r[i]])] if r[i] is not None else [blank] * c for r in rows])
        lines = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", "FIELDS " + " ".join(names), "SIZE " + " ".join(map(str, h.sizes)), "TYPE " + " ".join(h.types), "COUNT " + " ".join(map(str, counts)), f"WIDTH {len(rows)}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {len(rows)}", f"DATA {self.encoding}"]
        out = ("\n".join(lines) + "\n").encode()
        if self.encoding == "ascii":
            out += "".join(" ".join(repr(v) if isinstance(v, int) else f"{v:.17g}" for n in body.dtype.names for v in r[n].tolist()) + "\n" for r in body).encode()
        elif self.encoding == "binary":
            out += body.tobytes()
        else:
            data = b"".join(np.ascontiguousarray(body[n]).tobytes() for n in body.dtype.names)
            packed = compressed(data)
            out += struct.pack("<II", len(packed), len(data)) + packed
        name = f"{at}/.part-{uuid.uuid4().hex}.pcd"
        system.create_dir(at, recursive=True)
        with system.open_output_stream(name) as f:
            f.write(out)
        return name

    def commit(self, messages: list[Saved | None]) -> None:
        system, at = opened(self.path)
        if self.overwrite:
            for name, _ in listed(self.path)[1] if system.get_file_info(at).type == fs.FileType.Directory else []:
                system.delete_file(name)
        for m in messages:
            for file in m.files if m else []:
                head, _, name = file.rpartition("/")
                system.move(file, f"{head}/{name[1:]}")

    def abort(self, messages: list[Saved | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            for file in m.files if m else []:
                system.delete_file(file)


class PointClouds(DataSource):
    """Options: path; split, bytes of a body for a task; when writing, encoding: ascii, binary or binary_compressed; and points, of a file at most."""

    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def schema(self) -> StructType:
        system, files = listed(self.options["path"])
        if not files:
            raise ValueError("no files below " + self.options["path"])
        with system.open_input_file(files[0][0]) as f:
            h = header(f)
        return StructType([StructField("file", StringType()), StructField("row", LongType()), *h.schema()])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, self.options.get("encoding", "binary"), overwrite, int(self.options.get("points", POINTS)))
