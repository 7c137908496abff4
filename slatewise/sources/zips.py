"""Zip archives by byte ranges: their directories as a table, entries read where they stand, and a sink with a commit.

A directory is read from the end of its file; an entry's bytes are read only if its row is asked for. Entries
are dealt out by runs of neighbouring ones, so that a package of any size is many tasks and no task holds
more than an entry and what it returns at once. Written packages are deflated entry by entry wherever their rows are;
one task a package then only copies packed bytes to a file under a name of its own, and the commit
gives all files their names, or takes them away if any task failed.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from slatewise.shipping import ship

DIRECTORY = "package string, path string, at bigint, packed bigint, size bigint, crc bigint, method int, error string"
ENTRIES = "package string, path string, bytes binary, error string"
#: Bytes of a package whose entries one task reads, and bytes that a task returns at once.
RUN, AT_ONCE = 64 << 20, 16 << 20
#: The most bytes of one row.
ROW = (1 << 31) - (1 << 20)

# The zip format's marks, and its records after them.
_LOCAL, _CENTRAL, _END, _END64, _PLACE64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_LOCAL_F, _CENTRAL_F, _END_F, _END64_F, _PLACE64_F = "<HHHHHIIIHH", "<HHHHHHIIIHHHHHII", "<HHHHIIH", "<QHHIIQQQQ", "<IQI"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", uri) else (fs.LocalFileSystem(), uri)


class Broken(Exception):
    pass


def _central(f, length: int) -> bytes:
    """The central directory of a file."""
    tail_at = max(0, length - 65_557)
    f.seek(tail_at)
    tail = f.read(length - tail_at)
    ends = [m.start() for m in re.finditer(re.escape(_END), tail) if len(tail) - m.start() >= 22]
    if not ends:
        raise Broken("not a zip archive")
    whole = [e for e in ends if e + 22 + struct.unpack_from("<H", tail, e + 20)[0] == len(tail)]  # a comment may hold the mark too
    end = (whole or ends)[-1]
    size, at = struct.unpack_from(_END_F, tail, end + 4)[4:6]
    if at == _FULL32 or size == _FULL32:
        if tail[max(0, end - 20) : end][:4] != _PLACE64:
            raise Broken("no place of the large directory")
        f.seek(struct.unpack_from(_PLACE64_F, tail, end - 16)[1])
        record = f.read(56)
        if record[:4] != _END64:
            raise Broken("no large directory")
        size, at = struct.unpack_from(_END64_F, record, 4)[7:9]
    f.seek(at)
    found = f.read(size)
    if len(found) < size:
        raise Broken("the directory is cut off")
    return found


def _listed(central: bytes) -> Iterator[tuple]:
    """path, at, packed, size, crc, method of each entry that is a file, in order."""
    p = 0
    while central[p : p + 4] == _CENTRAL:
        _, _, flags, method, _, _, crc, packed, size, n_name, n_extra, n_comment, _, _, _, at = struct.unpack_from(_CENTRAL_F, central, p + 4)
        name = central[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra, q = central[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                large = list(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                size = large.pop(0) if size == _FULL32 and large else size
                packed = large.pop(0) if packed == _FULL32 and large else packed
                at = large.pop(0) if at == _FULL32 and large else at
            q += 4 + n
        if not name.endswith("/"):
            yield name, at, packed, size, crc, method if not flags & 1 else -1
        p += 46 + n_name + n_extra + n_comment


def directory(files: DataFrame) -> DataFrame:
    """DIRECTORY rows of the entries of zip files, folders left out. files: package (a path or URI), length in bytes.

    A file that is no zip archive gives one row with an error and no path. An empty archive gives none.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    system, path = opened(package)
                    with system.open_input_file(path) as f:
                        rows = [(package, *x, None) for x in _listed(_central(f, length))]
                except (Broken, struct.error, OSError) as e:
                    rows = [(package, *[None] * 6, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    return files.select("package", "length").mapInArrow(run, DIRECTORY)


_NAMES = re.findall(r"(\w+) \w+", DIRECTORY)
_TYPES = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[t] for t in re.findall(r"\w+ (\w+)", DIRECTORY)]


def _content(f, at: int, packed: int, size: int, crc: int, method: int) -> bytes:
    if method not in (0, 8):
        raise Broken("encrypted" if method == -1 else f"packed by method {method}")
    if max(size, packed) > ROW:
        raise Broken(f"{size} bytes are more than a row holds")
    f.seek(at)
    head = f.read(30)
    if head[:4] != _LOCAL:
        raise Broken("no entry where the directory says")
    f.seek(at + 30 + sum(struct.unpack_from("<HH", head, 26)))
    raw = f.read(packed)
    out = raw if method == 0 else zlib.decompress(raw, -15, size)
    if len(out) != size or zlib.crc32(out) != crc:
        raise Broken("wrong bytes")
    return out


def contents(listed: DataFrame) -> DataFrame:
    """ENTRIES rows of directory() rows. An entry that can't be read has an error and no bytes; one row a row."""
    ship(listed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, f = None, None
        for batch in batches:
            rows, held = [], 0
            for package, path, at, packed, size, crc, method, error in zip(*(c.to_pylist() for c in batch.columns)):
                out = None
                if error is None:
                    try:
                        if package != here:
                            system, name = opened(package)
                            here, f = package, system.open_input_file(name)
                        out = _content(f, at, packed, size, crc, method)
                    except (Broken, zlib.error, struct.error, OSError) as e:
                        error = str(e)
                rows.append((package, path, out, error))
                held += len(out or b"")
                if held >= AT_ONCE:
                    yield _entries(rows)
                    rows, held = [], 0
            yield _entries(rows)

    dealt = listed.repartition("package", F.floor(F.col("at") / RUN)).sortWithinPartitions("package", "at")
    return dealt.select(*_NAMES).mapInArrow(run, ENTRIES)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    columns = [[r[k] for r in rows] for k in range(4)]
    kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["package", "path", "bytes", "error"])


def _deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for package, path, value in zip(*batch.columns):
            raw = value.as_py() or b""
            work = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = work.compress(raw) + work.flush()
            columns = [pa.array([package.as_py()]), pa.array([path.as_py()]), pa.array([packed], pa.binary()), pa.array([zlib.crc32(raw)], pa.int64()), pa.array([len(raw)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["package", "path", "packed", "crc", "size"])


def local_header(name: bytes, crc: int, packed: int, size: int) -> bytes:
    return _LOCAL + struct.pack(_LOCAL_F, 20, 0x800, 8, 0, 0x21, crc, packed, size, len(name), 0) + name


def central_entry(name: bytes, crc: int, packed: int, size: int, at: int) -> bytes:
    extra = struct.pack("<HHQ", 1, 8, at) if at >= _FULL32 else b""
    return _CENTRAL + struct.pack(_CENTRAL_F, 45, 45 if extra else 20, 0x800, 8, 0, 0x21, crc, packed, size, len(name), len(extra), 0, 0, 0, 0, min(at, _FULL32)) + name + extra


def ending(n: int, size: int, at: int) -> bytes:
    """What stands after a directory of n entries and so many bytes that starts at a place."""
    large = b""
    if n >= _FULL16 or size >= _FULL32 or at >= _FULL32:
        large = _END64 + struct.pack(_END64_F, 44, 45, 45, 0, 0, n, n, size, at) + _PLACE64 + struct.pack(_PLACE64_F, 0, at + size, 1)
    return large + _END + struct.pack(_END_F, 0, 0, min(n, _FULL16), min(n, _FULL16), min(size, _FULL32), min(at, _FULL32), 0)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: package and file of each of its packages."""

    files: list[tuple[str, str]]


class ZipSink(DataSource):
    """Rows of package, path, packed, crc, size, a package's in one partition and together, as files in the folder of option path."""

    @classmethod
    def name(cls) -> str:
        return "slatewise_zip"

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options["path"])


class ZipWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.pending = f"{self.folder}/_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, pending = opened(self.pending)
        system.create_dir(pending, recursive=True)
        files, here, out, entries = [], None, None, []

        def finish() -> None:
            if out is not None:
                at = out.tell()
                size = 0
                for e in entries:
                    size += out.write(central_entry(*e))
                out.write(ending(len(entries), size, at))
                out.close()

        for row in rows:
            if row.package != here:
                finish()
                here, entries = row.package, []
                files.append((here, f"{pending}/{uuid.uuid4().hex}"))
                out = system.open_output_stream(files[-1][1])
            name, packed = row.path.encode(), bytes(row.packed)
            entries.append((name, row.crc, len(packed), row.size, out.tell()))
            out.write(local_header(name, row.crc, len(packed), row.size))
            out.write(packed)
        finish()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Gives files their names; nothing gets its name where two packages would have the same one."""
        files = [x for m in messages if m is not None for x in m.files]
        names = [package.rstrip("/").rsplit("/", 1)[-1] for package, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two packages of one name")
        system, folder = opened(self.folder)
        for name, (_, file) in zip(names, files):
            system.move(file, f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Takes the files of all tasks away, of failed ones too."""
        system, pending = opened(self.pending)
        if system.get_file_info(pending).type == fs.FileType.Directory:
            system.delete_dir(pending)


def write(parts: DataFrame, folder: str) -> None:
    """Writes a zip file for each package to a folder that all executors share: folder/<last part of package's path>.

    parts: package, path, bytes; rows without a path are left out, null bytes count as none. Entries are in order of
    path. A file of that name is replaced. A package's file is written by one task, which copies packed entries and
    holds one at a time.
    """
    spark: SparkSession = parts.sparkSession
    ship(spark)
    spark.dataSource.register(ZipSink)
    packed = parts.where("package IS NOT NULL AND path IS NOT NULL").select("package", "path", "bytes").mapInArrow(_deflate, "package string, path string, packed binary, crc bigint, size bigint")
    packed.repartition("package").sortWithinPartitions("package", "path").write.format("slatewise_zip").mode("append").option("path", folder).save()
