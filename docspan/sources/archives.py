"""A data source for archives: `spark.read.format("archives").load(folder)`.

Rows are (path, member, content, error): the documents in archives, in archives inside these, and files that are
documents themselves.  The driver lists files and reads the directories at the end of ZIP archives, from
which it plans partitions of members of about `partitionBytes`; a task then reads just its members.  TAR archives and
compressed files have no directory, so each is one partition and is read as it comes, member by member.  At any time one
member is held (and one batch of members that were read), and a member of more than `memberBytes` is a row with an
error instead, as is what can't be read.

Files are opened by pyarrow's file systems, so any store that these know will do; local paths too.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docspan.sources.files import ARCHIVES, DEPTH, DOCUMENTS

SCHEMA = "path string, member string, content binary, error string"
TARS = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")
UNPACK = ((("gz",), gzip.open), (("bz2",), bz2.open), (("xz",), lzma.open))
SINGLE = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}
#: Rows and bytes of a batch that a task hands on.
ROWS, BYTES = 64, 8 << 20
Row = tuple[str, bytes | None, str | None]


@dataclass
class Part(InputPartition):
    """A file, or of a ZIP archive the members from first to before last."""

    path: str
    first: int | None = None
    last: int | None = None


def taken(stream: BinaryIO, most: int) -> bytes | None:
    """The whole of a stream, or None if it is longer than allowed."""
    held: list[bytes] = []
    size = 0
    while more := stream.read(1 << 20):  # some readers set aside all that they are asked for
        held.append(more)
        size += len(more)
        if size > most:
            return None
    return b"".join(held)


def opened(name: str, stream: BinaryIO, most: int, depth: int = 0) -> Iterator[Row]:
    """Documents in a file of this name and in archives inside it: (path inside, bytes, error)."""
    low = name.lower()
    if depth > DEPTH:
        yield name, None, f"nested more than {DEPTH} deep"
        return
    try:
        if low.endswith(".zip"):
            if not stream.seekable():  # a directory at the end can't be read from a stream
                data = taken(stream, most)
                if data is None:
                    yield name, None, f"larger than {most} bytes"
                    return
                stream = io.BytesIO(data)
            with zipfile.ZipFile(stream) as z:
                for info in z.infolist():
                    yield from _zipped(name, z, info, most, depth)
        elif low.endswith(TARS):
            # unpacked outside of tarfile, which would hold all that a block of packed bytes unfolds to
            unpack = next((f for ends, f in UNPACK if low.endswith(ends)), lambda s: s)
            with tarfile.open(fileobj=unpack(stream), mode="r|") as t:
                for info in t:
                    if info.isfile():
                        yield from opened(f"{name}/{info.name}", _Forward(t.extractfile(info)), most, depth + 1)
        elif low.endswith(tuple(SINGLE)):
            end = "." + low.rsplit(".", 1)[1]
            with SINGLE[end](stream) as inner:
                yield from opened(name[: -len(end)], _Forward(inner), most, depth + 1)
        elif low.endswith((".rar", ".7z")):
            yield name, None, "needs a program that isn't here"
        elif low.endswith(DOCUMENTS):
            data = taken(stream, most)
            yield name, data, None if data is not None else f"larger than {most} bytes"
    except Exception as err:  # a broken archive is a row, not a failed job
        yield name, None, f"cannot be read: {err}"


class _Forward(io.RawIOBase):
    """A stream that says it can't be gone back in, so that nobody unpacks it twice."""

    def __init__(self, inner: BinaryIO):
        self.inner = inner

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def read(self, n: int = -1) -> bytes:
        return self.inner.read(n)


def _zipped(name: str, z: zipfile.ZipFile, info: zipfile.ZipInfo, most: int, depth: int) -> Iterator[Row]:
    if info.is_dir():
        return
    inner = f"{name}/{info.filename}"
    try:
        with z.open(info) as member:
            yield from opened(inner, _Forward(member), most, depth + 1)
    except Exception as err:  # this member's own fault: a checksum, a password, an unknown method
        yield inner, None, f"cannot be read: {err}"


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("memberBytes", 256 << 20))
        self.size = int(options.get("partitionBytes", 32 << 20))

    def store(self, path: str) -> tuple[fs.FileSystem, str]:
        if "://" not in path and not path.startswith("file:"):
            return fs.LocalFileSystem(), path
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))

    def partitions(self) -> list[Part]:
        store, path = self.store(self.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        known = store.get_file_info(path)
        files = [known] if known.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        parts: list[Part] = []
        for info in sorted(files, key=lambda f: f.path):
            low = info.path.lower()
            if not info.is_file or not low.endswith((*ARCHIVES, *DOCUMENTS)):
                continue
            whole = Part(prefix + info.path)
            if not low.endswith(".zip"):
                parts.append(whole)
                continue
            try:
                with store.open_input_file(info.path) as f, zipfile.ZipFile(f) as z:
                    sizes = [m.compress_size for m in z.infolist()]
            except Exception:  # the task says what is wrong with it
                parts.append(whole)
                continue
            first, held = 0, 0
            for k, size in enumerate(sizes):
                if held and held + size > self.size:
                    parts.append(Part(whole.path, first, k))
                    first, held = k, 0
                held += size
            parts.append(Part(whole.path, first, len(sizes)))
        return parts

    def rows(self, part: Part) -> Iterator[Row]:
        store, path = self.store(part.path)
        name = path.rsplit("/", 1)[-1]
        if part.first is None:
            with store.open_input_file(path) as f:
                yield from opened(name, f, self.most)
            return
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            for info in z.infolist()[part.first : part.last]:
                yield from _zipped(name, z, info, self.most, 0)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        held: list[Row] = []
        size = 0

        def batch() -> pa.RecordBatch:
            member, content, error = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([part.path] * len(held)), pa.array(member, pa.string()), pa.array(content, pa.binary()), pa.array(error, pa.string())], ["path", "member", "content", "error"])

        for row in self.rows(part):
            held.append(row)
            size += len(row[1] or b"")
            if len(held) >= ROWS or size >= BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)


def write_archives(files: DataFrame, folder: str, name: str = "name", content: str = "content", group: str = "archive") -> DataFrame:
    """Packs rows (archive, name, content) into archives in folder, ZIP or TAR by the archive's name, and returns
    (archive, members).  A task writes its archives one after another, member by member; equal names follow on each
    other.  A task that is run again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, packed, out, n = None, None, None, 0
        done: list[tuple[str, int]] = []
        store, root = ArchiveReader({"path": folder}).store(folder)
        store.create_dir(root, recursive=True)

        def close() -> None:
            if packed is not None:
                packed.close()
                out.close()
                done.append((last, n))

        for batch in batches:
            for archive, member, data in zip(*(batch.column(c).to_pylist() for c in (group, name, content)), strict=True):
                if archive != last:
                    close()
                    last, n = archive, 0
                    out = store.open_output_stream(f"{root}/{archive}", compression=None)
                    packed = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) if archive.lower().endswith(".zip") else tarfile.open(fileobj=out, mode="w|gz" if archive.lower().endswith("gz") else "w|")
                if isinstance(packed, zipfile.ZipFile):
                    packed.writestr(zipfile.ZipInfo(member), data, zipfile.ZIP_DEFLATED)
                else:
                    info = tarfile.TarInfo(member)
                    info.size = len(data)
                    packed.addfile(info, io.BytesIO(data))
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "members"])

    rows = files.select(group, name, content).repartition(group).sortWithinPartitions(group, name)
    return rows.mapInArrow(run, "archive string, members long")
