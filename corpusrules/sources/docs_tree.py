"""A tree of Markdown documents written by a Python data source with a two-phase commit.

Rows ``(path, a, b, c, line)`` are the lines of the documents; ``path`` is relative to the tree,
``(a, b, c)`` orders the lines of one document. Spark deals documents to tasks by ``path`` and
sorts each task's rows, so a task streams one file after the other and holds one line at a time.

Commit protocol:
* a task attempt writes its files below ``<tree>.__staging/<job>/attempt-<partition>-<attempt>``
  and returns that folder as its commit message;
* the driver's ``commit`` moves the files of committed attempts into ``<job>/tree``, then
  publishes: the old tree is renamed aside, the new one renamed into place, the old one
  deleted. A reader sees the old tree or the new one, never a mix;
* ``abort`` and any failed attempt leave nothing: the job's staging folder is deleted.

Files are written through ``pyarrow.fs``, so the tree may be on any file system it knows.

A file takes a block (4 KB, mostly) and an entry of its file system, however short it is. A tree
of millions of short pages is therefore written with ``archives=True``: each task streams its
documents into ``tar.gz`` archives, whose members have the documents' paths, so that unpacking all
archives in one folder gives the tree. The commit is the same; ``read_archives`` reads them.
"""

from __future__ import annotations

import codecs
import hashlib
import tarfile
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .files import SCHEMA as FILE_SCHEMA
from .files import SourceListing

SCHEMA = "path string, a long, b string, c long, line string"
ORDER = ("path", "a", "b", "c")
#: A task begins another archive after so many documents or bytes; they are read back one archive a task.
DOCUMENTS_PER_ARCHIVE = 10_000
BYTES_PER_ARCHIVE = 64 * 1024 * 1024
# bytes of text per record batch, and of a document held before its size is known
_BATCH_BYTES = 16 * 1024 * 1024
# bytes compressed, read or decompressed at once
_PIECE_BYTES = 1024 * 1024
_BLOCK = 512


def _fs(uri: str):
    import pyarrow.fs as pafs

    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class _Files:
    """Documents as files below a folder."""

    def __init__(self, fs, base: str, partition: int):
        self.fs, self.base = fs, base

    def open(self, path: str):
        target = f"{self.base}/{path}"
        self.fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
        return self.fs.open_output_stream(target)

    def close(self) -> None:
        pass


#: The header of a member without name, size and check sum, and the sum of its bytes with blanks for the last.
_HEADER = tarfile.TarInfo("").tobuf(tarfile.PAX_FORMAT)
_SUM = sum(_HEADER[:124]) + sum(_HEADER[136:148]) + 8 * ord(" ") + sum(_HEADER[156:])


def _member_header(path: str, size: int) -> bytes:
    """What stands before a member's bytes; ``tarfile`` writes what does not fit the plain form."""
    name = path.encode("utf-8")
    if len(name) > 100 or not name.isascii() or size >= 8**11:
        member = tarfile.TarInfo(path)
        member.size = size
        return member.tobuf(tarfile.PAX_FORMAT)
    digits = b"%011o\0" % size
    check = b"%06o\0 " % (_SUM + sum(name) + sum(digits))
    return b"".join([name, _HEADER[len(name) : 124], digits, _HEADER[136:148], check, _HEADER[156:]])


class _Archives:
    """Documents as members of compressed archives, written as streams one after the other."""

    def __init__(self, fs, base: str, partition: int):
        self.fs, self.base, self.partition = fs, base, partition
        self.archives, self.documents, self.stream = 0, 0, None

    def open(self, path: str):
        return _Member(self, path)

    def add(self, path: str, pieces: Iterator[bytes], size: int) -> None:
        if self.stream is not None and (
            self.documents >= DOCUMENTS_PER_ARCHIVE or self.stream.tell() >= BYTES_PER_ARCHIVE
        ):
            self.close()
        if self.stream is None:
            self.fs.create_dir(self.base, recursive=True)
            name = f"docs-{self.partition:05d}-{self.archives:05d}.tar.gz"
            # compressed here; pyarrow would do so again, going by the name
            self.stream = self.fs.open_output_stream(f"{self.base}/{name}", compression=None)
            self.packer, self.held, self.waiting = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0
            self.archives, self.documents = self.archives + 1, 0
        self._put(_member_header(path, size))
        for piece in pieces:
            self._put(piece)
        self._put(bytes(-size % _BLOCK))
        self.documents += 1

    def _put(self, data: bytes) -> None:
        self.held.append(data)
        self.waiting += len(data)
        if self.waiting >= _PIECE_BYTES:
            self.stream.write(self.packer.compress(b"".join(self.held)))
            self.held, self.waiting = [], 0

    def close(self) -> None:
        if self.stream is not None:
            self._put(bytes(2 * _BLOCK))  # the end of a tar file
            self.stream.write(self.packer.compress(b"".join(self.held)) + self.packer.flush())
            self.stream.close()
            self.stream = None


class _Member:
    """One document, held (a long one in a temporary file) until its size is known."""

    def __init__(self, archives: _Archives, path: str):
        self.archives, self.path = archives, path
        self.held, self.size, self.file = [], 0, None

    def write(self, data: bytes) -> None:
        self.size += len(data)
        if self.file is None:
            self.held.append(data)
            if self.size <= _BATCH_BYTES:
                return
            self.file = tempfile.TemporaryFile()
            data = b"".join(self.held)
            self.held = []
        self.file.write(data)

    def _pieces(self) -> Iterator[bytes]:
        yield from self.held
        if self.file is not None:
            self.file.seek(0)
            while data := self.file.read(_PIECE_BYTES):
                yield data

    def close(self) -> None:
        self.archives.add(self.path, self._pieces(), self.size)
        if self.file is not None:
            self.file.close()


class DocsTreeWriter(DataSourceArrowWriter):
    def __init__(self, tree: str, job: str, archives: bool = False):
        self.tree, self.job, self.archives = tree.rstrip("/"), job, archives

    @property
    def staging(self) -> str:
        return f"{self.tree}.__staging/{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Attempt:
        from pyspark import TaskContext

        task = TaskContext.get()
        folder = f"{self.staging}/attempt-{task.partitionId()}-{task.attemptNumber()}"
        fs, base = _fs(folder)
        target = (_Archives if self.archives else _Files)(fs, base, task.partitionId())
        current, out, files = None, None, 0
        try:
            for path, text in (run for batch in batches for run in _runs(batch)):
                if path != current:
                    if out is not None:
                        out.close()
                    current = path
                    out = target.open(_safe(current))
                    files += 1
                out.write(text)
        finally:
            if out is not None:
                out.close()
            target.close()
        return Attempt(folder, files)

    def commit(self, messages: list[Attempt]) -> None:
        import pyarrow.fs as pafs

        fs, staging = _fs(self.staging)
        _, tree = _fs(self.tree)
        built = f"{staging}/tree"
        fs.create_dir(built, recursive=True)
        for message in messages:
            if message is None or not message.files:
                continue
            _, folder = _fs(message.folder)
            for info in fs.get_file_info(pafs.FileSelector(folder, recursive=True)):
                if info.type == pafs.FileType.File:
                    target = f"{built}/{info.path[len(folder) + 1 :]}"
                    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    fs.move(info.path, target)
        old = f"{staging}/replaced"
        if fs.get_file_info(tree).type != pafs.FileType.NotFound:
            fs.move(tree, old)
        fs.move(built, tree)
        fs.delete_dir(staging)
        _drop_if_empty(fs, staging.rsplit("/", 1)[0])

    def abort(self, messages: list[Attempt]) -> None:
        import pyarrow.fs as pafs

        fs, staging = _fs(self.staging)
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)
        _drop_if_empty(fs, staging.rsplit("/", 1)[0])


def _drop_if_empty(fs, folder: str) -> None:
    import pyarrow.fs as pafs

    try:
        if not fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            fs.delete_dir(folder)
    except OSError:
        pass  # another job's staging is in it


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(path, text) of each run of rows of one path: their lines, each with a line end."""
    if not batch.num_rows:
        return
    paths = batch.column(SCHEMA_COLUMNS.index("path"))
    wide = pa.large_string()
    lines = batch.column(SCHEMA_COLUMNS.index("line")).cast(wide).fill_null("")
    ended = pc.binary_join_element_wise(lines, pa.scalar("", wide), pa.scalar("\n", wide))
    _, offsets, data = ended.buffers()
    offsets = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    text = memoryview(data)
    other = pc.not_equal(paths[1:], paths[:-1]).to_numpy(zero_copy_only=False)
    starts = np.append(0, np.flatnonzero(other) + 1)
    at = [*offsets[starts].tolist(), int(offsets[-1])]
    for i, path in enumerate(paths.take(pa.array(starts)).to_pylist()):
        yield path, bytes(text[at[i] : at[i + 1]])


def _safe(path: str) -> str:
    """A relative path that cannot leave the tree."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    return "/".join(parts) or "_"


class DocsTree(DataSource):
    """``df.write.format("docs_tree").mode("overwrite").save(folder)`` for rows of ``SCHEMA``."""

    @classmethod
    def name(cls) -> str:
        return "docs_tree"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DocsTreeWriter:
        archives = self.options.get("archives", "false") == "true"
        return DocsTreeWriter(self.options["path"], self.options.get("job", uuid.uuid4().hex), archives)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocsTree)


def write_tree(
    lines: DataFrame, folder: str, tasks: int | None = None, archives: bool = False
) -> None:
    """Write documents given as lines (``SCHEMA``) as a tree of files below ``folder``.

    With ``archives`` the tree is kept in archives there, for trees of very many documents.
    The tree replaces what was there; a failed job leaves the old tree as it was.
    """
    spark = lines.sparkSession
    register(spark)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        lines.select(*SCHEMA_COLUMNS)
        .repartition(tasks, "path")
        .sortWithinPartitions(*ORDER)
        .write.format("docs_tree")
        .mode("overwrite")
        .option("archives", str(archives).lower())
        .save(folder)
    )


class _Unpacked:
    """The decompressed bytes of a gzip stream, a piece at a time."""

    def __init__(self, stream):
        self.stream, self.unpacker = stream, zlib.decompressobj(31)
        self.held, self.at = b"", 0

    def _more(self) -> bool:
        while True:
            if self.unpacker.eof:  # another gzip stream may follow
                raw = self.unpacker.unused_data or self.stream.read(_PIECE_BYTES)
                if not raw:
                    return False
                self.unpacker = zlib.decompressobj(31)
            else:
                raw = self.unpacker.unconsumed_tail or self.stream.read(_PIECE_BYTES)
            data = self.unpacker.decompress(raw, _PIECE_BYTES)
            if data:
                self.held, self.at = self.held[self.at :] + data, 0
                return True
            if not raw and not self.unpacker.eof:
                raise EOFError("the archive ends early")

    def read(self, size: int) -> bytes:
        while len(self.held) - self.at < size and self._more():
            pass
        data = self.held[self.at : self.at + size]
        self.at += len(data)
        return data

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            data = self.read(min(size, _PIECE_BYTES))
            if not data:
                raise EOFError("the archive ends early")
            size -= len(data)
            yield data


def _members(stream) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(name, its bytes in pieces, to be read in turn) of the files in a tar.gz archive."""
    unpacked, extra = _Unpacked(stream), {}
    while True:
        header = unpacked.read(_BLOCK)
        if len(header) < _BLOCK:
            raise tarfile.ReadError("the archive has no end")
        if not header.strip(b"\0"):
            while unpacked.read(_PIECE_BYTES):  # to the check sum of the stream
                pass
            return
        if sum(header) - sum(header[148:156]) + 8 * ord(" ") != tarfile.nti(header[148:156]):
            raise tarfile.ReadError("bad check sum of a header")
        size, kind = tarfile.nti(header[124:136]), header[156:157]
        if kind == b"x":  # values that do not fit the plain form, for the next member
            records = b"".join(unpacked.pieces(size))
            while records:
                length, _, _ = records.partition(b" ")
                key, _, value = records[len(length) + 1 : int(length) - 1].partition(b"=")
                extra[key], records = value, records[int(length) :]
            unpacked.read(-size % _BLOCK)
            continue
        size = int(extra.get(b"size", size))
        parts = [header[345:500], header[:100]] if header[257:263] == b"ustar\0" else [header[:100]]
        plain = b"/".join(p for p in (p.partition(b"\0")[0] for p in parts) if p)
        pieces = unpacked.pieces(size)
        if kind in (b"0", b"\0"):
            yield extra.get(b"path", plain).decode("utf-8", "surrogateescape"), pieces
        for _ in pieces:
            pass  # what was not read
        unpacked.read(-size % _BLOCK)
        extra = {}


def _facts(pieces: Iterator[bytes]) -> tuple[int, str]:
    """Number of line ends and MD5 of a text, a piece at a time."""
    decoder, digest, lines = codecs.getincrementaldecoder("utf-8")("replace"), hashlib.md5(), 0
    for piece in pieces:
        lines += piece.count(b"\n")
        digest.update(decoder.decode(piece).encode("utf-8"))
    digest.update(decoder.decode(b"", True).encode("utf-8"))
    return lines, digest.hexdigest()


def read_archives(spark: SparkSession, folder: str, facts: bool = False) -> DataFrame:
    """``(file_path, content, error)`` of the documents of a tree written with ``archives``.

    With ``facts`` ``(file_path, n_lines, text_md5, error)``: the number of line ends and the MD5
    of each document, which is read a piece at a time, however long it is; ``content`` must fit a cell.
    An archive that cannot be read gives one row with its own path and ``error``.
    """
    spark.dataSource.register(SourceListing)
    listing = spark.read.format("source_listing").option("suffixes", ".tar.gz").load(folder)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [("file_path", pa.string())]
    named += [("n_lines", pa.int64()), ("text_md5", pa.string())] if facts else [("content", pa.string())]
    schema = pa.schema([*named, ("error", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        rows: list[tuple] = []
        size = 0
        for path in (p for batch in batches for p in batch.column("file_path").to_pylist()):
            try:
                with fs.open_input_stream(f"{base}/{path}", compression=None) as f:
                    for name, pieces in _members(f):
                        if facts:
                            rows.append((name, *_facts(pieces), None))
                            size += 200
                        else:
                            data = b"".join(pieces)
                            rows.append((name, data.decode("utf-8", "replace"), None))
                            size += len(data)
                        if size > _BATCH_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
            except (OSError, EOFError, tarfile.TarError, zlib.error) as e:
                rows.append((path, *[None] * (len(schema) - 2), str(e)))
        if rows:
            yield batch_of(rows)

    out = "file_path string, n_lines long, text_md5 string, error string" if facts else FILE_SCHEMA
    return listing.repartition(tasks).select("file_path").mapInArrow(read, out)


SCHEMA_COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
