"""Documents as a data source: spark.read.format("citegrid") over folders of files, df.write.format("citegrid") to ten formats.

Register it once in a session, `datasource.register(spark)`. Files are reached through pyarrow.fs, so paths are absolute local ones
or URIs that it knows, and must be the same on the driver and all executors.
"""

from __future__ import annotations

import importlib
import io
import json
import re
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import readers, writers

NAME = "citegrid"
SPLIT_BYTES = 128 << 20
BATCH_BYTES = 8 << 20
STAGING = "_staging-"
ARCHIVE, ARCHIVE_BYTES = ".documents.tar.zst", 32 << 20  # how the name of an archive of documents ends; what it holds at most, unpacked
ABORT_TRIES = 25
EXTENSIONS = {**{kind: kind for kind in (*writers.FORMATS, *writers.REPORTS)}, "report-md": "md"}
_READ = pa.schema([(x.split()[0], pa.string()) for x in readers.SCHEMA.split(", ")])


def reached(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def _hidden(info: fs.FileInfo) -> bool:
    return info.base_name.startswith(("_", "."))


def _called(name: str | None):
    """A function by "module:name"."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


_TOO_LARGE = ("none", None, f"the file has more than {readers.MAX_BYTES} bytes", None)


@dataclass
class Slice(InputPartition):
    """Those files of one folder whose names fall to one of so many slices."""

    folder: str
    number: int
    of: int


class FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob, self.mode = options["path"], options.get("glob", "*"), options.get("mode", "auto")
        self.pdf, self.ocr = options.get("pdf"), options.get("ocr")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def _files(self, where: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
        for info in where.get_file_info(fs.FileSelector(folder)):
            if info.type == fs.FileType.File and not _hidden(info) and (info.base_name.endswith(ARCHIVE) or fnmatchcase(info.base_name, self.glob)):
                yield info

    def partitions(self) -> list[Slice]:
        """A slice for each splitBytes of a folder's files. The driver looks at one folder at a time and keeps the slices, not the files."""
        where, root = reached(self.path)
        if where.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out, open_folders = [], [root]
        while open_folders:
            folder = open_folders.pop()
            size = sum(ARCHIVE_BYTES if info.base_name.endswith(ARCHIVE) else min(info.size or 0, readers.MAX_BYTES) + 4096 for info in self._files(where, folder))
            of = -(-size // self.split)
            out += [Slice(folder, i, of) for i in range(of)]
            open_folders += [info.path for info in where.get_file_info(fs.FileSelector(folder)) if info.type == fs.FileType.Directory and not _hidden(info)]
        return out or [Slice(root, 0, 1)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        where, _ = reached(self.path)
        pdf, ocr = _called(self.pdf), _called(self.ocr)
        read = readers.Once(lambda path, data: readers.told(path, data, pdf, ocr, self.mode))
        rows, size = [], 0
        for info in self._files(where, partition.folder):
            if zlib.crc32(info.base_name.encode()) % partition.of != partition.number:
                continue
            for path, data in self._contents(where, info):
                rows.append((path, *(read(path, data) if data is not None else _TOO_LARGE)))
                size += len(rows[-1][2] or "") + 256
                if size > BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _contents(self, where: fs.FileSystem, info: fs.FileInfo) -> Iterator[tuple[str, bytes | None]]:
        """(path, content) of a file, or of those in an archive; no content where the size refuses it, which is then not read.

        Storage that fails, and an archive that is damaged, is no matter of one document: the task is tried again.
        """
        if not info.base_name.endswith(ARCHIVE):
            data = None
            if (info.size or 0) <= readers.MAX_BYTES:
                with where.open_input_file(info.path) as f:
                    data = f.read()
            yield info.path, data
            return
        with where.open_input_stream(info.path, compression="zstd") as f, tarfile.open(fileobj=f, mode="r|") as archive:
            for member in archive:
                archive.members = []  # it would keep them all
                name = member.name.rpartition("/")[2]
                if member.isfile() and not name.startswith(("_", ".")) and fnmatchcase(name, self.glob):
                    yield f"{info.path}/{member.name}", archive.extractfile(member).read() if member.size <= readers.MAX_BYTES else None

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], schema=_READ)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's files, and how many there are."""

    folder: str
    files: int


class _Files:
    """Each document as a file of its own."""

    def __init__(self, where: fs.FileSystem, folder: str):
        self.where, self.folder = where, folder

    def __call__(self, name: str, content: bytes) -> None:
        with self.where.open_output_stream(f"{self.folder}/{name}") as f:
            f.write(content)

    def close(self) -> None:
        pass


class _Archives:
    """Documents as files in archives, of some size each, so that many tasks can read them again."""

    def __init__(self, where: fs.FileSystem, folder: str):
        self.where, self.folder, self.size, self.open = where, folder, 0, None

    def __call__(self, name: str, content: bytes) -> None:
        whole = 512 + -(-len(content) // 512) * 512  # a head and full blocks
        if self.open and self.size + whole > ARCHIVE_BYTES:
            self.close()
        if not self.open:
            stream = self.where.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}{ARCHIVE}", compression="zstd")
            self.open, self.size = (stream, tarfile.open(fileobj=stream, mode="w|")), 0
        told = tarfile.TarInfo(name)
        told.size = len(content)
        self.open[1].addfile(told, io.BytesIO(content))
        self.open[1].members = []  # it would keep them all
        self.size += whole

    def close(self) -> None:
        if self.open:
            stream, archive = self.open
            archive.close()
            stream.close()
            self.open = None


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("format"), overwrite
        if self.kind not in EXTENSIONS:
            raise ValueError(f"option format is {self.kind!r}; it must be one of {', '.join(EXTENSIONS)}")
        body = "content" if "content" in columns else "text"
        if "doc_id" not in columns or body not in columns:
            raise ValueError("a row needs doc_id, and text or content")
        if body == "text" and self.kind in writers.REPORTS:
            raise ValueError(f"{self.kind} is made from findings by operators.reports; give it as content")
        self.body, self.run, self.archive = body, uuid.uuid4().hex, str(options.get("archive", "false")).lower() == "true"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Files of one attempt of a task, in a folder of its own that nothing reads before commit."""
        where, root = reached(self.path)
        folder, files = f"{root}/{STAGING}{self.run}/{uuid.uuid4().hex}", 0
        where.create_dir(folder)
        put = _Archives(where, folder) if self.archive else _Files(where, folder)
        for batch in batches:
            batch = batch.select([c for c in ("doc_id", self.body, "marks", "comments") if c in batch.schema.names])
            step = max(1, min(1000, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes)))  # rows that are unpacked at a time
            for at in range(0, batch.num_rows, step):
                for row in batch.slice(at, step).to_pylist():
                    if row[self.body] is not None:
                        put(f"{row['doc_id']}.{files}.{EXTENSIONS[self.kind]}", self._content(row))
                        files += 1
        put.close()
        return Written(folder, files)

    def _content(self, row: dict) -> bytes:
        body = row[self.body]
        if self.body == "content" or self.kind in ("txt", "md"):
            return body.encode() if isinstance(body, str) else bytes(body)
        notes = [(c["start"], c["end"], c["body"] or "") for c in row.get("comments") or [] if c and None not in (c["start"], c["end"])]
        marks = [(m["mark"], m["start"], m["end"]) for m in row.get("marks") or [] if m and None not in (m["start"], m["end"])]
        return writers.made(self.kind, body, tuple(sorted(notes)) if self.kind in writers.COMMENTED else (), tuple(marks))

    def commit(self, messages: list[Written | None]) -> None:
        """What attempts left that do not count is deleted, then one renaming shows all files of the run; with overwrite older ones go after that."""
        where, root = reached(self.path)
        staged, kept = f"{root}/{STAGING}{self.run}", {m.folder for m in messages if m is not None and m.files}
        where.create_dir(staged)
        names = {k.rsplit("/", 1)[1] for k in kept}
        for info in where.get_file_info(fs.FileSelector(staged)):
            if info.base_name not in names:
                where.delete_dir(info.path)
        old = [x for x in where.get_file_info(fs.FileSelector(root)) if not _hidden(x)] if self.overwrite else []
        where.move(staged, f"{root}/run-{self.run}")
        for info in old:
            where.delete_file(info.path) if info.type == fs.FileType.File else where.delete_dir(info.path)
        with where.open_output_stream(f"{root}/_written-{self.run}.json") as f:
            f.write(json.dumps({"format": self.kind, "files": sum(m.files for m in messages if m is not None)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Tasks that are being killed may still add a file while their folder is deleted; hence several tries."""
        where, root = reached(self.path)
        staged = f"{root}/{STAGING}{self.run}"
        for left in reversed(range(ABORT_TRIES)):
            try:
                if where.get_file_info(staged).type == fs.FileType.NotFound:
                    return
                where.delete_dir(staged)
            except OSError:
                if not left:
                    raise
            time.sleep(0.2)


class Documents(DataSource):
    """Files as rows (path, format, text, error, warning), rows as files.

    Reading. load(folder) takes all files below a folder but those whose names, or whose folders'
    names, begin with "_" or ".". Options: glob (of file names), mode, pdf and ocr ("module:name" of
    functions as in readers.import_document), splitBytes. Refused and damaged files are rows with a
    reason; a storage error fails the task. A folder without files gives no rows.

    Writing. Rows (doc_id, text) give files of option format: txt, md, html, rtf, docx, odt, pdf.
    Columns marks (mark, start, end) and comments (start, end, body), arrays, are used by formats that
    have them. Rows (doc_id, content), string or binary, are written as they are, in any of these and
    in json, csv and report-md, which operators.reports makes. A null text gives no file, other columns are
    ignored. A file is named by doc_id and its number in its task, so repeated ids stay apart; it
    appears, with all others of the run, when the job commits, below a folder of the run. Attempts that fail, and
    second ones of the same task, leave none. Modes are append and overwrite. Where files are many and
    small, each takes a block of the disk and a name of the folder: option archive (true) puts them, named as ever, into
    archives (tar in zstd, of 32 MB unpacked), which load() opens by their names; a path then ends in the name within.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return readers.SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)
