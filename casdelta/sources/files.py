"""File trees as tables: a data source for stat rows, streamed contents, and index snapshots."""

from __future__ import annotations

import hashlib
import os
import stat
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from casdelta.functions.ids import CHUNK_SIZE
from casdelta.functions.rules import Rule, is_ignored
from casdelta.sources.store import file_system

INDEX_VERSION = 1
INDEX_SCHEMA = "rel_path string, file_cid string, size long, mtime_ms long, mode int, chunks array<string>"


class _Folder(InputPartition):
    """A folder, with what is below it if deep, and of its files those whose name's checksum leaves `part` modulo `parts`."""

    def __init__(self, folder: str, deep: bool, part: int = 0, parts: int = 1):
        self.folder, self.deep, self.part, self.parts = folder, deep, part, parts


class TreeReader(DataSourceReader):
    """levels: how many levels of folders the driver lists; the ones below go to tasks whole. slices: tasks that share a listed folder's own files."""

    def __init__(self, root: str, levels: int = 2, slices: int = 4):
        self.root, self.levels, self.slices = root, levels, slices

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        level = [self.root]
        for depth in range(self.levels + 1):
            if depth == self.levels:
                return out + [_Folder(d, True) for d in level]
            out += [_Folder(d, False, i, self.slices) for d in level for i in range(self.slices)]
            level = [d for folder in level for d in self._below(folder)]
        return out

    @staticmethod
    def _below(folder: str) -> list[str]:
        try:
            return sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False))
        except OSError:
            return []

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for folder, dirs, names in os.walk(partition.folder, followlinks=False):
            if not partition.deep:
                dirs.clear()
            for name in names:
                if partition.parts > 1 and zlib.crc32(os.fsencode(name)) % partition.parts != partition.part:
                    continue
                path = os.path.join(folder, name)
                try:
                    s = os.lstat(path)
                except OSError:
                    continue
                if stat.S_ISREG(s.st_mode):
                    yield (os.path.relpath(path, self.root).replace(os.sep, "/"), path, s.st_size, s.st_mtime_ns // 1_000_000, s.st_mode & 0o7777)


class FileTree(DataSource):
    """Regular files below a folder that all executors mount: rel_path, uri, size, mtime_ms, mode; links are not followed.

    Options: path; levels and slices, as TreeReader has them: raise levels for a deep tree with few folders at the top, slices for
    folders of very many files.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "rel_path string, uri string, size long, mtime_ms long, mode int"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], int(self.options.get("levels", "2")), int(self.options.get("slices", "4")))


def scan_tree(spark: SparkSession, root: str, rules: list[Rule] | None = None) -> DataFrame:
    """Stat rows of the files that the rules don't ignore; empty files and modes included, unreadable entries skipped."""
    spark.dataSource.register(FileTree)
    out = spark.read.format("filetree").load(root)
    return out.where(~is_ignored(F.col("rel_path"), rules)) if rules else out


def read_chunks(files: DataFrame, chunk_size: int = CHUNK_SIZE, payload: bool = False) -> DataFrame:
    """(rel_path, idx, cid, len, file_cid[, bytes]) of files (rel_path, uri), read piece by piece, never whole.

    A file's chunk rows come first, then one row of idx -1 with its file_cid, so an empty file has just that one.
    """
    kind = pa.schema([("rel_path", pa.string()), ("idx", pa.int32()), ("cid", pa.string()), ("len", pa.int64()), ("file_cid", pa.string()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole, i = hashlib.sha256(), 0
                with open(uri, "rb") as f:
                    while piece := f.read(chunk_size):
                        whole.update(piece)
                        row = [[rel], [i], [hashlib.sha256(piece).hexdigest()], [len(piece)], [None], [piece if payload else None]]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(row, kind, strict=True)], schema=kind)
                        i += 1
                row = [[rel], [-1], [None], [None], [whole.hexdigest()], [None]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(row, kind, strict=True)], schema=kind)

    out = files.select("rel_path", "uri").mapInArrow(run, "rel_path string, idx int, cid string, len long, file_cid string, bytes binary")
    return out if payload else out.drop("bytes")


def save_index(index: DataFrame, root: str, session: str) -> str:
    """Write a snapshot of the index in a new folder; it counts once Spark has put its success mark there."""
    path = f"{root.rstrip('/')}/session={session}/v={_latest(root, session) + 1:012d}-{uuid.uuid4().hex[:8]}"
    index.withColumn("index_version", F.lit(INDEX_VERSION)).write.parquet(path)
    return path


def _snapshots(root: str, session: str) -> list[str]:
    """Complete snapshots, oldest first."""
    store, path = file_system(f"{root.rstrip('/')}/session={session}")
    found = [x for x in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if x.base_name.startswith("v=")]
    done = [x.base_name for x in found if store.get_file_info(f"{x.path}/_SUCCESS").type == pafs.FileType.File]
    return [f"{root.rstrip('/')}/session={session}/{name}" for name in sorted(done)]


def _latest(root: str, session: str) -> int:
    found = _snapshots(root, session)
    return int(found[-1].rpartition("/v=")[2].partition("-")[0]) if found else 0


def load_index(spark: SparkSession, root: str, session: str) -> DataFrame:
    """The last complete snapshot; an empty index if there is none or it is of another version."""
    found = _snapshots(root, session)
    if not found:
        return spark.createDataFrame([], INDEX_SCHEMA)
    return spark.read.schema(f"{INDEX_SCHEMA}, index_version int").parquet(found[-1]).where(F.col("index_version") == INDEX_VERSION).drop("index_version")
