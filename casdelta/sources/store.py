"""Sinks with commit and abort: a store of chunks by id prefix, and plain files.

Tasks write beside the target, under names of their own that readers pass over; the driver's commit moves all of it into place, and an
abort removes it, so a job that fails leaves nothing visible. Both sinks only count unless dry_run is switched off.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from casdelta.staging import staged

STORE_SCHEMA = "cid string, bytes binary, prefix string"
#: Hexadecimal digits of an id that name its bucket, a folder; and bytes after which a task closes a file.
PREFIX_DIGITS, FILE_BYTES = 2, 128 << 20
#: Up to so many asked ids go to the scan as a filter, which passes row groups over by their least and largest ids.
PUSHED_IDS = 200


def file_system(place: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, of any store that Arrow knows, and the path in it."""
    return pafs.FileSystem.from_uri(place if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", place) else f"file://{os.path.abspath(place)}")


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: rows and bytes, and the files, as (where it lies, where it belongs)."""

    rows: int
    bytes: int
    moves: list[tuple[str, str]]


@dataclass
class Receipt:
    """What a job has written, or would write: rows, bytes and files."""

    rows: int
    bytes: int
    files: int


class _Writer(DataSourceArrowWriter):
    """Common to both sinks: a job's own folder for what is not committed yet, and the moves at its end."""

    def __init__(self, options: dict):
        self.root, self.dry = options["path"], options.get("dry_run", "true").lower() != "false"
        self.job, self.receipt = options.get("job") or uuid.uuid4().hex, options.get("receipt")

    @property
    def waiting(self) -> str:
        return f"_uncommitted-{self.job}"

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        store, root = file_system(self.root)
        for m in done:
            for here, there in m.moves:
                store.create_dir(f"{root}/{os.path.dirname(there)}", recursive=True)
                store.move(f"{root}/{self.waiting}/{here}", f"{root}/{there}")
        self._clear(store, root)
        total = Receipt(sum(m.rows for m in done), sum(m.bytes for m in done), sum(len(m.moves) for m in done))
        if self.receipt:
            with store.open_output_stream(f"{file_system(self.receipt)[1]}", compression=None) as f:
                f.write(json.dumps(asdict(total)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.root))

    def _clear(self, store: pafs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.waiting}").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/{self.waiting}")


class _ChunkWriter(_Writer):
    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Rows come sorted by id; each is verified, and a task's files each hold one prefix."""
        store, root = file_system(self.root)
        kind = pa.schema([("cid", pa.string()), ("bytes", pa.binary())])
        out, name, held, size, rows, total, moves, last = None, "", ([], []), 0, 0, 0, [], None

        def flush() -> None:
            nonlocal held, size
            if held[0] and not self.dry:
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.binary())], schema=kind))
            held, size = ([], []), 0

        def close() -> None:
            nonlocal out, name
            flush()
            if out is not None:
                out.close()
            out, name = None, ""

        in_file = 0
        for batch in batches:
            for cid, data in zip(batch.column("cid").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if cid == last:
                    continue
                if hashlib.sha256(data).hexdigest() != cid:
                    raise ValueError(f"stored id differs from {cid}")
                if name and (cid[:PREFIX_DIGITS] != last[:PREFIX_DIGITS] or in_file >= FILE_BYTES):
                    close()
                if not name:
                    name, in_file = f"{uuid.uuid4().hex}.parquet", 0
                    moves += [] if self.dry else [(name, f"prefix={cid[:PREFIX_DIGITS]}/{name}")]
                    if not self.dry:
                        store.create_dir(f"{root}/{self.waiting}", recursive=True)
                        out = pq.ParquetWriter(f"{root}/{self.waiting}/{name}", kind, filesystem=store)
                last = cid
                held[0].append(cid)
                held[1].append(data)
                size, in_file, rows, total = size + len(data), in_file + len(data), rows + 1, total + len(data)
                if size >= 4 << 20:
                    flush()
        close()
        return Written(rows, total, moves)


class _FileWriter(_Writer):
    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = file_system(self.root)
        rows, total, moves = 0, 0, []
        for batch in batches:
            for path, data in zip(batch.column("rel_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"unsafe path {path}")
                name = uuid.uuid4().hex
                if not self.dry:
                    store.create_dir(f"{root}/{self.waiting}", recursive=True)
                    with store.open_output_stream(f"{root}/{self.waiting}/{name}", compression=None) as f:
                        f.write(data or b"")
                    moves.append((name, path))
                rows, total = rows + 1, total + len(data or b"")
        return Written(rows, total, moves)


class ChunkSink(DataSource):
    """Chunks (cid, bytes) into a store. Options: path; dry_run (true unless false); receipt, a file for the counts."""

    @classmethod
    def name(cls) -> str:
        return "chunkstore"

    def schema(self) -> str:
        return "cid string, bytes binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ChunkWriter(dict(self.options))


class FileSink(DataSource):
    """Objects (rel_path, content) as plain files, each replacing what was there. Options as ChunkSink's."""

    @classmethod
    def name(cls) -> str:
        return "objectfiles"

    def schema(self) -> str:
        return "rel_path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FileWriter(dict(self.options))


def _save(df: DataFrame, sink: type[DataSource], root: str, dry_run: bool) -> Receipt:
    spark = df.sparkSession
    spark.dataSource.register(sink)
    store, path = file_system(root)
    store.create_dir(path, recursive=True)
    receipt = f"_receipt-{uuid.uuid4().hex}"
    df.write.format(sink.name()).mode("append").option("path", root).option("dry_run", str(dry_run).lower()).option("job", uuid.uuid4().hex).option("receipt", f"{root.rstrip('/')}/{receipt}").save()
    with store.open_input_stream(f"{path}/{receipt}", compression=None) as f:
        out = Receipt(**json.loads(f.read()))
    store.delete_file(f"{path}/{receipt}")
    return out


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(cid, bytes, prefix) of a store's committed chunks, maybe with repeats; an empty or absent store has none."""
    store, path = file_system(root)
    if not any(x.base_name.startswith("prefix=") for x in store.get_file_info(pafs.FileSelector(path, allow_not_found=True))):
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).parquet(root)


def asked_of(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The part of stored() that a request (cid) concerns: the folders of its ids' prefixes, and of few ids the row groups.

    At most 256 prefixes come to the driver, and PUSHED_IDS ids.
    """
    few = [r["cid"] for r in ids.select("cid").where("cid is not null").distinct().limit(PUSHED_IDS + 1).collect()]
    if len(few) <= PUSHED_IDS:
        prefixes = {c[:PREFIX_DIGITS] for c in few}
        near = store.where(F.col("prefix").isin(*prefixes)) if few else store.limit(0)
        hit = F.lit(False)
        for c in few:
            hit = hit | (F.col("cid") == c)
        return near.where(hit)
    prefixes = [r[0] for r in ids.select(F.substring("cid", 1, PREFIX_DIGITS)).where("cid is not null").distinct().collect()]
    return store.where(F.col("prefix").isin(*prefixes))


def held(store: DataFrame, ids: DataFrame) -> DataFrame:
    """(cid): the distinct asked ids that a store has. Bytes are not read."""
    return ids.select("cid").distinct().join(asked_of(store, ids).select("cid"), "cid", "left_semi")


def fetched(store: DataFrame, ids: DataFrame) -> DataFrame:
    """(cid, bytes) of the asked ids that a store has, each once."""
    return asked_of(store, ids).join(ids.select("cid").distinct(), "cid", "left_semi").groupBy("cid").agg(F.first("bytes").alias("bytes"))


def upload(chunks: DataFrame, root: str, dry_run: bool = True) -> Receipt:
    """Write the chunks (cid, bytes) that a store lacks, each once and verified, all of them or none; returns what was, or would be, written.

    An id that its bytes don't hash to is an error, and nothing is written. A second upload of the same chunks writes nothing.
    """
    ids = staged(chunks.select("cid").distinct(), "upload-ids")  # the chunks are cut and hashed once for their ids, and once for their bytes
    lacking = ids.join(held(stored(chunks.sparkSession, root), ids), "cid", "left_anti")
    new = chunks.select("cid", "bytes").join(lacking, "cid", "left_semi").persist(StorageLevel.DISK_ONLY)
    try:
        return _save(new.repartitionByRange("cid").sortWithinPartitions("cid"), ChunkSink, root, dry_run)
    finally:
        new.unpersist()


def export(objects: DataFrame, root: str, dry_run: bool = True) -> Receipt:
    """Write objects (rel_path, content) as plain files below root, all of them or none; returns what was, or would be, written."""
    return _save(objects.select("rel_path", "content"), FileSink, root, dry_run)
