"""Stream sources: growing logs by byte offset, and changes of a file tree by time."""

from __future__ import annotations

import os
import stat
import time
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from casdelta.sources.files import TreeReader
from casdelta.sources.store import file_system

#: Bytes of a log that one row holds, and rows of a partition.
PIECE_BYTES, PIECES = 1 << 20, 16


class _Range(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class _LogReader(DataSourceStreamReader):
    """An offset is the length of each log as it was listed; a range of bytes between two offsets is read by one task or more."""

    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", ".log")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, path = file_system(self.root)
        found = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return {x.base_name.removesuffix(self.suffix): x.size for x in found if x.type == pafs.FileType.File and x.base_name.endswith(self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        most = PIECE_BYTES * PIECES
        return [_Range(name, at, min(at + most, size)) for name, size in sorted(end.items()) for at in range(start.get(name, 0), size, most)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        store, path = file_system(self.root)
        with store.open_input_file(f"{path}/{partition.name}{self.suffix}") as f:
            for at in range(partition.start, partition.end, PIECE_BYTES):
                yield partition.name, at, f.read_at(min(PIECE_BYTES, partition.end - at), at)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """(job_id, offset, data) of the logs <job_id>.log in a folder, as they grow: each byte once, also over restarts from a checkpoint.

    Options: path, a folder of any store that executors reach; suffix. A log only grows. The offset holds a number for each log.
    """

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "job_id string, offset long, data binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogReader(dict(self.options))


class _ChangeReader(DataSourceStreamReader):
    """An offset is a time; files whose status changed after the one and up to the other are changes between them."""

    def __init__(self, options: dict):
        self.root, self.lag, self.since = options["path"], int(options.get("lag_ms", "1000")), int(options.get("since_ms", "0"))

    def initialOffset(self) -> dict:
        return {"ms": self.since}

    def latestOffset(self) -> dict:
        return {"ms": time.time_ns() // 1_000_000 - self.lag}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        folders = TreeReader(self.root).partitions() if end["ms"] > start["ms"] else []
        for f in folders:
            f.start, f.end = start["ms"], end["ms"]
        return folders

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for rel, uri, size, mtime, mode in TreeReader(self.root).read(partition):
            try:
                changed = os.lstat(uri)
            except OSError:
                continue
            when = changed.st_ctime_ns // 1_000_000
            if stat.S_ISREG(changed.st_mode) and partition.start < when <= partition.end:
                yield rel, when, size, mtime, mode

    def commit(self, end: dict) -> None:
        pass


class TreeChanges(DataSource):
    """(path, changed_ms, size, mtime_ms, mode) of files of a mounted tree whose status has changed since the last batch.

    Options: path; since_ms, where a new stream begins; lag_ms, how old a change must be to be seen, so that a clock's step hides none.
    A file that changes again is seen again. Files that went are not seen: a full reconcile finds them.
    """

    @classmethod
    def name(cls) -> str:
        return "treechanges"

    def schema(self) -> str:
        return "path string, changed_ms long, size long, mtime_ms long, mode int"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ChangeReader(dict(self.options))
