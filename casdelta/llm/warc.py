"""WARC archives and a two-level capture index.

Archives hold a compressed record for each capture, with revisit records for payloads that another record has. The capture index lies
in shards: lines sorted by reversed-host URL key, in compressed blocks, and beside them a sparse directory with the first key of each
block. A lookup searches the list of shards, then a shard's directory by bisection, reads the one or few blocks that may hold the key
by their byte ranges, and from their lines gets the byte ranges of records in the archives. No archive is read beyond these.
Files are named anew by each attempt of a task and only names that a finished task has handed on are ever read, so what lost or
repeated attempts leave behind is not seen.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casdelta.llm.common import free, ranges, shared_dir, slices, staged, whole_text
from casdelta.operators.skew import hot_join

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures in a block of the index, and bytes after which an archive file is closed.
BLOCK_LINES, ARCHIVE_BYTES = 1_000, 256 << 20
#: Payloads of fewer bytes are kept again and again, as a revisit record would hardly be smaller.
LEAST_REVISIT = 1_000
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def url_key(url: Column) -> Column:
    """The key by which captures are sorted: host labels reversed, then path and query: com,example,www)/a?b=1.

    Scheme, user, port and fragment go, the host is in lower case; bytes that are not printable ASCII, and spaces, are %-encoded by
    header_url(), which keys are made from. No URL, or one without a host: the key is ')' and what there is of it.
    """
    bare = F.regexp_replace(header_url(url), r"#.*\z", "")
    rest = F.regexp_replace(bare, r"\A[A-Za-z][A-Za-z0-9+.-]*://", "")
    has = bare != rest
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"\A[^/?]*", 0), r"\A.*@", ""), r":[0-9]*\z", ""))
    path = F.regexp_replace(rest, r"\A[^/?]*", "")
    turned = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))
    return F.when(has, turned).otherwise(F.concat(F.lit(")"), F.coalesce(rest, F.lit(""))))


def header_url(url: Column) -> Column:
    """The URL in bytes that may stand in a header line."""
    odd = F.transform(F.split(url.cast("string"), ""), lambda c: F.when(c.rlike(r"\A[!-~]?\z"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")))
    return F.when(url.rlike(r"\A[!-~]*\z"), url).otherwise(F.array_join(odd, ""))


def decided(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT, broadcast_rows: int = 500_000) -> DataFrame:
    """Return seq, page_id, url, key, payload, n_bytes, sha1, first (seq and page_id of the response it revisits, or null) of each page.

    Of pages with equal payloads (by SHA-1 and length) of at least `least` bytes the one of the largest page_id is the response, null
    ids last; of rows that repeat payload and id, the last as numbered. A null page has an empty payload. The table of repeated payloads is broadcast if it has at most
    broadcast_rows rows, as counted (some sixty bytes each); a larger one is joined by shuffle, hot payloads spread.
    """
    payload = F.encode(whole_text(html), "UTF-8")
    rows = pages.select(F.monotonically_increasing_id().alias("seq"), F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), url_key(F.col(url)).alias("key"), payload.alias("payload"))
    rows = staged(rows.select("*", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1")), "warc-pages")
    same = rows.where(F.col("n_bytes") >= least).groupBy("sha1", "n_bytes").agg(F.max(F.struct("page_id", "seq")).alias("first"), F.count("*").alias("_n")).where("_n > 1")
    same = staged(same.select(F.concat_ws(":", "sha1", "n_bytes").alias("_same"), "first"), "warc-repeats")
    marked = rows.withColumn("_same", F.when(F.col("n_bytes") >= least, F.concat_ws(":", "sha1", "n_bytes")))
    met = marked.join(F.broadcast(same), "_same", "left") if same.count() <= broadcast_rows else hot_join(marked, same, "_same", ["seq"])
    return met.drop("_same").withColumn("first", F.when(F.col("first.seq") != F.col("seq"), F.col("first")))


def record_id(run: str, seq: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(run), str(seq))}>"


def record(run: str, date: str, seq: int, page_id: object, url: str | None, payload: bytes, sha1: str, first: tuple[int, object] | None) -> bytes:
    """The bytes of a response or revisit record; a revisit holds the response's headers and no payload."""
    block = HEAD % len(payload) + (b"" if first else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {record_id(run, seq)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {url}"] if url is not None else []
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(run, first[0])}", f"X-Refers-To-Page: {json.dumps(first[1])}"] if first else []
    lines += [f"X-Page-ID: {json.dumps(page_id)}", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


class DamagedRecord(ValueError):
    """A record that is not what its headers say."""


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of one record, whose length and digest must be right."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("ascii").split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if first != "WARC/1.1" or rest[n:] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(rest[:n]).hexdigest()}":
        raise DamagedRecord(headers.get("WARC-Record-ID"))
    return headers, rest[:n]


def _gzip(raw: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _store(place: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder (a path or a URI of any store that Arrow knows) and the folder's path in it."""
    return pafs.FileSystem.from_uri(place if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", place) else f"file://{place}")


def write(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 6, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write decided() rows as records to archives in folder; return (key, seq, file, offset, length), a row a record.

    Each task writes files of its own, each record a gzip member, and closes a file at `most` bytes. A page without a URL gets no
    target URI. Not to be evaluated twice: stage what it returns.
    """
    run_id = str(uuid.uuid4())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        out, file, at = None, "", 0
        try:
            for batch in batches:
                for part in slices(batch, 3, 1_000, 16 << 20):
                    keys, seqs, files, offsets, lengths = [], [], [], [], []
                    for seq, page, url, payload, key, sha1, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        if out is None or at >= most:
                            if out is not None:
                                out.close()
                            file, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            store.create_dir(root, recursive=True)
                            out = store.open_output_stream(f"{root}/{file}", compression=None)
                        member = _gzip(record(run_id, date, seq, page, url, payload, sha1, (first["seq"], first["page_id"]) if first else None), level)
                        out.write(member)
                        for column, value in zip((keys, seqs, files, offsets, lengths), (key, seq, file, at, len(member)), strict=True):
                            column.append(value)
                        at += len(member)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(seqs, pa.int64()), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "seq", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    slim = rows.select("seq", "page_id", header_url(F.col("url")).alias("url"), "payload", "key", "sha1", "first")
    return slim.mapInArrow(run, "key string, seq long, file string, offset long, length long")


def build_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index of captures (key, seq, file, offset, length) to folder; return (low, shard), a row a shard, low its first key.

    Captures are dealt by ranges of key and seq, so a key with any share of them runs over as many shards as it needs. A shard is a
    file of compressed blocks of `lines` sorted lines, and a directory of its own: first key, offset and length of each block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, at, held, directory, out = uuid.uuid4().hex, 0, [], [], None

        def block() -> None:
            nonlocal at, held, out
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}.blocks", compression=None)
            packed = zlib.compress("\n".join(json.dumps(x) for x in held).encode("ascii"))
            out.write(packed)
            directory.append([held[0][0], at, len(packed)])
            at, held = at + len(packed), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == lines:
                    block()
        if held:
            block()
        if directory:
            out.close()
            with store.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode("ascii")))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], ["low", "shard"])

    rows = captures.count()
    dealt = captures.repartitionByRange(ranges(captures.sparkSession, rows), "key", "seq").sortWithinPartitions("key", "seq")
    return dealt.select("key", "seq", "file", "offset", "length").mapInArrow(run, "low string, shard string")


@lru_cache(maxsize=4)
def _directory(folder: str, shard: str) -> list[list]:
    store, root = _store(folder)
    with store.open_input_file(f"{root}/{shard}.directory") as f:
        return json.loads(zlib.decompress(f.read()))


def lookup(keys: DataFrame, shards: DataFrame, folder: str, most_shards: int = 1_000_000) -> DataFrame:
    """(key, seq, file, offset, length) of all captures of the keys (column key); repeated keys count once.

    A key goes by bisection to the shards and then to the blocks that may hold it, a row a block; the pairs are dealt by block, so a
    key of very many captures is read by many tasks. The list of shards, one for up to a million captures, is broadcast: most_shards
    bounds it, and it is an error to have more.
    """
    listed = sorted((r["low"], r["shard"]) for r in shards.limit(most_shards + 1).collect())
    if len(listed) > most_shards:
        raise ValueError(f"more than {most_shards} shards")
    known = keys.sparkSession.sparkContext.broadcast(listed)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = [x[0] for x in known.value]
        for batch in batches:
            out: list[tuple] = []
            for key in batch.column(0).to_pylist():
                for s in range(max(0, bisect_left(lows, key) - 1), bisect_right(lows, key)):
                    directory = _directory(folder, known.value[s][1])
                    for b in range(max(0, bisect_left(directory, key, key=itemgetter(0)) - 1), bisect_right(directory, key, key=itemgetter(0))):
                        out.append((key, known.value[s][1], directory[b][1], directory[b][2]))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "shard", "at", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        pairs = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (shard, at, size), few in groupby(pairs, key=itemgetter(1, 2, 3)):
            with store.open_input_file(f"{root}/{shard}.blocks") as f:
                lines = [json.loads(x) for x in zlib.decompress(f.read_at(size, at)).decode("ascii").split("\n")]
            hits = []
            for key, *_ in few:
                hits += lines[bisect_left(lines, key, key=itemgetter(0)) : bisect_right(lines, key, key=itemgetter(0))]
            columns = list(zip(*hits, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "seq", "file", "offset", "length"])

    asked = keys.select(F.col("key")).where("key is not null").distinct()
    # neighbouring keys lie in the same shard, so a task reads few directories
    pairs = staged(asked.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(find, "key string, shard string, at long, size long"), "warc-lookups")
    dealt = pairs.repartitionByRange(ranges(keys.sparkSession, pairs.count()), "shard", "at", "key").sortWithinPartitions("shard", "at", "key")
    return dealt.mapInArrow(read, "key string, seq long, file string, offset long, length long")


def fetch(captures: DataFrame, folder: str, most: int = 16 << 20) -> DataFrame:
    """Return key, seq, record_id, record_type, url, page_id, refers_to, refers_to_id, digest, n_bytes, payload of captures.

    Records are read by byte range, in order of file and offset, and checked: a record whose length or digest is not what its headers
    say is an error. digest and n_bytes are what the headers say of the whole payload; payload is null for revisits. page_id and
    refers_to are JSON texts. A task holds `most` bytes of payload, or one record, at once.
    """
    names = ["key", "seq", "record_id", "record_type", "url", "page_id", "refers_to", "refers_to_id", "digest", "n_bytes", "payload"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 7, pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

        pairs = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for file, few in groupby(pairs, key=itemgetter(2)):
            with store.open_input_file(f"{root}/{file}") as f:
                for key, seq, _, offset, length in few:
                    headers, block = parsed(zlib.decompress(f.read_at(length, offset), 31))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    said = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    revisit = headers["WARC-Type"] == "revisit"
                    held.append((key, seq, headers["WARC-Record-ID"], headers["WARC-Type"], headers.get("WARC-Target-URI"), headers["X-Page-ID"], headers.get("X-Refers-To-Page"), headers.get("WARC-Refers-To"), headers["WARC-Payload-Digest"].removeprefix("sha1:"), said, None if revisit else payload))
                    size += len(payload)
                    if size > most or len(held) >= 2_000:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    dealt = captures.repartitionByRange(ranges(captures.sparkSession, captures.count()), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.select("key", "seq", "file", "offset", "length").mapInArrow(run, "key string, seq long, record_id string, record_type string, url string, page_id string, refers_to string, refers_to_id string, digest string, n_bytes long, payload binary")


def resolved(records: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """fetch() rows without payloads, with payload_bytes and payload_digest of the full payload as read: a revisit has its response's.

    It is an error if a payload is not what its own record's headers, or those of a revisit, say, or if a response is not there.
    A response that very many revisit is met in many tasks.
    """
    read = records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload")).drop("payload")
    read = staged(read, "warc-read")
    whole = read.where("record_type = 'response'")
    wanted = read.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    asked = wanted.select(F.col("refers_to_id").alias("record_id")).distinct()
    facts = staged(whole.join(asked, "record_id", "left_semi").select(F.col("record_id").alias("refers_to_id"), "payload_bytes", "payload_digest"), "warc-responses")
    met = wanted.join(F.broadcast(facts), "refers_to_id", "left") if facts.count() <= broadcast_rows else hot_join(wanted, facts, "refers_to_id", ["seq"])
    both = whole.unionByName(met.select(whole.columns))
    right = (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("n_bytes"))
    wrong = F.raise_error(F.concat(F.lit("payload differs from the headers of "), F.col("record_id")))
    return both.withColumn("payload_digest", F.when(F.coalesce(right, F.lit(False)), F.col("payload_digest")).otherwise(wrong.cast("string")))


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Write pages as archives with their index; return the captures, the shards and the folder, below the shared one if not given."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    captures = staged(write(decided(pages), folder), "warc-captures")
    return captures, staged(build_index(captures, folder), "warc-shards"), folder


def read_back(pages: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """resolved() records of all captures of the pages' URLs, found through the index alone."""
    (key,) = free(pages, "_key")
    asked = pages.select(url_key(F.col("url")).alias(key)).select(F.col(key).alias("key"))
    return resolved(fetch(staged(lookup(asked, shards, folder), "warc-found"), folder))
