"""Chunking, manifests, verified reassembly and tree digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casdelta.functions.ids import CHUNK_SIZE, chunk_array, content_id
from casdelta.operators.skew import dealt, hot_join

KIND = "object-v1"


def chunk(objects: DataFrame, chunk_size: int = CHUNK_SIZE, key: str = "rel_path", payload: bool = True) -> DataFrame:
    """(key, idx, cid, len[, bytes]): a row a chunk; empty objects have none. Nothing is shuffled."""
    rows = objects.select(key, F.inline(chunk_array(F.col("content"), chunk_size)))
    out = rows.select(key, "idx", content_id(F.col("bytes")).alias("cid"), F.octet_length("bytes").cast("long").alias("len"), "bytes")
    return out if payload else out.drop("bytes")


def manifests(objects: DataFrame, chunk_size: int = CHUNK_SIZE, key: str = "rel_path", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kind, file_cid, chunk_size, total_size, chunks, keep…) in the row itself, without a shuffle."""
    return objects.select(
        key,
        F.lit(KIND).alias("kind"),
        content_id(F.col("content")).alias("file_cid"),
        F.lit(chunk_size).cast("long").alias("chunk_size"),
        F.octet_length("content").cast("long").alias("total_size"),
        F.transform(chunk_array(F.col("content"), chunk_size), lambda x: content_id(x["bytes"])).alias("chunks"),
        *keep,
    )


def reassemble(wanted: DataFrame, blobs: DataFrame, key: str = "rel_path", strict: bool = False, once: bool = False, all_wanted: bool = False) -> DataFrame:
    """(key, status, content) from manifests (key, file_cid, chunks) and blobs (cid, bytes).

    status: ok, missing_chunk, bad_chunk or bad_file; content is null unless ok. strict raises instead. Each distinct chunk is
    read and checked once; a file of no chunks is the empty file. A chunk that very many files share, such as a block of zeros, is
    replicated to tasks that share its files, and none has them all. once: blobs has each id once already. all_wanted: blobs is no
    more than what these files need; otherwise blobs of other ids are dropped before they meet the files.
    """
    parts = wanted.select(key, "file_cid", F.posexplode_outer("chunks").alias("idx", "cid"))
    known = blobs.select("cid", "bytes") if once else blobs.groupBy("cid").agg(F.first("bytes").alias("bytes"))
    if not all_wanted:
        known = known.join(parts.select("cid").distinct(), "cid", "left_semi")
    known = known.withColumn("good", content_id(F.col("bytes")) == F.col("cid"))
    joined = hot_join(parts, known, "cid", [key, "idx"])
    whole = joined.groupBy(key, "file_cid").agg(
        F.bool_or(F.col("cid").isNotNull() & F.col("good").isNull()).alias("lacks"),
        F.bool_or(F.col("cid").isNotNull() & ~F.col("good")).alias("spoilt"),
        F.coalesce(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY idx)"), F.lit(b"")).alias("content"),
    )
    status = F.when(F.coalesce("lacks", F.lit(False)), "missing_chunk").when(F.coalesce("spoilt", F.lit(False)), "bad_chunk").when(content_id(F.col("content")) != F.col("file_cid"), "bad_file").otherwise("ok")
    if strict:
        status = F.when(status == "ok", status).otherwise(F.raise_error(F.concat(F.lit("cannot rebuild "), F.col(key).cast("string"), F.lit(": expected "), F.col("file_cid"), F.lit(", "), status)))
    return whole.select(key, status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))


def entry_line(x: Column) -> Column:
    return F.concat(x["path"], F.lit("\x00"), x["file_cid"], F.lit("\x00"), x["size"].cast("string"), F.lit("\n"))


def tree_cids(entries: DataFrame, tree: str = "tree_id", most: int = 100_000) -> DataFrame:
    """(tree, tree_cid, n): SHA-256 of the sorted entries' lines (path, file_cid, size); trees of more than `most` entries, as counted, stream."""
    small = entries.groupBy(tree).agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select(tree)
    sorted_rows = F.array_sort(F.collect_list(F.struct("path", "file_cid", "size")))
    lines = F.array_join(F.transform("e", entry_line), "")
    in_rows = entries.join(small, tree, "left_semi").groupBy(tree).agg(sorted_rows.alias("e")).select(tree, F.sha2(lines, 256).alias("tree_cid"), F.size("e").cast("long").alias("n"))
    return in_rows.unionByName(large_tree_cids(entries.join(small, tree, "left_anti"), tree))


def streamed_digests(rows: DataFrame, group: str, line: Column, order: list[str], digest: str) -> DataFrame:
    """(group, digest, n): SHA-256 of each group's lines in order, as one running digest, in constant memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, n = None, None, 0
        kind = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([sha.hexdigest()]), pa.array([n], pa.int64())], ["group", "digest", "n"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sha is None or t != now:
                    if sha is not None:
                        yield done()
                    now, sha, n = t, hashlib.sha256(), 0
                sha.update(x.encode("utf-8"))
                n += 1
        if sha is not None:
            yield done()

    out = dealt(rows, group, order).select(F.col(group).alias("group"), line.alias("line"))
    return out.mapInArrow(run, f"group {out.schema['group'].dataType.simpleString()}, digest string, n long").select(F.col("group").alias(group), F.col("digest").alias(digest), "n")


def large_tree_cids(entries: DataFrame, tree: str = "tree_id") -> DataFrame:
    """As tree_cids() for trees of any size; one task a tree, as the digest runs over its entries in order."""
    line = F.concat(F.col("path"), F.lit("\x00"), F.col("file_cid"), F.lit("\x00"), F.col("size").cast("string"), F.lit("\n"))
    return streamed_digests(entries, tree, line, ["path", "file_cid", "size"], "tree_cid")


def file_cids(entries: DataFrame) -> DataFrame:
    return entries.select("file_cid").distinct()
