"""Sinks with commit and abort, and what a request reads of a store."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from casdelta.operators import reconcile
from casdelta.sources import store

CHUNKS = "cid string, bytes binary"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def chunks(spark, names):
    return spark.createDataFrame([(sha(n.encode()), n.encode()) for n in names], CHUNKS)


def visible(root):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if not f.startswith("."))


def test_uploads_write_what_is_missing(spark, tmp_path):
    root = str(tmp_path / "store")
    df = chunks(spark, [str(i % 30) for i in range(50)]).repartition(4)
    assert store.upload(df, root) == store.Receipt(30, 50, 0) and visible(root) == []
    first = store.upload(df, root, dry_run=False)
    assert (first.rows, first.bytes) == (30, 50) and first.files == len(visible(root)) > 1
    assert store.upload(df, root, dry_run=False) == store.Receipt(0, 0, 0)
    assert store.upload(df.union(chunks(spark, ["new"])), root, dry_run=False).rows == 1
    got = {r["cid"]: bytes(r["bytes"]) for r in store.stored(spark, root).collect()}
    assert got == {sha(x): x for x in [*(str(i).encode() for i in range(30)), b"new"]}
    assert store.upload(df.limit(0), root, dry_run=False).rows == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    store.upload(chunks(spark, ["kept"]), root, dry_run=False)
    before = visible(root)
    bad = chunks(spark, [str(i) for i in range(40)]).union(spark.createDataFrame([("ff" * 32, b"liar")], CHUNKS))
    with pytest.raises(Exception, match="stored id differs"):
        store.upload(bad, root, dry_run=False)
    assert visible(root) == before and not [x for x in os.listdir(root) if x.startswith("_")]


def test_a_request_reads_only_its_folders(spark, tmp_path):
    root = str(tmp_path / "store")
    store.upload(chunks(spark, [str(i) for i in range(300)]), root, dry_run=False)
    kept = store.stored(spark, root)
    asked = chunks(spark, ["7", "8", "not there"]).select("cid")
    named = {r["cid"][:2] for r in asked.collect()}
    for path in visible(root):  # what the request doesn't name can't even be read
        if path.split("prefix=")[1][:2] not in named:
            with open(path, "wb") as f:
                f.write(b"spoilt")
    assert {r["cid"] for r in store.held(kept, asked).collect()} == {sha(b"7"), sha(b"8")}
    assert {bytes(r["bytes"]) for r in store.fetched(kept, asked).collect()} == {b"7", b"8"}
    lacking = reconcile.missing(asked.withColumn("pos", F.lit(1)), store.held(kept, asked))
    assert [r["cid"] for r in lacking.collect()] == [sha(b"not there")]
    with pytest.raises(Exception):  # noqa: B017
        kept.agg(F.sum(F.octet_length("bytes"))).collect()


def test_many_ids_and_an_absent_store(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.held(store.stored(spark, root), chunks(spark, ["a"])).count() == 0
    store.upload(chunks(spark, [str(i) for i in range(400)]), root, dry_run=False)
    asked = chunks(spark, [str(i) for i in range(100, 600)])
    assert store.held(store.stored(spark, root), asked).count() == 300
    assert store.held(store.stored(spark, root), asked.limit(0)).count() == 0


def test_export_is_all_or_nothing(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a").mkdir(parents=True)
    (root / "a/one").write_bytes(b"old")
    rows = [("a/one", b"new"), ("a/b/two", b""), ("three", None)]
    df = spark.createDataFrame(rows, "rel_path string, content binary").repartition(3)
    assert store.export(df, str(root)) == store.Receipt(3, 3, 0) and (root / "a/one").read_bytes() == b"old"
    with pytest.raises(Exception, match="unsafe path"):
        store.export(df.union(spark.createDataFrame([("../out", b"x")], "rel_path string, content binary")), str(root), dry_run=False)
    assert (root / "a/one").read_bytes() == b"old" and visible(root) == [str(root / "a/one")]
    assert store.export(df, str(root), dry_run=False).files == 3
    assert [(root / p).read_bytes() for p, _ in rows] == [b"new", b"", b""]


def test_an_upload_cuts_its_chunks_once_for_ids_and_once_for_bytes(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def hashed(data):
        reads.add(1)
        return hashlib.sha256(bytes(data)).hexdigest()

    cut = chunks(spark, [f"c{i}" for i in range(300)]).select(F.udf(hashed, "string").asNondeterministic()("bytes").alias("cid"), "bytes")
    assert store.upload(cut, str(tmp_path / "store"), dry_run=False).rows == 300
    assert reads.value == 600
