"""A whole push, and a pull after it."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from casdelta.operators import chunking, reconcile

SCAN = "rel_path string, size long, mtime_ms long, mode int, content binary"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def scan(spark, files):
    return spark.createDataFrame([(k, len(v), m, 420, v) for k, (v, m) in files.items()], SCAN)


@pytest.fixture
def nothing(spark):
    index = spark.createDataFrame([], "rel_path string, file_cid string, size long, mtime_ms long, mode int, chunks array<string>, base string")
    return index, spark.createDataFrame([], "rel_path string, cid string, mtime_ms long, content binary"), spark.createDataFrame([], "cid string")


def kept(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_push_twice_and_after_an_edit(spark, nothing):
    index, files, store = nothing
    mine = {"a.md": (b"x" * 2500, 10), "empty": (b"", 11), "same": (b"x" * 1024, 12)}
    one = reconcile.push_once(scan(spark, mine), index, files, store, 1024)
    assert {r["rel_path"]: bytes(r["content"]) for r in one.files.collect()} == {k: v for k, (v, _) in mine.items()}
    assert {r["cid"] for r in one.uploaded.collect()} == {sha(b"x" * 1024), sha(b"x" * 452)}
    index, files, store = kept(one.index), kept(one.files), kept(one.uploaded.select("cid"))
    assert {r["rel_path"]: r["base"] for r in index.collect()} == {k: sha(v) for k, (v, _) in mine.items()}
    two = reconcile.push_once(scan(spark, mine), index, files, store, 1024)
    assert two.uploaded.count() == 0 and {r["op"]: r["n_files"] for r in two.counts.collect()} == {"unchanged": 3}
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))
    assert same(two.files, files) and same(two.index, index)
    # an edit, a deletion, and an edit at the receiver that no one pushed
    mine = {"a.md": (b"y" + b"x" * 2499, 20), "same": (b"z", 21)}
    theirs = files.withColumn("content", F.when(F.col("rel_path") == "same", F.lit(b"theirs")).otherwise(F.col("content"))).withColumn("cid", F.sha2("content", 256)).withColumn("mtime_ms", F.when(F.col("rel_path") == "same", 99).otherwise(F.col("mtime_ms")).cast("long"))
    three = reconcile.push_once(scan(spark, mine), index, kept(theirs), store, 1024, short="me")
    assert {r["rel_path"]: bytes(r["content"]) for r in three.files.collect()} == {"a.md": mine["a.md"][0], "same": b"theirs", "same.conflict-me-0": b"z"}
    assert {r["cid"] for r in three.uploaded.collect()} == {sha(b"y" + b"x" * 1023), sha(b"z")}
    assert {r["rel_path"]: r["base"] for r in three.index.collect()} == {"a.md": sha(mine["a.md"][0]), "same": sha(b"theirs")}
    assert {r["op"]: r["n_files"] for r in three.counts.collect()} == {"modify": 2, "delete": 1}


def test_a_merge_reaches_both_sides(spark, nothing):
    index, files, store = nothing
    base, left, right, both = (b"\n".join(x) + b"\n" for x in ((b"a", b"b", b"c"), (b"A", b"b", b"c"), (b"a", b"b", b"C"), (b"A", b"b", b"C")))
    one = reconcile.push_once(scan(spark, {"f.md": (base, 1)}), index, files, store, 1024)
    theirs = kept(one.files).withColumn("content", F.lit(right)).withColumn("cid", F.lit(sha(right)))
    known = kept(theirs).union(kept(one.files).withColumn("rel_path", F.lit("old/f.md")))
    two = reconcile.push_once(scan(spark, {"f.md": (left, 2)}), kept(one.index), known, kept(one.uploaded.select("cid")), 1024, policy="crdt")
    assert {r["rel_path"]: bytes(r["content"]) for r in two.files.where("rel_path = 'f.md'").collect()} == {"f.md": both}
    assert [(r["file_cid"], r["base"]) for r in two.index.collect()] == [(sha(both), sha(both))]


def test_one_shot_pull(spark):
    remote = scan(spark, {"d/x": (b"x" * 2100, 1), "e": (b"", 2)})
    wanted = chunking.manifests(remote, 1024, keep=("mode",))
    asked = spark.createDataFrame([("d/x",), ("e",), ("d/x",)], "rel_path string")
    got = {r["rel_path"]: (r["n_fetched"], r["status"], r["mode"], len(r["content"])) for r in reconcile.pull_one_shot(asked, wanted, chunking.chunk(remote, 1024)).collect()}
    assert got == {"d/x": (2, "ok", 420, 2100), "e": (0, "ok", 420, 0)}
    more = asked.union(spark.createDataFrame([("none",)], "rel_path string"))
    with pytest.raises(Exception, match="no remote file at none"):
        reconcile.pull_one_shot(more, wanted, chunking.chunk(remote, 1024)).collect()
    assert reconcile.pull_one_shot(more, wanted, chunking.chunk(remote, 1024), strict=False).where("status = 'absent'").count() == 1


def test_pull_takes_the_remote_row_whole(spark):
    s = "rel_path string, file_cid string, size long, mtime_ms long, mode int, chunks array<string>"
    state = spark.createDataFrame([("a", "old", 1, 1, 420, ["c"], "old"), ("b", "keep", 1, 1, 420, [], "keep")], s + ", base string")
    pulled = spark.createDataFrame([("a", "new", 9, 8, 493, ["d", "e"], "ok"), ("b", "bad", 0, 0, 0, [], "bad_chunk"), ("n", "n", 1, 2, 420, ["f"], "ok")], s + ", status string")
    got = {r["rel_path"]: tuple(r)[1:] for r in reconcile.pull_apply(state, pulled).collect()}
    assert got == {"a": ("new", 9, 8, 493, ["d", "e"], "new"), "b": ("keep", 1, 1, 420, [], "keep"), "n": ("n", 1, 2, 420, ["f"], "n")}
