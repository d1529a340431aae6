from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from casdelta.operators import chunking, reconcile

SCHEMA = "rel_path string, size long, mtime_ms long, mode int, content binary"


def tree(spark, files: dict[str, bytes], mtime: int = 1000):
    return spark.createDataFrame([(k, len(v), mtime, 420, v) for k, v in files.items()], SCHEMA)


def test_fixed_chunks_and_ids(spark):
    long = bytes(i % 251 for i in range(2500))
    rows = chunking.manifests(tree(spark, {"long": long, "empty": b"", "same": b"\x07" * 2048}), 1024).collect()
    by = {r["rel_path"]: r for r in rows}
    assert len(by["long"]["chunks"]) == 3
    assert by["long"]["file_cid"] == hashlib.sha256(long).hexdigest()
    assert by["empty"]["chunks"] == []
    assert by["empty"]["file_cid"] == hashlib.sha256(b"").hexdigest()
    assert len(by["same"]["chunks"]) == 2 and len(set(by["same"]["chunks"])) == 1


def test_reassemble_states(spark):
    t = tree(spark, {"a": b"x" * 3000, "b": b"", "c": b"hello"})
    wanted, blobs = chunking.manifests(t, 1024), chunking.chunk(t, 1024)
    assert {r["rel_path"]: bytes(r["content"]) for r in chunking.reassemble(wanted, blobs).collect()} == {"a": b"x" * 3000, "b": b"", "c": b"hello"}
    spoilt = blobs.withColumn("bytes", F.when(F.col("rel_path") == "c", F.lit(b"other")).otherwise(F.col("bytes"))).where("not (rel_path = 'a' and len < 1024)")
    assert {r["rel_path"]: r["status"] for r in chunking.reassemble(wanted, spoilt).collect()} == {"a": "missing_chunk", "b": "ok", "c": "bad_chunk"}
    wrong = wanted.withColumn("file_cid", F.when(F.col("rel_path") == "c", F.lit("deadbeef")).otherwise(F.col("file_cid")))
    assert {r["rel_path"]: r["status"] for r in chunking.reassemble(wrong, blobs).collect()}["c"] == "bad_file"
    with pytest.raises(Exception, match="deadbeef"):
        chunking.reassemble(wrong, blobs, strict=True).collect()


def test_tree_digest_ignores_row_order(spark):
    rows = [("t", "b.rs", "11", 2), ("t", "a.rs", "22", 3)]
    small = [chunking.tree_cids(spark.createDataFrame(r, "tree_id string, path string, file_cid string, size long")).first()["tree_cid"] for r in (rows, rows[::-1])]
    large = chunking.large_tree_cids(spark.createDataFrame(rows, "tree_id string, path string, file_cid string, size long")).first()["tree_cid"]
    want = hashlib.sha256(b"a.rs\x0022\x003\nb.rs\x0011\x002\n").hexdigest()
    assert small == [want, want] and large == want


def test_one_byte_edit_moves_one_chunk(spark):
    def content(k: int) -> bytes:
        return b"".join(bytes((97 * c + i % 251) % 256 for i in range(1024)) for c in range(3)) if not k else bytes([content(0)[0]]) + content(0)[1:7] + bytes([content(0)[7] ^ 255]) + content(0)[8:]

    old, new = tree(spark, {"f": content(0)}), tree(spark, {"f": content(1)})
    none = chunking.chunk(old, 1024, payload=False).where("false")
    plan = lambda t, held: reconcile.push_plan(chunking.chunk(t, 1024, payload=False), t, held).first()["n_new"]
    held = chunking.chunk(old, 1024, payload=False)
    assert (plan(old, none), plan(new, held), plan(old, held)) == (3, 1, 0)
    both = tree(spark, {"f": content(0), "g": content(0)})
    rows = reconcile.push_plan(chunking.chunk(both, 1024, payload=False), both, none).collect()
    assert {r["rel_path"]: r["n_new"] for r in rows} == {"f": 3, "g": 0}


def test_plans_keep_first_order(spark):
    asked = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "pos int, cid string")
    other = spark.createDataFrame([("a",), ("c",)], "cid string")
    assert [r["cid"] for r in reconcile.transfer(asked, other).orderBy("pos").collect()] == ["a", "c"]
    assert [r["cid"] for r in reconcile.missing(asked, other).orderBy("pos").collect()] == ["b"]
    assert reconcile.transfer(asked, other.where("false")).count() == 0


def test_index_reuses_unchanged_rows(spark):
    before = tree(spark, {"a.rs": b"one", "gone": b"x"})
    index = chunking.manifests(before, 1024).select("rel_path", "file_cid", "chunks").join(before.drop("content"), "rel_path").select(reconcile.INDEX)
    scan = tree(spark, {"a.rs": b"two", "new": b"n"})  # same size and time: taken as unchanged
    made = {r["rel_path"]: r["file_cid"] for r in reconcile.build_index(scan, index, 1024).collect()}
    assert made == {"a.rs": hashlib.sha256(b"one").hexdigest(), "new": hashlib.sha256(b"n").hexdigest()}


def test_plan_after_apply_is_empty(spark):
    a, b = tree(spark, {"x": b"1", "y": b"2"}), tree(spark, {"y": b"3", "z": b"4"})
    cid = lambda t: t.select("rel_path", F.sha2("content", 256).alias("file_cid"))
    steps = reconcile.plan(cid(a), cid(b))
    change = steps.where("op <> 'unchanged'").select("rel_path", "op", F.col("new_cid").alias("file_cid"))
    after = reconcile.upsert(cid(a), change)
    assert reconcile.plan(after, cid(b)).where("op <> 'unchanged'").count() == 0


def test_refused_push_keeps_the_index(spark):
    index = spark.createDataFrame([("a", "old", "old"), ("b", "old", "old")], "rel_path string, file_cid string, base string")
    sent = spark.createDataFrame([("a", "new"), ("b", "new")], "rel_path string, file_cid string")
    replies = spark.createDataFrame([("a", True, True, True, False, None)], "rel_path string, ok boolean, conflict boolean, applied boolean, merged boolean, remote_cid string")
    out = {r["rel_path"]: tuple(r)[1:] for r in reconcile.push_apply(index, sent, replies).collect()}
    assert out == {"a": ("new", "new", False), "b": ("old", "old", True)}
