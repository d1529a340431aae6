"""Mergeable digests of keyed tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from casdelta.operators import tables


def test_digests_follow_changes_without_the_table(spark):
    df = spark.range(5_000).select(F.col("id").alias("k"), (F.col("id") * 7 % 11).cast("string").alias("v"))
    new = df.where("k % 100 <> 3").withColumn("v", F.when(F.col("k") % 50 == 1, "changed").otherwise(F.col("v")))
    hashed = lambda x: tables.keyed(x, ["k"], 64)
    removed = df.join(new, ["k", "v"], "left_anti")
    added = new.join(df, ["k", "v"], "left_anti")
    got = tables.updated(tables.leaf_digests(hashed(df)), hashed(added), hashed(removed))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tables.leaf_digests(hashed(new)).collect()))
    # everything taken away leaves nothing
    assert tables.updated(tables.leaf_digests(hashed(df)), hashed(df.limit(0)), hashed(df)).count() == 0


def test_digest_is_the_sum_of_row_digests(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (2, "b")], "k int, v string")
    shas = [hashlib.sha256(x.encode()).hexdigest() for x in ("1:1|-", "1:2|1:b", "1:2|1:b")]
    want = [sum(int(s[15 * i : 15 * i + 15], 16) for s in shas) % (2**61 - 1) for i in range(4)]
    assert [tuple(r)[1:] for r in tables.leaf_digests(tables.keyed(df, ["k"], 1)).collect()] == [(3, *want)]


def test_one_changed_row_opens_one_leaf(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    leaves = [tables.leaf_digests(tables.keyed(x, ["k"], 1024)) for x in (df, df.withColumn("v", F.when(F.col("k") == 77, "w").otherwise(F.col("v"))))]
    assert [x.count() for x in tables.differing(*leaves, 1024)] == [1, 1, 1, 1]
    assert [x.count() for x in tables.differing(leaves[0], leaves[0], 1024)] == [0, 0, 0, 0]
    rows = tables.table_delta(df, df.where("k <> 5"), ["k"])
    assert [tuple(r) for r in rows.collect()] == [(5, "delete")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, v string")
    assert tables.table_delta(none, none, ["k"]).count() == 0
    assert [tuple(r) for r in tables.table_delta(none, spark.createDataFrame([(1, "a")], none.schema), ["k"]).collect()] == [(1, "insert")]
