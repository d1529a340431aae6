"""Joins under hot keys."""

from __future__ import annotations

from statistics import median

import pytest
from pyspark.sql import functions as F

from casdelta.operators import chunking, skew


@pytest.fixture(scope="module")
def rows(spark):
    """40,000 rows: half with key hot, a twentieth null, the rest over 2,000 keys."""
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 20 != 1, F.concat(F.lit("k"), (F.col("id") % 2001).cast("string")))
    return spark.range(40_000).select(key.alias("cid"), F.col("id").alias("n")).repartition(8)


def test_sketch_finds_every_hot_key(rows):
    found = dict(skew.heavy_keys(rows, "cid", 0.01))
    assert set(found) == {"hot"} and 20_000 * 0.99 <= found["hot"] <= 20_000
    # with a smaller share more keys count; each is found, and few besides
    many = skew.heavy_keys(rows, "cid", 1 / 4000)
    assert len(many) <= 8000 and many[0][0] == "hot"
    assert skew.heavy_keys(rows.limit(0), "cid") == []


@pytest.mark.parametrize("how", ["left", "inner"])
def test_same_rows_as_a_plain_join(rows, how):
    right = rows.where("cid is not null and n % 3 = 0").select("cid").distinct().withColumn("value", F.length("cid"))
    got = skew.hot_join(rows, right, "cid", ["n"], how)
    want = rows.join(right, "cid", how).select(got.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_no_task_has_the_hot_key_alone(spark, rows):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("16", "-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        right = rows.where("cid is not null").select("cid").distinct().withColumn("value", F.lit(1))
        joined = skew.hot_join(rows.where("cid = 'hot'"), right, "cid", ["n"]).groupBy(F.spark_partition_id().alias("p")).count().collect()
        each = [r["count"] for r in joined]
        assert sum(each) == 20_000 and max(each) <= 3 * median(each)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_files_that_share_a_block(spark):
    files = [(f"f{i}", b"0" * 64 * (1 + i % 3) + bytes(str(i), "ascii")) for i in range(500)] + [("empty", b""), ("again", b"0" * 64)]
    tree = spark.createDataFrame(files, "rel_path string, content binary")
    wanted, blobs = chunking.manifests(tree, 64), chunking.chunk(tree, 64)
    got = {r["rel_path"]: (r["status"], r["content"] and bytes(r["content"])) for r in chunking.reassemble(wanted, blobs).collect()}
    assert got == {k: ("ok", v or None) for k, v in files} | {"empty": ("ok", got["empty"][1])}
    lacking = blobs.where(F.col("bytes") != b"0" * 64)
    assert {r["status"] for r in chunking.reassemble(wanted.where("rel_path <> 'empty'"), lacking).collect()} == {"missing_chunk"}
