"""WARC archives: records, the two-level index and what comes back, against plain Python."""

from __future__ import annotations

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from casdelta.llm import warc

PAGES = "page_id long, url string, html string"


def sha1(b):
    return hashlib.sha1(b).hexdigest()


def brute(rows):
    groups = {}
    for i, (page, _, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, i))
    out = []
    for body, group in groups.items():
        first = max(group)
        for g in group:
            revisit = len(body) >= 1000 and g != first
            out.append((rows[g[2]][0], len(body), sha1(body), "revisit" if revisit else "response", rows[first[2]][0] if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows = [(i, f"http{'s' * (i % 2)}://www.Site{i % 9}.example.org:80/p/{i % 40}?q={i}#top", f"<p>{i % 60}</p>" * rng.choice((1, 200))) for i in range(300)]
    rows += [(1000 + i, "http://hot.example.com/", "hot " * 500) for i in range(400)]
    rows += [(7, "http://a.b/", "x" * 1000), (7, "http://a.b/", "x" * 1000), (None, None, "x" * 1000), (None, None, None), (8, "", ""), (9, "no host\r\nX: y é", "é" * 600), (10, "ftp://u:p@h/é é", "y" * 999), (11, "http://a.b", "y" * 999), (12, "http://h/" + "z" * 3000, "big" * 400_000)]
    return rows, spark.createDataFrame(rows, PAGES).repartition(6)


def read_back(df, **how):
    _, shards, folder = warc.archive(df)
    out = warc.read_back(df, shards, folder)
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long")
    rows = out.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to")).collect()
    return sorted(map(tuple, rows), key=repr)


def test_every_page_comes_back(pages):
    rows, df = pages
    assert read_back(df) == brute(rows)


def test_small_blocks_hot_keys_and_no_broadcast(pages, monkeypatch, spark):
    rows, df = pages
    captures = warc.staged(warc.write(warc.decided(df, broadcast_rows=0), folder := f"{warc.shared_dir(spark)}/warc-small", most=20_000), "test-captures")
    assert captures.select("file").distinct().count() > 6
    shards = warc.staged(warc.build_index(captures, folder, lines=3), "test-shards")
    keys = df.select(warc.url_key(F.col("url")).alias("key"))
    found = warc.lookup(keys, shards, folder)
    assert found.count() == len(rows) and found.exceptAll(captures.select(found.columns)).isEmpty()
    records = warc.resolved(warc.fetch(found, folder), broadcast_rows=0)
    assert records.groupBy("record_type").count().orderBy("record_type").collect() == spark.createDataFrame([(t, sum(r[3] == t for r in brute(rows))) for t in ("response", "revisit")], "record_type string, count long").collect()
    one = warc.lookup(keys.where("key like 'com,example,hot%'").union(spark.createDataFrame([("com,example,none)/",), (None,)], "key string")), shards, folder)
    assert one.count() == 400 and {r["key"] for r in one.select("key").distinct().collect()} == {"com,example,hot)/"}


def test_archives_are_plain_warc(spark, pages):
    _, df = pages
    captures, _, folder = warc.archive(df.where("page_id < 20"))
    path = folder.removeprefix("file://")
    whole = b"".join(gzip.open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".warc.gz"))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == captures.count()
    assert b"WARC-Target-URI: no%20host%0D%0AX:%20y%20%C3%A9\r\n" in whole and b"WARC-Target-URI: no host" not in whole


def test_a_damaged_record_is_an_error(spark, pages):
    _, df = pages
    captures, shards, folder = warc.archive(df.where("page_id < 3"))
    row = captures.orderBy("file", "offset").first()
    path = os.path.join(folder.removeprefix("file://"), row["file"])
    with open(path, "r+b") as f:
        f.seek(row["offset"])
        raw = gzip.decompress(f.read(row["length"]))
        spoilt = warc._gzip(raw[:-6] + b"!" + raw[-5:], 6)
        f.seek(row["offset"])
        f.write(spoilt.ljust(row["length"], b"\0")[: row["length"]])
    with pytest.raises(Exception, match="DamagedRecord|incorrect|invalid"):
        warc.read_back(df.where("page_id < 3"), shards, folder).collect()


def test_keys(spark):
    urls = ["http://www.Example.com/a?b=1#c", "https://u:p@x.example.org:8443/", "http://h", "HTTP://H?q", "plain", "", None, "http://ü.de/ö"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(warc.url_key(F.col("u"))).collect()]
    assert got == ["com,example,www)/a?b=1", "org,example,x)/", "h)/", "h)/?q", ")plain", ")", ")", "de,%c3%bc)/%C3%B6"]


def test_empty_tables_and_clashing_columns(spark, pages):
    _, df = pages
    none = df.where("false")
    _, shards, folder = warc.archive(none)
    assert shards.count() == 0 and warc.read_back(none, shards, folder).count() == 0
    clash = df.where("page_id < 5").withColumn("_key", F.lit(1)).withColumn("key", F.lit("k")).withColumn("seq", F.lit(1)).withColumn("payload", F.lit("p"))
    _, shards, folder = warc.archive(clash)
    assert warc.read_back(clash, shards, folder).count() == 5
