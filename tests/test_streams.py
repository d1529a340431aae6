from __future__ import annotations

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from casdelta.operators import conflict
from casdelta.sources import files
from casdelta.streaming import events


def drain(df, name, mode="append", **options):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    for k, v in options.items():
        q = q.option(k, v)
    q = q.start()
    q.awaitTermination(120)
    return q


def test_debounce_stream_equals_batch(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("k", at(s), p) for s, p in ((0, "a"), (10, "b"), (20, "a"), (100, "c/.syncignore"), (5000, "z"), (90000, "end"))]
    df = spark.createDataFrame(rows, "k string, ts timestamp, path string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {(r["start"], tuple(r["paths"]), r["full_rescan"]) for r in events.debounce(df, "10 seconds", "k").collect()}
    assert (at(0), ("a", "b"), False) in want and (at(100), ("c/.syncignore",), True) in want
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    drain(events.debounce(stream, "10 seconds", "k", "1 minute"), "deb", checkpointLocation=str(tmp_path / "cp"))
    got = {(r["start"], tuple(r["paths"]), r["full_rescan"]) for r in spark.table("deb").collect()}
    assert got == {w for w in want if w[0] < at(80000)}


def test_debounce_of_a_batch_keeps_the_streams_rows_and_spreads_a_key(spark):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [("k", at(0), "a"), ("k", at(1500), "b"), ("k", at(3001), "a"), (None, at(0), "n"), (None, at(1000), None), ("m", at(5), None), ("m", None, "x")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, path string")
    got = events.debounce(df, "1500 milliseconds", "k")
    assert {(r["k"], r["start"], r["end"], tuple(r["paths"]), r["n_events"], r["full_rescan"]) for r in got.collect()} == {
        ("k", at(0), at(3000), ("a", "b"), 2, False), ("k", at(3001), at(4501), ("a",), 1, False), (None, at(0), at(2500), ("n",), 2, False), ("m", at(5), at(1505), (), 1, None),
    }
    # no step takes a key's events whole
    assert "SessionWindow" not in got._jdf.queryExecution().toString() and "MergingSessions" not in got._jdf.queryExecution().toString()


def test_stateful_replay_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = [("p", 1, "a", 10, ""), ("p", 2, "b", 5, "a"), ("p", 3, "x", 1, "a"), ("q", 1, "n", 5, "")]
    schema = "rel_path string, seq long, cid string, mtime_ms long, base string"
    for i, part in enumerate((log[:2], log[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 * (i == 0))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(events.stateful_replay(stream), "replayed", "update", checkpointLocation=str(tmp_path / "cp"))
    last = spark.table("replayed").groupBy("rel_path").agg(F.max_by(F.struct("cid", "mtime_ms", "n_conflicts"), "n_conflicts").alias("s")).select("rel_path", "s.*")
    empty = spark.createDataFrame([], "rel_path string, cid string, mtime_ms long")
    want = {tuple(r) for r in conflict.replay(empty, spark.createDataFrame(log, schema)).collect()}
    assert {tuple(r) for r in last.collect()} == want


def test_dedup(spark):
    rows = [(1, dt.datetime(2024, 1, 1), 5), (2, dt.datetime(2024, 1, 1), 5), (3, dt.datetime(2023, 1, 1), 6)]
    got = events.dedup(spark.createDataFrame(rows, "event_id long, ts timestamp, reply_token long"), ["reply_token"])
    assert {(r["reply_token"], r["event_id"]) for r in got.collect()} == {(5, 1), (6, 3)}


def test_files_round_trip(spark, tmp_path):
    from casdelta.functions.rules import read_rules

    root = tmp_path / "tree"
    for rel, data in {"a/b/one.txt": b"x" * 2500, "a/two.tmp": b"t", "empty": b"", "a/b/c/d/deep.txt": b"d"}.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(data)
    (root / "link").symlink_to(root / "empty")
    scan = files.scan_tree(spark, str(root), read_rules(""))
    assert {r["rel_path"]: r["size"] for r in scan.collect()} == {"a/b/one.txt": 2500, "empty": 0, "a/b/c/d/deep.txt": 1}
    for levels, slices in ((0, 1), (1, 3), (5, 2)):
        again = spark.read.format("filetree").option("levels", levels).option("slices", slices).load(str(root))
        assert sorted(r["rel_path"] for r in again.collect()) == ["a/b/c/d/deep.txt", "a/b/one.txt", "a/two.tmp", "empty"]
    chunks = files.read_chunks(scan, 1024).collect()
    assert sorted(r["idx"] for r in chunks if r["rel_path"] == "a/b/one.txt") == [-1, 0, 1, 2]
    assert [r["idx"] for r in chunks if r["rel_path"] == "empty"] == [-1]


def test_index_snapshots(spark, tmp_path):
    where = str(tmp_path / "index")
    assert files.load_index(spark, where, "s").count() == 0
    for cid in ("one", "two"):
        files.save_index(spark.createDataFrame([("a", cid, 1, 1, 420, [])], files.INDEX_SCHEMA), where, "s")
    assert [r["file_cid"] for r in files.load_index(spark, where, "s").collect()] == ["two"]


def test_a_stream_follows_what_is_there(spark, tmp_path):
    """Batch over a prefix of the log, then a stream over the rest, equals the batch over all."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "rel_path string, seq long, cid string, mtime_ms long, base string"
    log = [(p, s, f"c{s % 4}", 100 - s * (s % 3), f"c{(s + 3) % 4}" if s % 2 else "") for p in "abcd" for s in range(8)] + [("new", 9, "n", 1, "")]
    head, tail = [x for x in log if x[1] < 4], [x for x in log if x[1] >= 4]
    empty = spark.createDataFrame([], "rel_path string, cid string, mtime_ms long")
    start = conflict.replay(empty, spark.createDataFrame(head, schema))
    spark.createDataFrame(tail, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    drain(events.stateful_replay(stream, start), "followed", "update", checkpointLocation=str(tmp_path / "cp"))
    seen = {r["rel_path"]: tuple(r) for r in start.collect()} | {r["rel_path"]: tuple(r) for r in spark.table("followed").collect()}
    assert set(seen.values()) == {tuple(r) for r in conflict.replay(empty, spark.createDataFrame(log, schema)).collect()}


def test_sessions_by_slices_equal_session_windows(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rng = random.Random(2)
    rows = [(rng.choice("xxxxxy"), at(rng.randrange(40_000)), rng.choice("abc")) for _ in range(1500)] + [("x", at(50_000 + 10 * i), "long") for i in range(2_000)] + [(None, at(1), "a"), ("x", None, "a"), ("z", at(5), None), ("z", at(5), "q/.syncignore")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, path string").repartition(5)
    for slice_ms in (7_000, 3_600_000):
        got, paths = events.debounced(df, 30_000, "k", slice_ms=slice_ms)
        want = events.debounce(df.where("k is not null and ts is not null"), "30 seconds", "k").select("k", "start", "end", "n_events", F.size("paths").cast("long"), F.coalesce("full_rescan", F.lit(False)))
        assert sorted(map(tuple, got.drop("session").collect())) == sorted(map(tuple, want.collect()))
        assert paths.count() == got.agg(F.sum("n_paths")).first()[0]
    assert events.debounced(df.limit(0), 1000, "k")[0].count() == 0


def test_late_rows_are_sent_again(spark, tmp_path):
    """What a watermark drops, the next tick's comparison of both sides sends."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "k string, ts timestamp, path string"
    seen: set[str] = set()
    for part in ([("k", at(0), "a"), ("k", at(90_000), "b")], [("k", at(10), "late"), ("k", at(200_000), "c")], [("k", at(400_000), "d")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = events.debounce(stream, "1 second", "k", "1 minute").writeStream.foreachBatch(lambda rows, b: seen.update(p for r in rows.collect() for p in r["paths"]))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert "late" not in seen and {"a", "b", "c"} <= seen
    changes = spark.createDataFrame([(p, p) for p in ("a", "b", "c", "late")], "rel_path string, cid string")
    peers, sent = spark.createDataFrame([("p",)], "peer string"), []
    acked = spark.createDataFrame([("p", x, x) for x in sorted(seen)], "peer string, rel_path string, cid string")
    events.reemit_each(lambda s: changes, lambda s: peers, lambda s: acked, lambda rows, b: sent.extend(r["rel_path"] for r in rows.collect()))(changes, 0)
    assert sent == ["late"]


def follow(spark, source, where, out, **options):
    reader = spark.readStream.format(source)
    for k, v in options.items():
        reader = reader.option(k, v)
    q = reader.load().writeStream.foreachBatch(lambda rows, b: out.extend(rows.collect())).option("checkpointLocation", where).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_logs_are_followed_byte_by_byte(spark, tmp_path):
    from casdelta.sources import following

    spark.dataSource.register(following.LogTail)
    logs, out = tmp_path / "logs", []
    logs.mkdir()
    big = bytes(i % 251 for i in range(3 << 20))
    for step in ({"a": b"one\n", "b": b""}, {"a": b"two\n", "b": big, "c": b"\xff\x00"}, {}, {"c": b"end"}):
        for name, data in step.items():
            with open(logs / f"{name}.log", "ab") as f:
                f.write(data)
        (logs / "other.txt").write_bytes(b"not a log")
        follow(spark, "logtail", str(tmp_path / "cp"), out, path=str(logs))  # each run begins at the checkpoint
    pieces = sorted((r["job_id"], r["offset"], bytes(r["data"])) for r in out)
    whole = {j: b"".join(p[2] for p in pieces if p[0] == j) for j in "abc"}
    assert whole == {"a": b"one\ntwo\n", "b": big, "c": b"\xff\x00end"}
    assert all(len(p[2]) <= following.PIECE_BYTES for p in pieces)


def test_changes_of_a_tree_are_followed(spark, tmp_path):
    from casdelta.sources import following

    spark.dataSource.register(following.TreeChanges)
    root, rounds = tmp_path / "tree", []
    for step in ({"a/x": b"1", "y": b"2"}, {"y": b"3", "a/b/c/new": b""}, {}):
        for rel, data in step.items():
            (root / rel).parent.mkdir(parents=True, exist_ok=True)
            (root / rel).write_bytes(data)
        time.sleep(0.3)
        out: list = []
        follow(spark, "treechanges", str(tmp_path / "cp"), out, path=str(root), lag_ms="50")
        rounds.append({r["path"] for r in out})
    assert rounds == [{"a/x", "y"}, {"y", "a/b/c/new"}, set()]
