"""Merges told from conflicts, and the loops that follow a stream: revocations, repeats, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from casdelta.operators import history, jobs
from casdelta.streaming import events


def drain(df, name, where, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_sync_outcomes(spark):
    # o <- a <- x, and o <- a <- y; z has no history in common
    commits = spark.createDataFrame([("r", s, p) for s, p in (("o", []), ("a", ["o"]), ("x", ["a"]), ("y", ["a"]), ("z", []))], "repo string, sha string, parents array<string>")
    text = b"one\ntwo\nthree\nfour\nfive\n"
    trees = {
        "a": {"lines": text, "both": b"1\n", "gone": b"2\n", "same": b"3\n"},
        "x": {"lines": text.replace(b"one", b"ONE"), "both": b"mine\n", "gone": b"2!\n", "same": b"3\n"},
        "y": {"lines": text.replace(b"five", b"FIVE"), "both": b"yours\n", "same": b"3\n", "new": b"n\n"},
        "z": {"same": b"3\n", "both": b"mine\n"},
    }
    rows = [("r", sha, path, data.hex(), data) for sha, files in trees.items() for path, data in files.items()]
    entries = spark.createDataFrame(rows, "repo string, sha string, path string, cid string, content binary")
    local = spark.createDataFrame([("r", "main", "x")], "repo string, branch string, head string")
    incoming = spark.createDataFrame([("r", "main", h, f"p{h}") for h in "xyaz"], "repo string, branch string, head string, peer string")
    got = {r["peer"]: (r["action"], r["n_clashes"], r["kept"]) for r in history.sync_outcomes(commits, incoming, local, entries, "t").collect()}
    # "lines" merges line by line; "both" and the deleted "gone" don't
    assert got == {"px": ("noop", 0, None), "py": ("conflict", 2, "sync/conflict-py-t"), "pa": ("ahead", 0, None), "pz": ("merge", 0, None)}
    # without contents, every path that both sides changed clashes
    blind = history.sync_outcomes(commits, incoming.where("head = 'y'"), local, entries.withColumn("content", F.lit(None).cast("binary")), "t")
    assert blind.first()["n_clashes"] == 3
    assert history.sync_outcomes(commits, incoming.limit(0), local, entries, "t").count() == 0


def test_merge_base_is_the_nearest(spark):
    commits = spark.createDataFrame([(1, s, p) for s, p in ((1, []), (2, [1]), (3, [2]), (4, [3, 1]), (5, [3]))], "repo int, sha int, parents array<int>")
    pairs = spark.createDataFrame([(1, 4, 5)], "repo int, _head int, head int")
    for most in (100, 2):  # by walk, and by rounds
        assert [r["base"] for r in history.merge_bases(commits, pairs, most).collect()] == [3]


def test_revocation_holds_from_the_next_batch(spark, tmp_path):
    asked = spark.createDataFrame([("q", "host", "me", "sync")], "request_id string, host string, from_id string, action string")
    links = spark.createDataFrame([("q", 0, "host", "me", ["sync"], 0, "src", 7, True)], "request_id string, pos int, issuer string, audience string, actions array<string>, not_after long, path_prefix string, nonce long, sig_ok boolean")
    gone, seen = [], []
    revoked = lambda s: s.createDataFrame(gone, "issuer string, nonce long")
    roots = lambda s: s.createDataFrame([], "key string")
    each = events.judge_each(lambda s: links, roots, revoked, lambda: 1, lambda rows, batch: seen.append((batch, rows.first()["reason"])))
    for _ in range(2):
        asked.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        gone.append(("host", 7))
    assert seen == [(0, None), (1, "revoked")]


def test_reemit_sends_what_is_not_acknowledged(spark, tmp_path):
    changes = spark.createDataFrame([("a", "1"), ("b", "2")], "rel_path string, cid string")
    peers = spark.createDataFrame([("p",), ("q",)], "peer string")
    acks, sent = [("p", "a", "1"), ("q", "b", "old")], []

    def write(rows, batch):
        sent.append({(r["peer"], r["rel_path"]) for r in rows.collect()})
        acks.extend([("p", "b", "2"), ("q", "a", "1"), ("q", "b", "2")])

    each = events.reemit_each(lambda s: changes, lambda s: peers, lambda s: s.createDataFrame(acks, "peer string, rel_path string, cid string"), write)
    for _ in range(2):
        spark.range(1).write.mode("append").parquet(str(tmp_path / "in"))
        ticks = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        ticks.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sent == [{("p", "b"), ("q", "a"), ("q", "b")}, set()]


def test_tail_gives_each_byte_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "job_id string, offset long, data binary, exit_code int"
    rounds = [
        [("j", 0, b"abc", None), ("j", 6, b"ghi", None), ("k", 0, b"x", None)],
        [("j", 0, b"abc", None), ("j", 2, b"cdef", None), ("k", 1, None, 3)],
        [("j", 9, None, 0), ("k", 1, b"never", None), ("e", 0, None, -1)],
    ]
    for i, rows in enumerate(rounds):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(events.tail(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), f"tail{i}", str(tmp_path / f"cp{i}"))
    # one run over all three files at once gives the same bytes
    whole = {(r["job_id"], bytes(r["data"]), r["next_offset"], r["exit_code"]) for r in spark.table("tail2").collect()}
    assert ("j", b"abcdefghi", 9, 0) in whole and ("e", b"", 0, -1) in whole and ("k", b"x", 1, 3) in whole
    out = []
    for i in range(3):
        spark.createDataFrame(rounds[i], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "steps"))
        q = events.tail(spark.readStream.schema(schema).parquet(str(tmp_path / "steps"))).writeStream.foreachBatch(lambda rows, b: out.extend(rows.collect()))
        q.option("checkpointLocation", str(tmp_path / "steps-cp")).trigger(availableNow=True).start().awaitTermination(120)
    joined = {j: b"".join(bytes(r["data"]) for r in out if r["job_id"] == j) for j in "jke"}
    assert joined == {"j": b"abcdefghi", "k": b"x", "e": b""}
    assert {(r["job_id"], r["exit_code"]) for r in out if r["exit_code"] is not None} == {("k", 3), ("e", -1), ("j", 0)}


def test_poll(spark):
    logs = spark.createDataFrame([("j", b"abc"), ("k", b"")], "job_id string, content binary")
    rows = spark.createDataFrame([("j", True, None), ("k", False, "4")], "job_id string, alive boolean, status string")
    asked = spark.createDataFrame([("1", "j", 1), ("2", "k", 0), ("3", "none", 5)], "request_id string, job_id string, offset long")
    got = {r["request_id"]: (bytes(r["data"]), r["next_offset"], r["running"], r["exit_code"]) for r in jobs.poll(logs, rows, asked).collect()}
    assert got == {"1": (b"bc", 3, True, None), "2": (b"", 0, False, 4), "3": (b"", 5, False, 0)}
