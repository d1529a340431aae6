from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casdelta.operators import authz, history, jobs, tables

LINK = "request_id string, pos int, issuer string, audience string, actions array<string>, not_after long, path_prefix string, nonce long, sig_ok boolean"
HOST, NOW = "host", 1000


@pytest.mark.parametrize(
    "links, action, reason",
    [
        ([("host", "me", ["sync"], 0)], "sync", None),
        ([("host", "me", ["sync"], 0)], "spawn", "not_granted"),
        ([("host", "me", ["sync"], 1)], "sync", "expired"),
        ([("host", "you", ["sync"], 0)], "sync", "wrong_audience"),
        ([("stranger", "me", ["sync"], 0)], "sync", "untrusted_root"),
        ([("root", "seed", ["sync", "spawn"], 0), ("seed", "me", ["spawn"], 0)], "spawn", None),
        ([("root", "seed", ["sync"], 0), ("seed", "me", ["spawn"], 0)], "spawn", "actions_grow"),
        ([("root", "seed", ["spawn"], 0), ("other", "me", ["spawn"], 0)], "spawn", "broken_chain"),
        ([("gone", "me", ["sync"], 0)], "sync", "revoked"),
        ([], "sync", "no_chain"),
    ],
)
def test_authorize(spark, links, action, reason):
    asked = spark.createDataFrame([("r", HOST, "me", action)], "request_id string, host string, from_id string, action string")
    rows = spark.createDataFrame([("r", i, a, b, acts, t, "src", 7, True) for i, (a, b, acts, t) in enumerate(links)], LINK)
    roots = spark.createDataFrame([("root",), ("gone",)], "key string")
    revoked = spark.createDataFrame([("gone", 7)], "issuer string, nonce long")
    got = authz.authorize(asked, rows, roots, revoked, NOW).first()
    assert (got["allowed"], got["reason"]) == (reason is None, reason)


def test_decode_defaults(spark):
    rows = [(1, b'{"a":"x"}'.hex()), (2, b"{}".hex()), (3, "zz"), (4, b"\xff".hex()), (5, None)]
    got = authz.decode(spark.createDataFrame(rows, "id int, payload_hex string"), "a string", {"a": F.lit("d")}).orderBy("id").collect()
    assert [(r["status"], r["body"]["a"] if r["body"] else None) for r in got][:3] == [("ok", "x"), ("ok", "d"), ("bad_json", None)]
    assert [r["status"] for r in got][3:] == ["bad_json", "bad_json"]


def test_job_logs(spark):
    logs = spark.createDataFrame([("j", b"hello\n")], "job_id string, content binary")
    asked = spark.createDataFrame([(1, "j", 2), (2, "j", 6), (3, "none", 4)], "request_id int, job_id string, offset long")
    got = {r[0]: (bytes(r[1]), r[2]) for r in jobs.log_delta(logs, asked).collect()}
    assert got == {1: (b"llo\n", 6), 2: (b"", 6), 3: (b"", 4)}
    kept = jobs.trim(spark.createDataFrame([(f"job{i:02}", i, None) for i in range(5)], "job_id string, started_ms long, dir_mtime_ms long"), 2)
    assert {r["job_id"] for r in kept.collect()} == {"job03", "job04"}
    state = spark.createDataFrame([("a", True, "3"), ("b", True, None), ("c", False, None), ("d", False, "x")], "job_id string, alive boolean, status string")
    assert {r[0]: (r[1], r[2]) for r in jobs.job_status(state).collect()} == {"a": ("done", 3), "b": ("running", None), "c": ("done", -1), "d": ("done", -1)}


def test_sync_actions(spark):
    graph = [("r", "1", []), ("r", "2", ["1"]), ("r", "3", ["2"]), ("r", "x", ["1"]), ("r", "m", ["3", "x"]), ("r", "lone", [])]
    commits = spark.createDataFrame(graph, "repo string, sha string, parents array<string>")

    def act(local, head, branch="main"):
        mine = spark.createDataFrame([("r", "main", local)] if local else [], "repo string, branch string, head string")
        return history.sync_actions(commits, spark.createDataFrame([("r", branch, head, "p")], "repo string, branch string, head string, peer string"), mine).first()["action"]

    assert [act(None, "2"), act("2", "2"), act("1", "3"), act("3", "1"), act("3", "x"), act("x", "m"), act("2", "lone"), act("1", "3", "dev")] == ["adopt", "noop", "ff", "ahead", "merge", "ff", "merge", "skip"]
    pairs = spark.createDataFrame([("r", "1", "m"), ("r", None, "2"), ("r", "lone", "2")], "repo string, base string, head string")
    got = history.delta_commits(commits, pairs).groupBy("base").agg(F.sort_array(F.collect_set("sha"))).collect()
    assert {r[0]: r[1] for r in got} == {"1": ["2", "3", "m", "x"], None: ["1", "2"], "lone": ["1", "2"]}


def test_table_merge_and_delta(spark):
    s = "k int, a string, b string"
    base = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "a", "b"), (4, "a", "b"), (5, "a", None)], s)
    local = spark.createDataFrame([(1, "L", "b"), (2, "L", "b"), (4, "a", "b"), (5, "a", None), (6, "n", "n")], s)
    incoming = spark.createDataFrame([(1, "a", "I"), (2, "I", "b"), (3, "E", "b"), (5, "a", "x")], s)
    merged, lost = tables.merge_tables(base, local, incoming, ["k"])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "L", "I"), (2, "L", "b"), (3, "E", "b"), (5, "a", "x"), (6, "n", "n")]
    assert sorted((r["k"], r["column"]) for r in lost.collect()) == [(2, "a"), (3, "*")]
    got = {r["k"]: r["op"] for r in tables.table_delta(base, local, ["k"], 4).collect()}
    assert got == {1: "update", 2: "update", 3: "delete", 6: "insert"}
    with pytest.raises(Exception, match="repeated key"):
        tables.table_delta(base.union(base), local, ["k"]).collect()
