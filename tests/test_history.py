"""Reachability: the walk by generations against plain search, and against the rounds for large repositories."""

from __future__ import annotations

import random
import time

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casdelta.operators import history
from casdelta.plans.queries import ORACLES, QUERIES

PAIRS = "repo string, base string, head string"
COMMITS = "repo string, sha string, parents array<string>"


def reached(parents, head):
    out, todo = {head}, [head]
    while todo:
        for p in parents.get(todo.pop(), ()):
            if p not in out:
                out.add(p)
                todo.append(p)
    return out


@pytest.fixture(scope="module")
def graphs():
    rng = random.Random(5)
    out = {}
    for r in range(6):
        n = 30 + 10 * r
        out[f"r{r}"] = {str(i): [str(p) for p in rng.sample(range(i), min(i, rng.choice((0, 1, 1, 1, 2))))] for i in range(n)}
    return out


@pytest.mark.parametrize("most", [1_000, 45])
def test_all_answers_equal_plain_search(spark, graphs, most):
    rng = random.Random(6)
    commits = spark.createDataFrame([(r, s, p) for r, g in graphs.items() for s, p in g.items()], COMMITS)
    asked = [(r, rng.choice([*g, None]), rng.choice([*g])) for r, g in graphs.items() for _ in range(12)] + [("r0", "3", "3"), ("r1", "gone", "7"), ("nowhere", "a", "b")]
    pairs = spark.createDataFrame(asked, PAIRS)
    parents = graphs | {"nowhere": {}}
    delta = {(r, b, h, s) for r, b, h in asked if b != h for s in reached(parents[r], h) - (reached(parents[r], b) if b in reached(parents[r], h) else set())}
    assert {tuple(x) for x in history.delta_commits(commits, pairs, most).collect()} == delta
    known = {(r, b, h, b in reached(parents[r], h)) for r, b, h in asked if b is not None}
    assert {tuple(x) for x in history.is_ancestor(commits, pairs.where("base is not null"), most).collect()} == known
    heads = pairs.select("repo", "head")
    assert {tuple(x) for x in history.ancestors(commits, heads, most).collect()} == {(r, h, s) for r, _, h in asked for s in reached(parents[r], h)}


def test_a_deep_history_is_one_walk(spark):
    n = 60_000
    rows = [("deep", str(i), [str(p) for p in ((i - 1,) if i % 5 else (i - 1, i - 2)) if p >= 0]) for i in range(n)]
    commits = spark.createDataFrame(rows, COMMITS)
    began = time.perf_counter()
    got = history.delta_commits(commits, spark.createDataFrame([("deep", "100", str(n - 1))], PAIRS))
    assert got.count() == n - 101 and time.perf_counter() - began < 30


def test_a_cycle_is_an_error():
    with pytest.raises(RuntimeError, match="cycle"):
        history.generations({"a": ["b"], "b": ["a"]}, ["a"])


def test_more_peers_than_are_broadcast(spark):
    rows, peers = spark.createDataFrame([(1,), (2,)], "n int"), spark.createDataFrame([(f"p{i % 50}",) for i in range(80)], "peer string")
    few, many = (sorted(tuple(r) for r in history.each_peer(rows, peers, most).collect()) for most in (100, 7))
    assert few == many and len(few) == 100


def joined_graph(spark):
    """Commits from a window and pairs from a join: both are dealt by repository already, but in tasks of their own."""
    w = Window.partitionBy("repo").orderBy("sha")
    commits = spark.range(400_000).select((F.col("id") % 4_000).alias("repo"), F.col("id").alias("sha"))
    commits = commits.withColumn("parents", F.array_compact(F.array(F.lag("sha").over(w))))
    ends = commits.groupBy("repo").agg(F.min("sha").alias("base")), commits.groupBy("repo").agg(F.max("sha").alias("head"))
    return commits, ends[0].join(ends[1], "repo")


def test_pairs_from_a_join_meet_all_commits_of_their_repository(spark):
    assert history.is_ancestor(*joined_graph(spark)).groupBy("is_ancestor").count().collect() == [(True, 4_000)]


def test_deltas_of_pairs_from_a_join_leave_out_what_the_base_has(spark):
    assert history.delta_commits(*joined_graph(spark)).count() == 4_000 * 99


def test_actions_on_heads_from_a_join_follow_the_history(spark):
    commits, pairs = joined_graph(spark)
    incoming = pairs.select("repo", F.lit("main").alias("branch"), "head", F.lit("p").alias("peer"))
    local = pairs.select("repo", F.lit("main").alias("branch"), F.col("base").alias("head"))
    assert history.sync_actions(commits, incoming, local).groupBy("action").count().collect() == [("ff", 4_000)]


@pytest.mark.parametrize("name", ["k3_delta_commits", "k4_sync_action"])
def test_histories_have_the_rows_of_their_sql_at_scale(spark, name):
    """At sf0.1 joins are shuffled and their partitions coalesced, which the smallest tables of the other tests don't show."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    try:
        df = QUERIES[name](spark, "/root/testdata/sf0.1")
        got = sorted(map(repr, map(tuple, df.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    con = duckdb.connect()
    con.execute("CREATE VIEW orders AS SELECT * FROM '/root/testdata/sf0.1/orders.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert got == sorted(map(repr, want))


@pytest.mark.parametrize("most", [1_000, 45])
def test_relations_and_bases_equal_plain_search(spark, graphs, most):
    rng = random.Random(7)
    commits = spark.createDataFrame([(r, s, p) for r, g in graphs.items() for s, p in g.items()], COMMITS)
    asked = {(r, *rng.sample([*g], 2)) for r, g in graphs.items() for _ in range(12)}
    want = set()
    for r, a, b in asked:
        of_a, of_b = reached(graphs[r], a), reached(graphs[r], b)
        common = of_a & of_b
        best = [s for s in common if not any(s in reached(graphs[r], o) for o in common - {s})]
        want.add((r, a, b, a in of_b, b in of_a, None if a in of_b or b in of_a else min(best, default=None)))
    pairs = spark.createDataFrame(sorted(asked), "repo string, _head string, head string")
    assert {tuple(x) for x in history._related(commits, pairs, True, most).select("repo", "_head", "head", "_up", "_down", "_base").collect()} == want
    assert {tuple(x) for x in history._related(commits, pairs, False, most).select("repo", "_head", "head", "_up", "_down").collect()} == {x[:5] for x in want}


def test_outcomes_take_one_walk_and_read_the_trees_once(spark, monkeypatch):
    walks, reads, walk = [], spark.sparkContext.accumulator(0), history._walk
    monkeypatch.setattr(history, "_walk", lambda *args: walks.append(1) or walk(*args))

    @F.udf("string")
    def counted(cid):
        reads.add(1)
        return cid

    commits = spark.createDataFrame([("r", "a", []), ("r", "x", ["a"]), ("r", "y", ["a"])], COMMITS)
    entries = spark.createDataFrame([("r", s, f"f{i}", s if i == 0 else "same") for s in "axy" for i in range(5)], "repo string, sha string, path string, cid string")
    entries = entries.withColumn("cid", counted("cid")).withColumn("content", F.lit(None).cast("binary"))
    heads = [spark.createDataFrame([("r", "main", h)], "repo string, branch string, head string") for h in "xy"]
    got = history.sync_outcomes(commits, heads[1].withColumn("peer", F.lit("p")), heads[0], entries, "t").collect()
    assert [tuple(r) for r in got] == [("r", "p", "conflict", 1, "sync/conflict-p-t")]
    assert len(walks) == 1 and reads.value == 15
