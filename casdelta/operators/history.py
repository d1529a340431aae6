"""Commit graphs: ancestry, what to send, and what to do with a peer's head.

A repository's commits are walked once, from the asked heads only, in order of generation: children before parents. Each commit holds
a bitmap of the asked heads that reach it, so one pass over a repository answers all its questions, whatever the depth. Repositories
stream through the tasks one after another; one of more commits than a task should hold is followed by rounds of joins instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from casdelta.functions.rules import INLINE_MAX
from casdelta.operators.conflict import merge3
from casdelta.operators.skew import dealt
from casdelta.staging import staged

#: Commits of a repository that one task walks in memory, and pairs of heads whose bitmaps it holds at once.
MOST_COMMITS, PAIRS_AT_ONCE = 500_000, 256

Pair = tuple[object, object]
#: Columns of answers that are true or false; all others are ids of commits.
FLAGS = {"is_ancestor", "_up", "_down"}


def each_peer(rows: DataFrame, peers: DataFrame, most: int = 100_000) -> DataFrame:
    """rows for each distinct peer: every row goes to every peer, so there are as many as that.

    Up to `most` peers, as counted, are broadcast. More are cut into blocks of that many, each row goes once to each block by an
    equijoin on the block, and meets the block's peers there as one array.
    """
    names = peers.select("peer").distinct()
    if names.limit(most + 1).count() <= most:
        return rows.crossJoin(F.broadcast(names))
    n = -(-names.count() // most) * 16
    blocks = names.groupBy(F.pmod(F.xxhash64("peer"), F.lit(n)).alias("_block")).agg(F.collect_list("peer").alias("_peers"))
    spread = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return spread.join(blocks, "_block").withColumn("peer", F.explode("_peers")).drop("_block", "_peers")


def acked_heads(announces: DataFrame) -> DataFrame:
    """(repo, peer, head): the last head known of each peer."""
    return announces.groupBy("repo", "peer").agg(F.max_by("head", "seq").alias("head"))


def generations(parents: dict[object, list], ends: Iterable) -> list:
    """All that the ends reach, themselves included, every commit before its parents; an error if the history has a cycle."""
    out, state = [], {}
    for end in ends:
        stack = [(end, iter(parents.get(end) or ()))] if end not in state else []
        state.setdefault(end, 1)
        while stack:
            sha, rest = stack[-1]
            for p in rest:
                seen = state.get(p)
                if seen == 1:
                    raise RuntimeError("the history has a cycle")
                if seen is None:
                    state[p] = 1
                    stack.append((p, iter(parents.get(p) or ())))
                    break
            else:
                stack.pop()
                state[sha] = 2
                out.append(sha)
    return out[::-1]


def bitmaps(parents: dict[object, list], ends: list) -> dict[object, int]:
    """Of each commit that an end reaches, the bits of the ends that do, children first."""
    held = {sha: 0 for sha in generations(parents, ends)}
    for i, end in enumerate(ends):
        held[end] |= 1 << i
    for sha, bits in held.items():  # in order, so a commit's bits are complete when its parents get them
        for p in parents.get(sha) or ():
            held[p] |= held[sha]
    return held


def _reached(parents: dict, pairs: list[Pair]) -> Iterator[tuple]:
    ends = list(dict.fromkeys(h for h, _ in pairs))
    for sha, bits in bitmaps(parents, ends).items():
        yield from ((end, sha) for i, end in enumerate(ends) if bits >> i & 1)


def _ancestry(parents: dict, pairs: list[Pair]) -> Iterator[tuple]:
    ends = list(dict.fromkeys(h for h, _ in pairs))
    held, place = bitmaps(parents, ends), {e: i for i, e in enumerate(ends)}
    yield from ((head, base, bool(held.get(base, 0) >> place[head] & 1)) for head, base in pairs)


def _delta(parents: dict, pairs: list[Pair]) -> Iterator[tuple]:
    ends = list(dict.fromkeys(x for pair in pairs for x in pair if x is not None))
    held, place = bitmaps(parents, ends), {e: i for i, e in enumerate(ends)}
    for head, base in pairs:
        if head == base:
            continue
        want, skip = 1 << place[head], 0
        if base is not None and held.get(base, 0) & want:
            skip = 1 << place[base]
        yield from ((head, base, sha) for sha, bits in held.items() if bits & want and not bits & skip)


def _base(parents: dict, held: dict[object, int], both: int) -> object:
    common = [sha for sha, bits in held.items() if bits & both == both]
    # what is below a common ancestor is common too, so only the parents of common ones have to go
    below = {p for sha in common for p in parents.get(sha) or ()}
    return min((sha for sha in common if sha not in below), default=None)


def _bases(parents: dict, pairs: list[Pair]) -> Iterator[tuple]:
    ends = list(dict.fromkeys(x for pair in pairs for x in pair))
    held, place = bitmaps(parents, ends), {e: i for i, e in enumerate(ends)}
    for a, b in pairs:
        if (base := _base(parents, held, 1 << place[a] | 1 << place[b])) is not None:
            yield a, b, base


def _relations(parents: dict, pairs: list[Pair]) -> Iterator[tuple]:
    ends = list(dict.fromkeys(x for pair in pairs for x in pair))
    held, place = bitmaps(parents, ends), {e: i for i, e in enumerate(ends)}
    yield from ((a, b, bool(held[a] >> place[b] & 1), bool(held[b] >> place[a] & 1)) for a, b in pairs)


def _relations_and_bases(parents: dict, pairs: list[Pair]) -> Iterator[tuple]:
    ends = list(dict.fromkeys(x for pair in pairs for x in pair))
    held, place = bitmaps(parents, ends), {e: i for i, e in enumerate(ends)}
    for a, b in pairs:
        up, down = bool(held[a] >> place[b] & 1), bool(held[b] >> place[a] & 1)
        yield a, b, up, down, None if up or down else _base(parents, held, 1 << place[a] | 1 << place[b])


def _walk(commits: DataFrame, pairs: DataFrame, answer: Callable[[dict, list[Pair]], Iterator[tuple]], names: list[str]) -> DataFrame:
    """(repo, *names) of answer() for each repository, from its commits and its pairs (repo, a, b)."""
    sha = commits.schema["sha"].dataType
    kinds = [BooleanType() if n in FLAGS else sha for n in names]
    asked = pairs.select("repo", F.lit(0).alias("kind"), F.col("a").cast(sha).alias("a"), F.col("b").cast(sha).alias("b"), F.lit(None).cast(commits.schema["parents"].dataType).alias("parents")).distinct()
    known = commits.select("repo", F.lit(1).alias("kind"), F.col("sha").alias("a"), F.lit(None).cast(sha).alias("b"), "parents")
    # the pairs of a repository come before its commits; one without pairs is passed over
    rows = dealt(asked.unionByName(known), "repo", ["kind"])
    schema = StructType([StructField("repo", rows.schema["repo"].dataType), *(StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs_, parents, held, types = object(), [], {}, [], None

        def answers() -> Iterator[tuple]:
            for at in range(0, len(pairs_), PAIRS_AT_ONCE):
                yield from ((now, *x) for x in answer(parents, pairs_[at : at + PAIRS_AT_ONCE]))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], ["repo", *names])

        for batch in batches:
            types = [batch.schema.field(0).type, *(pa.bool_() if n in FLAGS else batch.schema.field(2).type for n in names)]
            for repo, kind, a, b, ps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if repo != now:
                    for x in answers():
                        held.append(x)
                        if len(held) >= 50_000:
                            yield out()
                            held = []
                    now, pairs_, parents = repo, [], {}
                if not kind:
                    pairs_.append((a, b))
                elif pairs_:
                    parents[a] = [*(parents[a] or ()), *(ps or ())] if a in parents else ps
        for x in answers():
            held.append(x)
            if len(held) >= 50_000:
                yield out()
                held = []
        if held:
            yield out()

    return rows.mapInArrow(run, schema)


def _by_size(commits: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Commits of repositories of at most `most`, and those of the few larger ones, or None; there are at most commits/most of these."""
    large = commits.groupBy("repo").agg(F.count("*").alias("n")).where(F.col("n") > most).select("repo")
    found = large.collect()
    if not found:
        return commits, None
    large = commits.sparkSession.createDataFrame(found, large.schema)
    return commits.join(F.broadcast(large), "repo", "left_anti"), commits.join(F.broadcast(large), "repo", "left_semi")


def ancestors_by_rounds(commits: DataFrame, heads: DataFrame, rounds: int = 64) -> DataFrame:
    """ancestors() for histories of any size, by joins: rounds double the reach, so a million steps take twenty."""
    asked = heads.select("repo", "head").distinct()
    steps = commits.join(asked.select("repo").distinct(), "repo", "left_semi")
    steps = staged(steps.select("repo", F.col("sha").alias("child"), F.explode("parents").alias("parent")).distinct(), "history-steps")
    seen = staged(asked.withColumn("sha", F.col("head")), "history-seen")
    for _ in range(rounds):
        if steps.isEmpty():
            return seen
        further = seen.withColumnRenamed("sha", "child").join(steps, ["repo", "child"]).select("repo", "head", F.col("parent").alias("sha"))
        seen = staged(seen.union(further).distinct(), "history-seen")
        next_ = steps.select("repo", "child", F.col("parent").alias("mid")).join(steps.select("repo", F.col("child").alias("mid"), "parent"), ["repo", "mid"])
        steps = staged(next_.select("repo", "child", "parent").distinct(), "history-steps")
    raise RuntimeError("the history is deeper than the rounds allow: it has a cycle")


def ancestors(commits: DataFrame, heads: DataFrame, most: int = MOST_COMMITS) -> DataFrame:
    """(repo, head, sha): all commits reachable from each head (heads: repo, head), itself included."""
    small, large = _by_size(commits, most)
    out = _walk(small, heads.select("repo", F.col("head").alias("a"), F.col("head").alias("b")), _reached, ["head", "sha"])
    if large is None:
        return out
    here = large.select("repo").distinct()
    return _split(out, ancestors_by_rounds(large, heads.join(here, "repo", "left_semi")), here)


def _split(walked: DataFrame, by_rounds: DataFrame, large: DataFrame) -> DataFrame:
    """The answers by walk, except for the large repositories, whose answers come by rounds."""
    return walked.join(large, "repo", "left_anti").unionByName(by_rounds)


def is_ancestor(commits: DataFrame, pairs: DataFrame, most: int = MOST_COMMITS) -> DataFrame:
    """(repo, base, head, is_ancestor) of the distinct pairs (repo, base, head)."""
    small, large = _by_size(commits, most)
    out = _walk(small, pairs.select("repo", F.col("head").alias("a"), F.col("base").alias("b")), _ancestry, ["head", "base", "is_ancestor"]).select("repo", "base", "head", "is_ancestor")
    if large is None:
        return out
    here = large.select("repo").distinct()
    few_pairs = pairs.select("repo", "base", "head").distinct().join(here, "repo", "left_semi")
    reach = ancestors_by_rounds(large, few_pairs).select("repo", "head", F.col("sha").alias("base"), F.lit(True).alias("_hit"))
    return _split(out, few_pairs.join(reach, ["repo", "head", "base"], "left").select("repo", "base", "head", F.coalesce("_hit", F.lit(False)).alias("is_ancestor")), here)


def delta_commits(commits: DataFrame, pairs: DataFrame, most: int = MOST_COMMITS) -> DataFrame:
    """(repo, base, head, sha): commits of head that base lacks; all, if base is null or no ancestor of head; none if they are equal."""
    small, large = _by_size(commits, most)
    out = _walk(small, pairs.select("repo", F.col("head").alias("a"), F.col("base").alias("b")), _delta, ["head", "base", "sha"]).select("repo", "base", "head", "sha")
    if large is None:
        return out
    here = large.select("repo").distinct()
    asked = pairs.where("base is null or base <> head").select("repo", "base", "head").distinct().join(here, "repo", "left_semi")
    known = asked.where("base is not null")
    reach = ancestors_by_rounds(large, asked.select("repo", "head").union(known.select("repo", "base")))
    anc = known.join(reach.select("repo", "head", F.col("sha").alias("base")), ["repo", "head", "base"], "left_semi")
    of_head = asked.join(reach, ["repo", "head"]).select("repo", "base", "head", "sha")
    of_base = anc.join(reach.select("repo", F.col("head").alias("base"), "sha"), ["repo", "base"]).select("repo", "base", "head", "sha").withColumn("_known", F.lit(True))
    key = F.struct("repo", "base", "head", "sha")
    lacks = of_head.withColumn("_key", key).join(of_base.select(key.alias("_key")), "_key", "left_anti").drop("_key")
    return _split(out, lacks, here)


def _related(commits: DataFrame, pairs: DataFrame, bases: bool, most: int = MOST_COMMITS) -> DataFrame:
    """(repo, _head, head, _up, _down) of the distinct pairs (repo, _head, head): whether head descends from _head, and _head from head.

    With bases also _base, as merge_bases() has it, of pairs of which neither descends from the other. All by one walk.
    """
    small, large = _by_size(commits, most)
    names, answer = (["_head", "head", "_up", "_down", "_base"], _relations_and_bases) if bases else (["_head", "head", "_up", "_down"], _relations)
    out = _walk(small, pairs.select("repo", F.col("_head").alias("a"), F.col("head").alias("b")), answer, names)
    if large is None:
        return out
    here = large.select("repo").distinct()
    few_pairs = pairs.select("repo", "_head", "head").distinct().join(here, "repo", "left_semi")
    reach = ancestors_by_rounds(large, few_pairs.select("repo", "head").union(few_pairs.select("repo", "_head")))
    up = reach.select("repo", "head", F.col("sha").alias("_head"), F.lit(True).alias("_up"))
    down = reach.select("repo", F.col("head").alias("_head"), F.col("sha").alias("head"), F.lit(True).alias("_down"))
    rounds = few_pairs.join(up, ["repo", "_head", "head"], "left").join(down, ["repo", "_head", "head"], "left").na.fill(False, ["_up", "_down"])
    if bases:
        apart = rounds.where("not _up and not _down").select("repo", "_head", "head")
        rounds = rounds.join(_bases_by_rounds(large, apart, reach).withColumnRenamed("base", "_base"), ["repo", "_head", "head"], "left")
    return _split(out, rounds, here)


def _meetings(commits: DataFrame, incoming: DataFrame, local: DataFrame, bases: bool = False) -> DataFrame:
    """Incoming heads with the local one (_head) and the action for each; with bases also their merge base (_base)."""
    mine = local.select("repo", F.col("branch").alias("_branch"), F.col("head").alias("_head"))
    both = incoming.join(mine, "repo", "left")
    pairs = both.where("_head is not null and _head <> head and _branch = branch").select("repo", "_head", "head").distinct()
    out = both.join(staged(_related(commits, pairs, bases), "history-met"), ["repo", "_head", "head"], "left")
    action = (
        F.when(F.col("_head").isNull(), "adopt")
        .when(F.col("_head") == F.col("head"), "noop")
        .when(F.col("_branch") != F.col("branch"), "skip")
        .when(F.col("_up"), "ff")
        .when(F.col("_down"), "ahead")
        .otherwise("merge")
    )
    return out.withColumn("action", action)


def sync_actions(commits: DataFrame, incoming: DataFrame, local: DataFrame) -> DataFrame:
    """(repo, peer, action) of incoming (repo, branch, head, peer) against local (repo, branch, head).

    adopt: no local head; noop: same; skip: another branch; ff: the local head is an ancestor of the incoming one; ahead: the other
    way round; else merge.
    """
    return _meetings(commits, incoming, local).select("repo", "peer", "action")


def _bases_by_rounds(large: DataFrame, pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """merge_bases() of pairs in large repositories; reach: ancestors() of their heads."""
    common = pairs.join(reach, ["repo", "head"]).join(reach.withColumnRenamed("head", "_head"), ["repo", "_head", "sha"]).select("repo", "_head", "head", "sha")
    below = common.join(large.select("repo", "sha", F.explode("parents").alias("_parent")), ["repo", "sha"])
    best = common.join(below.select("repo", "_head", "head", F.col("_parent").alias("sha")), ["repo", "_head", "head", "sha"], "left_anti")
    return best.groupBy("repo", "_head", "head").agg(F.min("sha").alias("base"))


def merge_bases(commits: DataFrame, pairs: DataFrame, most: int = MOST_COMMITS) -> DataFrame:
    """(repo, _head, head, base): the common ancestor of two heads that no other common ancestor descends from.

    Of several such the least id is taken; pairs (repo, _head, head) without one are left out.
    """
    small, large = _by_size(commits, most)
    out = _walk(small, pairs.select("repo", F.col("_head").alias("a"), F.col("head").alias("b")), _bases, ["_head", "head", "base"])
    if large is None:
        return out
    here = large.select("repo").distinct()
    few_pairs = pairs.join(here, "repo", "left_semi")
    reach = ancestors_by_rounds(large, few_pairs.select("repo", "head").union(few_pairs.select("repo", "_head")))
    return _split(out, _bases_by_rounds(large, few_pairs, reach), here)


def sync_outcomes(commits: DataFrame, incoming: DataFrame, local: DataFrame, entries: DataFrame, stamp: str, branch: str = "sync/conflict") -> DataFrame:
    """(repo, peer, action, n_clashes, kept) as sync_actions(), with conflict told from merge by the files of both heads.

    entries: repo, sha, path, cid and content (bytes, or null where it is not at hand) of the commits' whole trees. A path clashes
    if both sides changed it since their merge base, each in its own way, and its lines don't merge; without a base it clashes if
    both have it and differ. A deletion against an edit clashes. kept names the branch that keeps the incoming head of a conflict.
    """
    met = staged(_meetings(commits, incoming, local, bases=True), "history-outcomes")
    key, sides = ["repo", "_head", "head", "path"], {"local": "_head", "incoming": "head", "base": "_base"}
    apart = met.where("action = 'merge'").select("repo", *sides.values()).distinct()
    asked = apart.select("repo", "_head", "head", F.inline(F.array(*(F.struct(F.lit(k).alias("_side"), F.col(c).alias("sha")) for k, c in sides.items())))).where("sha is not null")
    # the trees of all three commits come by one join; only their ids are compared, and contents follow for what both sides edited
    trees = asked.join(entries.where("path is not null").select("repo", "sha", "path", "cid", "content"), ["repo", "sha"])
    trees = staged(trees.select(*key, "_side", "cid", "content"), "history-trees")
    x, y, b = (F.max(F.when(F.col("_side") == k, F.col("cid"))).alias(f"_{k}_cid") for k in sides)
    of = lambda k: F.col(f"_{k}_cid")
    differ = ~of("local").eqNullSafe(of("incoming")) & ~of("local").eqNullSafe(of("base")) & ~of("incoming").eqNullSafe(of("base"))
    both = staged(trees.groupBy(*key).agg(x, y, b).where(differ).select(*key), "history-edited")
    texts = trees.where("content is not null").join(both, key, "left_semi")
    texts = texts.groupBy(*key).agg(*(F.first(F.when(F.col("_side") == k, F.col("content")), ignorenulls=True).alias(k) for k in sides))
    edited = both.join(texts, key, "left")
    clashes = merge3(edited).where("status <> 'clean'").groupBy("repo", "_head", "head").agg(F.count("*").alias("n_clashes"))
    out = met.join(clashes, ["repo", "_head", "head"], "left").withColumn("n_clashes", F.coalesce("n_clashes", F.lit(0)).cast("long"))
    lost = F.col("n_clashes") > 0
    name = F.concat(F.lit(f"{branch}-"), F.col("peer"), F.lit(f"-{stamp}"))
    return out.select("repo", "peer", F.when(lost, "conflict").otherwise(F.col("action")).alias("action"), "n_clashes", F.when(lost, name).alias("kept"))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Snapshots (repo, host, seq, tree) whose tree differs from the one before; the first always counts."""
    order = Window.partitionBy("repo", "host").orderBy("seq")
    return snapshots.withColumn("_before", F.lag("tree").over(order)).where(~F.col("tree").eqNullSafe(F.col("_before"))).drop("_before")


def pending_snapshots(snapshots: DataFrame, peers: DataFrame, sent: DataFrame, most: int = INLINE_MAX) -> DataFrame:
    """(peer, repo, snap) to send: not sent yet, not empty, within the cap. snapshots: repo, snap, bytes (length).

    peers: see each_peer().
    """
    fit = snapshots.where((F.col("bytes") > 0) & (F.col("bytes") <= most)).select("repo", "snap")
    return each_peer(fit, peers).join(sent.select("peer", "repo", "snap"), ["peer", "repo", "snap"], "left_anti").select("peer", "repo", "snap")


def mirror_decisions(rows: DataFrame) -> DataFrame:
    """(repo, decision) of rows (repo, incoming_tree, tree, applied_tree, dirty): record, overwrite or keep."""
    same = F.col("incoming_tree") == F.col("tree")
    free = ~F.col("dirty") | F.col("tree").eqNullSafe(F.col("applied_tree"))
    return rows.select("repo", F.when(same, "record").when(free, "overwrite").otherwise("keep").alias("decision"))
