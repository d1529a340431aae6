"""The Merkle manifest against plain Python."""

from __future__ import annotations

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from casdelta.llm import merkle


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, arity):
    """Root and, for each leaf, the siblings by level as (before, after)."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, place in enumerate(at):
            start = place - place % arity
            paths[i].append((level[start:place], level[place + 1 : start + arity]))
            at[i] = place // arity
        level = [H(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


def brute(rows, arity):
    """{row number: (leaf, subroot, root, proof digest)}; rows: doc_id, source, lang, n_chars, text."""
    by = {}
    for i, r in enumerate(rows):
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), i))
    subroots, inner = {}, {}
    for lang, group in by.items():
        group.sort()
        subroots[lang], paths = tree([g[2] for g in group], arity)
        inner |= {g[3]: p for g, p in zip(group, paths, strict=True)}
    order = sorted(subroots, key=lambda x: (x is not None, (x or "").encode()))
    root, tops = tree([subroots[x] for x in order], arity)
    out = {}
    for i, r in enumerate(rows):
        path = inner[i] + tops[order.index(r[2])]
        out[i] = (leaf_of(r), subroots[r[2]], root, H(*(x for before, after in path for x in (*before, *after))))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(n, seed=0):
    rng = random.Random(seed)
    return [(rng.choice((i, i, i, i % 7, None)), rng.choice(("s", None, "é")), rng.choice(("en", "en", "en", "fr", "é", None, "zz", "a")), rng.choice((None, i)), rng.choice((None, "", "texté", "x" * i))) for i in range(n)]


@pytest.mark.parametrize("n, arity", [(1, 2), (2, 2), (61, 2), (200, 3), (130, 16)])
def test_equals_plain_python(spark, n, arity):
    rows = rows_of(n) + [(77, "s", "fr", 1, "same")] * min(n - 1, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    done = merkle.verified(merkle.manifest(df, arity=arity), F.col("leaf"), arity)
    got = sorted((r["leaf"], r["subroot"], r["root"], r["d"]) for r in done.withColumn("d", merkle.proof_digest(F.concat("proof", "tree_proof"))).collect())
    assert got == sorted(brute(rows, arity).values())
    assert done.where("verified and folded_root = root").count() == len(rows)


def test_any_other_leaf_folds_to_another_root(spark):
    rows = rows_of(90, 4)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("other", F.when(F.col("n_chars") % 3 == 0, F.sha2("text", 256)))
    done = merkle.verified(merkle.manifest(df, other=F.col("other")), F.coalesce("other", "leaf"))
    assert {(r["other"] is None, r["verified"]) for r in done.collect()} == {(True, True), (False, False)}


def test_broadcast_and_shuffle_agree(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(150, 9), SCHEMA)
    columns = ["leaf", "subroot", "root", "proof", "tree_proof"]
    one = sorted(map(repr, merkle.manifest(df).select(columns).collect()))
    monkeypatch.setattr(merkle, "FEW_NODES", 0)
    monkeypatch.setattr(merkle, "FEW_PROOFS", 0)
    assert sorted(map(repr, merkle.manifest(df).select(columns).collect())) == one


def test_odd_rows_and_empty_table(odd, none):
    done = merkle.verified(merkle.manifest(odd), F.col("leaf"))
    assert done.count() == odd.count() and done.where("verified").count() == odd.count()
    assert merkle.manifest(none).count() == 0
    assert merkle.verified(merkle.manifest(none), F.col("leaf")).columns[-1] == "verified"


def test_fields_cannot_be_shifted(spark):
    rows = [(1, "a", "b", 2, "c"), (1, "ab", "", 2, "c"), (1, None, "b", 2, "c"), (1, "-", "b", 2, "c")]
    got = spark.createDataFrame(rows, SCHEMA).select(merkle.leaf([F.col(c) for c in merkle.FIELDS])).collect()
    assert [r[0] for r in got] == [leaf_of(r) for r in rows] and len({r[0] for r in got}) == 4
