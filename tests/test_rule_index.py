"""Many rules by index: the same as the rules one after another."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from casdelta.functions import rules

PIECES = ["a", "b", "ab", "src", "*", "?", "**", ".md", ".txt", "x*", "*~", "a**b", ".#*", "*.tar.gz", "**c", "c**"]


def some(rng, n, pieces, sep):
    return {sep.join("".join(rng.choices(pieces, k=rng.choice((1, 1, 2)))) for _ in range(rng.randint(1, 3))) for _ in range(n)}


def test_index_equals_the_rules_in_turn(spark):
    rng = random.Random(3)
    lines = [rng.choice(("", "!")) + rng.choice(("", "", "/")) + p + rng.choice(("", "", "/")) for p in sorted(some(rng, 150, PIECES, "/"))]
    rng.shuffle(lines)
    known = rules.read_rules("\n".join(lines), builtin=False)
    names = sorted(some(rng, 400, ["a", "b", "ab", "src", "x", "c", ".md", ".txt", "~", ".#", ".tar.gz", "é"], "/"))
    paths = spark.createDataFrame([(n, i % 2) for i, n in enumerate([*names, *names[:50], None, ""])], "rel_path string, keep int")
    table = rules.parsed_rules(spark.createDataFrame(list(enumerate(lines)), "rule_idx int, line string"))
    got = sorted(map(tuple, rules.ignored_by_index(paths, table).collect()), key=repr)
    want = sorted(map(tuple, paths.withColumn("ignored", F.coalesce(rules.is_ignored(F.col("rel_path"), known), F.lit(False))).collect()), key=repr)
    assert got == want and 0 < sum(r[2] for r in want) < len(want)


@pytest.mark.parametrize("pattern, anchored, kind", [("src3/en/*.md", True, "prefix"), ("**/fr/*.txt", True, "segment"), ("*.png", False, "ext"), ("*~", False, "tail1"), (".#*", False, "head2"), ("x**/fr", True, "tail2"), ("a/**/b", True, "prefix"), ("**", True, "any"), ("x**/fr/y", True, "segment")])
def test_keys(pattern, anchored, kind):
    assert kind in [k for k, _ in rules.rule_keys(pattern, anchored)]


def test_ten_thousand_rules_without_a_nested_loop(spark):
    n = 10_000
    table = spark.range(n).select(F.col("id").cast("int").alias("rule_idx"), F.concat(F.lit("dir/"), F.col("id").cast("string"), F.lit("/*.md")).alias("pattern"), F.lit(False).alias("negated"), F.lit(True).alias("anchored"), F.lit(False).alias("dir_only"))
    paths = spark.range(2 * n).select(F.concat(F.lit("dir/"), F.col("id").cast("string"), F.lit("/x.md")).alias("rel_path"))
    out = rules.ignored_by_index(paths, table)
    assert out.where("ignored").count() == n
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|CartesianProduct", plan)


def test_no_rules(spark):
    paths = spark.createDataFrame([("a",), ("a",)], "rel_path string")
    table = rules.parsed_rules(spark.createDataFrame([], "rule_idx int, line string"))
    assert [r["ignored"] for r in rules.ignored_by_index(paths, table).collect()] == [False, False]
