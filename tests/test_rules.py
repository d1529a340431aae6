from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from casdelta.functions import ids, rules


def slow_match(pattern: str, path: str) -> bool:
    """Segments by segments: ** stands for any number of whole ones, at the end for anything at all."""
    head, two, tail = pattern.partition("**")
    if not two:
        return re.fullmatch("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in pattern), path) is not None
    tail = tail.removeprefix("/")
    for i in range(len(path) + 1):
        if slow_match(head, path[:i]):
            if not tail:
                return True
            if any(slow_match(tail, path[j:]) for j in range(i, len(path) + 1) if j == i or path[j - 1] == "/"):
                return True
    return False


def test_globs_against_a_slow_matcher():
    rng = random.Random(5)
    for _ in range(4000):
        pattern = "".join(rng.choice(["a", "b", "/", "*", "?", "**", "**/", "."]) for _ in range(rng.randint(1, 5)))
        path = "".join(rng.choice("ab/.") for _ in range(rng.randint(1, 6)))
        assert bool(re.fullmatch(rules.glob_regex(pattern), path)) == slow_match(pattern, path), (pattern, path)


@pytest.mark.parametrize(
    "text, path, want",
    [
        ("*.log", "deep/x.log", True),
        ("*.log\n!keep.log", "keep.log", False),
        ("/build", "build", True),
        ("/build", "build/x", False),
        ("/build", "a/build", False),
        ("out/", "out/x", True),
        ("out/", "out", False),
        ("#c\nx ", "x", True),
        ("src/**", "src", False),
        ("src/**", "src/a/b", True),
        ("a**b", "ab", True),
        ("a**b", "ax/b", True),
        ("", ".git/config", True),
        ("", "a/.#lock", True),
        ("", "main.rs", False),
        ("!*.tmp", "x.tmp", False),
    ],
)
def test_rules(spark, text, path, want):
    got = spark.range(1).select(rules.is_ignored(F.lit(path), rules.read_rules(text))).first()[0]
    assert got is want


def test_paths(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert [one(rules.prefix_admits(lit(p), lit(q))) for p, q in (("", "x"), ("a", "a"), ("a/", "a/b"), ("a", "ab"))] == [True, True, True, False]
    assert [one(rules.is_unsafe_path(lit(p))) for p in ("/x", "a\\b", "C:x", "a/b")] == [True, True, True, False]
    assert one(rules.target_fault(lit("a..b"))) == "dotdot"
    assert one(rules.target_fault(lit("b/c"), lit("a"))) == "outside"
    assert [one(rules.program_fault(F.array(lit("/bin/ls")), a)) for a in (["ls"], ["cat"], [])] == [None, "not_allowed", "nothing_allowed"]
    assert one(ids.remote_root_of(lit("~/~/proj/"))) == "proj"
    assert one(ids.strip_remote_root(lit("proj"), lit("project/x"))) is None
    assert one(ids.strip_remote_root(lit("proj"), lit("proj/x"))) == "x"
    assert one(ids.rel_of(lit("/r/"), lit("/r/a\\b"))) == "a/b"
    assert len(one(ids.session_id(lit("/a"), lit("n"), lit("p")))) == 16
    assert one(ids.action_for(lit("run/start"))) == "spawn"
    assert one(ids.clip(lit("é" * 10).cast("binary"), 5, "~")) == "éé~"
    assert one(ids.policy_of(lit("CRDT"))) == "crdt" and one(ids.policy_of(lit("?"))) == "lww"
