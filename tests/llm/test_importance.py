"""Importance resampling against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from casdelta.llm import importance
from casdelta.llm.common import numbered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, target, n, buckets, percent, least):
    runs = lambda t: [" ".join(w[i : i + k]) for w in (words(t),) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, d in docs for f in runs(d)), Counter(bucket(f) for d in target for f in runs(d))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, d in docs:
        f = runs(d)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(d)) >= least, None])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[5] = k
    return sorted(((*r[:4], r[5]) for r in rows), key=repr)


def test_composition_equals_the_crc_of_the_run():
    rng = random.Random(1)
    for _ in range(200):
        ws = ["".join(rng.choices("abé0", k=rng.randint(1, 40))).encode() for _ in range(rng.randint(1, 6))]
        crc, length = np.array([zlib.crc32(w) for w in ws], np.uint32), np.array([len(w) for w in ws])
        for k, got in enumerate(importance.run_crcs(crc, length, 4), 1):
            assert got.tolist() == [zlib.crc32(b" ".join(ws[i : i + k])) for i in range(len(ws) - k + 1)]


def test_scan_emits_the_words_in_order():
    text = importance.folded("The CAT, the\x00cat-sat ÄB é9  x")
    automaton, crc, length = importance.dictionary([text, b"other words"])
    ids = [i for _, i in automaton.iter(f" {text.decode('latin-1')} ")]
    want = [w.encode() for w in words("The CAT, the\x00cat-sat ÄB é9  x")]
    assert [crc[i] for i in ids] == [zlib.crc32(w) for w in want] and [length[i] for i in ids] == [len(w) for w in want]


@pytest.mark.parametrize("n, buckets, least", [(1, 10_000, 3), (2, 97, 20), (3, 1000, 1)])
def test_equals_plain_python(spark, n, buckets, least):
    rng = random.Random(n)
    text = lambda: " ".join(rng.choices(["the", "cat", "Sat", "on", "x-y", "é", "42", "mat!"], k=rng.choice((0, 2, 5, 40))))
    docs = [(i, text()) for i in range(150)] + [(5, "the cat " * 30)] * 4 + [(None, "the mat on the mat " * 9)] * 9 + [(900, None), (901, ""), (902, ", . !"), (903, "on the mat " * 30_000)]
    target = ["the mat on the mat", "cat 42", None, ""] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, goal, n, buckets, 30, least).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, target, n, buckets, 30, least)


def test_odd_rows_and_empty_tables(spark, odd, none):
    goal = spark.createDataFrame([("the of",)], "text string")
    got = importance.resample(odd, goal, least_words=1, percent=100)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and got.count() == odd.count()
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 8))
    assert {r["weight"] for r in got.where("n_features = 0").collect()} == {0}
    assert importance.resample(none, goal).count() == 0
    assert {r["rank"] for r in importance.resample(odd, goal.limit(0)).collect()} == {None}


def test_numbering_of_hot_groups(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), (F.col("id") * 7919 % 5_000).alias("v"))
    got = numbered(rows, [F.col("v")], "at", "g").collect()
    by: dict[str, list] = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["at"], r["v"]))
    assert {k: len(v) for k, v in by.items()} == {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}
    for group in by.values():
        group.sort()
        assert [a for a, _ in group] == list(range(len(group))) and [v for _, v in group] == sorted(v for _, v in group)
    assert sorted(r["at"] for r in numbered(rows.select("v"), [F.col("v").desc()], "at").collect()) == list(range(30_000))
