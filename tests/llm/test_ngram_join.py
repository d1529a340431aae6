from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from casdelta.llm import ngram_join
from casdelta.llm.graph import components


def grams(text):
    w = (text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    near = [[i != j and bool(a) and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i]] + [label[j] for j in range(len(rows)) if near[i][j]]) for i in range(len(rows))]
    return {i: (rows[label[n]][0], sum(near[n])) for n, (i, _) in enumerate(rows)}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)]
    rows, k = [], 0
    for _ in range(12):
        text = list(rng.choice(words, 120))
        for _ in range(8):
            rows.append((k, " ".join(text)))
            k += 1
            if rng.random() < 0.7:
                text[int(rng.integers(0, 120))] = f"new{k}"
    rows += [(k, "one two three"), (k + 1, "one  two\nthree"), (k + 2, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(df, block=4).collect()}
    want = brute(rows)
    # recall at exactly 0.8 is 0.9994 a pair, and components are compared whole, so none is missed here
    assert got == want


def test_pairs_at_exactly_the_threshold(spark):
    for m in range(1, 101):  # 4m of 5m n-grams, and one n-gram less
        whole = np.arange(1, 5 * m + 1, dtype=np.uint64)
        assert ngram_join.links_of([whole, whole[: 4 * m]], 0.8)[0, 1]
        assert not ngram_join.links_of([whole, whole[: 4 * m - 1]], 0.8)[0, 1]
    rows = []
    for m in range(3, 40):
        words = [f"g{m}w{i}" for i in range(5 * m + 4)]
        rows += [(10 * m, " ".join(words)), (10 * m + 1, " ".join(words[: 4 * m + 4])), (10 * m + 2, " ".join(words[: 4 * m + 3]))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), bands=400, rows=2).collect()}
    assert got == brute(rows)


def test_large_group_of_copies_and_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, base) for i in range(300)] + [(300 + i, base + f" tail{i}") for i in range(300)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), block=64)
    seen = got.groupBy("class_id").agg(F.count("*").alias("n"), F.min("n_links").alias("l"), F.max("n_links").alias("h")).collect()
    assert [tuple(r) for r in seen] == [(0, 600, 599, 599)]
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_recall_of_the_bands():
    assert 1 - (1 - 0.8**8) ** 40 > 0.999
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(200):
        both = rng.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, 10).astype(np.uint64)]) for _ in "ab")
        hits += bool(set(ngram_join.band_hashes(a, 40, 8).tolist()) & set(ngram_join.band_hashes(b, 40, 8).tolist()))
    assert hits >= 199


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long").repartition(4)).collect()}
    assert got == dict.fromkeys(range(61), 0) | {100: 100, 101: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none):
    got = ngram_join.join(odd)
    assert got.count() == odd.count()
    by = {(r["doc_id"], r["n_links"], r["class_id"]) for r in got.collect()}
    assert {(1, 2, 1), (6, 2, 1), (2, 0, 2), (3, 0, 2), (4, 0, 4), (5, 0, 5)} <= by
    kept = ngram_join.representatives(odd)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "7", "8", "None"]
    assert kept.columns == odd.columns
    assert set(map(str, kept.collect())) <= set(map(str, odd.collect()))
    assert ngram_join.join(none).count() == 0 and ngram_join.representatives(none).count() == 0


@pytest.mark.parametrize("text, n", [("", 0), ("a", 1), ("a b c d", 1), ("a b c d e", 1), ("a b c d e f", 2), ("x " * 5000, 4996)])
def test_ngrams(text, n):
    assert len(ngram_join.ngrams(text)) == n
    assert (ngram_join.ngrams(text) == ngram_join.ngrams("  " + text.replace(" ", "\t\n"))).all()


def test_one_id_on_different_texts_and_near_copies_without_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(5, a, 1), (5, b, 2), (5, b, 3), (9, a + " more", 4), (None, c, 5), (None, c + " end", 6), (None, c, 7), (7, b + " tail", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_Text_Key` int")
    for most in (500_000, 0):
        kept = ngram_join.representatives(df, broadcast_rows=most)
        got = sorted((str(r["doc_id"]), r["text"]) for r in kept.collect())
        assert len(got) == 3 and got[0] == ("5", a) and got[1] == ("5", b) and got[2][0] == "None" and kept.columns == df.columns


def test_blocks_of_bounded_bytes(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base + [f"t{i}"])) for i in range(40)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=5000).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 39)}
