"""Quality classifier, language model, language identification: held-out accuracy, brute force, odd rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casdelta.llm import langid, lm, quality
from casdelta.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(score, label):
    pos, neg = score[label == 1], np.sort(score[label == 0])
    return (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).mean() / 2 / len(neg)


def test_quality_held_out(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op8_quality"](spark, SF).collect()}
    assert len(rows) == 1000
    held = [(rows[i]["score"], q) for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    assert auc(*map(np.array, zip(*held, strict=True))) > 0.95


def test_rules_compile_to_what_they_mean(spark):
    rng = np.random.default_rng(1)
    names = list(quality.features())
    x = rng.random((400, len(names)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.4)).astype(float)
    model = quality.fit(x, y, names)
    want = model.bias + sum(w * quality.holds(r, x, names) for r, w in model.rules)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    got = np.array([r[0] for r in df.coalesce(1).select(model.score()).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-want))) and auc(got, y) > 0.98
    assert 0 < len(model.rules) < 120


def test_quality_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    assert quality.score(odd, model, ["doc_id"]).count() == odd.count()
    kept = quality.accepted(odd, model, threshold=0.0)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    both = {(str(r["doc_id"]), r["words"], r["quality"]) for r in quality.score(odd, model, ["doc_id", "words"]).collect()}
    passed = {(str(r["doc_id"]), r["words"]) for r in quality.accepted(odd, model).collect()}
    assert passed == {(i, w) for i, w, q in both if q}
    model = quality.train(none, labels)
    assert model.rules == [] and quality.score(none, model, ["doc_id"]).count() == 0


def test_quality_features_against_plain_python(spark):
    texts = ["Hello, World! ok", "", "a|b $$ !! ?\nA line\nA line", "É é ñ 12 12 12."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["_kept"]["doc_id"]: r for r in quality.with_features(df, [F.col("doc_id")]).collect()}
    for i, t in enumerate(texts):
        words, lines, up = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n"), sum(c.isupper() for c in t)
        letters, n = sum(c.isalpha() for c in t), max(1, len(words))
        distinct = len(set(re.split(r"[\x20\x09-\x0D]+", t)))
        want = [len(words), len(t) / n, up / max(1, letters), letters / max(1, len(t)), sum(c in "!*$#%&|" for c in t) / n, t.count("!!") / n, t.count("|") / n, sum(c in ".?" for c in t) / n, distinct / n, len(set(lines)) / max(1, len(lines))]
        assert [got[i][k] for k in quality.features()] == pytest.approx(want)


def test_quality_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i} !!") for i in range(70)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 7, i % 2) for i in range(20)], "doc_id long, quality int")
    rows = quality.score(docs, quality.train(docs, labels), ["doc_id"]).collect()
    assert len(rows) == 70 and all(0 <= r["quality_score"] <= 1 for r in rows)


def test_lm_base_and_gain(spark):
    rows = QUERIES["op3_lm"](spark, SF).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    toks = {i: lm.tokens(t) for i, t in texts.items()}
    count = Counter(w for i in toks if not held[i] for w in toks[i])
    ends = sum(not h for h in held.values())
    n, v = sum(count.values()) + ends, len(count) + 1
    assert len(rows) == len(texts)
    for r in rows:
        i = r["doc_id"]
        c = [count[w] for w in toks[i]] + [ends]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(c), sum(x > 0 for x in c), n)
        assert r["base_score"] == pytest.approx(sum(log10((x + 1) / (n + (v + 1))) for x in c))
    out = [r for r in rows if r["held_out"]]
    total = sum(r["n_tokens"] for r in out)
    assert sum(r["score"] for r in out) / total > sum(r["base_score"] for r in out) / total + 0.2


def tiny_model():
    words = [b"a", b"b.", b"c"]
    sums = np.zeros((lm.SHAPES, 2))
    for w, n in ((b"c", 2), (b"rare", 1)):
        sums[lm.shape(w)] += n, 1
    return lm.Vocabulary(words, np.array([5, 3, 2]), 2, sums, 3, 14, 5, a_class=2).index()


def test_probabilities_sum_to_one():
    vocab = tiny_model()
    net = lm.Network(vocab, 4)
    seen = [b"a", b"b.", b"c", b"rare"]
    assert [lm.shape(w) for w in (b"x", b"x.", "xé".encode(), b"x!")] == [0, 4, 2, 12]
    for w in seen:
        ln, _, _, _, inner, _ = lm.score_texts(net, vocab, [w.decode() + " a"])[0]
        assert np.isfinite(ln + inner)
    h = np.zeros((1, 4), np.float32)
    classes = np.exp(lm.log_softmax(h @ net.c + net.cb))[0]
    assert classes.sum() == pytest.approx(1)
    for k in range(vocab.head_classes):
        rows = slice(k * 2, k * 2 + 2)
        total = np.exp(lm.log_softmax(h @ net.w[rows].T + net.wb[rows])).sum()
        assert total == pytest.approx(1)
    mass = vocab.shapes[0].sum() + 1
    assert sum((n + 1) / mass for n in (2, 1)) + 1 / mass == pytest.approx(1)  # c, rare, and all unseen words of this shape


def test_probabilities_sum_to_one_at_trained_states():
    vocab = tiny_model()
    net = lm.Network(vocab, 8)
    lm.train_on(net, vocab, iter(["a b. c rare a b."] * 400), lanes=4)
    h = np.zeros((1, 8), np.float32)
    for x in (vocab.head + lm.SHAPES, 0, 1, 0):
        h = net.step(net.x[[x]], h)[0]
        rank = np.array([0, 1] + [-1] * (lm.SHAPES + 1))
        kind = np.array([0, 0] + list(range(vocab.head_classes, vocab.classes)))
        p = np.exp(lm.log_probability(net, vocab, np.repeat(h, len(rank), axis=0), kind, rank).astype(float))
        assert p.sum() == pytest.approx(1, abs=1e-5) and p.max() > 0.3


def test_replicas_do_not_depend_on_the_partitioning(spark):
    df = spark.createDataFrame([(i, f"word{i % 9} and more {i % 5}") for i in range(300)], "doc_id long, text string")
    vocab = lm.vocabulary(lm.count_words(df), 300)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append(lm.train(df.repartition(parts), vocab, tokens_a_replica=vocab.total // 4))
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert np.allclose(*got, atol=1e-6)


def test_state_crosses_windows():
    vocab = tiny_model()
    net = lm.Network(vocab, 4)
    text = "a b. c a b. " * 30
    one, two = (lm.score_texts(net, vocab, [text, "a"], window=w) for w in (7, 1000))
    assert one[0][0] == pytest.approx(two[0][0], rel=1e-5) and one[1][0] == pytest.approx(two[1][0], rel=1e-5)


def test_training_lowers_the_loss():
    vocab = tiny_model()
    net = lm.Network(vocab, 8)
    texts = ["a b. a b. a b. a b."] * 200
    before = lm.score_texts(net, vocab, texts[:1])[0][0]
    assert lm.train_on(net, vocab, iter(texts)) == 200 * 9
    assert lm.score_texts(net, vocab, texts[:1])[0][0] > before + 3


def test_every_training_text_is_read(spark):
    df = spark.createDataFrame([(i, f"word{i} and more") for i in range(60)], "doc_id long, text string").repartition(3)
    vocab = lm.vocabulary(lm.count_words(df), 60)
    start = lm.Network(vocab)
    net = lm.Network(vocab, flat=lm.train(df, vocab))
    assert len(vocab.words) == vocab.head == 62
    assert (net.x[: vocab.head] != start.x[: vocab.head]).any(axis=1).all()


def test_head_words(spark):
    df = spark.range(5000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    assert lm.vocabulary(lm.count_words(df), 5000).head == 4096


def test_slopes_match_differences():
    """Backpropagation through time against finite differences, through one update of a plain-rate kind."""
    vocab = tiny_model()
    net = lm.Network(vocab, 3)
    text = "a b. c a"
    grads = {}
    before = net.flat.copy()
    lm.train_on(net, vocab, iter([text]), lanes=1, window=20, rate=1e-6)
    step = (before - net.flat) / 1e-6  # rate * g / sqrt(1e-4 + g^2)
    g = step * 1e-2 / np.sqrt(np.maximum(1e-12, 1 - np.minimum(step**2, 0.9999)))
    flat = before.astype(np.float64)
    for i in np.argsort(-np.abs(step) * (np.abs(step) < 0.7))[:12]:
        values = []
        for d in (1e-2, -1e-2):
            f = flat.copy()
            f[i] += d
            values.append(-lm.score_texts(lm.Network(vocab, 3, f.astype(np.float32)), vocab, [text])[0][0])
        grads[i] = (values[0] - values[1]) / 2e-2
        assert g[i] == pytest.approx(grads[i], rel=0.15, abs=0.02)


def test_lm_odd_rows(odd, none):
    rows = lm.fit_and_score(odd).collect()
    assert len(rows) == odd.count() and all(np.isfinite([r["score"], r["base_score"]]).all() for r in rows)
    assert lm.fit_and_score(none).count() == 0


def test_langid_held_out(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op10_langid"](spark, SF).collect()}
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    assert len(rows) == len(truth)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i]["held_out"] for i in held)
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.97


def test_langid_labels_each_byte_once():
    net = langid.Network.new(["x", "y"])
    texts = [b"a" * 500, b"", b"xyz", b"q" * 120]
    got = langid.label_positions(net, texts, window=1000, margin=8)
    assert got.shape == (4, 2) and (got[1] == 0).all()
    alone = np.concatenate([langid.label_positions(net, [t], window=1000, margin=8) for t in texts])
    assert np.allclose(got, alone, rtol=1e-4)


def test_langid_windows_cover_each_byte_once():
    texts, labels = [f"der die das und {i} " * 40 for i in range(20)] + [f"the of and to {i} " * 40 for i in range(20)], ["de"] * 20 + ["en"] * 20
    net = langid.fit(texts, labels)
    raw = [texts[0].encode(), texts[21].encode(), b"zz"]
    for window in (50, 480, 5000):
        assert langid.label_positions(net, raw, window=window).argmax(axis=1).tolist()[:2] == [0, 1]
    _, owner, start, end = langid.windows(raw, 50, 32)
    assert [int((end - start)[owner == i].sum()) for i in range(3)] == [len(t) for t in raw]


def test_langid_learns_rare_languages(spark):
    rows = [(i, f"the of and to {i}", "en") for i in range(3000)] + [(9000 + i, f"der die das und {i}", "de") for i in range(30)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_a_language=50)
    assert net.langs == ["de", "en"]
    got = langid.predict(spark.createDataFrame([(1, "und die der das"), (2, "and the of")], "doc_id long, text string"), net)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "de", 2: "en"}


def test_langid_odd_rows(spark, odd, none):
    train = spark.createDataFrame([(i, f"der die das und {i}" if i % 2 else f"the of and to {i}", "de" if i % 2 else "en") for i in range(60)], "doc_id long, text string, lang string")
    net = langid.train(train)
    rows = langid.predict(odd, net).collect()
    assert len(rows) == odd.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4, 7)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.predict(none, net).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}


def test_count_words_covers_everything(spark):
    df = spark.createDataFrame([("A a É\x1cx",), (None,), ("b " * 10,)], "text string")
    got = {bytes(r["word"]).decode(): r["n"] for r in lm.count_words(df, held=2).collect()}
    assert got == {"a": 2, "É\x1cx": 1, "b": 10}
    assert df.select(F.count("*")).first()[0] == 3


def test_lm_replicas_share_a_text_that_half_of_the_rows_repeat(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    for rows in (docs, docs.withColumn("doc_id", F.monotonically_increasing_id()), docs.withColumn("doc_id", F.lit(None).cast("long"))):
        each = [r["count"] for r in lm.dealt(rows, 2, 20, 20_000).groupBy("replica").count().collect()]
        assert len(each) == 20 and max(each) < 1.3 * min(each)
    # a row trains in one round, with all rows of its text
    assert lm.dealt(docs, 2, 20, 20_000).groupBy("text").agg(F.countDistinct("_turn").alias("n")).where("n > 1").count() == 0


def test_lm_lanes_that_run_out_change_nothing():
    """Texts of very different lengths train as they would with a lane for each from the start to the end."""
    texts = ["a b c", "", "a " * 300, "b c", "c " * 90, "a b"]
    words = [b"a", b"b", b"c"]
    vocab = lm.Vocabulary(words, np.array([304, 3, 92]), 3, np.zeros((lm.SHAPES, 2)), len(texts), 399 + 6, 4).index()
    flats = []
    for lanes in (6, 64):  # the scale of a step goes by lanes, so the rates differ by as much
        net = lm.Network(vocab)
        assert lm.train_on(net, vocab, iter(texts), lanes, rate=0.05) == sum(len(t.split()) + 1 for t in texts)
        assert np.isfinite(net.flat).all()
        flats.append(sum(r[0] for r in lm.score_texts(net, vocab, texts)))
    untrained = sum(r[0] for r in lm.score_texts(lm.Network(vocab), vocab, texts))
    assert min(flats) > untrained


def test_lm_output_of_a_long_text_is_not_worked_out_window_by_window(monkeypatch):
    vocab, calls, plain = tiny_model(), [], lm.log_probability
    monkeypatch.setattr(lm, "log_probability", lambda *args: calls.append(len(args[3])) or plain(*args))
    lm.score_texts(lm.Network(vocab, 4), vocab, ["a b. c rare " * 1000, "a"])
    assert sum(calls) == 4003 and len(calls) == 1


def test_lm_head_words_go_through_one_product_a_window(monkeypatch):
    """A window's softmaxes are one over classes and one over all classes' words, however many classes it has."""
    words = [b"w%d" % i for i in range(64)]
    vocab = lm.Vocabulary(words, np.full(64, 10), 64, np.ones((lm.SHAPES, 2)), 4, 644, 65, a_class=2).index()
    calls = []
    for name in ("log_softmax", "exps"):
        monkeypatch.setattr(lm, name, lambda a, plain=getattr(lm, name, None): calls.append(1) or plain(a), raising=False)
    lm.train_on(lm.Network(vocab, 4), vocab, iter([" ".join(f"w{i}" for i in range(59))] * 4), lanes=4, window=20)
    assert len(calls) == 3 * 2


@pytest.mark.parametrize("level", [0, -200, 200])
def test_lm_logits_of_any_level_give_the_same_probabilities(level):
    a = np.random.default_rng(5).normal(size=(6, 9)).astype(np.float32)
    at = np.arange(6)
    assert np.allclose(lm.picked(a + np.float32(level), at), lm.log_softmax(a)[at, at], atol=1e-4)
    assert np.allclose(np.divide(*(lambda e, t: (e, t[:, None]))(*lm.exps(a + np.float32(level)))), np.exp(lm.log_softmax(a)), atol=1e-4)


def test_lm_runs_and_blocks_equal_plain_sums():
    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 30, 400) ** 2 // 20)
    rows = rng.normal(size=(400, 3))
    ids, first = np.unique(keys, return_index=True)
    assert np.allclose(lm.run_sums(rows, first), [rows[keys == i].sum(axis=0) for i in ids])
    kinds = rng.integers(0, 9, 200)
    at, slots, cls = lm.blocks(kinds, 6, 16)
    assert sorted(at) == np.flatnonzero(kinds < 6).tolist() and len(set(slots)) == len(at)
    assert (cls[slots // 16] == kinds[at]).all()


def test_quality_draws_about_as_many_as_asked(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    kept, quality_fit = quality.fit, quality.fit
    try:
        quality.fit = lambda x, y, names: seen.append(len(y)) or quality_fit(x[:50], y[:50], names)
        quality.train(docs, labels, max_rows=1000)
        quality.train(docs, labels, max_rows=100_000)
    finally:
        quality.fit = kept
    assert 850 < seen[0] < 1150 and seen[1] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(6000))


def test_more_languages_than_two_hundred(spark, monkeypatch):
    monkeypatch.setattr(langid, "fit", lambda texts, langs: (texts, langs))
    rows = [(i, f"text {i} of some words", f"l{i % 260:03d}") for i in range(5200)] + [(9000 + i, "long " * 20_000, "big") for i in range(100)]
    texts, langs = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(langs) - {"big"}) == 260 and sum(len(t) for t, x in zip(texts, langs, strict=True) if x == "big") < 4_000_000
