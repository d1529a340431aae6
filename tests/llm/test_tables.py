"""Mixing, nearest neighbours, licenses, media and the pipeline."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from casdelta.llm import ann, licenses, media, mixing, quality
from casdelta.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = sorted(repr(tuple(r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    same_as_sql(spark, name)


def fill(sizes, share=1.5, most=2.0):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        each = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if each[s] > most * sizes[s]}
        if not above:
            return out | each
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def test_mix(spark):
    rows = [(i, "w " * (i % 17), [None, "b", "a", "é", "c"][i % 5 if i % 3 else 1]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, rows_a_range=20).collect()
    assert {tuple(r) for r in mixing.mix(df.repartition(7), rows_a_range=20).collect()} == {tuple(r) for r in got}
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = fill(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)


def test_better_documents_come_first(spark):
    rows = [(i, ("good words here " if i % 2 else "bad!!!! words!!!! ") * 4, s) for s, n in (("a", 400), ("b", 4000), ("c", 100)) for i in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    good = {k for k, t, s in rows if s == "b" and t.startswith("good")}
    b = {k for k, _, s in rows if s == "b"}
    part = {r["doc_id"]: r["taken"] / r["size"] % 1 or float(r["taken"] >= r["size"]) for r in got.collect() if r["doc_id"] in b}
    assert sum(part[k] for k in good) >= sum(part[k] for k in b - good)


def test_weights_of_the_caller(spark):
    rows = [(i, "good words here " if i % 3 else "bad!!!! words!!!!", "s") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = {r["doc_id"] for r in mixing.mix(df, share=0.3, rows_a_range=200, weight=F.when(F.col("doc_id") < 1000, 50.0).otherwise(1.0)).where("taken > 0").collect()}
    assert sum(i < 1000 for i in first) > 800


def test_mix_odd_rows(odd, none):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(none).count() == 0
    assert mixing.repeated(odd).columns == odd.columns
    plan = {}
    for r in mixing.mix(odd).collect():
        taken, rows = plan.get((r["doc_id"], r["size"]), (0, 0))
        plan[r["doc_id"], r["size"]] = (taken + r["taken"], rows + 1)
    want = []
    for r in odd.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        taken, rows = plan[r["doc_id"], n]
        want += [str(r)] * (int(taken / (n * rows) + 0.5) if n else 0)
    assert sorted(map(str, mixing.repeated(odd).collect())) == sorted(want)
    assert sorted(map(str, mixing.repeated(odd, broadcast_rows=0).collect())) == sorted(want)
    assert mixing.repeated(none).count() == 0


def brute(rows, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for n, q in enumerate(ids):
        if q % 20 == 0:
            s = x @ x[n]
            s[n] = -np.inf
            out[int(q)] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:k] if s[j] > -np.inf]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=16)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(300)]  # a very common vector
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] + [0.0] * 15), (2080, [None] * 16), (2100, [1.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann.search(df, books=8, words=32, most=120, pack=128, queries_a_block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute(rows)
    assert got.pop(2100, []) == []  # the only vector of its length finds none
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    assert all(dict(want_all)[v] == pytest.approx(s, abs=1e-12) for q, want_all in brute(rows, 2000).items() for v, s in got[q])
    assert got[720] == want[720]  # ties go to the smaller ids


def test_repeated_ids_and_other_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 40, [float(np.float32(v)) for v in rng.normal(size=4 if i % 3 else 6)]) for i in range(90)]
    rows += [rows[0], rows[0], rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(df).collect())
    want = []
    for n, (q, v) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-float(np.dot(v, w)), i) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v))[:20]
            want += [(q, k + 1, i, round(-s, 9)) for k, (s, i) in enumerate(near)]
    assert got == sorted(want)


def test_shortlist_grows_with_the_table(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=16)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2).where("vec_id % 20 <> 0 or vec_id < 1000")
    got = {}
    for r in ann.search(df, books=2, words=16, most=64, pack=128).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute([r for r in rows if r[0] % 20 or r[0] < 1000])
    assert got.keys() == want.keys()
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) >= 0.8 * 20 * len(want)


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(3)
    v = np.unique((rng.random((3000, 12)) < 0.5).astype(float), axis=0)
    v = v[v.any(axis=1)][:1500]
    ids = rng.permutation(len(v))
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>").repartition(7)
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    place = np.argsort(ids)
    hits = total = 0
    for q, found in got.items():
        score = v[place] @ v[place[q]]
        want = [i for i in np.lexsort((np.arange(len(v)), -score)) if i != q][:20]
        assert [s for _, s in found] == [score[i] for i in want]
        hits, total = hits + len({i for i, _ in found} & set(want)), total + 20
    assert len(got) == 75 and hits / total > 0.99


def test_few_and_no_vectors(spark):
    s = "vec_id long, embedding array<float>, embedding_norm double"
    got = ann.search(spark.createDataFrame([(0, [1.0, 0.0], 1.0), (7, [0.5, 0.5], 1.0), (20, [0.0, 2.0], 1.0)], s)).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 7, 0.5), (0, 2, 20, 0.0), (20, 1, 7, 1.0), (20, 2, 0, 0.0)]
    assert ann.search(spark.createDataFrame([], s)).count() == 0
    assert ann.search(spark.createDataFrame([(20, [1.0], 0.0)], s)).count() == 0


def test_licenses(spark, odd, none):
    filler = "some other words that stand around here and there "
    mit = licenses.TEMPLATES["MIT-notice"]
    edited = mit.replace("merge, publish", "blend, publish")
    rows = [(1, filler * 30 + mit + filler), (2, filler + edited), (3, mit[: len(mit) // 2]), (4, "(Released under\nthe MIT LICENSE!)"), (5, filler * 50), (6, licenses.TEMPLATES["GPL-3.0"] + " " + licenses.TEMPLATES["MIT"]), (7, "license license license")]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT-notice"), (2, "MIT-notice"), (4, "MIT"), (6, "GPL-3.0"), (6, "MIT")}
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    assert licenses.scan(odd, {}).count() == 0


def test_pivots_are_sound():
    for text in licenses.TEMPLATES.values():
        w = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
        grams = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
        least = -(-4 * len(grams) // 5)
        words = licenses.pivots(grams, least)
        assert sum(words.isdisjoint(g.split()) for g in grams) < least


def test_media_round_trip(spark, odd, none):
    rows = QUERIES["op9_media"](spark, SF).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_bytes"] > len(payload)
    assert {r["feature"].split("|")[0] for r in rows} == set(media.FORMATS)
    got = media.sniff(media.store(odd)).collect()
    assert len(got) == odd.count() and all(len(r["payload"]) % 192 == 0 and r["payload"] for r in got)
    assert media.sniff(media.store(none)).count() == 0


def png(data=b"x"):
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(data)) + part(b"IEND", b"")


def test_media_of_huge_texts(spark, monkeypatch):
    monkeypatch.setattr(media, "SLICE_BYTES", 1 << 20)
    texts = ["x" * 3_000_000, "é" * 1_000_000, None, "small", "y" * 500_000, "z" * 600_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in media.sniff(media.store(df), keep=("doc_id", "n_bytes")).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["n_bytes"] == len(raw) and bytes(r["payload"]) == raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")


def test_sniffing_and_carving(spark):
    wav, gif = media.pack(b"a" * 192, "wav"), b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    assert [m[0] for m in media.sniff_bytes(wav + b"junk" + png() + b"BM" + gif)] == ["wav", "png", "gif"]
    assert media.sniff_bytes(wav[:100]) == [] and media.sniff_bytes(b"BM P5 GIF89a RIFFxxxxWAVEfmt .snd") == []
    assert media.sniff_bytes(png()[:-5]) == []
    for kind in media.FORMATS:
        k, start, end, at, n = media.sniff_bytes(media.pack(bytes(range(192)) * 3, kind))[0]
        assert (k, start, end) == (kind, 0, len(media.pack(bytes(range(192)) * 3, kind)))
        assert media.pack(bytes(range(192)) * 3, kind)[at : at + n] == bytes(range(192)) * 3
    df = spark.createDataFrame([(1, wav, "png"), (2, b"", None), (3, None, "wav"), (4, b"x" + png(), "wav")], "doc_id long, media binary, declared string")
    got = {r["doc_id"]: (r["type"], r["corrected"], len(r["carved"])) for r in media.sniff(df).collect()}
    assert got == {1: ("wav", True, 0), 2: ("unknown", True, 0), 3: ("unknown", True, 0), 4: ("unknown", True, 1)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == corpus_pipeline.COLUMNS
        rows = out.collect()
        counts.append(len(rows))
        docs = spark.createDataFrame(rows, out.schema)
    assert before >= counts[0] > counts[1] == counts[2] and counts[3] == counts[4] > 0
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def words5(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_stages_against_plain_python(spark):
    """Each stage's rows worked out again without Spark, from the rows of the one before it."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS).collect()]
    rows += [(None, None, None, None, None), (90001, "", "en", "src1", 0), rows[0], (90002, rows[3][1], "en", None, rows[3][4])]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda r: spark.createDataFrame(r, kinds)
    steps = dict(corpus_pipeline.STAGES)
    taken = lambda df: [tuple(r) for r in df.collect()]
    plain = lambda r: sorted(map(repr, r))

    model = quality.train(frame(rows), spark.read.parquet(f"{SF}/labels.parquet"))
    good = []
    for r in rows:
        t = r[1] or ""
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
        letters, n, upper = sum(c.isalpha() for c in t), max(1, len(w)), sum(unicodedata.category(c) == "Lu" for c in t)
        x = [len(w), len(t) / n, upper / max(1, letters), letters / max(1, len(t)), sum(c in "!*$#%&|" for c in t) / n, t.count("!!") / n, t.count("|") / n, sum(c in ".?" for c in t) / n, len(set(re.split(r"[\x20\x09-\x0D]+", t))) / n, len(set(lines)) / len(lines)]
        held = model.bias + sum(v for q, v in model.rules if quality.holds(q, np.array([x]), list(quality.features()))[0])
        if 1 / (1 + np.exp(-held)) >= 0.3:
            good.append(r)
    first = taken(steps["quality"](spark, frame(rows), SF))
    assert plain(first) == plain(good)

    sets = [words5(r[1]) for r in first]
    label = list(range(len(first)))
    near = [[j for j, b in enumerate(sets) if (first[i][1] or "") == (first[j][1] or "") or (a and b and 5 * len(a & b) >= 4 * len(a | b))] for i, a in enumerate(sets)]
    while (new := [min(label[j] for j in near[i]) for i in range(len(first))]) != label:
        label = new
    second = taken(steps["near_duplicates"](spark, frame(first), SF))
    ids = {}
    for r, k in zip(first, label, strict=True):
        ids.setdefault(k, []).append(r)
    assert len(second) == len(ids) and set(map(repr, second)) <= set(map(repr, first))
    least = sorted(str(min((r[0] for r in g if r[0] is not None), default=None)) for g in ids.values())
    assert sorted(str(r[0]) for r in second) == least

    third = {r[0]: r for r in taken(steps["pii"](spark, frame(second), SF))}
    assert len(third) == len(second)
    for r in second:
        new = third[r[0]]
        assert new[2:4] == r[2:4] and new[4] == (None if r[1] is None else len(new[1]))
        if not re.search(r"[0-9@]|dot|at\b", r[1] or ""):
            assert new[1] == r[1]
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", new[1] or "")

    docs = frame(list(third.values()))
    plan = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(docs).collect()}
    want = [r for r in third.values() for _ in range(int(plan[r[0]][0] / plan[r[0]][1] + 0.5) if plan[r[0]][1] else 0)]
    fourth = taken(steps["mixing"](spark, docs, SF))
    assert plain(fourth) == plain(want)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    out = [(r["doc_id"], r["n_tokens"], r["ids"], r["decoded_sha256"]) for r in steps["bpe"](spark, frame(fourth), SF).collect()]
    coded = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in fourth]
    assert plain(out) == plain((i, len(x), x, hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in coded)


def test_pipeline_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], stage(spark, docs, SF).schema)
    assert docs.count() == 0
