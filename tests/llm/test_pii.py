from __future__ import annotations

import hashlib
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from casdelta.llm import pii
from casdelta.llm.queries import QUERIES

# The contract's patterns.
PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


TRICKY = [
    "a@b.c_w@q.r x@y..z a@b @c.d",
    "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1.2.3.4x",
    "4111 1111-1111 1111 4111111111111111 4111  1111 1111 1111",
    "+1 (743) 555-3824 +1 23 ++44 20 7946 0958. +12-",
    "é😀 mail ü.x@y.zz, ip 10.0.0.1 😀 +1 (743) 555-3824 4111111111111111",
    "\x01 4111\x011111 1111 1111 1111",
    "1 " * 3000,
    "1." * 3000,
    "a." * 3000 + "@b.c",
    "x@y." + "z." * 2000 + "q",
    "9" * 5000,
    "+1" + " (1)" * 2000,
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id int, text string")
    out = pii.detect(df, pii.SpanModel({}, {})).select("doc_id", pii.written(F.col("_spans"))).collect()
    for i, spans in out:
        assert spans == base(TRICKY[i]), TRICKY[i][:60]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    rows = QUERIES["op2_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r["spans"].split(",")) or not want
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in want.split(",")) for k in pii.KINDS]


def test_weak_supervision_adds_likely_spans(spark):
    rows = [(i, f"please call me on +1 (743) 555-{3000 + i} or mail joe{i}@mail.example.com from host 9.8.7.{i % 200}") for i in range(120)]
    rows += [(200 + i, f"order no {i:012d}7 version 300.1.2.{i}") for i in range(60)]
    rows += [(500, "call me: 743-555-3824 today"), (501, "write to joe [at] mail (dot) com please"), (502, "nothing here at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(df)
    assert set(model.reliabilities) == set(pii.KINDS)
    assert all(r["strict"][1, 1] > r["strict"][1, 0] for r in (model.reliabilities["email"], model.reliabilities["phone"], model.reliabilities["ip"]))
    got = {r[0]: r[1] for r in pii.detect(df, model).select("doc_id", pii.written(F.col("_spans"))).collect()}
    assert got[500] == "phone:9:21" and got[501] == "email:9:32" and got[502] == ""


def test_redaction(spark, odd, none):
    df = spark.createDataFrame([(1, "a x@y.zz b"), (2, "1.2.3.4"), (3, "none"), (4, "é +1 (743) 555-3824")], "doc_id long, text string")
    out = pii.detect(df, pii.SpanModel({}, {})).select("doc_id", pii.redacted(F.col("text"), F.col("_spans"))).collect()
    assert {r[0]: r[1] for r in out} == {1: "a [EMAIL] b", 2: "[IP]", 3: "none", 4: "é [PHONE]"}
    found = pii.detect(odd, pii.train(odd))
    assert found.columns == [c for c in odd.columns if c != "_spans"] + ["_spans"]
    assert sorted((str(r["doc_id"]), str(r["text"]), pii_written(r["_spans"]), r["words"]) for r in found.collect()) == sorted((str(r["doc_id"]), str(r["text"]), base(r["text"]), r["words"]) for r in odd.collect())
    assert pii.detect(none, pii.train(none)).count() == 0


def pii_written(spans):
    return ",".join(f"{pii.KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in spans)


def test_overlaps_and_redaction_against_brute_force(spark):
    draw = random.Random(4)
    rows = []
    for i in range(60):
        text = "".join(draw.choice("abcé😀 ") for _ in range(draw.choice([0, 5, 300, 5000])))
        spans = []
        for _ in range(draw.choice([0, 1, 5, 60])):
            a = draw.randrange(max(1, len(text)))
            b = min(len(text), a + draw.choice([1, 3, 2500]))
            if b > a:
                spans.append((a, draw.randrange(4), b, 2, "", ""))
        unique = sorted({(s[0], s[1]): s for s in spans}.values())
        half = len(unique) // 2
        rows.append((i, text, unique[half:], unique[:half]))
    df = spark.createDataFrame(rows, f"i int, text string, more {pii.SPANS}, sure {pii.SPANS}")
    joined = F.array_sort(F.concat("more", "sure"))
    got = df.select("i", pii.apart(F.col("more"), F.col("sure")).alias("a"), pii.first_of_overlaps(joined).alias("f"), pii.redacted(F.col("text"), joined, 64).alias("r")).collect()
    for r, (_, text, more, sure) in zip(sorted(got), rows, strict=True):
        assert {tuple(x) for x in r["a"]} == {x for x in more if not any(b[0] < x[2] and x[0] < b[2] for b in sure)}
        every = sorted(more + sure)
        assert [tuple(x) for x in r["f"]] == [x for n, x in enumerate(every) if not any(y[2] > x[0] for y in every[:n] if y[:2] != x[:2])]
        at, out = 0, ""
        for a, k, b, *_ in every:
            if a >= at:
                out += text[at:a] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, b)
        assert r["r"] == out + text[at:]


def test_very_many_matches_in_one_text(spark):
    n = 40_000
    text = "".join(f"u{i}@mail.example.com, " for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    pii.detect(df.limit(0), pii.SpanModel({}, {})).collect()
    began = time.monotonic()
    found = pii.detect(df, pii.SpanModel({}, {}))
    row = found.select(F.size("_spans").alias("n"), pii.redacted(F.col("text"), F.col("_spans")).alias("t")).first()
    assert row["n"] == n and row["t"] == "[EMAIL], " * n
    assert time.monotonic() - began < 20


@pytest.mark.parametrize("n", [0, 1])
def test_estimate_without_contrast(n):
    belief, _ = pii.estimate([((1, 1, 1, 1), 5.0)] * n)
    assert len(belief) == n and all(b > 0.5 for b in belief.values())
