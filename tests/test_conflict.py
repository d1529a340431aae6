from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from casdelta.operators import conflict

COLS = "rel_path string, local_cid string, local_mtime_ms long, incoming_cid string, incoming_mtime_ms long, base_cid string, policy string, short string"


@pytest.mark.parametrize(
    "row, action, copied",
    [
        (("old", 100, "new", 200, "old", "lww"), "take", False),
        (("same", 100, "same", 50, None, "lww"), "take", False),
        (("mine", 100, "theirs", 200, "older", "lww"), "take", True),
        (("mine", 300, "theirs", 200, "older", "lww"), "keep", True),
        (("aaa", 100, "zzz", 100, "older", "lww"), "take", True),
        (("zzz", 100, "aaa", 100, "older", "lww"), "keep", True),
        (("mine", 100, "theirs", 999, "older", "copy"), "keep", True),
        (("mine", 100, "theirs", 999, "", "lww"), "take", True),
        ((None, None, "theirs", 999, "older", "lww"), "take", False),
    ],
)
def test_decisions(spark, row, action, copied):
    df = spark.createDataFrame([("docs/f.md", row[0], row[1], row[2], row[3], row[4], row[5], "abc123")], COLS)
    got = conflict.resolve(df).first()
    assert (got["action"], got["conflict_copy"] is not None) == (action, copied)


def test_names_and_kinds(spark):
    rows = [("docs/notes.md", 1718900000000), ("README", 2000), (".bashrc", 2000), ("a/foo.", 2000)]
    got = spark.createDataFrame(rows, "p string, m long").select(conflict.copy_name(F.col("p"), F.lit("abc123"), F.col("m"))).collect()
    assert [r[0] for r in got] == ["docs/notes.conflict-abc123-1718900000.md", "README.conflict-abc123-2", ".bashrc.conflict-abc123-2", "a/foo.conflict-abc123-2."]
    kinds = {"a.rs": True, "src/b.ts": True, "C.MD": True, ".gitignore": True, "logo.png": False, "noext": False, "x.exe": False}
    got = spark.createDataFrame([(k,) for k in kinds], "p string").select("p", conflict.is_mergeable(F.col("p"))).collect()
    assert {r[0]: r[1] for r in got} == kinds


def test_merge3(spark):
    base = b"a\nb\nc\nd\ne\n"
    rows = [
        (base, b"A\nb\nc\nd\ne\n", b"a\nb\nc\nd\nE\n", "clean", "A\nb\nc\nd\nE\n"),
        (base, b"a\nX\nc\nd\ne\n", b"a\nY\nc\nd\ne\n", "conflict", None),
        (base, b"same\n", b"same\n", "clean", "same\n"),
        (base, base, b"new\n", "clean", "new\n"),
        (base, b"\xff\xfe\x00\x01", base, "not_text", None),
        (None, base, base, "not_text", None),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, base binary, local binary, incoming binary")
    got = conflict.merge3(df).orderBy("i").collect()
    assert [(r["status"], r["merged"]) for r in got] == [r[3:] for r in rows]


def test_crdt_merges_text_only(spark):
    edit = (b"a\nb\nc\nd\n", b"a\nb\nc\nD\n", b"A\nb\nc\nd\n")
    df = spark.createDataFrame([(p, "l", 1, "i", 2, "b", pol, "s", *edit) for p, pol in (("x.md", "crdt"), ("x.png", "crdt"), ("y.md", "lww"))], COLS + ", base binary, local binary, incoming binary")
    got = {r["rel_path"]: (r["action"], r["merged"], r["conflict_copy"] is None) for r in conflict.resolve_with_merge(df).collect()}
    assert got == {"x.md": ("merged", "A\nb\nc\nD\n", True), "x.png": ("take", None, False), "y.md": ("take", None, False)}


def test_no_version_is_lost(spark):
    df = spark.createDataFrame([("f.md", "l", m, "i", 50, "b", p, "s") for m, p in ((10, "lww"), (90, "lww"), (10, "copy"))], COLS)
    got = conflict.applied(conflict.resolve(df)).groupBy("kind").agg(F.sort_array(F.collect_list("cid"))).collect()
    assert {r[0]: r[1] for r in got} == {"file": ["i", "l", "l"], "copy": ["i", "i", "l"]}


def test_replay_is_an_ordered_fold(spark):
    state = spark.createDataFrame([("p", "s0", 100)], "rel_path string, cid string, mtime_ms long")
    log = [("p", 1, "s1", 50, "s0"), ("p", 2, "s2", 40, "s1"), ("p", 3, "x", 10, "s0"), ("q", 1, "n", 5, None)]
    df = spark.createDataFrame(log, "rel_path string, seq long, cid string, mtime_ms long, base string")
    for parts in (1, 3):
        got = {r["rel_path"]: tuple(r)[1:] for r in conflict.replay(state, df.repartition(parts)).collect()}
        assert got == {"p": ("s2", 40, 1), "q": ("n", 5, 0)}


def test_deletions(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "rel_path string, cid string")
    asked = spark.createDataFrame([("a", "1"), ("b", "other"), ("c", None), ("absent", "9")], "rel_path string, base string")
    run = lambda strict: {r["rel_path"]: r["deleted"] for r in conflict.delete_batch(asked, state, strict).collect()}
    assert run(False) == {"a": True, "b": False, "c": True, "absent": True}
    assert run(True) == {"a": True, "b": False, "c": False, "absent": True}


def test_merged_rows_keep_both_edits(spark):
    edit = (b"a\nb\nc\nd\n", b"a\nb\nc\nD\n", b"A\nb\nc\nd\n")
    both = b"A\nb\nc\nD\n"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [(p, sha(edit[1]), 7, sha(edit[2]), 5, sha(edit[0]), pol, "s", *edit) for p, pol in (("m.md", "crdt"), ("t.png", "crdt"), ("k.md", "copy"))]
    df = spark.createDataFrame(rows, COLS + ", base binary, local binary, incoming binary")
    done = conflict.accepted(df, df.select("rel_path", F.lit("ok").alias("status")))
    files = {r["rel_path"]: (r["cid"], r["mtime_ms"], r["content"] and bytes(r["content"])) for r in conflict.applied(done).collect()}
    assert files["m.md"] == (sha(both), 7, both)
    # each of the three paths leaves both versions: in one merged file, or as file and copy
    assert len(files) == 5 and {v[0] for k, v in files.items() if k != "m.md"} == {sha(edit[1]), sha(edit[2])}
    heard = {r["rel_path"]: (r["applied"], r["merged"], r["remote_cid"], r["remote_mtime_ms"]) for r in conflict.replies(done).collect()}
    assert heard == {"m.md": (True, True, sha(both), 7), "t.png": (False, False, sha(edit[1]), 7), "k.md": (False, False, sha(edit[1]), 7)}
    blobs = {r["cid"]: bytes(r["bytes"]) for r in conflict.published(done).collect()}
    assert blobs == {sha(edit[2]): edit[2], sha(both): both}
    state = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows] + [("other", "o", 1)], "rel_path string, cid string, mtime_ms long")
    after = {r["rel_path"]: r["cid"] for r in conflict.committed(state, done).collect()}
    assert after == {**{k: v[0] for k, v in files.items()}, "other": "o"}
    # every id that the state names is a stored one, or one the receiver had
    assert {c for c in after.values()} <= set(blobs) | {r[1] for r in rows} | {"o"}


def test_batch_refuses_unsafe_and_unbuilt(spark):
    rows = [(p, None, None, "i", 1, None, "lww", "s", None, None, b"x") for p in ("ok.md", "../up.md", "/abs.md", "lacks.md")]
    df = spark.createDataFrame(rows, COLS + ", base binary, local binary, incoming binary")
    built = df.select("rel_path", F.when(F.col("rel_path") == "lacks.md", "missing_chunk").otherwise("ok").alias("status"))
    assert [r["rel_path"] for r in conflict.commit_batch(df, built).collect()] == ["ok.md"]


def test_journal_is_the_fold_with_merges(spark):
    text = lambda *edits: "".join(f"{e}\n" for e in edits).encode()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    v0, v1, v2, v3 = text("a", "b", "c", "d", "e"), text("A", "b", "c", "d", "e"), text("a", "b", "c", "d", "E"), text("a", "b", "Z", "d", "e")
    both, three = text("A", "b", "c", "d", "E"), text("A", "b", "Z", "d", "E")
    state = spark.createDataFrame([("f.md", sha(v0), 10, v0), ("idle", "i", 1, None)], "rel_path string, cid string, mtime_ms long, content binary")
    log = [("f.md", 1, v1, 20, v0, "lww"), ("f.md", 2, v2, 15, v0, "crdt"), ("f.md", 3, v3, 30, v0, "crdt"), ("f.md", 4, v2, 5, v0, "lww"), ("f.md", 5, v3, 1, three, "lww"), ("n.bin", 1, b"\xff", 3, None, "copy"), ("n.bin", 2, b"\xfe", 4, None, "copy")]
    df = spark.createDataFrame([(p, s, sha(b), m, base and sha(base), pol, "s", b, base) for p, s, b, m, base, pol in log], "rel_path string, seq long, cid string, mtime_ms long, base string, policy string, short string, content binary, ancestor binary")
    for parts in (1, 5):
        entries = conflict.journal(state, df.repartition(parts, "seq"))
        got = {(r["rel_path"], r["seq"]): (r["action"], r["conflict"], r["cid"], r["lost_cid"]) for r in entries.collect()}
        assert got == {
            ("f.md", 1): ("take", False, sha(v1), None),
            ("f.md", 2): ("merged", True, sha(both), None),
            ("f.md", 3): ("merged", True, sha(three), None),
            ("f.md", 4): ("keep", True, sha(three), sha(v2)),
            ("f.md", 5): ("take", False, sha(v3), None),
            ("n.bin", 1): ("take", False, sha(b"\xff"), None),
            ("n.bin", 2): ("keep", True, sha(b"\xff"), sha(b"\xfe")),
        }
    after = {r["rel_path"]: (r["cid"], r["mtime_ms"]) for r in conflict.journal_state(state, entries).collect()}
    assert after == {"f.md": (sha(v3), 1), "idle": ("i", 1), "n.bin": (sha(b"\xff"), 3), "f.conflict-s-0.md": (sha(v2), 5), "n.conflict-s-0.bin": (sha(b"\xfe"), 4)}
    assert conflict.journal(state, df.limit(0)).count() == 0
