"""Conflict detection and resolution, three-way merge of text, and replay of commit logs."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casdelta.functions.diff import merge_texts
from casdelta.functions.rules import target_fault
from casdelta.operators.skew import dealt

# File name extensions whose conflicts merge as lines of text.
MERGEABLE = (
    "rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "java", "kt", "swift", "rb", "php", "c", "h", "cc", "cpp", "hpp",
    "cs", "scala", "lua", "ex", "exs", "dart", "sh", "bash", "zsh", "sql", "r", "pl", "m", "md", "markdown", "txt", "rst", "adoc",
    "tex", "org", "toml", "yaml", "yml", "json", "jsonc", "ini", "cfg", "conf", "env", "properties", "html", "htm", "css", "scss",
    "sass", "less", "xml", "svg", "vue", "svelte", "gitignore", "dockerignore", "editorconfig", "gitattributes",
)


def is_conflict(local: Column, incoming: Column, base: Column) -> Column:
    """The receiver has another content than both the incoming one and the one the sender assumed ('' and null: none)."""
    return F.coalesce(local.isNotNull() & (local != incoming) & ((F.coalesce(base, F.lit("")) == "") | (local != base)), F.lit(False))


def copy_name(path: Column, short: Column, mtime_ms: Column) -> Column:
    """<stem>.conflict-<short>-<seconds><extension>; the extension is after the last dot of the name, unless that leaves no stem."""
    folder, name = F.regexp_extract(path, r"(?s)\A(.*/)?([^/]*)\z", 1), F.regexp_extract(path, r"(?s)\A(.*/)?([^/]*)\z", 2)
    has = name.rlike(r"(?s)\A.+\.[^.]*\z")
    stem = F.when(has, F.regexp_extract(name, r"(?s)\A(.+)\.([^.]*)\z", 1)).otherwise(name)
    ext = F.when(has, F.concat(F.lit("."), F.regexp_extract(name, r"(?s)\A(.+)\.([^.]*)\z", 2))).otherwise(F.lit(""))
    seconds = F.floor(mtime_ms / 1000).cast("long").cast("string")
    return F.concat(folder, stem, F.lit(".conflict-"), short, F.lit("-"), seconds, ext)


def is_mergeable(path: Column) -> Column:
    name = F.regexp_extract(path, r"(?s)([^/]*)\z", 1)
    ext = F.when(name.rlike(r"(?s)\A.+\.[^.]*\z"), F.regexp_extract(name, r"(?s)\.([^.]*)\z", 1)).when(F.startswith(name, F.lit(".")), F.substring(name, F.lit(2), F.length(name)))
    return F.coalesce(F.lower(ext).isin(*MERGEABLE), F.lit(False))


def incoming_wins(local: Column, local_mtime: Column, incoming: Column, incoming_mtime: Column) -> Column:
    return (incoming_mtime > local_mtime) | ((incoming_mtime == local_mtime) & (incoming > local))


def resolve(rows: DataFrame) -> DataFrame:
    """rows with conflict, action (take or keep) and conflict_copy (null: none).

    rows: rel_path, local_cid, local_mtime_ms, incoming_cid, incoming_mtime_ms, base_cid, policy, short. Policy copy keeps the local
    content; others let the later write win, ties by the larger id; the loser becomes the copy, named by its own time.
    """
    c = F.col
    conflict = is_conflict(c("local_cid"), c("incoming_cid"), c("base_cid"))
    wins = (c("policy") != "copy") & incoming_wins(c("local_cid"), c("local_mtime_ms"), c("incoming_cid"), c("incoming_mtime_ms"))
    out = rows.withColumn("conflict", conflict).withColumn("action", F.when(~c("conflict") | wins, "take").otherwise("keep"))
    loser = F.when(c("action") == "take", c("local_mtime_ms")).otherwise(c("incoming_mtime_ms"))
    return out.withColumn("conflict_copy", F.when(c("conflict"), copy_name(c("rel_path"), c("short"), loser)))


def _merge(base: pd.Series, local: pd.Series, incoming: pd.Series) -> pd.DataFrame:
    out = [None if b is None or x is None or y is None else merge_texts(b, x, y) for b, x, y in zip(base, local, incoming, strict=True)]
    return pd.DataFrame({"text": pd.Series([m and m.text for m in out], dtype=object), "clashes": pd.Series([m.clashes if m else 0 for m in out], dtype="int64")})


def merge3(rows: DataFrame, inline: bool = False) -> DataFrame:
    """rows (base, local, incoming as bytes) with status (clean, conflict, not_text) and merged text, null unless clean.

    Sides that are equal or unchanged are settled in columns; only the rest is merged line by line, in Arrow batches. With inline
    there are n_clashes too and inline_text, where a conflict holds both versions and the base between marks, so that none is lost.
    """
    text = {k: F.try_validate_utf8(F.col(k).cast("string")) for k in ("base", "local", "incoming")}
    out = rows.select("*", *(t.alias(f"_{k}") for k, t in text.items()))
    usable = F.col("_base").isNotNull() & F.col("_local").isNotNull() & F.col("_incoming").isNotNull()
    easy = F.when((F.col("_local") == F.col("_incoming")) | (F.col("_incoming") == F.col("_base")), F.col("_local")).when(F.col("_local") == F.col("_base"), F.col("_incoming"))
    out = out.withColumn("_easy", F.when(usable, easy))
    hard = lambda k: F.when(usable & F.col("_easy").isNull(), F.col(k))
    lines = F.pandas_udf(_merge, "text string, clashes long")
    out = out.withColumn("_hard", lines(hard("_base"), hard("_local"), hard("_incoming")))
    merged = F.coalesce("_easy", F.when(F.col("_hard.clashes") == 0, F.col("_hard.text")))
    status = F.when(~usable, "not_text").when(merged.isNull(), "conflict").otherwise("clean")
    more = [F.coalesce(F.when(usable, F.col("_hard.clashes")), F.lit(0)).cast("long").alias("n_clashes"), F.coalesce("_easy", F.when(usable, F.col("_hard.text"))).alias("inline_text")] if inline else []
    return out.select(*rows.columns, status.alias("status"), merged.alias("merged"), *more)


def resolve_with_merge(rows: DataFrame) -> DataFrame:
    """As resolve(), with action merged and the merged text where policy crdt meets a clean merge of a mergeable file.

    rows also have base, local and incoming bytes (null: not at hand).
    """
    out = merge3(resolve(rows))
    use = (F.col("policy") == "crdt") & F.col("conflict") & is_mergeable(F.col("rel_path")) & (F.col("status") == "clean")
    return out.select(
        *rows.columns,
        "conflict",
        F.when(use, "merged").otherwise(F.col("action")).alias("action"),
        F.when(~use, F.col("conflict_copy")).alias("conflict_copy"),
        F.when(use, F.col("merged")).alias("merged"),
    )


def applied(resolved: DataFrame) -> DataFrame:
    """(rel_path, kind, cid, mtime_ms, content): the rows a resolution leaves, kind file or copy, in one pass.

    No version is lost: one side is the file and the other, where they conflict, its copy; a merged file holds both sides' edits, and
    its bytes are in content, as no store has them yet. Its time is the later of both. resolved: of resolve() or resolve_with_merge().
    """
    c = F.col
    take, text = c("action") == "take", c("merged") if "merged" in resolved.columns else F.lit(None).cast("string")
    merged = c("action") == "merged"
    content = F.when(merged, F.encode(text, "UTF-8"))
    both = F.greatest("local_mtime_ms", "incoming_mtime_ms")
    row = lambda path, kind, cid, mtime, data: F.struct(path.alias("rel_path"), F.lit(kind).alias("kind"), cid.alias("cid"), mtime.alias("mtime_ms"), data.alias("content"))
    file = row(
        c("rel_path"),
        "file",
        F.when(merged, F.sha2(content, 256)).when(take, c("incoming_cid")).otherwise(c("local_cid")),
        F.when(merged, both).when(take, c("incoming_mtime_ms")).otherwise(c("local_mtime_ms")),
        content,
    )
    loser = row(c("conflict_copy"), "copy", F.when(take, c("local_cid")).otherwise(c("incoming_cid")), F.when(take, c("local_mtime_ms")).otherwise(c("incoming_mtime_ms")), F.lit(None).cast("binary"))
    return resolved.select(F.inline(F.filter(F.array(file, loser), lambda x: x["rel_path"].isNotNull())))


def accepted(rows: DataFrame, built: DataFrame) -> DataFrame:
    """Commits (as resolve_with_merge() takes them) of safe paths whose files were rebuilt and verified (built: rel_path, status), resolved."""
    ready = built.where("status = 'ok'").select("rel_path")
    return resolve_with_merge(rows.where(target_fault(F.col("rel_path")).isNull()).join(ready, "rel_path", "left_semi"))


def replies(resolved: DataFrame) -> DataFrame:
    """(rel_path, applied, conflict, merged, remote_cid, remote_mtime_ms, conflict_copy): what the sender hears.

    remote_cid and its time are what the receiver has afterwards: the merged text's, which no side had before, the incoming ones where
    they were taken, else the local ones.
    """
    merged, take = F.col("action") == "merged", F.col("action") == "take"
    remote = F.when(merged, F.sha2("merged", 256)).when(take, F.col("incoming_cid")).otherwise(F.col("local_cid"))
    mtime = F.when(merged, F.greatest("local_mtime_ms", "incoming_mtime_ms")).when(take, F.col("incoming_mtime_ms")).otherwise(F.col("local_mtime_ms"))
    return resolved.select("rel_path", (merged | take).alias("applied"), "conflict", merged.alias("merged"), remote.alias("remote_cid"), mtime.alias("remote_mtime_ms"), "conflict_copy")


def commit_batch(rows: DataFrame, built: DataFrame) -> DataFrame:
    """replies() to commits; a commit of an unsafe path, or of a file that was not rebuilt, gets none. One commit a path: see journal()."""
    return replies(accepted(rows, built))


def committed(state: DataFrame, resolved: DataFrame) -> DataFrame:
    """state (rel_path, cid, mtime_ms) after accepted() commits: files as resolved, copies beside them, all other rows as they were."""
    new = applied(resolved).groupBy("rel_path").agg(F.max_by(F.struct("cid", "mtime_ms"), "kind").alias("_new"))
    joined = state.join(new, "rel_path", "full_outer")
    pick = lambda k: F.when(F.col("_new").isNotNull(), F.col(f"_new.{k}")).otherwise(F.col(k)).alias(k)
    return joined.select("rel_path", pick("cid"), pick("mtime_ms"))


def published(resolved: DataFrame) -> DataFrame:
    """(cid, bytes) that accepted() commits add to a store of whole files: the incoming bytes, whoever won, and the merged ones; each once.

    A copy's or a merge's content can then be fetched by its id. resolved has incoming (bytes).
    """
    sent = F.struct(F.col("incoming_cid").alias("cid"), F.col("incoming").alias("bytes"))
    made = F.when(F.col("action") == "merged", F.struct(F.sha2("merged", 256).alias("cid"), F.encode("merged", "UTF-8").alias("bytes")))
    return resolved.select(F.inline(F.filter(F.array(sent, made), lambda x: x["bytes"].isNotNull()))).groupBy("cid").agg(F.first("bytes").alias("bytes"))


class Version(NamedTuple):
    cid: str | None
    mtime: int | None
    text: str | None = None


def meet(now: Version, new: Version, base: str | None, policy: str = "lww", ancestor: str | None = None) -> tuple[Version, str, bool]:
    """The version after a commit meets the present one, the action (take, keep, merged), and whether they were in conflict.

    Texts are null where they are not at hand or not to be merged; ancestor is the base's text.
    """
    if now.cid is None or now.cid == new.cid or (base and now.cid == base):
        return new, "take", False
    if policy == "crdt" and base and now.text is not None and new.text is not None and ancestor is not None:
        merge = merge_texts(ancestor, now.text, new.text)
        if not merge.clashes:
            return Version(sha256(merge.text.encode("utf-8")).hexdigest(), max(now.mtime, new.mtime), merge.text), "merged", True
    if policy != "copy" and (new.mtime, new.cid) > (now.mtime, now.cid):
        return new, "take", True
    return now, "keep", True


def journal(state: DataFrame, log: DataFrame) -> DataFrame:
    """(rel_path, seq, action, conflict, conflict_copy, lost_cid, lost_mtime_ms, cid, mtime_ms, merged): a row for each commit of a log.

    state: rel_path, cid, mtime_ms, content. log: rel_path, seq, cid, mtime_ms, base, policy, short, content, ancestor (bytes of both,
    or null). Each commit meets what the one before it left, merges included. cid and mtime_ms are what the path holds afterwards,
    merged its bytes where they are new; conflict_copy names the loser, lost_cid. Commits of one seq go by cid. A path's sorted log
    streams through one task in constant memory, however long it is.
    """
    text = lambda c: F.when(is_mergeable(F.col("rel_path")), F.try_validate_utf8(F.col(c).cast("string")))
    none = lambda kind: F.lit(None).cast(kind)
    start = state.select("rel_path", F.lit(0).alias("turn"), none("long").alias("seq"), "cid", F.col("mtime_ms").cast("long").alias("mtime_ms"), none("string").alias("base"), none("string").alias("policy"), none("string").alias("short"), text("content").alias("text"), none("string").alias("ancestor"))
    step = log.select("rel_path", F.lit(1).alias("turn"), F.col("seq").cast("long").alias("seq"), "cid", F.col("mtime_ms").cast("long").alias("mtime_ms"), F.nullif("base", F.lit("")).alias("base"), "policy", "short", text("content").alias("text"), text("ancestor").alias("ancestor"))
    rows = dealt(start.join(log.select("rel_path").distinct(), "rel_path", "left_semi").unionByName(step), "rel_path", ["turn", "seq", "cid"])
    names = ["rel_path", "seq", "action", "conflict", "short", "lost_cid", "lost_mtime", "cid", "mtime_ms", "merged"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, now = None, Version(None, None)
        for batch in batches:
            out = []
            for rel, turn, seq, cid, mtime, base, policy, short, body, ancestor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rel != path:
                    path, now = rel, Version(None, None)
                new = Version(cid, mtime, body)
                if not turn:
                    now = new
                    continue
                after, action, conflict = meet(now, new, base, policy or "lww", ancestor)
                loser = (now if action == "take" else new) if conflict and action != "merged" else Version(None, None)
                out.append((rel, seq, action, conflict, short, loser.cid, loser.mtime, after.cid, after.mtime, after.text if action == "merged" else None))
                now = after
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    done = rows.mapInArrow(run, "rel_path string, seq long, action string, conflict boolean, short string, lost_cid string, lost_mtime long, cid string, mtime_ms long, merged string")
    copy = F.when(F.col("lost_cid").isNotNull(), copy_name(F.col("rel_path"), F.col("short"), F.col("lost_mtime")))
    return done.select("rel_path", "seq", "action", "conflict", copy.alias("conflict_copy"), "lost_cid", F.col("lost_mtime").alias("lost_mtime_ms"), "cid", "mtime_ms", F.encode("merged", "UTF-8").alias("merged"))


def journal_state(state: DataFrame, entries: DataFrame) -> DataFrame:
    """state (rel_path, cid, mtime_ms) after a journal(): what each path holds last, and the copies."""
    last = entries.groupBy("rel_path").agg(F.max_by(F.struct("cid", "mtime_ms"), F.struct("seq", "cid")).alias("_new"))
    copies = entries.where("conflict_copy is not null").groupBy(F.col("conflict_copy").alias("rel_path")).agg(F.max_by(F.struct(F.col("lost_cid").alias("cid"), F.col("lost_mtime_ms").alias("mtime_ms")), "seq").alias("_new"))
    joined = state.select("rel_path", "cid", "mtime_ms").join(last.unionByName(copies).groupBy("rel_path").agg(F.first("_new").alias("_new")), "rel_path", "full_outer")
    pick = lambda k: F.when(F.col("_new").isNotNull(), F.col(f"_new.{k}")).otherwise(F.col(k)).alias(k)
    return joined.select("rel_path", pick("cid"), pick("mtime_ms"))


def replay(state: DataFrame, log: DataFrame) -> DataFrame:
    """(rel_path, cid, mtime_ms, n_conflicts) after commits (rel_path, seq, cid, mtime_ms, base) in order of seq.

    Each commit meets the state that the one before it left, so this is a fold a path, not a maximum: a clean update with an older
    time still wins. The fold holds one path's log in a row; endless logs belong to streaming.stateful_replay().
    """
    item = F.struct("seq", "cid", F.col("mtime_ms").alias("mtime"), "base")
    logs = log.groupBy("rel_path").agg(F.array_sort(F.collect_list(item)).alias("log"))
    now = state.select("rel_path", F.col("cid").alias("_cid"), F.col("mtime_ms").alias("_mtime"))
    start = F.struct(F.col("_cid").alias("cid"), F.col("_mtime").alias("mtime"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        conflict = is_conflict(acc["cid"], x["cid"], x["base"])
        take = ~conflict | incoming_wins(acc["cid"], acc["mtime"], x["cid"], x["mtime"])
        return F.struct(F.when(take, x["cid"]).otherwise(acc["cid"]).alias("cid"), F.when(take, x["mtime"]).otherwise(acc["mtime"]).alias("mtime"), (acc["n"] + conflict.cast("long")).alias("n"))

    joined = now.join(logs, "rel_path", "full_outer")
    folded = joined.select("rel_path", F.aggregate(F.coalesce("log", F.array().cast("array<struct<seq:bigint,cid:string,mtime:bigint,base:string>>")), start, step).alias("s"))
    return folded.select("rel_path", "s.cid", F.col("s.mtime").alias("mtime_ms"), F.col("s.n").alias("n_conflicts"))


def delete_batch(requests: DataFrame, state: DataFrame, strict: bool = False) -> DataFrame:
    """(rel_path, deleted, conflict) of requests (rel_path, base): a conflict where the content is another than a known base.

    An absent path counts as deleted. Without a base an existing file goes, unless strict, which makes that a conflict.
    """
    joined = requests.join(state.select("rel_path", F.col("cid").alias("_cid")), "rel_path", "left")
    base = F.coalesce("base", F.lit(""))
    conflict = F.col("_cid").isNotNull() & (F.lit(strict) if strict else (base != "")) & (F.col("_cid") != base)
    return joined.select("rel_path", (~conflict).alias("deleted"), conflict.alias("conflict"))


def apply_loose(incoming: DataFrame, local: DataFrame, bases: DataFrame) -> DataFrame:
    """(rel_path, status, target, content) of incoming loose files (rel_path, peer, content) against local and bases.

    status: unsafe, equal, new, merged or copy; target: where content goes, null if nothing is written.
    """
    joined = incoming.withColumnRenamed("content", "incoming").join(local.select("rel_path", F.col("content").alias("local")), "rel_path", "left").join(bases.select("rel_path", F.col("content").alias("base")), "rel_path", "left")
    out = merge3(joined)
    unsafe = F.contains("rel_path", F.lit("..")) | F.startswith("rel_path", F.lit("/"))
    merged = is_mergeable(F.col("rel_path")) & F.col("base").isNotNull() & (F.col("status") == "clean")
    status = F.when(unsafe, "unsafe").when(F.col("local").isNull(), "new").when(F.col("local") == F.col("incoming"), "equal").when(merged, "merged").otherwise("copy")
    out = out.withColumn("_status", status)
    target = F.when(F.col("_status").isin("new", "merged"), F.col("rel_path")).when(F.col("_status") == "copy", F.concat("rel_path", F.lit(".conflict-"), "peer"))
    content = F.when(F.col("_status") == "merged", F.encode("merged", "UTF-8")).when(F.col("_status").isin("new", "copy"), F.col("incoming"))
    return out.select("rel_path", F.col("_status").alias("status"), target.alias("target"), content.alias("content"))
