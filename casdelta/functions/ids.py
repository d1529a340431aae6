"""Content ids, path helpers and codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE = 1 << 20


def content_id(content: Column) -> Column:
    """Lower-case hex SHA-256 of bytes."""
    return F.sha2(content, 256)


def session_id(local_root: Column, node: Column, remote_root: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the three joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", local_root, node, remote_root), 256), 1, 16)


def chunk_array(content: Column, chunk_size: int = CHUNK_SIZE) -> Column:
    """Array of (idx, bytes) of fixed size, the last short; an empty file has none."""
    n = F.octet_length(content)
    empty = F.array().cast("array<struct<idx:int,bytes:binary>>")
    parts = F.transform(F.sequence(F.lit(0), F.ceil(n / chunk_size).cast("int") - 1), lambda i: F.struct(i.alias("idx"), F.substring(content, i * chunk_size + 1, F.lit(chunk_size)).alias("bytes")))
    return F.when(n == 0, empty).otherwise(parts)


def short_id(cid: Column, n: int = 16) -> Column:
    return F.substring(cid, 1, n)


def mtime_ms(ts: Column) -> Column:
    """Milliseconds since the epoch, 0 where unknown."""
    return F.coalesce(F.unix_millis(ts), F.lit(0))


def rel_of(root: Column, path: Column) -> Column:
    """path below root with forward slashes; null for root itself and what is not under it."""
    slashed, base = F.replace(path, F.lit("\\"), F.lit("/")), F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", "")
    return F.when(F.startswith(slashed, F.concat(base, F.lit("/"))) & (F.length(slashed) > F.length(base) + 1), F.substring(slashed, F.length(base) + 2, F.length(slashed)))


def remote_root_of(path: Column) -> Column:
    """Without repeated ~/, then ~, then / in front, and without / behind."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\A(?:~/)+", ""), r"\A~+", ""), r"\A/+", ""), r"/+\z", "")


def remote_join(root: Column, rel: Column) -> Column:
    return F.when(root == "", rel).otherwise(F.concat_ws("/", root, rel))


def strip_remote_root(root: Column, path: Column) -> Column:
    """path below root, at a component boundary; null if it is not under root."""
    under = F.startswith(path, F.concat(root, F.lit("/")))
    rest = F.when(root == "", path).when(path == root, F.lit("")).when(under, F.substring(path, F.length(root) + 2, F.length(path)))
    return F.regexp_replace(rest, r"\A/+|/+\z", "")


def split_dest(dest: Column) -> tuple[Column, Column]:
    """What is before and after the first colon; null, null without one."""
    has = F.contains(dest, F.lit(":"))
    at = F.instr(dest, ":")
    return F.when(has, F.substring(dest, F.lit(1), at - 1)), F.when(has, F.substring(dest, at + 1, F.length(dest)))


def policy_of(name: Column) -> Column:
    """lww, copy or crdt, whatever the case; lww if absent or unknown."""
    low = F.lower(name)
    return F.when(low.isin("lww", "copy", "crdt"), low).otherwise("lww")


def from_hex(text: Column) -> Column:
    """Bytes, or null if it is no hex."""
    return F.unhex(text)


def clip(content: Column, most: int = 262_144, marker: str = "\n[clipped]\n") -> Column:
    """Text of at most `most` bytes, cut at a character, with a marker; invalid UTF-8 is replaced."""
    text = F.make_valid_utf8(content.cast("string"))
    head = F.regexp_replace(F.make_valid_utf8(F.substring(content, 1, most).cast("string")), "�+\\z", "")
    return F.when(F.octet_length(content) > most, F.concat(head, F.lit(marker))).otherwise(text)


def action_for(topic: Column) -> Column:
    """The action that a topic's request needs; null for unknown topics."""
    name = F.element_at(F.split(topic, "/"), -1)
    sync = F.when(name == "commit", "sync").when(name == "delete", "delete").when(name.isin("have", "list", "manifest"), "sync-read")
    return F.when(F.startswith(topic, F.lit("run/")), "spawn").when(F.startswith(topic, F.lit("legacy/")), F.substring(topic, F.lit(8), F.length(topic))).otherwise(sync)
