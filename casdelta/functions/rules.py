"""Ignore rules, path scopes and path safety as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casdelta.operators.skew import HOT_SHARE, hot_join
from casdelta.staging import staged

# Built-in ignore rules, names never synced, and path fragments that repositories and loose files leave out.
BUILTIN = [".git/", "target/", "node_modules/", ".DS_Store", "*~", "*.swp", "*.tmp", ".#*"]
SKIP = ["target", ".git", "node_modules", ".DS_Store"]
REPO_FRAGMENTS = ["/.git/", "/target/", "/target-", "/node_modules/", "/.cargo-shared/", "/.cargo/", "/dist/", "/build/", "/.next/", "/.svelte-kit/", "/.worktrees/", "/__pycache__/"]
LOOSE_FRAGMENTS = [
    "/.git",
    "/target",
    "/node_modules/",
    "/.cargo-shared/",
    "/.cargo/",
    "/dist/",
    "/build/",
    "/.next/",
    "/.svelte-kit/",
    "/.worktrees/",
    "/__pycache__/",
    "/tmp/",
    "/trash/",
    "/.cache/",
    "/scratchpad/",
    "/.DS_Store",
]
#: Payloads of more bytes are not sent inline.
INLINE_MAX = 2 * 1024 * 1024
#: Characters of a segment's literal head or tail by which a rule is looked up.
KEY_CHARS = (8, 4, 2, 1)


@dataclass(frozen=True)
class Rule:
    """One ignore rule; regexes are full-match, for a file itself and for its directories."""

    pattern: str
    negated: bool
    anchored: bool
    dir_only: bool

    def body(self) -> str:
        if self.anchored:
            return glob_regex(self.pattern)
        return f"(?:(?:.*/)?{glob_regex(self.pattern)}|(?:.*/)?{glob_regex(self.pattern, segment=True)}(?:/.*)?)"

    def regex(self) -> str:
        return rf"(?s)\A{self.body()}{'/.*' if self.dir_only else ''}\z"


def _literal(glob: str) -> str:
    return "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.sub(r"([^\w/])", r"\\\1", c) if c.isascii() else c) for c in glob)


def glob_regex(glob: str, segment: bool = False) -> str:
    """Java regex of a glob: * and ? stay in a segment, ** spans any number of whole ones, at the end anything.

    segment: the form for one path segment, in which ** spans no slash.
    """
    head, two, tail = glob.partition("**")
    if not two:
        return _literal(glob)
    tail = tail.removeprefix("/")
    if not tail:
        return _literal(head) + ("[^/]*" if segment else ".*")
    return _literal(head) + ("" if segment else "(?:.*/)?") + glob_regex(tail, segment)


def parse_rule(line: str) -> Rule | None:
    """! negates; / behind: directories only; / in front or within: anchored; nothing left: no rule."""
    negated = line.startswith("!")
    body = line[negated:]
    dir_only = body.endswith("/")
    body = body.removesuffix("/")
    anchored = body.startswith("/") or "/" in body.removeprefix("/")
    body = body.removeprefix("/")
    return Rule(body, negated, anchored, dir_only) if body else None


def read_rules(text: str | None, builtin: bool = True) -> list[Rule]:
    """Rules of an ignore file, built-in ones first; # only at the start of a line; blanks behind go; no file: built-ins."""
    lines = (BUILTIN if builtin else []) + [x.rstrip() for x in (text or "").splitlines() if not x.startswith("#")]
    return [r for x in lines if (r := parse_rule(x))]


def parsed_rules(lines: DataFrame) -> DataFrame:
    """(rule_idx, pattern, negated, anchored, dir_only) of lines (rule_idx, line), as parse_rule() has them, for large tables."""
    body = F.regexp_replace("line", r"\A!", "")
    bare = F.regexp_replace(body, r"/\z", "")
    inner = F.regexp_replace(bare, r"\A/", "")
    out = lines.select("rule_idx", inner.alias("pattern"), F.startswith("line", F.lit("!")).alias("negated"), (F.startswith(bare, F.lit("/")) | F.contains(inner, F.lit("/"))).alias("anchored"), F.endswith(body, F.lit("/")).alias("dir_only"))
    return out.where("pattern <> ''")


def is_ignored(path: Column, rules: Sequence[Rule]) -> Column:
    """The last rule that matches decides; a negated one takes the path in again. A few rules fold into one expression."""
    out = F.lit(False)
    for rule in rules:
        out = F.when(path.rlike(rule.regex()), F.lit(not rule.negated)).otherwise(out)
    return out


def ignored_by_table(paths: DataFrame, rules: DataFrame, path: str = "rel_path", most: int = 1_000) -> DataFrame:
    """(path, ignored), a row for each row of paths, as is_ignored() for a short table of rules (rule_idx, rx, negated).

    Each path is tried against every rule, so it is an error to have more than `most` rules: ignored_by_index() is for many.
    """
    if rules.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rules")
    names = paths.select(F.col(path).alias("path")).where("path is not null").distinct()
    hit = names.crossJoin(F.broadcast(rules)).where("path rlike rx").groupBy("path").agg(F.max_by(~F.col("negated"), "rule_idx").alias("ignored"))
    out = paths.select(path).join(hit, F.col(path) == hit["path"], "left")
    return out.select(path, F.coalesce("ignored", F.lit(False)).alias("ignored"))


def _literal_text(segment: str) -> bool:
    return "*" not in segment and "?" not in segment


def rule_keys(pattern: str, anchored: bool) -> list[tuple[str, str]]:
    """(kind, key) of all that every path has which the rule matches.

    prefix: the path is this folder or below it, or is this path; segment: one of its segments; ext: what follows the last dot of one;
    head or tail: how one begins or ends, with the number of characters behind the kind. If nothing is sure: any.
    """
    parts = pattern.split("/")
    # what follows a segment such as x** may begin within a segment
    starts = [not (i and parts[i - 1].endswith("**") and parts[i - 1] != "**") for i in range(len(parts))]
    whole = [_literal_text(p) and ok for p, ok in zip(parts, starts, strict=True)]
    lead = next((i for i, ok in enumerate(whole) if not ok), len(parts))
    out = [("prefix", "/".join(parts[:lead]))] if anchored and lead else []
    for part, literal, begins in zip(parts, whole, starts, strict=True):
        head, tail = re.match(r"[^*?]*", part)[0] if begins else "", re.search(r"[^*?]*\Z", part)[0]
        if literal:
            out += [("segment", part)] if part else []
            continue
        out += [("ext", tail.rpartition(".")[2])] if "." in tail else []
        out += [(f"tail{n}", tail[-n:]) for n in KEY_CHARS if len(tail) >= n][:1]
        out += [(f"head{n}", head[:n]) for n in KEY_CHARS if len(head) >= n][:1]
    return list(dict.fromkeys(out)) or [("any", "")]


def path_keys(path: Column, kinds: Sequence[str]) -> Column:
    """Array of (kind, key) of all that a path can be looked up by, of the kinds that rules have."""
    parts = F.split(path, "/", -1)
    each = {
        "prefix": F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")),
        "segment": parts,
        "ext": F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("."))), lambda p: F.substring_index(p, ".", -1)),
        "any": F.array(F.lit("")),
    }
    def ends(n: int) -> dict[str, Column]:
        long = F.filter(parts, lambda p: F.length(p) >= n)
        return {f"head{n}": F.transform(long, lambda p: F.substring(p, 1, n)), f"tail{n}": F.transform(long, lambda p: F.substring(p, -n, n))}

    def tagged_as(kind: str) -> Column:
        return F.transform(each[kind], lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    for n in KEY_CHARS:
        each |= ends(n)
    tagged = [tagged_as(k) for k in sorted(kinds)]
    return F.array_distinct(F.concat(*tagged)) if tagged else F.array().cast("array<struct<kind:string,key:string>>")


def known_rules(rules: DataFrame) -> DataFrame:
    """(rule_idx, negated, rx, keys) of rules (rule_idx, pattern, negated, anchored, dir_only).

    Of rules with the same pattern and flags only the last counts, so those without a key are few, however many there are.
    """

    def derive(pattern: pd.Series, anchored: pd.Series, dir_only: pd.Series) -> pd.DataFrame:
        rows = list(zip(pattern, anchored, dir_only, strict=True))
        return pd.DataFrame({"rx": [Rule(p, False, a, d).regex() for p, a, d in rows], "tags": [[":".join(k) for k in rule_keys(p, a)] for p, a, _ in rows]})

    last = rules.groupBy("pattern", "anchored", "dir_only").agg(F.max(F.struct("rule_idx", "negated")).alias("r"))
    made = last.withColumn("d", F.pandas_udf(derive, "rx string, tags array<string>")("pattern", "anchored", "dir_only"))
    return made.select("r.rule_idx", "r.negated", "d.rx", "d.tags")


def ignored_by_index(paths: DataFrame, rules: DataFrame, path: str = "rel_path") -> DataFrame:
    """paths with `ignored`, as is_ignored() has it, for a table of many rules (of parsed_rules()); every row of paths stays.

    Rules meet paths by equijoins on literal prefixes, segments, extensions, heads and tails: each rule by the one of its keys that the
    fewest paths have, and not at all if none has one of them. A regex is tried only on what meets. Each distinct path is looked up
    once. A null path is not ignored.
    """
    known = staged(known_rules(rules), "rules")
    tags = staged(known.select("rule_idx", F.explode("tags").alias("tag")), "rule-tags")
    kinds = [r[0] for r in tags.select(F.substring_index("tag", ":", 1)).distinct().collect()]  # eleven at most
    names = paths.select(F.col(path).alias("path")).where("path is not null").distinct()
    asked = names.select("path", F.inline(path_keys(F.col("path"), kinds))).select("path", F.concat_ws(":", "kind", "key").alias("tag"))
    asked = asked.join(tags.select("tag").distinct(), "tag", "left_semi")
    counts = staged(asked.groupBy("tag").agg(F.count("*").alias("n")), "rule-counts")
    least = (counts.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE
    hot = [(r["tag"], r["n"]) for r in counts.where(F.col("n") >= max(1.0, least)).orderBy(F.desc("n")).collect()]  # 1/HOT_SHARE at most
    best = tags.join(counts, "tag", "left").groupBy("rule_idx").agg(F.min_by("tag", F.coalesce("n", F.lit(0))).alias("tag"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    index = known.join(best.where("n > 0"), "rule_idx").groupBy("tag").agg(F.collect_list(F.struct("rule_idx", "negated", "rx")).alias("rules"))
    met = hot_join(asked, staged(index, "rule-index"), "tag", ["path"], "inner", hot=hot).select("path", F.explode("rules").alias("r"))
    hits = met.where("path rlike r.rx").groupBy("path").agg(F.max_by(~F.col("r.negated"), "r.rule_idx").alias("ignored"))
    out = paths.join(hits.withColumnRenamed("path", "_path"), F.col(path) == F.col("_path"), "left").drop("_path")
    return out.withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def skip_any_component(path: Column) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP))) | last.rlike(r"(?s)~\z|\.swp\z|\.tmp\z|\A\.#")


def prefix_admits(prefix: Column, path: Column) -> Column:
    """path is prefix or below it, at a component boundary; '' admits all."""
    p = F.regexp_replace(prefix, r"/+\z", "")
    return (p == "") | (path == p) | F.startswith(path, F.concat(p, F.lit("/")))


def is_unsafe_path(path: Column) -> Column:
    return path.rlike(r"(?s)\A/|\\|\A[A-Za-z]:")


def target_fault(path: Column, prefix: Column | None = None) -> Column:
    """Why a path may not be written: dotdot, unsafe or outside; null if it may."""
    out = F.when(F.contains(path, F.lit("..")), "dotdot").when(is_unsafe_path(path), "unsafe")
    return out if prefix is None else out.when(~F.coalesce(prefix_admits(prefix, path), F.lit(True)), "outside")


def either_admits(cap: Column, asked: Column) -> Column:
    return prefix_admits(cap, asked) | prefix_admits(asked, cap)


def has_fragment(path: Column, fragments: Sequence[str]) -> Column:
    out = F.lit(False)
    for f in fragments:
        out = out | F.contains(path, F.lit(f))
    return out


def is_hex64(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-fA-F]{64}\z")


def program_fault(cmd: Column, allowed: Sequence[str]) -> Column:
    """Why a command may not run: empty, nothing_allowed or not_allowed; null if its program's name is allowed."""
    name = F.element_at(F.split(F.element_at(cmd, 1), "/"), -1)
    return F.when(F.coalesce(F.size(cmd), F.lit(0)) <= 0, "empty").when(F.lit(not allowed), "nothing_allowed").when(~name.isin(*allowed) if allowed else F.lit(True), "not_allowed")


def is_safe_job_id(job: Column) -> Column:
    return ~job.rlike(r"(?s)/|\\|\.\.")
