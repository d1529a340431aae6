"""Repositories, loose files and peers, found in tables of paths and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casdelta.functions.rules import LOOSE_FRAGMENTS, REPO_FRAGMENTS, has_fragment, is_hex64


def accepted_keys(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with key, a row for each line that holds a key of 64 hex digits before any #, in lower case; other lines go."""
    out = lines.withColumn("key", F.trim(F.split(line, "#")[0]))
    return out.where(is_hex64(F.col("key"))).withColumn("key", F.lower("key"))


def above(path: Column) -> Column:
    """Array of (depth, dir): the directories above a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n - 1), "/").alias("dir")))


def discover_repos(paths: DataFrame, path: str = "path") -> DataFrame:
    """(repo): folders at the top that hold a .git entry, each once."""
    return paths.where(F.col(path).rlike(r"\A[^/]+/\.git(?:/|\z)")).select(F.split(path, "/")[0].alias("repo")).distinct()


def repo_of(paths: DataFrame, repos: DataFrame, path: str = "rel_path") -> DataFrame:
    """(path, repo): the deepest repository above each path; paths in none are left out. A path equal to a repository is not in it."""
    dirs = paths.select(path, F.inline(above(F.col(path))))
    return dirs.join(repos.select("repo").distinct(), dirs["dir"] == F.col("repo")).groupBy(path).agg(F.max_by("repo", "depth").alias("repo"))


def loose_files(paths: DataFrame, repos: DataFrame, path: str = "rel_path") -> DataFrame:
    """Paths in no repository and without a fragment that loose files leave out."""
    kept = paths.where(~has_fragment(F.concat(F.lit("/"), F.col(path)), LOOSE_FRAGMENTS))
    return kept.join(repo_of(kept, repos, path).select(path), path, "left_anti")


def repo_events(events: DataFrame, path: str = "path") -> DataFrame:
    """Events whose path has no fragment that repositories leave out."""
    return events.where(~has_fragment(F.concat(F.lit("/"), F.col(path)), REPO_FRAGMENTS))


def load_peers(documents: DataFrame, json: str = "json") -> DataFrame:
    """(peer, peerNodeId) of JSON documents; those that lack either, or are no JSON, are left out."""
    return documents.select(F.from_json(json, "peer string, peerNodeId string").alias("p")).select("p.*").dropna()
