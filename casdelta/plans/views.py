"""Trees, messages and histories made from the tables of a directory; each has its DuckDB form beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1024
EXT = "CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.png' ELSE '' END"
PATH = f"concat(source, '/', lang, '/', doc_id, {EXT})"
CHANGED = "CASE WHEN doc_id % 7 = 0 THEN concat('X', substring(text, 2)) ELSE text END"
TIME_B = "1700000000000 + doc_id * 1000 + CASE WHEN doc_id % 7 = 0 OR doc_id % 13 = 0 THEN 60000 ELSE 0 END"
LOCAL = "CASE WHEN doc_id % 5 = 0 THEN concat(text, ' L') ELSE text END"
TIME_C = "1700000000000 + doc_id * 1000 + CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 30000 ELSE 60000 END ELSE 0 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tree(rows: DataFrame, path: str, text: str, mtime: str) -> DataFrame:
    out = rows.select(F.expr(path).alias("rel_path"), F.expr(text).alias("_text"), F.expr(mtime).cast("long").alias("mtime_ms"))
    content = F.encode(F.coalesce("_text", F.lit("")), "UTF-8")
    return out.where("rel_path is not null").select("rel_path", F.octet_length(content).cast("long").alias("size"), "mtime_ms", F.lit(420).alias("mode"), content.alias("content"))


def objects_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a tree of files."""
    return _tree(table(spark, sf_dir, "documents"), PATH, "text", "1700000000000 + doc_id * 1000")


def objects_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """objects_a after edits, deletions and additions."""
    docs = _tree(table(spark, sf_dir, "documents").where("doc_id % 11 <> 0"), PATH, CHANGED, TIME_B)
    return docs.unionByName(_tree(table(spark, sf_dir, "benchmark"), "concat('new/en/', item_id, '.md')", "text", "1700000000000"))


def objects_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """objects_a after other edits: a tree that has gone its own way."""
    return _tree(table(spark, sf_dir, "documents"), PATH, LOCAL, TIME_C)


def _sql_tree(table_name: str, path: str, text: str, mtime: str, where: str = "true") -> str:
    return f"SELECT {path} AS rel_path, encode(coalesce({text}, '')) AS content, octet_length(encode(coalesce({text}, '')))::BIGINT AS size, ({mtime})::BIGINT AS mtime_ms, 420 AS mode FROM {table_name} WHERE {where}"


SQL_A = _sql_tree("documents", PATH, "text", "1700000000000 + doc_id * 1000")
SQL_B = _sql_tree("documents", PATH, CHANGED, TIME_B, "doc_id % 11 <> 0") + " UNION ALL " + _sql_tree("benchmark", "concat('new/en/', item_id, '.md')", "text", "1700000000000")
SQL_C = _sql_tree("documents", PATH, LOCAL, TIME_C)
TREES = f"objects_a AS ({SQL_A}), objects_b AS ({SQL_B}), objects_c AS ({SQL_C})"


def sql_chunks(tree: str) -> str:
    """(rel_path, idx, cid, len) of a tree, as a CTE body."""
    return (
        f"SELECT rel_path, i::INTEGER AS idx, sha256(content[i * {CHUNK} + 1:(i + 1) * {CHUNK}]) AS cid, "
        f"octet_length(content[i * {CHUNK} + 1:(i + 1) * {CHUNK}])::BIGINT AS len "
        f"FROM (SELECT *, unnest(range(0, ceil(size / {CHUNK}.0)::BIGINT)) AS i FROM {tree})"
    )
