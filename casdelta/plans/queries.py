"""Registered queries over whole tables, each with DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casdelta.functions import ids, rules
from casdelta.operators import authz, chunking, conflict, history, jobs, reconcile, repos, tables
from casdelta.plans.views import CHUNK, TREES, objects_a, objects_b, objects_c, sql_chunks, table
from casdelta.sources import files, store
from casdelta.staging import shared_dir
from casdelta.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def cids(tree: DataFrame) -> DataFrame:
    return tree.select("rel_path", ids.content_id(F.col("content")).alias("file_cid"), "size", "mtime_ms", "mode")


SQL_CIDS = ", ".join(f"cid_{x} AS (SELECT rel_path, sha256(content) AS file_cid, size, mtime_ms, mode FROM objects_{x})" for x in "abc")
W = f"WITH {TREES}, {SQL_CIDS} "
SQL_CHUNKS = ", ".join(f"chunks_{x} AS ({sql_chunks(f'objects_{x}')})" for x in "abc")
WC = f"WITH {TREES}, {SQL_CIDS}, {SQL_CHUNKS} "
D3 = "SELECT coalesce(a.rel_path, b.rel_path) AS rel_path, CASE WHEN a.file_cid IS NULL THEN 'create' WHEN b.file_cid IS NULL THEN 'delete' WHEN a.file_cid <> b.file_cid THEN 'modify' ELSE 'unchanged' END AS op FROM cid_a a FULL JOIN cid_b b USING (rel_path)"
IGNORE = ["*.png", "!src1/**", "src2/", "/src3/en/*.md", "**/fr/*.txt"]
# the rules above, written out for SQL: the last one that matches decides
SQL_IGNORED = (
    "CASE WHEN regexp_full_match(rel_path, '(.*/)?fr/[^/]*\\.txt') THEN true WHEN regexp_full_match(rel_path, 'src3/en/[^/]*\\.md') THEN true "
    "WHEN regexp_full_match(rel_path, '(.*/)?src2/.*') THEN true WHEN regexp_full_match(rel_path, 'src1/.*') THEN false "
    "WHEN regexp_full_match(rel_path, '(.*/)?[^/]*\\.png(/.*)?') THEN true ELSE false END"
)


def rule_list() -> list[rules.Rule]:
    return rules.read_rules("\n".join(IGNORE), builtin=False)


# -- sources ---------------------------------------------------------------------------------------------------------


@query(W + f"SELECT rel_path, size, mtime_ms, mode FROM objects_a WHERE NOT {SQL_IGNORED}")
def a1_scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects_a(spark, sf_dir).where(~rules.is_ignored(F.col("rel_path"), rule_list())).drop("content")


@query(W + "SELECT concat('src1/en', substring(rel_path, 8)) AS path, sha256(content) AS file_cid, mtime_ms, mode FROM objects_a WHERE starts_with(rel_path, 'src1/en/')")
def a3_list_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.listing(objects_a(spark, sf_dir), rules.prefix_admits(F.lit("src1/en/"), F.col("rel_path")))


@query(
    W + f"SELECT b.rel_path, a.rel_path IS NOT NULL AS found, sha256(a.content) AS file_cid, ceil(a.size / {CHUNK}.0)::BIGINT AS n_chunks, a.mode, a.mtime_ms "
    "FROM objects_b b LEFT JOIN objects_a a USING (rel_path)"
)
def a4_manifest_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.manifest_of(objects_b(spark, sf_dir), objects_a(spark, sf_dir), CHUNK)


@query(
    "SELECT event_id AS rule_idx, ltrim(CASE WHEN starts_with(l, '!') THEN substring(l, 2) ELSE l END, '/') AS pattern, starts_with(l, '!') AS negated, contains(l, '/') AS anchored, false AS dir_only "
    "FROM (SELECT event_id, concat(CASE WHEN event_id % 3 = 0 THEN '!' ELSE '' END, CASE WHEN event_id % 5 = 0 THEN '/' ELSE '' END, event_type, CASE WHEN event_id % 7 = 0 THEN '/x' ELSE '' END) AS l FROM events)"
)
def a5_parse_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("concat(CASE WHEN event_id % 3 = 0 THEN '!' ELSE '' END, CASE WHEN event_id % 5 = 0 THEN '/' ELSE '' END, event_type, CASE WHEN event_id % 7 = 0 THEN '/x' ELSE '' END)")
    return rules.parsed_rules(table(spark, sf_dir, "events").select(F.col("event_id").alias("rule_idx"), line.alias("line")))


@query("SELECT o_orderkey AS id, lower(trim(split_part(t, '#', 1))) AS key FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat(' ', upper(sha256(o_orderkey::VARCHAR)), ' # root') WHEN 1 THEN '# none' ELSE 'short' END AS t FROM orders) WHERE regexp_full_match(trim(split_part(t, '#', 1)), '[0-9a-fA-F]{64}')")
def a6_read_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper(F.sha2(k.cast("string"), 256)), F.lit(" # root"))).when(k % 3 == 1, "# none").otherwise("short")
    return repos.accepted_keys(table(spark, sf_dir, "orders").select(k.alias("id"), line.alias("line"))).drop("line")


MESSAGES = (
    "messages AS (SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % (n * 3 // 4) END AS reply_token, sha256(user_id::VARCHAR) AS from_id, "
    "concat('sync2/', CASE event_type WHEN 'view' THEN 'have' WHEN 'click' THEN 'list' WHEN 'signup' THEN 'manifest' WHEN 'purchase' THEN 'commit' ELSE 'unknown' END) AS topic, "
    "CASE WHEN event_id % 13 = 0 THEN 'zz' ELSE lower(hex(encode(props))) END AS payload_hex FROM events, (SELECT count(*) AS n FROM events))"
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.floor(F.count("*") * 3 / 4).alias("_n"))))
    kind = F.col("event_type")
    verb = F.when(kind == "view", "have").when(kind == "click", "list").when(kind == "signup", "manifest").when(kind == "purchase", "commit").otherwise("unknown")
    return rows.select(
        "event_id",
        "ts",
        F.when(F.col("event_id") % 11 != 0, F.col("event_id") % F.col("_n")).alias("reply_token"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("from_id"),
        F.concat(F.lit("sync2/"), verb).alias("topic"),
        F.when(F.col("event_id") % 13 == 0, "zz").otherwise(F.lower(F.hex(F.encode("props", "UTF-8")))).alias("payload_hex"),
    )


@query(f"WITH {MESSAGES} SELECT event_id, reply_token, topic FROM messages WHERE reply_token IS NOT NULL AND starts_with(topic, 'sync2/l')")
def a8_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.inbox(messages(spark, sf_dir), "sync2/l").select("event_id", "reply_token", "topic")


REPO_OF = "CASE WHEN doc_id % 9 = 0 THEN source WHEN doc_id % 9 = 1 THEN concat(source, '/', lang) END"


def repo_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source in ('src1', 'src2', 'src7')")
    return rows.select(F.expr(REPO_OF).alias("repo")).where("repo is not null").distinct()


SQL_REPOS = f"repos AS (SELECT DISTINCT {REPO_OF} AS repo FROM documents WHERE source IN ('src1', 'src2', 'src7') AND {REPO_OF} IS NOT NULL)"


def sql_fragments(path: str, fragments: list[str]) -> str:
    return "(" + " OR ".join(f"contains({path}, '{f}')" for f in fragments) + ")"


ODD_PATH = "CASE WHEN size % 9 = 0 THEN concat(rel_path, '/target-x') WHEN size % 7 = 0 THEN concat('x/tmp/', rel_path) WHEN size % 5 = 0 THEN concat('y/.gitx/', rel_path) ELSE rel_path END"


@query(W + f", {SQL_REPOS}, odd AS (SELECT {ODD_PATH} AS rel_path FROM objects_a) SELECT rel_path FROM odd WHERE NOT {sql_fragments("concat('/', rel_path)", rules.LOOSE_FRAGMENTS)} AND NOT EXISTS (SELECT 1 FROM repos WHERE starts_with(rel_path, concat(repo, '/')))")
def a9_loose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repos.loose_files(objects_a(spark, sf_dir).select(F.expr(ODD_PATH).alias("rel_path")), repo_roots(spark, sf_dir))


@query("SELECT DISTINCT split_part(p, '/', 1) AS repo FROM (SELECT concat(source, '/', CASE WHEN doc_id % 5 = 0 THEN '.git/HEAD' ELSE lang END) AS p FROM documents) WHERE regexp_matches(p, '^[^/]+/\\.git(/|$)')")
def a10_discover_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("concat(source, '/', CASE WHEN doc_id % 5 = 0 THEN '.git/HEAD' ELSE lang END)")
    return repos.discover_repos(table(spark, sf_dir, "documents").select(path.alias("path")))


@query(W + f", {SQL_REPOS} SELECT rel_path, arg_max(repo, length(repo)) AS repo FROM objects_a JOIN repos ON starts_with(rel_path, concat(repo, '/')) GROUP BY rel_path")
def a11_repo_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repos.repo_of(objects_a(spark, sf_dir).select("rel_path"), repo_roots(spark, sf_dir))


@query("SELECT c_name AS peer, sha256(c_custkey::VARCHAR) AS peerNodeId FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 <> 0")
def a12_load_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    doc = F.to_json(F.struct(F.when(k % 4 != 0, F.col("c_name")).alias("peer"), F.when(k % 5 != 0, F.sha2(k.cast("string"), 256)).alias("peerNodeId")))
    return repos.load_peers(table(spark, sf_dir, "customer").select(doc.alias("json")))


# -- chunking --------------------------------------------------------------------------------------------------------


@query(WC + "SELECT c.cid, any_value(c.len) AS len FROM chunks_b c ANTI JOIN chunks_a a ON a.cid = c.cid GROUP BY c.cid")
def b1_upload_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = chunking.chunk(objects_b(spark, sf_dir), CHUNK)
    held = chunking.chunk(objects_a(spark, sf_dir), CHUNK, payload=False)
    lacking = reconcile.missing(new.select("cid", F.col("idx").alias("pos")), held)
    return reconcile.upload_missing(new, lacking).select("cid", F.octet_length("bytes").cast("long").alias("len"))


def store_of(spark: SparkSession, tree: DataFrame) -> str:
    """A new store with the tree's chunks, in the shared folder."""
    root = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    store.upload(chunking.chunk(tree, CHUNK), root, dry_run=False)
    return root


@query(WC + "SELECT 'first' AS upload, (SELECT count(DISTINCT cid) FROM chunks_a) AS written, (SELECT count(DISTINCT cid) FROM chunks_a) AS held UNION ALL SELECT 'second', (SELECT count(*) FROM (SELECT cid FROM chunks_b EXCEPT SELECT cid FROM chunks_a)), (SELECT count(*) FROM (SELECT cid FROM chunks_b UNION SELECT cid FROM chunks_a)) UNION ALL SELECT 'again', 0, (SELECT count(*) FROM (SELECT cid FROM chunks_b UNION SELECT cid FROM chunks_a))")
def b1_upload_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each upload writes to a store, and what the store has afterwards."""
    root, out = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}", []
    for name, tree in (("first", objects_a), ("second", objects_b), ("again", objects_b)):
        done = store.upload(chunking.chunk(tree(spark, sf_dir), CHUNK), root, dry_run=False)
        out.append((name, done.rows, store.stored(spark, root).select("cid").distinct().count()))
    return spark.createDataFrame(out, "upload string, written long, held long")


def exported(spark: SparkSession, sf_dir: str) -> str:
    """A folder on a mount, below the shared one, with objects_a as plain files."""
    root = f"{shared_dir(spark).removeprefix('file://')}/tree-{uuid.uuid4().hex}"
    store.export(objects_a(spark, sf_dir), root, dry_run=False)
    return root


@query(W + "SELECT rel_path, size FROM objects_a")
def b3_export_and_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects written as plain files, all or none, and found again by a scan of the tree."""
    return files.scan_tree(spark, exported(spark, sf_dir)).select("rel_path", "size")


@query(WC + "SELECT rel_path, idx, cid, len, NULL AS file_cid FROM chunks_a UNION ALL SELECT rel_path, -1, NULL, NULL, sha256(content) FROM objects_a")
def a2_read_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of plain files, read piece by piece, with each file's own id on a row behind them."""
    return files.read_chunks(files.scan_tree(spark, exported(spark, sf_dir)), CHUNK)


@query(W + "SELECT rel_path, file_cid, size, mtime_ms, mode FROM cid_b")
def a7_load_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that was saved last, of two in one session."""
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    for tree in (objects_a, objects_b):
        files.save_index(index_of(tree(spark, sf_dir)), root, "s")
    return files.load_index(spark, root, "s").select("rel_path", "file_cid", "size", "mtime_ms", "mode")


@query(W + f", plan AS ({D3}) SELECT p.rel_path, p.op, CASE WHEN p.op = 'delete' THEN 0 ELSE ceil(b.size / {CHUNK}.0)::BIGINT END AS n_chunks FROM plan p LEFT JOIN objects_b b USING (rel_path) WHERE p.op <> 'unchanged'")
def b7_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.dry_run(index_of(objects_a(spark, sf_dir)), index_of(objects_b(spark, sf_dir)))


@query(
    W + "SELECT coalesce(a.rel_path, b.rel_path) AS rel_path, coalesce(b.file_cid, a.file_cid) AS file_cid FROM cid_a a FULL JOIN (SELECT * FROM cid_b WHERE rel_path NOT LIKE 'src4/%') b ON a.rel_path = b.rel_path "
    "WHERE coalesce(a.rel_path, b.rel_path) NOT LIKE 'src4/%'"
)
def b4_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = cids(objects_a(spark, sf_dir)).select("rel_path", "file_cid")
    put = cids(objects_b(spark, sf_dir)).where("rel_path not like 'src4/%'").select("rel_path", "file_cid", F.lit("put").alias("op"))
    drop = state.where("rel_path like 'src4/%'").withColumn("op", F.lit("delete"))
    return reconcile.upsert(state, put.unionByName(drop))


@query(W + "SELECT a.rel_path, b.file_cid AS base FROM cid_a a LEFT JOIN cid_b b USING (rel_path)")
def b5_base_cid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.set_base(objects_a(spark, sf_dir).select("rel_path"), cids(objects_b(spark, sf_dir)))


@query(W + "SELECT rel_path, sha256(content) AS file_cid, size FROM objects_b UNION ALL SELECT rel_path, sha256(content), size FROM objects_a WHERE rel_path NOT IN (SELECT rel_path FROM objects_b) AND mtime_ms % 2000 <> 0")
def b6_put_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = objects_a(spark, sf_dir).select("rel_path", "content")
    put = objects_b(spark, sf_dir).select("rel_path", ids.from_hex(F.hex("content")).alias("content"), F.lit("put").alias("op"))
    gone = objects_a(spark, sf_dir).where("mtime_ms % 2000 = 0").select("rel_path", "content").join(put.select("rel_path"), "rel_path", "left_anti").withColumn("op", F.lit("delete"))
    done = reconcile.upsert(state, put.unionByName(gone))
    return done.select("rel_path", ids.content_id(F.col("content")).alias("file_cid"), F.octet_length("content").cast("long").alias("size"))


@query(W + "SELECT rel_path, file_cid FROM cid_b UNION ALL SELECT rel_path, file_cid FROM cid_a WHERE rel_path NOT IN (SELECT rel_path FROM cid_b)")
def b8_put_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = reconcile.put_base(objects_a(spark, sf_dir).select("rel_path", "content"), objects_b(spark, sf_dir))
    return done.select("rel_path", ids.content_id(F.col("content")).alias("file_cid"))


@query(W + "SELECT rel_path, file_cid, size FROM cid_a")
def c1_content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cids(objects_a(spark, sf_dir)).select("rel_path", "file_cid", "size")


@query(WC + "SELECT * FROM chunks_a")
def c2_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(objects_a(spark, sf_dir), CHUNK, payload=False)


@query(
    WC + f"SELECT o.rel_path, 'object-v1' AS kind, sha256(o.content) AS file_cid, {CHUNK}::BIGINT AS chunk_size, o.size AS total_size, coalesce(m.chunks, '') AS chunks "
    "FROM objects_a o LEFT JOIN (SELECT rel_path, string_agg(cid, ',' ORDER BY idx) AS chunks FROM chunks_a GROUP BY rel_path) m USING (rel_path)"
)
def c3_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.manifests(objects_a(spark, sf_dir), CHUNK).withColumn("chunks", F.array_join("chunks", ","))


@query(W + "SELECT rel_path, 'ok' AS status, sha256(content) AS content_cid FROM objects_a")
def c5_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = objects_a(spark, sf_dir)
    done = chunking.reassemble(chunking.manifests(tree, CHUNK), chunking.chunk(tree, CHUNK), all_wanted=True)
    return done.select("rel_path", "status", ids.content_id(F.col("content")).alias("content_cid"))


ZEROS = "SELECT concat('zero/', rel_path) AS rel_path, encode(repeat('0', {CHUNK} * (3 + (size % 3)::INTEGER))) || content AS content FROM objects_a"


@query(W + f", zeros AS ({ZEROS.format(CHUNK=CHUNK)}) SELECT rel_path, 'ok' AS status, sha256(content) AS content_cid FROM zeros")
def c5_reassemble_hot_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file begins with the same block some times over, so one chunk is most of all chunks."""
    zeros = F.encode(F.repeat(F.lit("0"), (F.lit(3) + F.col("size") % 3).cast("int") * CHUNK), "UTF-8")
    tree = objects_a(spark, sf_dir).select(F.concat(F.lit("zero/"), "rel_path").alias("rel_path"), F.concat(zeros, "content").alias("content"))
    done = chunking.reassemble(chunking.manifests(tree, CHUNK), chunking.chunk(tree, CHUNK), all_wanted=True)
    return done.select("rel_path", "status", ids.content_id(F.col("content")).alias("content_cid"))


@query(
    WC + "SELECT b.rel_path, CASE WHEN bool_or(c.cid IS NOT NULL AND a.cid IS NULL) THEN 'missing_chunk' ELSE 'ok' END AS status, "
    "CASE WHEN NOT bool_or(c.cid IS NOT NULL AND a.cid IS NULL) THEN sha256(any_value(b.content)) END AS content_cid FROM objects_b b LEFT JOIN chunks_b c USING (rel_path) LEFT JOIN (SELECT DISTINCT cid FROM chunks_a) a ON a.cid = c.cid GROUP BY b.rel_path"
)
def c6_apply_commit_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = chunking.chunk(objects_a(spark, sf_dir), CHUNK)
    done = chunking.reassemble(chunking.manifests(objects_b(spark, sf_dir), CHUNK), held)
    return done.select("rel_path", "status", ids.content_id(F.col("content")).alias("content_cid"))


TREE_SQL = "sha256(string_agg(concat(rel_path, chr(0), file_cid, chr(0), size, chr(10)), '' ORDER BY rel_path, file_cid, size))"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cids(objects_a(spark, sf_dir)).select(F.split("rel_path", "/")[0].alias("tree_id"), F.col("rel_path").alias("path"), "file_cid", "size")


@query(W + f"SELECT split_part(rel_path, '/', 1) AS tree_id, {TREE_SQL} AS tree_cid, count(*) AS n FROM cid_a GROUP BY 1")
def c7_tree_cid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.tree_cids(entries(spark, sf_dir))


@query(W + f"SELECT split_part(rel_path, '/', 1) AS tree_id, {TREE_SQL} AS tree_cid, count(*) AS n FROM cid_a GROUP BY 1")
def c8_large_tree_cid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.large_tree_cids(entries(spark, sf_dir))


@query(W + "SELECT DISTINCT file_cid FROM cid_a")
def c9_file_cids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.file_cids(cids(objects_a(spark, sf_dir)))


@query("SELECT c_custkey AS id, substring(sha256(concat(c_name, ':', c_nationkey, ':', c_mktsegment)), 1, 16) AS session FROM customer")
def c10_session_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ids.session_id(F.col("c_name"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("session"))


# -- delta and reconcile ---------------------------------------------------------------------------------------------


@query(W + "SELECT b.rel_path, coalesce(a.size = b.size AND a.mtime_ms = b.mtime_ms, false) AS unchanged FROM objects_b b LEFT JOIN objects_a a USING (rel_path)")
def d1_is_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.mark_unchanged(objects_b(spark, sf_dir), objects_a(spark, sf_dir)).select("rel_path", "unchanged")


def index_of(tree: DataFrame) -> DataFrame:
    made = chunking.manifests(tree, CHUNK).select("rel_path", "file_cid", "chunks")
    return made.join(tree.drop("content"), "rel_path").select(reconcile.INDEX)


@query(
    W + "SELECT b.rel_path, CASE WHEN a.size = b.size AND a.mtime_ms = b.mtime_ms THEN a.file_cid ELSE b.file_cid END AS file_cid, b.size, b.mtime_ms, "
    f"ceil(b.size / {CHUNK}.0)::BIGINT AS n_chunks FROM cid_b b LEFT JOIN cid_a a USING (rel_path)"
)
def d2_build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reconcile.build_index(objects_b(spark, sf_dir), index_of(objects_a(spark, sf_dir)), CHUNK)
    return made.select("rel_path", "file_cid", "size", "mtime_ms", F.size("chunks").cast("long").alias("n_chunks"))


@query(W + D3)
def d3_reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.plan(cids(objects_a(spark, sf_dir)), cids(objects_b(spark, sf_dir))).select("rel_path", "op")


def positions(tree: DataFrame) -> DataFrame:
    """(cid, pos): chunk ids with a place that follows path and index within documents of under a million chunks."""
    key = F.regexp_extract("rel_path", r"([0-9]+)(?:\.[a-z]+)?\z", 1).cast("long")
    return chunking.chunk(tree, CHUNK, payload=False).select("cid", (key * 1_000_000 + F.col("idx")).alias("pos"))


SQL_POS = "(regexp_extract(rel_path, '([0-9]+)(?:\\.[a-z]+)?$', 1)::BIGINT * 1000000 + idx)"


@query(WC + f"SELECT b.cid, min({SQL_POS}) AS pos FROM chunks_b b ANTI JOIN chunks_a a ON a.cid = b.cid GROUP BY b.cid")
def d4_compute_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.missing(positions(objects_b(spark, sf_dir)), positions(objects_a(spark, sf_dir)))


@query(WC + f"SELECT b.cid, min({SQL_POS}) AS pos FROM chunks_b b ANTI JOIN chunks_a a ON a.cid = b.cid GROUP BY b.cid")
def d4_missing_in_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As d4_compute_missing, against a store written by id prefix, of which only what the request names is read."""
    asked = positions(objects_b(spark, sf_dir))
    kept = store.stored(spark, store_of(spark, objects_a(spark, sf_dir)))
    return reconcile.missing(asked, store.held(kept, asked))


@query(WC + f"SELECT b.cid, min({SQL_POS}) AS pos FROM chunks_b b SEMI JOIN chunks_c c ON c.cid = b.cid GROUP BY b.cid")
def d5_plan_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.transfer(positions(objects_b(spark, sf_dir)), positions(objects_c(spark, sf_dir)))


@query(WC + f"SELECT a.cid, min({SQL_POS}) AS pos FROM chunks_a a ANTI JOIN chunks_c c ON c.cid = a.cid GROUP BY a.cid")
def d6_plan_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.missing(positions(objects_a(spark, sf_dir)), positions(objects_c(spark, sf_dir)))


@query(
    WC + ", lacking AS (SELECT rel_path, cid, min(idx) AS i FROM chunks_b WHERE cid NOT IN (SELECT cid FROM chunks_a) GROUP BY rel_path, cid) "
    "SELECT o.rel_path AS request_id, coalesce(string_agg(l.cid, ',' ORDER BY l.i), '') AS missing FROM objects_b o LEFT JOIN lacking l USING (rel_path) GROUP BY o.rel_path"
)
def d7_have(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = chunking.manifests(objects_b(spark, sf_dir), CHUNK).select(F.col("rel_path").alias("request_id"), F.col("chunks").alias("cids"))
    store = chunking.chunk(objects_a(spark, sf_dir), CHUNK, payload=False)
    return reconcile.have(asked, store).withColumn("missing", F.array_join("missing", ","))


D8 = (
    ", owners AS (SELECT cid, min(rel_path) AS rel_path FROM chunks_b WHERE cid NOT IN (SELECT cid FROM chunks_a) GROUP BY cid), "
    "new AS (SELECT rel_path, count(*) AS n FROM owners GROUP BY rel_path), total AS (SELECT rel_path, count(*) AS n FROM chunks_b GROUP BY rel_path) "
    "SELECT o.rel_path, coalesce(t.n, 0)::BIGINT AS n_chunks, coalesce(n.n, 0)::BIGINT AS n_new FROM objects_b o LEFT JOIN total t USING (rel_path) LEFT JOIN new n USING (rel_path)"
)


@query(WC + D8)
def d8_push_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, a = objects_b(spark, sf_dir), objects_a(spark, sf_dir)
    return reconcile.push_plan(chunking.chunk(b, CHUNK, payload=False), b, chunking.chunk(a, CHUNK, payload=False))


PULLED = (
    ", held AS (SELECT DISTINCT rel_path, cid FROM chunks_a {where}), fetched AS (SELECT o.rel_path, count(DISTINCT CASE WHEN h.cid IS NULL THEN c.cid END) AS n_fetched "
    "FROM objects_b o LEFT JOIN chunks_b c USING (rel_path) LEFT JOIN held h ON h.rel_path = c.rel_path AND h.cid = c.cid GROUP BY o.rel_path), "
    "avail AS ({avail}), rebuilt AS (SELECT o.rel_path, CASE WHEN bool_or(c.cid IS NOT NULL AND v.cid IS NULL) THEN 'missing_chunk' ELSE 'ok' END AS status "
    "FROM objects_b o LEFT JOIN chunks_b c USING (rel_path) LEFT JOIN avail v ON v.cid = c.cid GROUP BY o.rel_path), "
    "pulled AS (SELECT f.rel_path, f.n_fetched, r.status, CASE WHEN r.status = 'ok' THEN b.file_cid END AS content_cid FROM fetched f JOIN rebuilt r USING (rel_path) JOIN cid_b b USING (rel_path)) "
)
READABLE = PULLED.format(where="WHERE idx <> 0", avail="SELECT cid FROM chunks_a WHERE idx <> 0 UNION SELECT cid FROM chunks_b")
LACKING = PULLED.format(where="", avail="SELECT cid FROM chunks_a WHERE idx <> 0 UNION SELECT cid FROM chunks_b WHERE idx <> 2")
ONE_SHOT = PULLED.format(where="WHERE false", avail="SELECT cid FROM chunks_b WHERE idx <> 2")


def pulled(spark: SparkSession, sf_dir: str, remote: str = "true", held: str = "true", readable: bool = True) -> DataFrame:
    """objects_b pulled over objects_a, whose first chunks are known but not readable."""
    mine = chunking.chunk(objects_a(spark, sf_dir), CHUNK).where(held)
    mine = mine.withColumn("bytes", F.when(F.col("idx") != 0, F.col("bytes")))
    theirs = chunking.chunk(objects_b(spark, sf_dir), CHUNK).where(remote)
    done = reconcile.pull_files(chunking.manifests(objects_b(spark, sf_dir), CHUNK), mine, theirs, readable)
    return done.select("rel_path", "n_fetched", "status", ids.content_id(F.col("content")).alias("content_cid"))


@query(WC + READABLE + "SELECT * FROM pulled")
def d9_pull_with_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulled(spark, sf_dir)


@query(WC + LACKING + "SELECT * FROM pulled")
def d10_pull_file_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulled(spark, sf_dir, "idx <> 2", readable=False)


@query(W + "SELECT b.rel_path, b.file_cid, coalesce(c.file_cid IS DISTINCT FROM a.file_cid AND c.file_cid IS DISTINCT FROM b.file_cid AND c.file_cid IS NOT NULL, false) AS refused FROM cid_b b LEFT JOIN cid_a a USING (rel_path) LEFT JOIN cid_c c USING (rel_path) WHERE b.file_cid IS DISTINCT FROM a.file_cid")
def d11_pull_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (cids(f(spark, sf_dir)) for f in (objects_a, objects_b, objects_c))
    return reconcile.pull_plan(b, a, c)


@query(
    WC + LACKING + "SELECT coalesce(a.rel_path, p.rel_path) AS rel_path, coalesce(p.content_cid, a.file_cid) AS file_cid, coalesce(p.size, a.size) AS size, coalesce(p.mtime_ms, a.mtime_ms) AS mtime_ms, 420 AS mode, "
    f"ceil(coalesce(p.size, a.size) / {CHUNK}.0)::BIGINT AS n_chunks, coalesce(p.content_cid, a.file_cid) AS base "
    "FROM cid_a a FULL JOIN (SELECT p.*, b.size, b.mtime_ms FROM pulled p JOIN objects_b b USING (rel_path) LEFT JOIN cid_a USING (rel_path) WHERE p.content_cid IS DISTINCT FROM cid_a.file_cid AND p.status = 'ok') p ON p.rel_path = a.rel_path"
)
def d12_pull_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = index_of(objects_a(spark, sf_dir)), index_of(objects_b(spark, sf_dir))
    wanted = reconcile.pull_plan(b, a).select("rel_path")
    done = pulled(spark, sf_dir, "idx <> 2", readable=False).select("rel_path", "status").join(wanted, "rel_path", "left_semi").join(b, "rel_path")
    after = reconcile.pull_apply(a.withColumn("base", F.col("file_cid")), done)
    return after.select("rel_path", "file_cid", "size", "mtime_ms", "mode", F.size("chunks").cast("long").alias("n_chunks"), "base")


@query(WC + ONE_SHOT + "SELECT rel_path, n_fetched, status, 420 AS mode, content_cid FROM pulled UNION ALL SELECT a.rel_path, NULL, 'absent', NULL, NULL FROM objects_a a ANTI JOIN objects_b b ON b.rel_path = a.rel_path")
def d13_pull_one_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths of both trees are asked for at the side that has objects_b, whose third chunks are gone."""
    b = objects_b(spark, sf_dir)
    asked = objects_a(spark, sf_dir).select("rel_path").union(b.select("rel_path"))
    remote = chunking.manifests(b, CHUNK, keep=("mode",))
    done = reconcile.pull_one_shot(asked, remote, chunking.chunk(b, CHUNK).where("idx <> 2"), strict=False)
    return done.select("rel_path", "n_fetched", "status", "mode", ids.content_id(F.col("content")).alias("content_cid"))


SQL_CONFLICT = "coalesce(l IS NOT NULL AND l <> i AND (coalesce(b, '') = '' OR l <> b), false)"
COMMITS = (
    W + ", joined AS (SELECT rel_path, c.file_cid AS l, c.mtime_ms AS lm, b.file_cid AS i, b.mtime_ms AS im, a.file_cid AS b, "
    "CASE regexp_extract(rel_path, '([0-9]+)(?:\\.[a-z]+)?$', 1)::BIGINT % 3 WHEN 0 THEN 'lww' WHEN 1 THEN 'copy' ELSE 'crdt' END AS policy "
    f"FROM cid_b b LEFT JOIN cid_c c USING (rel_path) LEFT JOIN cid_a a USING (rel_path)), judged AS (SELECT *, {SQL_CONFLICT} AS conflict, "
    "coalesce(im > lm OR (im = lm AND i > l), false) AS newer FROM joined), decided AS (SELECT *, CASE WHEN NOT conflict OR (policy <> 'copy' AND newer) THEN 'take' ELSE 'keep' END AS action FROM judged), "
    "named AS (SELECT *, CASE WHEN conflict THEN concat(regexp_replace(rel_path, '\\.[a-z]+$', ''), '.conflict-peer01-', (CASE WHEN action = 'take' THEN lm ELSE im END) // 1000, regexp_extract(rel_path, '(\\.[a-z]+)$', 1)) END AS conflict_copy FROM decided) "
)


# objects_b edits the first line and objects_c the last: with a line between them both edits stand
MERGES = COMMITS.rstrip() + (
    ", texts AS (SELECT b.rel_path, decode(a.content) AS tb, decode(b.content) AS ti, decode(c.content) AS tl FROM objects_b b JOIN objects_a a USING (rel_path) JOIN objects_c c USING (rel_path)), "
    "merges AS (SELECT rel_path, CASE WHEN tl = ti OR ti = tb THEN tl WHEN tl = tb THEN ti WHEN length(tb) - length(replace(tb, chr(10), '')) >= 2 THEN concat('X', substring(tl, 2)) END AS m FROM texts), "
    "used AS (SELECT n.*, m, coalesce(policy = 'crdt' AND conflict AND regexp_matches(n.rel_path, '\\.(md|txt)$') AND m IS NOT NULL, false) AS use FROM named n LEFT JOIN merges USING (rel_path)), "
    "answers AS (SELECT rel_path, use OR action = 'take' AS applied, conflict, use AS merged, CASE WHEN use THEN sha256(m) WHEN action = 'take' THEN i ELSE l END AS remote_cid, CASE WHEN use THEN greatest(lm, im) WHEN action = 'take' THEN im ELSE lm END AS remote_mtime_ms, i, CASE WHEN NOT use THEN conflict_copy END AS conflict_copy FROM used) "
)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """objects_b as incoming, objects_c as local, objects_a as base."""
    local = cids(objects_c(spark, sf_dir)).select("rel_path", F.col("file_cid").alias("local_cid"), F.col("mtime_ms").alias("local_mtime_ms"))
    base = cids(objects_a(spark, sf_dir)).select("rel_path", F.col("file_cid").alias("base_cid"))
    new = cids(objects_b(spark, sf_dir)).select("rel_path", F.col("file_cid").alias("incoming_cid"), F.col("mtime_ms").alias("incoming_mtime_ms"))
    key = F.regexp_extract("rel_path", r"([0-9]+)(?:\.[a-z]+)?\z", 1).cast("long") % 3
    policy = F.when(key == 0, "lww").when(key == 1, "copy").otherwise("crdt")
    return new.join(local, "rel_path", "left").join(base, "rel_path", "left").select("*", policy.alias("policy"), F.lit("peer01").alias("short"))


def with_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commits() with base, local and incoming bytes."""
    a, b, c = (f(spark, sf_dir).select("rel_path", F.col("content").alias(n)) for f, n in ((objects_a, "base"), (objects_b, "incoming"), (objects_c, "local")))
    return commits(spark, sf_dir).join(a, "rel_path", "left").join(b, "rel_path", "left").join(c, "rel_path", "left")


def rebuilt_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = objects_b(spark, sf_dir)
    return chunking.reassemble(chunking.manifests(b, CHUNK), chunking.chunk(b, CHUNK)).select("rel_path", "status")


@query(
    MERGES + "SELECT rel_path, CASE WHEN merged THEN remote_cid ELSE i END AS file_cid, CASE WHEN merged THEN remote_cid WHEN NOT conflict OR applied THEN i ELSE remote_cid END AS base, false AS error FROM answers WHERE rel_path NOT LIKE 'src6/%' "
    "UNION ALL SELECT a.rel_path, a.file_cid, a.file_cid, n.rel_path IS NOT NULL FROM cid_a a LEFT JOIN answers n USING (rel_path) WHERE n.rel_path IS NULL OR rel_path LIKE 'src6/%'"
)
def d14_push_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conflict.commit_batch(with_bytes(spark, sf_dir), rebuilt_b(spark, sf_dir)).drop("conflict_copy")
    rows = rows.withColumn("ok", ~F.col("rel_path").like("src6/%"))
    index = cids(objects_a(spark, sf_dir)).select("rel_path", "file_cid", F.col("file_cid").alias("base"))
    return reconcile.push_apply(index, cids(objects_b(spark, sf_dir)).select("rel_path", "file_cid"), rows)


@query(WC + f", plan AS ({D3}), moved AS ({D8.split('SELECT o.rel_path', 1)[0].removeprefix(', ').join(['WITH ', ''])} SELECT rel_path, n FROM new) SELECT p.op, count(*) AS n_files, coalesce(sum(m.n), 0)::BIGINT AS n_new FROM plan p LEFT JOIN moved m USING (rel_path) GROUP BY p.op")
def d15_push_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = objects_a(spark, sf_dir), objects_b(spark, sf_dir)
    return reconcile.push_counts(cids(a), cids(b), chunking.chunk(b, CHUNK, payload=False), chunking.chunk(a, CHUNK, payload=False))


PUSHED = (
    W.rstrip() + f", plan AS ({D3}), joined AS (SELECT b.rel_path, c.file_cid AS l, c.mtime_ms AS lm, b.file_cid AS i, b.mtime_ms AS im, a.file_cid AS b FROM cid_b b JOIN plan p ON p.rel_path = b.rel_path AND p.op IN ('create', 'modify') "
    f"LEFT JOIN cid_c c ON c.rel_path = b.rel_path LEFT JOIN cid_a a ON a.rel_path = b.rel_path), judged AS (SELECT *, {SQL_CONFLICT} AS conflict, coalesce(im > lm OR (im = lm AND i > l), false) AS newer FROM joined), "
    "written AS (SELECT rel_path, CASE WHEN NOT conflict OR newer THEN i ELSE l END AS cid, CASE WHEN NOT conflict OR newer THEN im ELSE lm END AS mtime_ms FROM judged UNION ALL "
    "SELECT concat(regexp_replace(rel_path, '\\.[a-z]+$', ''), '.conflict-peer01-', (CASE WHEN newer THEN lm ELSE im END) // 1000, regexp_extract(rel_path, '(\\.[a-z]+)$', 1)), CASE WHEN newer THEN l ELSE i END, CASE WHEN newer THEN lm ELSE im END FROM judged WHERE conflict), "
    "gone AS (SELECT p.rel_path FROM plan p JOIN cid_a a USING (rel_path) LEFT JOIN cid_c c USING (rel_path) WHERE p.op = 'delete' AND NOT coalesce(c.file_cid <> a.file_cid, false)) "
)


def pushed(spark: SparkSession, sf_dir: str) -> reconcile.Push:
    """objects_b pushed by one whose index has objects_a, to one who has gone on to objects_c."""
    index = index_of(objects_a(spark, sf_dir)).withColumn("base", F.col("file_cid"))
    files = objects_c(spark, sf_dir).select("rel_path", ids.content_id(F.col("content")).alias("cid"), "mtime_ms", "content")
    store_ = chunking.chunk(objects_a(spark, sf_dir), CHUNK, payload=False).select("cid")
    return reconcile.push_once(objects_b(spark, sf_dir), index, files, store_, CHUNK, short="peer01")


@query(PUSHED + "SELECT coalesce(w.rel_path, c.rel_path) AS rel_path, coalesce(w.cid, c.file_cid) AS cid, coalesce(w.mtime_ms, c.mtime_ms) AS mtime_ms, coalesce(w.cid, c.file_cid) AS content_cid FROM cid_c c FULL JOIN written w ON w.rel_path = c.rel_path WHERE coalesce(w.rel_path, c.rel_path) NOT IN (SELECT rel_path FROM gone)")
def d15_push_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receiver's files after one whole push: index, plan, upload, commit, delete."""
    return pushed(spark, sf_dir).files.select("rel_path", "cid", "mtime_ms", ids.content_id(F.col("content")).alias("content_cid"))


@query(
    PUSHED + "SELECT coalesce(j.rel_path, a.rel_path) AS rel_path, coalesce(j.i, a.file_cid) AS file_cid, CASE WHEN j.rel_path IS NULL THEN a.file_cid WHEN NOT conflict OR newer THEN i ELSE l END AS base "
    "FROM cid_a a FULL JOIN judged j ON j.rel_path = a.rel_path WHERE coalesce(j.rel_path, a.rel_path) NOT IN (SELECT rel_path FROM gone)"
)
def d15_push_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sender's index after the same push."""
    return pushed(spark, sf_dir).index.select("rel_path", "file_cid", "base")


@query(WC + "SELECT DISTINCT cid FROM chunks_b WHERE cid NOT IN (SELECT cid FROM chunks_a)")
def d15_push_uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the same push moves; each is what its id says."""
    done = pushed(spark, sf_dir).uploaded
    return done.where(ids.content_id(F.col("bytes")) == F.col("cid")).select("cid")


# -- conflicts -------------------------------------------------------------------------------------------------------


@query(COMMITS + "SELECT rel_path, conflict FROM named")
def e1_is_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.resolve(commits(spark, sf_dir)).select("rel_path", "conflict")


@query(COMMITS + "SELECT rel_path, policy, action, conflict_copy FROM named")
def e2_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.resolve(commits(spark, sf_dir)).select("rel_path", "policy", "action", "conflict_copy")


@query(W + "SELECT rel_path, b.mtime_ms > c.mtime_ms OR (b.mtime_ms = c.mtime_ms AND b.file_cid > c.file_cid) AS incoming_wins FROM cid_b b JOIN cid_c c USING (rel_path)")
def e3_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commits(spark, sf_dir).where("local_cid is not null")
    return rows.select("rel_path", conflict.incoming_wins(*map(F.col, ("local_cid", "local_mtime_ms", "incoming_cid", "incoming_mtime_ms"))).alias("incoming_wins"))


@query(W + "SELECT rel_path, concat(regexp_replace(rel_path, '\\.[a-z]+$', ''), '.conflict-abc123-', mtime_ms // 1000, regexp_extract(rel_path, '(\\.[a-z]+)$', 1)) AS copy_name FROM objects_a")
def e4_copy_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects_a(spark, sf_dir).select("rel_path", conflict.copy_name(F.col("rel_path"), F.lit("abc123"), F.col("mtime_ms")).alias("copy_name"))


@query(W + "SELECT rel_path, regexp_matches(rel_path, '\\.(md|txt)$') AS mergeable FROM objects_a")
def e5_is_mergeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects_a(spark, sf_dir).select("rel_path", conflict.is_mergeable(F.col("rel_path")).alias("mergeable"))


@query(MERGES + "SELECT rel_path, CASE WHEN m IS NULL THEN 'conflict' ELSE 'clean' END AS status, sha256(m) AS merged_cid FROM merges")
def e6_merge3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_bytes(spark, sf_dir).where("base is not null and local is not null")
    return conflict.merge3(rows).select("rel_path", "status", F.sha2("merged", 256).alias("merged_cid"))


@query(MERGES + "SELECT rel_path, policy, conflict, CASE WHEN use THEN 'merged' ELSE action END AS action, CASE WHEN NOT use THEN conflict_copy END AS conflict_copy, CASE WHEN use THEN sha256(m) END AS merged_cid FROM used")
def e7_resolve_with_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.resolve_with_merge(with_bytes(spark, sf_dir)).select("rel_path", "policy", "conflict", "action", "conflict_copy", F.sha2("merged", 256).alias("merged_cid"))


E8 = (
    "SELECT rel_path, 'file' AS kind, CASE WHEN action = 'take' THEN i ELSE l END AS cid, CASE WHEN action = 'take' THEN im ELSE lm END AS mtime_ms FROM named "
    "UNION ALL SELECT conflict_copy, 'copy', CASE WHEN action = 'take' THEN l ELSE i END, CASE WHEN action = 'take' THEN lm ELSE im END FROM named WHERE conflict_copy IS NOT NULL"
)


@query(COMMITS + E8)
def e8_apply_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.applied(conflict.resolve(commits(spark, sf_dir))).drop("content")


E8_MERGED = (
    "written AS (SELECT rel_path, 'file' AS kind, CASE WHEN use THEN sha256(m) WHEN action = 'take' THEN i ELSE l END AS cid, CASE WHEN use THEN greatest(lm, im) WHEN action = 'take' THEN im ELSE lm END AS mtime_ms, "
    "CASE WHEN use THEN sha256(m) END AS content_cid FROM used "
    "UNION ALL SELECT conflict_copy, 'copy', CASE WHEN action = 'take' THEN l ELSE i END, CASE WHEN action = 'take' THEN lm ELSE im END, NULL FROM used WHERE conflict_copy IS NOT NULL AND NOT use) "
)


@query(MERGES.rstrip() + ", " + E8_MERGED + "SELECT * FROM written")
def e8_apply_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = conflict.applied(conflict.resolve_with_merge(with_bytes(spark, sf_dir)))
    return done.withColumn("content_cid", ids.content_id(F.col("content"))).drop("content")


@query(MERGES + "SELECT rel_path, applied, conflict, merged, remote_cid, remote_mtime_ms, conflict_copy FROM answers WHERE NOT contains(rel_path, '/fr/')")
def e9_commit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_bytes(spark, sf_dir).where(~F.contains("rel_path", F.lit("/fr/")))
    return conflict.commit_batch(rows, rebuilt_b(spark, sf_dir))


@query(
    MERGES.rstrip() + ", " + E8_MERGED + "SELECT coalesce(w.rel_path, c.rel_path) AS rel_path, coalesce(w.cid, c.file_cid) AS cid, CASE WHEN w.rel_path IS NULL THEN c.mtime_ms ELSE w.mtime_ms END AS mtime_ms FROM cid_c c FULL JOIN written w ON w.rel_path = c.rel_path"
)
def e9_state_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of the receiver after the batch: as committed, copies beside them, and the rest as it was."""
    done = conflict.accepted(with_bytes(spark, sf_dir), rebuilt_b(spark, sf_dir))
    return conflict.committed(cids(objects_c(spark, sf_dir)).select("rel_path", F.col("file_cid").alias("cid"), "mtime_ms"), done)


@query(MERGES.rstrip() + ", sent AS (SELECT i AS cid FROM used UNION SELECT sha256(m) FROM used WHERE use) SELECT cid FROM sent")
def e9_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files whose bytes the batch adds to the store; each is what its id says."""
    done = conflict.published(conflict.accepted(with_bytes(spark, sf_dir), rebuilt_b(spark, sf_dir)))
    return done.where(ids.content_id(F.col("bytes")) == F.col("cid")).select("cid")


@query(
    MERGES + "SELECT rel_path, CASE WHEN m IS NULL THEN 1 ELSE 0 END AS n_clashes, CASE WHEN m IS NOT NULL THEN m ELSE concat('<<<<<<< local', chr(10), CASE WHEN tl = '' OR ends_with(tl, chr(10)) THEN tl ELSE concat(tl, chr(10)) END, "
    "'||||||| base', chr(10), CASE WHEN tb = '' OR ends_with(tb, chr(10)) THEN tb ELSE concat(tb, chr(10)) END, '=======', chr(10), CASE WHEN ti = '' OR ends_with(ti, chr(10)) THEN ti ELSE concat(ti, chr(10)) END, '>>>>>>> incoming', chr(10)) END AS inline_text "
    "FROM merges JOIN texts USING (rel_path)"
)
def e6_conflict_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged texts, or both versions and the base between marks where the edits meet."""
    rows = with_bytes(spark, sf_dir).where("base is not null and local is not null")
    return conflict.merge3(rows, inline=True).select("rel_path", "n_clashes", "inline_text")


@query(
    COMMITS + "SELECT coalesce(c.rel_path, n.rel_path) AS rel_path, CASE WHEN n.rel_path IS NULL THEN c.file_cid WHEN NOT n.conflict OR n.newer THEN n.i ELSE n.l END AS cid, "
    "CASE WHEN n.rel_path IS NULL THEN c.mtime_ms WHEN NOT n.conflict OR n.newer THEN n.im ELSE n.lm END AS mtime_ms, coalesce(n.conflict, false)::BIGINT AS n_conflicts FROM cid_c c FULL JOIN named n USING (rel_path)"
)
def e10_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commits(spark, sf_dir).select("rel_path", F.col("incoming_mtime_ms").alias("seq"), F.col("incoming_cid").alias("cid"), F.col("incoming_mtime_ms").alias("mtime_ms"), F.col("base_cid").alias("base"))
    state = cids(objects_c(spark, sf_dir)).select("rel_path", F.col("file_cid").alias("cid"), "mtime_ms")
    return conflict.replay(state, log)


JOURNAL = (
    "log AS (SELECT o_custkey AS rel_path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS seq, sha256(concat(o_custkey, o_orderstatus, o_orderkey % 3)) AS cid, floor(o_totalprice)::BIGINT AS mtime_ms, "
    "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE sha256(concat(o_custkey, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % 3)) END AS base, "
    "CASE WHEN o_orderkey % 5 = 0 THEN 'copy' ELSE 'lww' END AS policy FROM orders), "
    "start AS (SELECT c_custkey AS rel_path, CASE WHEN c_custkey % 3 <> 0 THEN sha256(c_name) END AS cid, CASE WHEN c_custkey % 3 <> 0 THEN 100000 END::BIGINT AS mtime_ms FROM customer), "
    "fold(rel_path, n, seq, conflict, action, lost_cid, lost_mtime_ms, cid, mtime_ms) AS (SELECT rel_path, 0::BIGINT, NULL::BIGINT, false, '', NULL::VARCHAR, NULL::BIGINT, cid, mtime_ms FROM start UNION ALL "
    "SELECT rel_path, n, seq, conflict, CASE WHEN take THEN 'take' ELSE 'keep' END, CASE WHEN conflict THEN CASE WHEN take THEN c0 ELSE c1 END END, CASE WHEN conflict THEN CASE WHEN take THEN m0 ELSE m1 END END, CASE WHEN take THEN c1 ELSE c0 END, CASE WHEN take THEN m1 ELSE m0 END FROM ("
    "SELECT *, NOT conflict OR (policy <> 'copy' AND (m1 > m0 OR (m1 = m0 AND c1 > c0))) AS take FROM (SELECT l.rel_path, l.n, l.seq, l.policy, f.cid AS c0, f.mtime_ms AS m0, l.cid AS c1, l.mtime_ms AS m1, "
    "coalesce(f.cid <> l.cid AND (coalesce(l.base, '') = '' OR f.cid <> l.base), false) AS conflict FROM fold f JOIN log l ON l.rel_path = f.rel_path AND l.n = f.n + 1)))"
)


def journal_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A customer's orders as commits on one path, many a path; every third path is new."""
    from pyspark.sql import Window

    w, k = Window.partitionBy("o_custkey").orderBy("o_orderkey"), F.col("o_orderkey")
    none = lambda c: F.lit(None).cast("binary").alias(c)
    base = F.when(k % 4 == 1, "x").when(k % 4 > 1, F.sha2(F.concat(F.col("o_custkey").cast("string"), F.coalesce(F.lag("o_orderstatus").over(w), F.lit("")), F.coalesce((F.lag("o_orderkey").over(w) % 3).cast("string"), F.lit(""))), 256))
    cid = F.sha2(F.concat(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), (k % 3).cast("string")), 256)
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("rel_path"), k.alias("seq"), cid.alias("cid"), F.floor("o_totalprice").alias("mtime_ms"), base.alias("base"), F.when(k % 5 == 0, "copy").otherwise("lww").alias("policy"), F.lit("p").alias("short"), none("content"), none("ancestor"))
    state = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("rel_path"), F.sha2("c_name", 256).alias("cid"), F.lit(100000).cast("long").alias("mtime_ms"), none("content"))
    return state, log


@query(f"WITH RECURSIVE {JOURNAL} SELECT rel_path::VARCHAR AS rel_path, seq, conflict, action, lost_cid, lost_mtime_ms, cid, mtime_ms FROM fold WHERE n > 0")
def e10_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit of every path in its order, with what it met and what it left."""
    return conflict.journal(*journal_inputs(spark, sf_dir)).drop("conflict_copy", "merged")


E11 = "SELECT rel_path, NOT k AS deleted, k AS conflict FROM (SELECT b.rel_path, c.file_cid IS NOT NULL AND {base} AND c.file_cid <> coalesce(a.file_cid, '') AS k FROM cid_b b LEFT JOIN cid_c c USING (rel_path) LEFT JOIN cid_a a ON a.rel_path = b.rel_path AND a.mtime_ms % 3000 <> 0)"


def deletions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = cids(objects_a(spark, sf_dir).where("mtime_ms % 3000 <> 0")).select("rel_path", F.col("file_cid").alias("base"))
    asked = objects_b(spark, sf_dir).select("rel_path").join(base, "rel_path", "left")
    return asked, cids(objects_c(spark, sf_dir)).select("rel_path", F.col("file_cid").alias("cid"))


@query(W + E11.format(base="coalesce(a.file_cid, '') <> ''"))
def e11_delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.delete_batch(*deletions(spark, sf_dir))


@query(W + E11.format(base="true"))
def e12_delete_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.delete_batch(*deletions(spark, sf_dir), strict=True)


@query(
    W + ", answers AS (" + E11.format(base="coalesce(a.file_cid, '') <> ''") + ") SELECT a.rel_path, a.file_cid, a.file_cid AS base FROM cid_a a LEFT JOIN answers USING (rel_path) WHERE NOT coalesce(deleted AND NOT conflict, false)"
)
def e12_delete_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = cids(objects_a(spark, sf_dir)).select("rel_path", "file_cid", F.col("file_cid").alias("base"))
    return reconcile.delete_ack(index, conflict.delete_batch(*deletions(spark, sf_dir)))


E13 = (
    ", judged13 AS (SELECT b.rel_path, b.content, m, CASE WHEN c.rel_path IS NULL THEN 'new' WHEN c.content = b.content THEN 'equal' WHEN regexp_matches(b.rel_path, '\\.(md|txt)$') AND m IS NOT NULL THEN 'merged' ELSE 'copy' END AS status "
    "FROM objects_b b LEFT JOIN objects_c c USING (rel_path) LEFT JOIN merges USING (rel_path)) SELECT rel_path, status, CASE WHEN status IN ('new', 'merged') THEN rel_path WHEN status = 'copy' THEN concat(rel_path, '.conflict-peer01') END AS target, "
    "CASE WHEN status = 'merged' THEN sha256(m) WHEN status IN ('new', 'copy') THEN sha256(content) END AS content_cid FROM judged13"
)


@query(MERGES.rstrip() + E13)
def e13_apply_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = objects_b(spark, sf_dir).select("rel_path", F.lit("peer01").alias("peer"), "content")
    done = conflict.apply_loose(incoming, objects_c(spark, sf_dir), objects_a(spark, sf_dir))
    return done.select("rel_path", "status", "target", F.sha2("content", 256).alias("content_cid"))


# -- rules and paths -------------------------------------------------------------------------------------------------


@query(W + f"SELECT rel_path, {SQL_IGNORED} AS ignored FROM objects_a")
def f2_is_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects_a(spark, sf_dir).select("rel_path", rules.is_ignored(F.col("rel_path"), rule_list()).alias("ignored"))


@query(W + f"SELECT rel_path, {SQL_IGNORED} AS ignored FROM objects_a")
def f2_ignored_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(i, r.regex(), r.negated) for i, r in enumerate(rule_list())], "rule_idx int, rx string, negated boolean")
    return rules.ignored_by_table(objects_a(spark, sf_dir).select("rel_path"), known)


# a rule for every document number that is a multiple of three, of one of six kinds; the last that matches decides
RULES = (
    "SELECT CAST(doc_id AS INTEGER) AS rule_idx, concat(CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END, CASE doc_id % 18 WHEN 0 THEN concat('/', source, '/', lang, '/', doc_id, '*') WHEN 3 THEN concat(doc_id, '.md') "
    "WHEN 6 THEN concat('/', source, '/', lang, '/', doc_id, '/') WHEN 9 THEN concat('**/', lang, '/', doc_id, '.*') WHEN 12 THEN concat('*', doc_id, '.txt') ELSE concat(doc_id, '?md') END) AS line FROM documents WHERE doc_id % 3 = 0 AND source IS NOT NULL AND lang IS NOT NULL"
)


@query(
    W + f", lines AS ({RULES}), known AS (SELECT rule_idx, starts_with(line, '!') AS negated, ltrim(line, '!') AS p FROM lines), hits AS (SELECT a.rel_path, k.rule_idx, k.negated FROM objects_a a JOIN known k ON "
    "CASE WHEN k.p LIKE '/%*' THEN starts_with(a.rel_path, rtrim(ltrim(k.p, '/'), '*')) AND NOT contains(substring(a.rel_path, length(k.p) - 1), '/') WHEN k.p LIKE '/%/' THEN false "
    "WHEN k.p LIKE '**/%' THEN starts_with(split_part(a.rel_path, '/', 3), rtrim(split_part(k.p, '/', 3), '*')) AND split_part(a.rel_path, '/', 2) = split_part(k.p, '/', 2) "
    "WHEN k.p LIKE '*%' THEN ends_with(split_part(a.rel_path, '/', 3), substring(k.p, 2)) WHEN contains(k.p, '?') THEN split_part(a.rel_path, '/', 3) = replace(k.p, '?', '.') ELSE split_part(a.rel_path, '/', 3) = k.p END) "
    "SELECT a.rel_path, coalesce(NOT h.negated, false) AS ignored FROM objects_a a LEFT JOIN (SELECT rel_path, arg_max(negated, rule_idx) AS negated FROM hits GROUP BY rel_path) h USING (rel_path)"
)
def f2_ignored_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rules as a third of the documents; each path meets only those that it shares a literal with."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_of_rules")
    lines = spark.sql(RULES.replace("FROM documents", "FROM documents_of_rules"))
    return rules.ignored_by_index(objects_a(spark, sf_dir).select("rel_path"), rules.parsed_rules(lines))


PATHS = "concat(CASE p_partkey % 7 WHEN 0 THEN '/' WHEN 1 THEN '../' WHEN 2 THEN 'C:' WHEN 3 THEN 'target/' WHEN 4 THEN 'a\\b/' ELSE 'src/' END, p_brand, CASE p_partkey % 5 WHEN 0 THEN '~' WHEN 1 THEN '.swp' WHEN 2 THEN '..x' ELSE '' END)"


def odd_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(PATHS.replace("\\", "\\\\")).alias("path"))


SQL_PATHS = f"WITH paths AS (SELECT p_partkey AS id, {PATHS} AS path FROM part) "


@query(SQL_PATHS + "SELECT id, list_has_any(string_split(path, '/'), ['target', '.git', 'node_modules', '.DS_Store']) OR ends_with(path, '~') OR ends_with(path, '.swp') OR ends_with(path, '.tmp') OR starts_with(string_split(path, '/')[-1], '.#') AS skipped FROM paths")
def f6_skip_any_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_paths(spark, sf_dir).select("id", rules.skip_any_component(F.col("path")).alias("skipped"))


@query(SQL_PATHS + "SELECT id % 10 AS batch, bool_or(NOT (ends_with(path, '~') OR ends_with(path, '.swp') OR starts_with(path, 'target/'))) AS relevant FROM paths GROUP BY 1")
def f7_any_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_paths(spark, sf_dir).groupBy((F.col("id") % 10).alias("batch")).agg(F.bool_or(~rules.skip_any_component(F.col("path"))).alias("relevant"))


@query(W + "SELECT rel_path, rel_path = 'src1' OR starts_with(rel_path, 'src1/') AS admitted, starts_with('src1', concat(rel_path, '/')) OR rel_path = 'src1' OR starts_with(rel_path, 'src1/') AS either FROM objects_a")
def f8_prefix_admits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("rel_path")
    return objects_a(spark, sf_dir).select(p, rules.prefix_admits(F.lit("src1/"), p).alias("admitted"), rules.either_admits(F.lit("src1"), p).alias("either"))


@query(SQL_PATHS + "SELECT id, starts_with(path, '/') OR contains(path, '\\') OR regexp_matches(path, '^[A-Za-z]:') AS unsafe FROM paths")
def f9_is_unsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_paths(spark, sf_dir).select("id", rules.is_unsafe_path(F.col("path")).alias("unsafe"))


@query(SQL_PATHS + "SELECT id, CASE WHEN contains(path, '..') THEN 'dotdot' WHEN starts_with(path, '/') OR contains(path, '\\') OR regexp_matches(path, '^[A-Za-z]:') THEN 'unsafe' WHEN NOT starts_with(path, 'src/') THEN 'outside' END AS fault FROM paths")
def f10_target_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_paths(spark, sf_dir).select("id", rules.target_fault(F.col("path"), F.lit("src")).alias("fault"))


EVENT_PATH = "concat('/', CASE event_id % 9 WHEN 0 THEN 'target-x' WHEN 1 THEN '.git' WHEN 2 THEN 'tmp' WHEN 3 THEN 'dist' WHEN 4 THEN '.cache' WHEN 5 THEN 'src' WHEN 6 THEN '.next' WHEN 7 THEN 'targets' ELSE 'lib' END, '/', event_type)"


@query(f"SELECT event_id, NOT {sql_fragments(EVENT_PATH, rules.LOOSE_FRAGMENTS)} AS loose FROM events")
def f12_loose_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (~rules.has_fragment(F.expr(EVENT_PATH), rules.LOOSE_FRAGMENTS)).alias("loose"))


@query(f"SELECT event_id FROM events WHERE NOT {sql_fragments(EVENT_PATH, rules.REPO_FRAGMENTS)}")
def f13_repo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.substring(F.expr(EVENT_PATH), F.lit(2), F.lit(1000)).alias("path"))
    return repos.repo_events(rows).select("event_id")


@query(W + "SELECT rel_path, size FROM objects_a WHERE size <= 2048")
def f14_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects_a(spark, sf_dir).where(F.col("size") <= 2048).select("rel_path", "size")


@query("SELECT c_custkey AS id, regexp_full_match(t, '[0-9a-fA-F]{64}') AS hex64 FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN sha256(c_name) ELSE c_name END AS t FROM customer)")
def f15_is_hex64(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("c_custkey") % 2 == 0, F.sha2("c_name", 256)).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), rules.is_hex64(t).alias("hex64"))


@query("SELECT event_id AS id, CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE 'not_allowed' END AS fault FROM events")
def f16_program_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cmd = F.array(F.concat(F.lit("/usr/bin/"), F.col("event_type")), F.lit("--x"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), rules.program_fault(cmd, ["view", "click"]).alias("fault"))


@query(SQL_PATHS + "SELECT id, NOT (contains(path, '/') OR contains(path, '\\') OR contains(path, '..')) AS safe FROM paths")
def f17_job_id_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_paths(spark, sf_dir).select("id", rules.is_safe_job_id(F.col("path")).alias("safe"))


@query(W + "SELECT rel_path, substring(rel_path, 6) AS below FROM objects_a WHERE starts_with(rel_path, 'src1/')")
def g1_rel_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = objects_a(spark, sf_dir).select("rel_path", ids.rel_of(F.lit("src1/"), F.col("rel_path")).alias("below"))
    return out.where("below is not null")


@query("SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^(~/)+', ''), '^~+', ''), '^/+', ''), '/+$', '') AS root FROM (SELECT p_partkey AS id, concat(CASE p_partkey % 4 WHEN 0 THEN '~/~/' WHEN 1 THEN '~' WHEN 2 THEN '/' ELSE '' END, p_brand, '/') AS t FROM part)")
def g2_remote_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("concat(CASE p_partkey % 4 WHEN 0 THEN '~/~/' WHEN 1 THEN '~' WHEN 2 THEN '/' ELSE '' END, p_brand, '/')")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ids.remote_root_of(t).alias("root"))


@query(W + "SELECT rel_path, CASE WHEN r = '' THEN rel_path ELSE concat(r, '/', rel_path) END AS remote, rel_path AS back FROM (SELECT rel_path, CASE WHEN size % 2 = 0 THEN 'proj' ELSE '' END AS r FROM objects_a)")
def g3_remote_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.when(F.col("size") % 2 == 0, "proj").otherwise("")
    out = objects_a(spark, sf_dir).select("rel_path", root.alias("r")).withColumn("remote", ids.remote_join(F.col("r"), F.col("rel_path")))
    return out.select("rel_path", "remote", ids.strip_remote_root(F.col("r"), F.col("remote")).alias("back"))


@query("SELECT event_id AS id, epoch_us(ts) // 1000 AS ms FROM events")
def g5_mtime_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ids.mtime_ms(F.col("ts").cast("timestamp")).alias("ms"))


@query("SELECT c_custkey AS id, CASE WHEN contains(t, ':') THEN split_part(t, ':', 1) END AS host, CASE WHEN contains(t, ':') THEN substring(t, instr(t, ':') + 1) END AS rest FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat(c_mktsegment, ':', c_name, ':x') END AS t FROM customer)")
def g6_split_dest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat(c_mktsegment, ':', c_name, ':x') END")
    host, rest = ids.split_dest(t)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), host.alias("host"), rest.alias("rest"))


@query("SELECT event_id AS id, CASE lower(p) WHEN 'lww' THEN 'lww' WHEN 'copy' THEN 'copy' WHEN 'crdt' THEN 'crdt' ELSE 'lww' END AS policy FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'LWW' WHEN 1 THEN 'Copy' WHEN 2 THEN 'crdt' ELSE event_type END AS p FROM events)")
def g7_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr("CASE event_id % 4 WHEN 0 THEN 'LWW' WHEN 1 THEN 'Copy' WHEN 2 THEN 'crdt' ELSE event_type END")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ids.policy_of(p).alias("policy"))


@query(f"WITH {MESSAGES} SELECT event_id, CASE WHEN payload_hex = 'zz' THEN 'bad_json' ELSE 'ok' END AS status, CASE WHEN payload_hex <> 'zz' THEN json_extract_string(props, '$.k') END AS k FROM messages JOIN events USING (event_id)")
def g9_decode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authz.decode(messages(spark, sf_dir), "k string", {"k": F.lit("-")}).select("event_id", "status", F.col("body.k").alias("k"))


@query(f"WITH {MESSAGES} SELECT event_id, CASE WHEN payload_hex = 'zz' THEN '{{\"ok\":false,\"error\":\"bad_json\"}}' ELSE concat('{{\"ok\":true,\"k\":\"', json_extract_string(props, '$.k'), '\"}}') END AS reply FROM messages JOIN events USING (event_id)")
def g10_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = authz.decode(messages(spark, sf_dir), "k string")
    ok = F.col("status") == "ok"
    return rows.select("event_id", authz.reply(ok, F.when(~ok, F.col("status")), k=F.col("body.k")).alias("reply"))


@query(f"WITH {MESSAGES} SELECT event_id, CASE string_split(topic, '/')[2] WHEN 'commit' THEN 'sync' WHEN 'have' THEN 'sync-read' WHEN 'list' THEN 'sync-read' WHEN 'manifest' THEN 'sync-read' END AS action, substring(from_id, 1, 16) AS short FROM messages")
def g13_action_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("event_id", ids.action_for(F.col("topic")).alias("action"), ids.short_id(F.col("from_id")).alias("short"))


BYTE = "TRY_CAST('0x' || hex(b[{0}:{0}]) AS INTEGER)"


@query(
    f"SELECT doc_id, CASE WHEN n > 200 THEN concat(decode(b[1:cut]), chr(10), '[clipped]', chr(10)) ELSE t END AS clipped FROM (SELECT *, CASE WHEN ({BYTE.format(201)} & 192) <> 128 THEN 200 "
    f"WHEN ({BYTE.format(200)} & 192) <> 128 THEN 199 WHEN ({BYTE.format(199)} & 192) <> 128 THEN 198 ELSE 197 END AS cut FROM (SELECT doc_id, coalesce(text, '') AS t, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents))"
)
def g11_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.clip(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 200).alias("clipped"))


# -- requests --------------------------------------------------------------------------------------------------------


@query(f"WITH {MESSAGES} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'run' WHEN event_id % 3 = 1 THEN 'sync' ELSE 'unknown' END AS handler FROM messages")
def h1_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.when(F.col("event_id") % 3 == 0, "run/start").when(F.col("event_id") % 3 == 1, F.col("topic")).otherwise("odd/x")
    return messages(spark, sf_dir).select("event_id", authz.route(topic).alias("handler"))


CHAIN = (
    "WITH requests AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('n', c_nationkey) ELSE 'other' END AS host, "
    "CASE WHEN o_orderkey % 19 = 0 THEN 'nobody' ELSE concat('o', o_orderkey) END AS from_id, CASE o_orderkey % 4 WHEN 0 THEN 'spawn' ELSE 'sync' END AS action, "
    "c_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey) "
)


def requests_and_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Link 0 from a nation to a customer, link 1 from the customer to an order."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("c_custkey = o_custkey"))
    asked = rows.selectExpr("o_orderkey as request_id", "CASE WHEN o_orderkey % 3 = 0 THEN concat('n', c_nationkey) ELSE 'other' END as host", "CASE WHEN o_orderkey % 19 = 0 THEN 'nobody' ELSE concat('o', o_orderkey) END as from_id", "CASE o_orderkey % 4 WHEN 0 THEN 'spawn' ELSE 'sync' END as action")
    all_, few = "array('sync', 'spawn')", "array('sync')"
    first = f"named_struct('pos', 0, 'issuer', concat('n', c_nationkey), 'audience', concat('c', c_custkey), 'actions', CASE WHEN c_custkey % 5 = 0 THEN {few} ELSE {all_} END, 'not_after', CASE WHEN c_custkey % 11 = 0 THEN 1L ELSE 0L END, 'path_prefix', 'src', 'nonce', bigint(c_custkey), 'sig_ok', c_custkey % 23 <> 0)"
    second = f"named_struct('pos', 1, 'issuer', CASE WHEN o_orderkey % 13 = 0 THEN 'stranger' ELSE concat('c', c_custkey) END, 'audience', concat('o', o_orderkey), 'actions', CASE WHEN o_orderkey % 2 = 0 THEN {all_} ELSE {few} END, 'not_after', 0L, 'path_prefix', concat('src', o_orderkey % 3), 'nonce', 0L, 'sig_ok', true)"
    links = rows.selectExpr("o_orderkey as request_id", f"inline(array({first}, {second}))")
    roots = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").selectExpr("concat('n', n_nationkey) as key")
    revoked = table(spark, sf_dir, "customer").where("c_custkey % 17 = 0").selectExpr("concat('n', c_nationkey) as issuer", "bigint(c_custkey) as nonce")
    return asked, links, roots, revoked


@query(
    CHAIN + "SELECT request_id, reason IS NULL AS allowed, reason FROM (SELECT request_id, CASE WHEN c_custkey % 23 = 0 THEN 'bad_signature' WHEN c_custkey % 17 = 0 THEN 'revoked' "
    "WHEN c_custkey % 11 = 0 THEN 'expired' WHEN NOT (c_nationkey % 2 = 0 OR host = concat('n', c_nationkey)) THEN 'untrusted_root' WHEN request_id % 13 = 0 THEN 'broken_chain' "
    "WHEN c_custkey % 5 = 0 AND request_id % 2 = 0 THEN 'actions_grow' WHEN from_id = 'nobody' THEN 'wrong_audience' WHEN request_id % 2 = 1 AND action = 'spawn' THEN 'not_granted' END AS reason FROM requests)"
)
def h2_authorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authz.authorize(*requests_and_links(spark, sf_dir), now=1_700_000_000).select("request_id", "allowed", "reason")


@query(CHAIN + "SELECT request_id, CASE WHEN request_id % 10 = 0 THEN 'dotdot' WHEN request_id % 3 <> request_id % 2 THEN 'outside' END AS fault FROM requests")
def h4_path_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, links, _, _ = requests_and_links(spark, sf_dir)
    path = F.expr("CASE WHEN request_id % 10 = 0 THEN 'src/../x' ELSE concat('src', request_id % 2, '/f') END")
    return authz.path_scope(asked.select("request_id", path.alias("path")), links)


@query("SELECT event_id AS request_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'not_allowed' WHEN event_id % 5 = 0 THEN 'cwd_dotdot' WHEN event_id % 5 = 1 THEN 'cwd_outside' END AS reason FROM events")
def h5_spawn_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id as request_id", "array(concat('/bin/', event_type)) as cmd", "CASE event_id % 5 WHEN 0 THEN 'a/../b' WHEN 1 THEN 'elsewhere' ELSE 'src/x' END as cwd", "'src' as path_prefix")
    return authz.spawn_audit(rows, ["view", "click"])


@query(
    "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN sha256(o_custkey::VARCHAR) WHEN o_custkey % 2 = 0 THEN sha256(concat('a', o_custkey)) WHEN o_custkey % 5 = 0 THEN sha256(concat('w', o_custkey)) END AS node_id, "
    "CASE WHEN o_orderkey % 7 = 0 THEN 'own' WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'alias' WHEN o_custkey % 5 = 0 THEN 'wallet' END AS cap, "
    "CASE WHEN o_orderkey % 3 <> 0 AND o_custkey % 2 <> 0 AND o_custkey % 5 <> 0 THEN 'unknown_target' WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN 'no_capability' END AS reason FROM orders"
)
def h6_resolve_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey as request_id", "CASE WHEN o_orderkey % 3 = 0 THEN upper(sha2(string(o_custkey), 256)) ELSE concat('alias', o_custkey) END as target", "CASE WHEN o_orderkey % 7 = 0 THEN 'own' END as cap")
    people = table(spark, sf_dir, "customer")
    known = people.where("c_custkey % 2 = 0").selectExpr("concat('alias', c_custkey) as alias", "sha2(concat('a', c_custkey), 256) as node_id", "'alias' as cap")
    wallet = people.where("c_custkey % 5 = 0").selectExpr("concat('alias', c_custkey) as alias", "sha2(concat('w', c_custkey), 256) as node_id", "'wallet' as cap")
    return authz.resolve_targets(asked, known, wallet)


@query(f"WITH {MESSAGES} SELECT event_id FROM messages WHERE topic LIKE 'sync2/%' AND from_id IN (SELECT sha256(c_custkey::VARCHAR) FROM customer WHERE c_custkey % 3 = 0)")
def h7_peer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    peers = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("peerNodeId"))
    return authz.from_peers(messages(spark, sf_dir), peers, "sync2/").select("event_id")


@query(f"WITH {MESSAGES} SELECT event_id, CASE WHEN topic <> 'sync2/unknown' THEN 'transfer_disabled' END AS refused FROM messages")
def h8_transfer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("event_id", authz.transfer_gate(F.col("topic"), False).alias("refused"))


@query(f"WITH {MESSAGES} SELECT event_id, NULL::VARCHAR AS refused FROM messages")
def h8_transfer_gate_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("event_id", authz.transfer_gate(F.col("topic"), True).alias("refused"))


# -- streams, in their batch form ------------------------------------------------------------------------------------

FS_EVENTS = "fs AS (SELECT event_id, event_type, ts, concat('src', user_id % 20, '/', user_id, CASE WHEN user_id % 50 = 0 THEN '/.syncignore' ELSE '.md' END) AS path FROM events)"


def fs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("concat('src', user_id % 20, '/', user_id, CASE WHEN user_id % 50 = 0 THEN '/.syncignore' ELSE '.md' END)")
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), path.alias("path"))


@query(
    f"WITH {FS_EVENTS}, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 15 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM fs WINDOW w AS (PARTITION BY event_type ORDER BY ts)), "
    "numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked) "
    "SELECT event_type, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 + 900000 AS end_ms, count(DISTINCT path) AS n_paths, count(*) AS n_events, bool_or(path LIKE '%/.syncignore') AS full_rescan FROM numbered GROUP BY event_type, s"
)
def i1_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.debounce(fs_events(spark, sf_dir), "15 minutes", "event_type")
    return out.select("event_type", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), F.size("paths").cast("long").alias("n_paths"), "n_events", "full_rescan")


SESSIONS = (
    f"{FS_EVENTS}, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 15 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM fs WINDOW w AS (PARTITION BY event_type ORDER BY ts)), "
    "numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM marked)"
)


@query(
    f"WITH {SESSIONS} SELECT event_type, session, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 + 900000 AS end_ms, count(DISTINCT path) AS n_paths, count(*) AS n_events, bool_or(path LIKE '%/.syncignore') AS full_rescan FROM numbered GROUP BY event_type, session"
)
def i1_debounce_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As i1_debounce, by time slices: five keys spread over all tasks."""
    out, _ = streams.debounced(fs_events(spark, sf_dir), 900_000, "event_type")
    return out.select("event_type", "session", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n_paths", "n_events", "full_rescan")


@query(f"WITH {SESSIONS} SELECT DISTINCT event_type, session, path FROM numbered")
def i1_session_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.debounced(fs_events(spark, sf_dir), 900_000, "event_type")[1]


@query(W + f", {FS_EVENTS}, paths AS (SELECT rel_path AS path FROM objects_a UNION SELECT rel_path FROM objects_b) SELECT path, CASE WHEN path LIKE '%.png' THEN 'drop' WHEN b.rel_path IS NOT NULL THEN 'push' ELSE 'delete' END AS action FROM paths LEFT JOIN objects_b b ON b.rel_path = path")
def i3_event_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = objects_b(spark, sf_dir)
    paths = objects_a(spark, sf_dir).select(F.col("rel_path").alias("path")).union(b.select("rel_path")).distinct()
    return streams.event_actions(paths, b, lambda p: rules.is_ignored(p, rules.read_rules("*.png", builtin=False)))


@query(f"WITH {MESSAGES} SELECT reply_token, arg_min(event_id, (ts, event_id)) AS event_id FROM messages WHERE reply_token IS NOT NULL GROUP BY reply_token")
def i4_dedup_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.dedup(messages(spark, sf_dir).where("reply_token is not null"), ["reply_token"]).select("reply_token", "event_id")


@query(f"WITH {MESSAGES} SELECT sha256(concat_ws('|', from_id, topic, payload_hex)) AS content_key, arg_min(event_id, (ts, event_id)) AS event_id FROM messages GROUP BY 1")
def i5_dedup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.dedup(streams.content_key(messages(spark, sf_dir)), ["content_key"]).select("content_key", "event_id")


@query(W + f", plan AS ({D3}) SELECT n_name AS peer, p.rel_path FROM plan p, nation WHERE op <> 'unchanged' AND NOT (p.op = 'modify' AND n_nationkey % 2 = 0)")
def i8_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = reconcile.plan(cids(objects_a(spark, sf_dir)), cids(objects_b(spark, sf_dir))).where("op <> 'unchanged'").select("rel_path", "op", F.coalesce("new_cid", "old_cid").alias("cid"))
    peers = table(spark, sf_dir, "nation").select(F.col("n_name").alias("peer"), "n_nationkey")
    acked = history.each_peer(changes.where("op = 'modify'"), peers.where("n_nationkey % 2 = 0")).select("peer", "rel_path", "cid")
    return streams.fan_out(changes, peers, acked).select("peer", "rel_path")


@query(
    W + f", plan AS ({D3}), sent AS (SELECT n_name AS peer, n_nationkey, p.rel_path, coalesce(size, 0) AS size FROM (SELECT * FROM plan WHERE op <> 'unchanged') p CROSS JOIN nation LEFT JOIN objects_b USING (rel_path)) "
    "SELECT peer, rel_path FROM sent WHERE (size + n_nationkey) % 5 = 0"
)
def i6_reemit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message in five was lost, by size and peer; the next tick sends just these again."""
    after = objects_b(spark, sf_dir)
    changes = reconcile.plan(cids(objects_a(spark, sf_dir)), cids(after)).where("op <> 'unchanged'").select("rel_path", F.coalesce("new_cid", "old_cid").alias("cid"))
    peers = table(spark, sf_dir, "nation").select(F.col("n_name").alias("peer"), "n_nationkey")
    sent = history.each_peer(changes.join(after.select("rel_path", "size"), "rel_path", "left"), peers).join(peers, "peer")
    acked = sent.where((F.coalesce("size", F.lit(0)) + F.col("n_nationkey")) % 5 != 0).select("peer", "rel_path", "cid")
    out: list[DataFrame] = []
    streams.reemit_each(lambda _: changes, lambda _: peers, lambda _: acked, lambda rows, _: out.append(rows))(changes, 0)
    return out[0].select("peer", "rel_path")


LOGS = "logs AS (SELECT conv_id AS job_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS log FROM conversations GROUP BY conv_id)"


def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    lines = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("job_id")).agg(turns.alias("t"))
    return lines.select("job_id", F.encode(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), "UTF-8").alias("content"))


@query(f"WITH {LOGS}, b AS (SELECT job_id, encode(log) AS c FROM logs) SELECT job_id AS request_id, sha256(CASE WHEN job_id % 200 >= octet_length(c) THEN ''::BLOB ELSE c[job_id % 200 + 1:] END) AS data, octet_length(c)::BIGINT AS next_offset FROM b")
def i9_log_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = job_logs(spark, sf_dir)
    asked = logs.select(F.col("job_id").alias("request_id"), "job_id", (F.col("job_id") % 200).cast("long").alias("offset"))
    return jobs.log_delta(logs, asked).select("request_id", ids.content_id(F.col("data")).alias("data"), "next_offset")


@query(
    f"WITH {LOGS}, b AS (SELECT job_id, encode(log) AS c FROM logs) SELECT job_id AS request_id, sha256(CASE WHEN job_id % 300 >= octet_length(c) THEN ''::BLOB ELSE c[job_id % 300 + 1:] END) AS data, "
    "octet_length(c)::BIGINT AS next_offset, job_id % 3 = 0 AS running, CASE job_id % 3 WHEN 1 THEN 7 WHEN 2 THEN CASE WHEN job_id % 2 = 0 THEN -1 ELSE 0 END END::INTEGER AS exit_code FROM b"
)
def i11_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = job_logs(spark, sf_dir)
    asked = logs.select(F.col("job_id").alias("request_id"), "job_id", (F.col("job_id") % 300).cast("long").alias("offset"))
    rows = logs.where("job_id % 3 <> 2 or job_id % 2 = 0").selectExpr("job_id", "job_id % 3 = 0 as alive", "CASE WHEN job_id % 3 = 1 THEN '7' END as status")
    return jobs.poll(logs, rows, asked).withColumn("data", ids.content_id(F.col("data")))


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 2 = 1 AND o_custkey % 2 = 0 THEN 'running' ELSE 'done' END AS state, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN -1 ELSE CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE -1 END END::INTEGER AS code FROM orders")
def i10_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey as job_id", "o_custkey % 2 = 0 as alive", "CASE o_orderkey % 4 WHEN 0 THEN '0' WHEN 1 THEN ' 3 ' WHEN 2 THEN 'bad' END as status")
    return jobs.job_status(rows)


@query("SELECT o_orderkey AS job_id FROM orders ORDER BY (epoch_ms(o_orderdate::TIMESTAMP)) DESC, o_orderkey DESC LIMIT 64")
def j1_trim_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), started.alias("started_ms"), F.lit(None).cast("long").alias("dir_mtime_ms"))
    return jobs.trim(rows).select("job_id")


@query("SELECT job_id, host FROM (SELECT o_orderkey AS job_id, o_custkey AS host, row_number() OVER (PARTITION BY o_custkey ORDER BY epoch_ms(o_orderdate::TIMESTAMP) DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def j1_trim_jobs_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("host"), started.alias("started_ms"), F.lit(None).cast("long").alias("dir_mtime_ms"))
    return jobs.trim(rows, 3, "host").select("job_id", "host")


@query(WC + "SELECT count(*) AS chunks, count(DISTINCT cid) AS distinct_chunks, sum(len)::BIGINT AS bytes FROM chunks_a")
def j3_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunk(objects_a(spark, sf_dir), CHUNK, payload=False)
    return rows.agg(F.count("*").alias("chunks"), F.countDistinct("cid").alias("distinct_chunks"), F.sum("len").alias("bytes"))


@query(W + "SELECT rel_path FROM objects_a ORDER BY rel_path")
def j4_sorted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects_a(spark, sf_dir).select("rel_path").orderBy("rel_path")


@query(WC + "SELECT cid FROM chunks_a INTERSECT SELECT cid FROM chunks_c")
def j6_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = (chunking.chunk(f(spark, sf_dir), CHUNK, payload=False).select("cid") for f in (objects_a, objects_c))
    return a.intersect(c)


# -- histories -------------------------------------------------------------------------------------------------------

GRAPH = (
    "ordered AS (SELECT o_custkey AS repo, o_orderkey AS sha, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders), "
    "parents AS (SELECT c.repo, c.sha AS child, p.sha AS parent FROM ordered c JOIN ordered p ON p.repo = c.repo AND (p.n = c.n - 1 OR (c.n % 5 = 0 AND p.n = c.n - 2))), "
    "tips AS (SELECT repo, max(n) AS n FROM ordered GROUP BY repo), heads AS (SELECT o.repo, o.sha AS head, b.sha AS base FROM tips t JOIN ordered o ON o.repo = t.repo AND o.n = t.n LEFT JOIN ordered b ON b.repo = t.repo AND b.n = t.n - t.repo % 4)"
)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """commits: a customer's orders in a chain, every fifth with a second parent; heads: the latest, and one some steps back (base)."""
    from pyspark.sql import Window

    repo = Window.partitionBy("repo")
    w = repo.orderBy(F.col("o_orderdate").asc_nulls_last(), F.col("sha").asc_nulls_last())
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("sha"), "o_orderdate").withColumn("n", F.row_number().over(w))
    one, two = F.lag("sha", 1).over(w), F.lag("sha", 2).over(w)
    parents = F.filter(F.array(one, F.when(F.col("n") % 5 == 0, two)), lambda x: x.isNotNull())
    commits_ = rows.select("repo", "sha", "n", parents.alias("parents"))
    marked = rows.where("repo is not null").select("repo", "sha", "n", F.count("*").over(repo).alias("top"))
    at = lambda place: F.max(F.expr(f"CASE WHEN n = {place} THEN sha END"))
    return commits_, marked.groupBy("repo").agg(at("top").alias("head"), at("top - repo % 4").alias("base"))


REACH = "reach(repo, head, sha) AS (SELECT repo, head, head FROM heads UNION SELECT r.repo, r.head, p.parent FROM reach r JOIN parents p ON p.repo = r.repo AND p.child = r.sha)"


@query("SELECT o_custkey AS repo, o_orderpriority AS peer, arg_min(o_orderkey, o_orderkey) AS head FROM orders GROUP BY 1, 2")
def k1_acked_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("peer"), F.col("o_orderkey").alias("head"), (-F.col("o_orderkey")).alias("seq"))
    return history.acked_heads(rows)


@query(f"WITH RECURSIVE {GRAPH}, {REACH} SELECT h.repo, h.base, h.head, r.sha IS NOT NULL AS is_ancestor FROM heads h LEFT JOIN reach r ON r.repo = h.repo AND r.head = h.head AND r.sha = h.base WHERE h.base IS NOT NULL")
def k2_is_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits_, heads = graph(spark, sf_dir)
    return history.is_ancestor(commits_, heads.where("base is not null"))


@query(
    f"WITH RECURSIVE {GRAPH}, {REACH}, low(repo, base, sha) AS (SELECT repo, base, base FROM heads WHERE base IS NOT NULL UNION SELECT r.repo, r.base, p.parent FROM low r JOIN parents p ON p.repo = r.repo AND p.child = r.sha) "
    "SELECT h.repo, h.base, h.head, r.sha FROM heads h JOIN reach r ON r.repo = h.repo AND r.head = h.head LEFT JOIN low l ON l.repo = h.repo AND l.base = h.base AND l.sha = r.sha WHERE l.sha IS NULL AND h.base IS DISTINCT FROM h.head"
)
def k3_delta_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits_, heads = graph(spark, sf_dir)
    return history.delta_commits(commits_, heads)


@query(
    f"WITH {GRAPH} SELECT repo, 'peer' AS peer, CASE WHEN repo % 5 = 0 OR base IS NULL THEN 'adopt' WHEN repo % 11 <> 0 AND head = base THEN 'noop' WHEN repo % 7 = 0 THEN 'skip' "
    "WHEN repo % 11 = 0 THEN CASE WHEN head = base OR repo % 3 = 1 THEN 'ahead' ELSE 'merge' END WHEN repo % 3 = 1 THEN 'ahead' ELSE 'ff' END AS action FROM heads"
)
def k4_sync_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest commit comes in, or in one repository of three the one some steps back; a local branch of one in eleven has left there."""
    commits_, heads = graph(spark, sf_dir)
    rows = heads.withColumn("back", F.col("repo") % 3 == 1).withColumn("fork", (F.col("repo") % 11 == 0) & F.col("base").isNotNull())
    forks = rows.where("fork").select("repo", (-F.col("base")).alias("sha"), F.array("base").alias("parents"))
    incoming = rows.select("repo", F.lit("main").alias("branch"), F.when(F.col("back") & F.col("base").isNotNull(), F.col("base")).otherwise(F.col("head")).alias("head"), F.lit("peer").alias("peer"))
    mine = F.when(F.col("fork"), -F.col("base")).when(F.col("back"), F.col("head")).otherwise(F.col("base"))
    local = rows.where("repo % 5 <> 0 and base is not null").select("repo", F.when(F.col("repo") % 7 == 0, "dev").otherwise("main").alias("branch"), mine.alias("head"))
    return history.sync_actions(commits_.select("repo", "sha", "parents").unionByName(forks), incoming, local)


TREE_FILES = "files AS (SELECT l_orderkey AS sha, l_linenumber AS path, max(l_partkey) % 4 AS cid FROM lineitem GROUP BY ALL)"


@query(
    f"WITH {GRAPH}, {TREE_FILES}, forks AS (SELECT * FROM heads WHERE base IS NOT NULL), mine AS (SELECT repo, head, path, cid AS b, CASE WHEN path % 3 = repo % 3 THEN 9 ELSE cid END AS l FROM forks JOIN files ON sha = base), "
    "theirs AS (SELECT repo, path, cid AS i FROM forks JOIN files ON sha = head), clashes AS (SELECT repo, count(*) AS n FROM mine FULL JOIN theirs USING (repo, path) "
    "WHERE l IS DISTINCT FROM i AND l IS DISTINCT FROM b AND i IS DISTINCT FROM b GROUP BY repo) "
    "SELECT repo, CASE WHEN head = base THEN 'ahead' WHEN n > 0 THEN 'conflict' ELSE 'merge' END AS action, CASE WHEN head = base THEN 0 ELSE coalesce(n, 0) END AS n_clashes, "
    "CASE WHEN head <> base AND n > 0 THEN 'sync/conflict-peer-t0' END AS kept FROM forks LEFT JOIN clashes USING (repo)"
)
def k4_merge_or_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repository has left the base by a commit of its own, which changes some of the base's files, when the latest commit comes in."""
    commits_, heads = graph(spark, sf_dir)
    rows = heads.where("base is not null")
    forks = rows.select("repo", (-F.col("base")).alias("sha"), F.array("base").alias("parents"))
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sha"), F.col("l_linenumber").alias("path")).agg((F.max("l_partkey") % 4).alias("cid"))
    own = rows.join(files, F.col("sha") == F.col("base")).select("repo", (-F.col("base")).alias("sha"), "path", F.when(F.col("path") % 3 == F.col("repo") % 3, 9).otherwise(F.col("cid")).alias("cid"))
    entries = commits_.select("repo", "sha").join(files, "sha").select("repo", "sha", "path", "cid").unionByName(own).withColumn("content", F.lit(None).cast("binary"))
    incoming = rows.select("repo", F.lit("main").alias("branch"), "head", F.lit("peer").alias("peer"))
    local = rows.select("repo", F.lit("main").alias("branch"), (-F.col("base")).alias("head"))
    return history.sync_outcomes(commits_.select("repo", "sha", "parents").unionByName(forks), incoming, local, entries, "t0").drop("peer")


@query("SELECT repo, seq FROM (SELECT o_custkey AS repo, o_orderkey AS seq, o_orderpriority AS tree, lag(o_orderpriority) OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS before FROM orders) WHERE tree IS DISTINCT FROM before")
def k5_snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), (F.col("o_orderkey") % 3).alias("host"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("tree"))
    return history.snapshot_changes(rows).select("repo", "seq")


@query(W + "SELECT n_name AS peer, rel_path AS repo FROM objects_a, nation WHERE size BETWEEN 1 AND 4096 AND NOT (n_nationkey % 3 = 0 AND size % 2 = 0)")
def k6_pending_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = objects_a(spark, sf_dir).select(F.col("rel_path").alias("repo"), F.col("mtime_ms").alias("snap"), F.col("size").alias("bytes"))
    peers = table(spark, sf_dir, "nation").select(F.col("n_name").alias("peer"), "n_nationkey")
    sent = history.each_peer(snaps.where("bytes % 2 = 0"), peers.where("n_nationkey % 3 = 0")).select("peer", "repo", "snap")
    return history.pending_snapshots(snaps, peers, sent, 4096).select("peer", "repo")


@query(W + "SELECT a.rel_path AS repo, CASE WHEN b.file_cid = a.file_cid THEN 'record' WHEN a.size % 2 = 0 OR a.size % 3 = 0 THEN 'overwrite' ELSE 'keep' END AS decision FROM cid_a a JOIN cid_b b USING (rel_path)")
def k7_mirror_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cids(objects_a(spark, sf_dir)).select(F.col("rel_path").alias("repo"), F.col("file_cid").alias("tree"), (F.col("size") % 2 != 0).alias("dirty"), F.when(F.col("size") % 3 == 0, F.col("file_cid")).alias("applied_tree"))
    b = cids(objects_b(spark, sf_dir)).select(F.col("rel_path").alias("repo"), F.col("file_cid").alias("incoming_tree"))
    return history.mirror_decisions(a.join(b, "repo"))


# -- keyed tables ----------------------------------------------------------------------------------------------------


def order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return old, old.where("o_orderkey % 50 <> 0").withColumn("price", F.when(F.col("o_orderkey") % 20 == 1, (F.col("price") + 1).cast("decimal(18,2)")).otherwise(F.col("price")))


@query(
    "SELECT bucket, sha256(string_agg(sha, '' ORDER BY sha)) AS digest, count(*) AS n FROM (SELECT o_orderkey % 64 AS bucket, sha256(concat_ws('|', "
    "coalesce(concat(length(o_custkey::VARCHAR), ':', o_custkey), '-'), coalesce(concat(length(o_orderkey::VARCHAR), ':', o_orderkey), '-'), coalesce(concat(length(o_orderstatus), ':', o_orderstatus), '-'))) AS sha FROM orders) GROUP BY bucket"
)
def m1_bucket_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tables.bucket_digests(rows, ["o_orderkey"], 64, F.col("o_orderkey") % 64)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'delete' ELSE 'update' END AS op FROM orders WHERE o_orderkey % 50 = 0 OR o_orderkey % 20 = 1")
def m2_table_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_delta(*order_versions(spark, sf_dir), ["o_orderkey"])


LIMBS_SQL = ", ".join(f"(sum(('0x' || substring(sha, {15 * i + 1}, 15))::HUGEINT) % 2305843009213693951)::BIGINT AS d{i}" for i in range(4))
ROW_SHA = (
    "sha256(concat_ws('|', coalesce(concat(length(o_custkey::VARCHAR), ':', o_custkey), '-'), coalesce(concat(length(o_orderkey::VARCHAR), ':', o_orderkey), '-'), coalesce(concat(length(o_orderstatus), ':', o_orderstatus), '-')))"
)


def status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return rows.select((F.col("o_orderkey") % 64).alias("bucket"), tables.row_sha(sorted(rows.columns)).alias("sha"))


@query(f"SELECT bucket, count(*) AS n, {LIMBS_SQL} FROM (SELECT o_orderkey % 64 AS bucket, {ROW_SHA} AS sha FROM orders) GROUP BY bucket")
def m1_leaf_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.leaf_digests(status_rows(spark, sf_dir))


@query(f"SELECT bucket, count(*) AS n, {LIMBS_SQL} FROM (SELECT o_orderkey % 64 AS bucket, {ROW_SHA.replace('o_orderstatus', 's')} AS sha FROM (SELECT *, CASE WHEN o_orderkey % 20 = 1 THEN 'X' ELSE o_orderstatus END AS s FROM orders) WHERE o_orderkey % 50 <> 0) GROUP BY bucket")
def m1_updated_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of a changed table from those before and the rows that changed alone."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    hashed = lambda df: df.select((F.col("o_orderkey") % 64).alias("bucket"), tables.row_sha(sorted(df.columns)).alias("sha"))
    gone, old = rows.where("o_orderkey % 50 = 0"), rows.where("o_orderkey % 20 = 1")
    new = old.withColumn("o_orderstatus", F.lit("X"))
    return tables.updated(tables.leaf_digests(hashed(rows)), hashed(new), hashed(gone.union(old)))


@query("SELECT 'orders' AS side, count(*) AS n_changed FROM orders WHERE o_orderkey % 50 = 0 OR o_orderkey % 20 = 1 UNION ALL SELECT 'same', 0")
def m2_changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a delta finds against another version, and against the table itself."""
    old, new = order_versions(spark, sf_dir)
    found = [tables.table_delta(old, x, ["o_orderkey"]).agg(F.lit(name).alias("side"), F.count("*").alias("n_changed")) for name, x in (("orders", new), ("same", old))]
    return found[0].union(found[1])


def customer_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = table(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"), "c_mktsegment")
    k = F.col("c_custkey")
    incoming = base.withColumn("cents", F.when(k % 3 == 0, F.col("cents") + 100).otherwise(F.col("cents")))
    local = base.withColumn("c_mktsegment", F.when(k % 2 == 0, F.lit("EDITED")).otherwise(F.col("c_mktsegment"))).withColumn("cents", F.when(k % 12 == 0, F.col("cents") + 500).otherwise(F.col("cents")))
    return base, local, incoming


@query("SELECT c_custkey, round(c_acctbal * 100)::BIGINT + CASE WHEN c_custkey % 12 = 0 THEN 500 WHEN c_custkey % 3 = 0 THEN 100 ELSE 0 END AS cents, CASE WHEN c_custkey % 2 = 0 THEN 'EDITED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def m3_merge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.merge_tables(*customer_versions(spark, sf_dir), ["c_custkey"])[0]


@query("SELECT c_custkey, 'cents' AS column, (round(c_acctbal * 100)::BIGINT + 500)::VARCHAR AS local, (round(c_acctbal * 100)::BIGINT + 100)::VARCHAR AS incoming FROM customer WHERE c_custkey % 12 = 0")
def m3_merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.merge_tables(*customer_versions(spark, sf_dir), ["c_custkey"])[1]
