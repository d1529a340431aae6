"""Delta planning and indexed reconcile: which objects changed, which chunks must move, what a push or pull leaves behind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casdelta.functions.ids import content_id
from casdelta.operators import conflict
from casdelta.operators.chunking import chunk, manifests, reassemble

INDEX = ["rel_path", "file_cid", "size", "mtime_ms", "mode", "chunks"]


def mark_unchanged(scan: DataFrame, index: DataFrame) -> DataFrame:
    """scan with unchanged: same path, size and mtime in the index; an absent path is changed."""
    known = index.select("rel_path", F.col("size").alias("_size"), F.col("mtime_ms").alias("_mtime"), F.lit(True).alias("_known"))
    same = F.col("_known") & F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ms").eqNullSafe(F.col("_mtime"))
    return scan.join(known, "rel_path", "left").withColumn("unchanged", F.coalesce(same, F.lit(False))).drop("_size", "_mtime", "_known")


def build_index(scan: DataFrame, index: DataFrame, chunk_size: int) -> DataFrame:
    """The new index: unchanged rows come over as they are, others are hashed and chunked in their row; vanished ones go.

    scan: rel_path, size, mtime_ms, mode, content. What is unchanged is decided on the metadata alone.
    """
    same = mark_unchanged(scan.select("rel_path", "size", "mtime_ms"), index).where("unchanged").select("rel_path")
    kept = index.join(same, "rel_path", "left_semi").select(INDEX)
    changed = scan.join(same, "rel_path", "left_anti")
    return kept.unionByName(manifests(changed, chunk_size, keep=("size", "mtime_ms", "mode")).select(INDEX))


def plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rel_path, op): create, modify, delete or unchanged, by file_cid; a new mtime alone is no change."""
    old = before.select("rel_path", F.col("file_cid").alias("old_cid"))
    new = after.select("rel_path", F.col("file_cid").alias("new_cid"))
    op = F.when(F.col("old_cid").isNull(), "create").when(F.col("new_cid").isNull(), "delete").when(F.col("old_cid") != F.col("new_cid"), "modify").otherwise("unchanged")
    return old.join(new, "rel_path", "full_outer").select("rel_path", op.alias("op"), "old_cid", "new_cid")


def missing(requested: DataFrame, held: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by…, cid, pos): distinct requested ids (cid, pos) that are not held, with the place where each was first seen."""
    first = requested.groupBy(*(by or []), "cid").agg(F.min("pos").alias("pos"))
    return first.join(held.select("cid").distinct(), "cid", "left_anti")


def transfer(local: DataFrame, receiver_missing: DataFrame) -> DataFrame:
    """(cid, pos): distinct local ids that the receiver lacks, by first place."""
    return local.groupBy("cid").agg(F.min("pos").alias("pos")).join(receiver_missing.select("cid").distinct(), "cid", "left_semi")


def have(requests: DataFrame, store: DataFrame) -> DataFrame:
    """(request_id, missing): each request's distinct ids that the store lacks, in order of first mention; none: an empty array."""
    wanted = requests.select("request_id", F.posexplode("cids").alias("pos", "cid"))
    lacking = missing(wanted, store, ["request_id"]).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "cid"))).alias("m"))
    listed = F.coalesce(F.transform("m", lambda x: x["cid"]), F.array().cast("array<string>"))
    return requests.select("request_id").join(lacking, "request_id", "left").select("request_id", listed.alias("missing"))


def push_plan(chunks: DataFrame, files: DataFrame, store: DataFrame) -> DataFrame:
    """(rel_path, n_chunks, n_new): new chunks are charged to the first file, by path and place, that carries them.

    chunks: rel_path, idx, cid. The first owner is a minimum, summed map-side, so a chunk that most files share is no hot key.
    """
    owner = chunks.groupBy("cid").agg(F.min(F.struct("rel_path", "idx")).alias("first")).join(store.select("cid").distinct(), "cid", "left_anti")
    new = owner.groupBy(F.col("first.rel_path").alias("rel_path")).agg(F.count("*").alias("n_new"))
    total = chunks.groupBy("rel_path").agg(F.count("*").alias("n_chunks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return files.select("rel_path").join(total, "rel_path", "left").join(new, "rel_path", "left").select("rel_path", zero("n_chunks"), zero("n_new"))


def pull_with_held(wanted: DataFrame, held: DataFrame, readable: bool = True) -> DataFrame:
    """(rel_path, n_fetched) of manifests (rel_path, chunks): distinct chunks to fetch.

    held: rel_path, cid and bytes where present. readable counts a chunk as held only with its bytes; otherwise membership is enough.
    """
    parts = wanted.select("rel_path", F.explode_outer("chunks").alias("cid")).distinct()
    have_it = (held.where("bytes is not null") if readable else held).select("rel_path", "cid", F.lit(True).alias("_held")).distinct()
    need = F.col("cid").isNotNull() & F.col("_held").isNull()
    return parts.join(have_it, ["rel_path", "cid"], "left").groupBy("rel_path").agg(F.sum(need.cast("long")).alias("n_fetched"))


def pull_plan(remote: DataFrame, index: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """(rel_path, file_cid, refused): remote objects that differ from the index; refused where local edits were never pushed.

    local: rel_path, file_cid as they are now. Remote deletions are never pulled.
    """
    known = index.select("rel_path", F.col("file_cid").alias("_cid"))
    out = remote.select("rel_path", "file_cid").join(known, "rel_path", "left").where(~F.col("file_cid").eqNullSafe(F.col("_cid")))
    if local is None:
        return out.select("rel_path", "file_cid", F.lit(False).alias("refused"))
    now = local.select("rel_path", F.col("file_cid").alias("_now"))
    unsynced = F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col("_cid")) & (F.col("_now") != F.col("file_cid"))
    return out.join(now, "rel_path", "left").select("rel_path", "file_cid", unsynced.alias("refused"))


def upsert(state: DataFrame, changes: DataFrame, key: str = "rel_path") -> DataFrame:
    """state with keyed changes: op delete removes, anything else puts the row; deleting an absent key does nothing."""
    columns = [c for c in state.columns if c != key]
    new = changes.select(key, "op", *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = state.join(new, key, "full_outer").where("op is null or op <> 'delete'")
    return joined.select(key, *[F.when(F.col("op").isNull(), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c) for c in columns])


def push_apply(index: DataFrame, commits: DataFrame, replies: DataFrame) -> DataFrame:
    """(rel_path, file_cid, base, error) after replies; the index moves on only where the reply is ok.

    commits: rel_path, file_cid. replies: rel_path, ok, conflict, applied, merged, remote_cid. Clean: base is the own id. Merged: both
    are the merged id, remote_cid. Incoming won a conflict: base is the incoming id. Otherwise the remote id is the base.
    """
    old = index.select("rel_path", F.col("file_cid").alias("_old"), F.col("base").alias("_base"))
    new = commits.select("rel_path", F.col("file_cid").alias("_new")).join(replies, "rel_path", "left")
    ok, own, remote = F.coalesce("ok", F.lit(False)), F.col("_new"), F.col("remote_cid")
    base = F.when(~F.col("conflict") | F.col("applied"), F.when(F.col("merged"), remote).otherwise(own)).otherwise(remote)
    joined = old.join(new, "rel_path", "full_outer")
    return joined.select(
        "rel_path",
        F.when(own.isNull() | ~ok, F.col("_old")).when(F.col("merged"), remote).otherwise(own).alias("file_cid"),
        F.when(own.isNull() | ~ok, F.col("_base")).otherwise(base).alias("base"),
        (own.isNotNull() & ~ok).alias("error"),
    )


def manifest_of(requests: DataFrame, objects: DataFrame, chunk_size: int) -> DataFrame:
    """(rel_path, found, file_cid, n_chunks, mode, mtime_ms) of requested paths; an absent one is found = false."""
    facts = manifests(objects, chunk_size, keep=("mode", "mtime_ms")).select("rel_path", "file_cid", F.size("chunks").cast("long").alias("n_chunks"), "mode", "mtime_ms")
    return requests.select("rel_path").join(facts, "rel_path", "left").select("rel_path", F.col("file_cid").isNotNull().alias("found"), "file_cid", "n_chunks", "mode", "mtime_ms")


def listing(objects: DataFrame, under: Column) -> DataFrame:
    """(path, file_cid, mtime_ms, mode) of objects for which `under` holds; no ignore rules."""
    return objects.where(under).select(F.col("rel_path").alias("path"), content_id(F.col("content")).alias("file_cid"), "mtime_ms", "mode")


def upload_missing(chunks: DataFrame, lacking: DataFrame) -> DataFrame:
    """(cid, bytes) to write, each missing chunk once; raises if bytes do not hash to their id."""
    one = chunks.join(lacking.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.first("bytes").alias("bytes"))
    wrong = F.raise_error(F.concat(F.lit("stored id differs from "), F.col("cid")))
    return one.select("cid", F.when(content_id(F.col("bytes")) == F.col("cid"), F.col("bytes")).otherwise(wrong.cast("binary")).alias("bytes"))


def pull_files(wanted: DataFrame, held: DataFrame, remote: DataFrame, readable: bool = True) -> DataFrame:
    """(rel_path, n_fetched, status, content): the wanted files rebuilt from chunks at hand and chunks fetched, and verified.

    wanted: manifests (rel_path, file_cid, chunks). held: rel_path, cid, bytes of the receiver; remote: cid, bytes of the sender.
    n_fetched counts a file's distinct chunks that are not held as pull_with_held() has it. A chunk that is held without its bytes
    comes from the sender too; one that nobody has makes the file missing_chunk, and bytes that don't hash to their id bad_chunk.
    """
    count = pull_with_held(wanted, held, readable)
    at_hand = held.where("bytes is not null").select("cid", "bytes", F.lit(0).alias("far"))
    # what is at hand and right goes before what has to travel
    both = at_hand.where(content_id(F.col("bytes")) == F.col("cid")).unionByName(remote.select("cid", "bytes", F.lit(1).alias("far")))
    blobs = both.groupBy("cid").agg(F.min_by("bytes", "far").alias("bytes"))
    return count.join(reassemble(wanted, blobs, once=True), "rel_path").select("rel_path", "n_fetched", "status", "content")


def pull_one_shot(asked: DataFrame, remote: DataFrame, blobs: DataFrame, strict: bool = True) -> DataFrame:
    """(rel_path, n_fetched, status, mode, content) of asked paths, every chunk fetched.

    remote: manifests with mode (rel_path, file_cid, chunks, mode). A path that the remote side lacks is an error, or has status
    absent if not strict, and no mode.
    """
    wanted = asked.select("rel_path").distinct().join(remote.select("rel_path", "file_cid", "chunks", "mode"), "rel_path", "left")
    none = blobs.select(F.lit(None).cast("string").alias("rel_path"), "cid", "bytes").limit(0)
    here = wanted.where("file_cid is not null")
    done = pull_files(here.drop("mode"), none, blobs, readable=False).join(here.select("rel_path", "mode"), "rel_path")
    absent = F.lit("absent") if not strict else F.raise_error(F.concat(F.lit("no remote file at "), F.col("rel_path"))).cast("string")
    lacking = wanted.where("file_cid is null").select("rel_path", F.lit(None).cast("long").alias("n_fetched"), absent.alias("status"), "mode", F.lit(None).cast("binary").alias("content"))
    return done.select(lacking.columns).unionByName(lacking)


def pull_apply(state: DataFrame, pulled: DataFrame) -> DataFrame:
    """The index (rel_path, file_cid, size, mtime_ms, mode, chunks, base) after a pull: verified files take the remote row, whole.

    pulled: the same columns but base, of the remote side, and status. Of a verified file (ok) the base is its new id; all others stay
    as they are.
    """
    columns = [c for c in state.columns if c not in ("rel_path", "base")]
    put = pulled.where("status = 'ok'").select("rel_path", *columns, F.col("file_cid").alias("base"), F.lit("put").alias("op"))
    return upsert(state, put)


def set_base(entries: DataFrame, seen: DataFrame) -> DataFrame:
    """entries with base, the id last seen at the other side (seen: rel_path, file_cid); null where none was."""
    return entries.drop("base").join(seen.select("rel_path", F.col("file_cid").alias("base")), "rel_path", "left")


def put_base(bases: DataFrame, changes: DataFrame) -> DataFrame:
    """bases (rel_path, content) after changes of the same columns: the new content replaces the old, whatever it was."""
    return upsert(bases, changes.select("rel_path", "content", F.lit("put").alias("op")))


def delete_ack(index: DataFrame, replies: DataFrame) -> DataFrame:
    """index after the replies to deletions (rel_path, deleted, conflict): what was deleted without a conflict is dropped with its base."""
    gone = replies.where(F.coalesce("deleted", F.lit(False)) & ~F.coalesce("conflict", F.lit(False))).select("rel_path").distinct()
    return index.join(gone, "rel_path", "left_anti")


def push_counts(before: DataFrame, after: DataFrame, chunks: DataFrame, store: DataFrame) -> DataFrame:
    """(op, n_files, n_new): files by what happens to them, and the chunks that must move for them; chunks and store as in push_plan()."""
    moved = push_plan(chunks, after, store)
    steps = plan(before, after).join(moved, "rel_path", "left")
    return steps.groupBy("op").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_new"), F.lit(0)).cast("long").alias("n_new"))


def dry_run(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rel_path, op, n_chunks): what a push would do, nothing written: all chunks of created and modified files, and the deletions.

    before and after: indexes (rel_path, file_cid, chunks).
    """
    steps = plan(before, after).where("op <> 'unchanged'")
    sizes = after.select("rel_path", F.size("chunks").cast("long").alias("n_chunks"))
    return steps.join(sizes, "rel_path", "left").select("rel_path", "op", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))


@dataclass
class Push:
    """What one push leaves: the sender's index, the receiver's files, the chunks written, and counts by what happened."""

    index: DataFrame
    files: DataFrame
    uploaded: DataFrame
    counts: DataFrame


def push_once(scan: DataFrame, index: DataFrame, files: DataFrame, store: DataFrame, chunk_size: int, policy: str = "lww", short: str = "local") -> Push:
    """One push of a scanned tree: index it, plan, upload the missing chunks, commit and delete at the receiver, fold the replies in.

    scan: rel_path, size, mtime_ms, mode, content. index: INDEX columns and base. files: the receiver's rel_path, cid, mtime_ms,
    content. store: cid of the chunks it has. Only created and modified files are read and sent; a second push of the same tree sends
    nothing. Conflicts go by policy, with the copies as files of their own; deletions go only where the receiver's file is the base.
    """
    fresh = build_index(scan, index.drop("base"), chunk_size)
    steps = plan(index, fresh)
    sent = steps.where("op in ('create', 'modify')").select("rel_path")
    bodies = scan.join(sent, "rel_path", "left_semi")
    parts = chunk(bodies, chunk_size)
    lacking = parts.select("cid").distinct().join(store.select("cid").distinct(), "cid", "left_anti")
    uploaded = upload_missing(parts, lacking)
    local = files.select("rel_path", F.col("cid").alias("local_cid"), F.col("mtime_ms").alias("local_mtime_ms"), F.col("content").alias("local"))
    base = index.select("rel_path", F.col("base").alias("base_cid"))
    known = files.select(F.col("cid").alias("base_cid"), F.col("content").alias("base")).dropDuplicates(["base_cid"])
    asked = bodies.select("rel_path", content_id(F.col("content")).alias("incoming_cid"), F.col("mtime_ms").alias("incoming_mtime_ms"), F.col("content").alias("incoming"))
    rows = asked.join(local, "rel_path", "left").join(base, "rel_path", "left").join(known, "base_cid", "left").select("*", F.lit(policy).alias("policy"), F.lit(short).alias("short"))
    built = asked.select("rel_path", F.lit("ok").alias("status"))
    done = conflict.accepted(rows, built)
    heard = conflict.replies(done).withColumn("ok", F.lit(True))
    contents = conflict.published(done).withColumnRenamed("bytes", "content").unionByName(files.select("cid", "content")).dropDuplicates(["cid"])
    kept = conflict.committed(files.select("rel_path", "cid", "mtime_ms"), done)
    gone = steps.where("op = 'delete'").select("rel_path").join(index.select("rel_path", "base"), "rel_path", "left")
    deleted = conflict.delete_batch(gone, files)
    kept = kept.join(deleted.where("deleted").select("rel_path"), "rel_path", "left_anti").join(contents, "cid", "left").select("rel_path", "cid", "mtime_ms", "content")
    moved = push_apply(index, fresh.join(sent, "rel_path", "left_semi").select("rel_path", "file_cid"), heard)
    # deletions that the receiver refused stay in the index as they were
    facts = fresh.unionByName(index.select(INDEX).join(fresh, "rel_path", "left_anti")).drop("file_cid")
    new_index = delete_ack(moved.join(facts, "rel_path", "left"), deleted).select(*INDEX, "base")
    counts = steps.groupBy("op").agg(F.count("*").alias("n_files"))
    return Push(new_index, kept, uploaded, counts)
