"""Streams of file events and messages: debounce, dedup, stateful replay. Each has a batch form with the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casdelta.operators.authz import authorize
from casdelta.operators.conflict import Version, meet
from casdelta.operators.history import each_peer
from casdelta.staging import staged

OnBatch = Callable[[DataFrame, int], None]


def inbox(messages: DataFrame, prefix: str) -> DataFrame:
    """Messages that await a reply, under a topic prefix; for batches and streams."""
    return messages.where(F.col("reply_token").isNotNull() & F.startswith("topic", F.lit(prefix)))


def debounce(events: DataFrame, gap: str, key: str, late: str = "1 hour", rules_file: str = ".syncignore") -> DataFrame:
    """(key, start, end, paths, full_rescan): sessions of events (key, ts, path) no more than `gap` apart, with their distinct paths.

    An event of the rules file asks for a full rescan. For batches and streams; streams drop what is later than `late`. A batch's
    sessions are numbered by time slices, as in debounced(), and only a session's distinct paths come together in its row.
    """
    if not events.isStreaming:
        spark = events.sparkSession
        micros = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + CAST('{gap}' AS INTERVAL))").first()[0]
        # a struct is never null, so events without a key have sessions of their own, as in a stream
        facts, paths = _sessions(events.select(F.struct(F.col(key).alias("key")).alias("_key"), "ts", "path"), micros / 1000, "_key", rules_file)
        held = paths.groupBy("_key", "session").agg(F.array_sort(F.collect_list("path")).alias("paths"))
        out = facts.join(held, ["_key", "session"], "left")
        none = F.array().cast(held.schema["paths"].dataType)
        rescan = F.when(F.col("paths").isNotNull(), F.col("full_rescan")).alias("full_rescan")
        return out.select(F.col("_key.key").alias(key), "start", "end", F.coalesce("paths", none).alias("paths"), "n_events", rescan)
    touches = F.element_at(F.split("path", "/"), -1) == rules_file
    return (
        events.withWatermark("ts", late)
        .groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("n_events"), F.bool_or(touches).alias("full_rescan"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n_events", "full_rescan")
    )


def sessioned(events: DataFrame, gap_ms: float, key: str, slice_ms: int = 3_600_000) -> DataFrame:
    """events (key, ts and whatever else) of a batch with `session`: 1, 2, 3… for each key, no more than gap_ms between neighbours.

    Events are dealt by key and time slice and numbered within; the slices' ends tell which of their sessions go on in the next one.
    So a key with any share of the events is spread over as many tasks as it has slices. Events without a key or time have none.
    """
    slice_ = F.floor(F.unix_micros("ts") / (slice_ms * 1000))
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withColumn("_us", F.unix_micros("ts")).withColumn("_slice", slice_)
    inside = Window.partitionBy(key, "_slice").orderBy("_us")
    fresh = F.coalesce(F.col("_us") - F.lag("_us").over(inside) > gap_ms * 1000, F.lit(True))
    rows = rows.withColumn("_fresh", fresh.cast("long"))
    rows = staged(rows.withColumn("_local", F.sum("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh"), "sessions")
    ends = rows.groupBy(key, "_slice").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.max("_local").alias("_k"))
    slices = Window.partitionBy(key).orderBy("_slice")
    glued = F.coalesce(F.col("_first") - F.lag("_last").over(slices) <= gap_ms * 1000, F.lit(False))
    ends = ends.withColumn("_new", F.col("_k") - glued.cast("long"))
    before = F.sum("_new").over(slices.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")
    joined = rows.join(ends.select(key, "_slice", before.alias("_before")), [key, "_slice"])
    return joined.withColumn("session", F.col("_before") + F.col("_local")).drop("_us", "_slice", "_local", "_before")


def _sessions(events: DataFrame, gap_ms: float, key: str, rules_file: str, slice_ms: int = 3_600_000) -> tuple[DataFrame, DataFrame]:
    """(key, session, start, end, n_events, full_rescan) and the distinct (key, session, path) of a batch."""
    rows = staged(sessioned(events.select(key, "ts", "path"), gap_ms, key, slice_ms), "debounce")
    touches = F.coalesce(F.element_at(F.split("path", "/"), -1) == rules_file, F.lit(False))
    end = F.timestamp_micros(F.max(F.unix_micros("ts")) + round(gap_ms * 1000))
    facts = rows.groupBy(key, "session").agg(F.min("ts").alias("start"), end.alias("end"), F.count("*").alias("n_events"), F.bool_or(touches).alias("full_rescan"))
    return facts, rows.where("path is not null").select(key, "session", "path").distinct()


def debounced(events: DataFrame, gap_ms: float, key: str, rules_file: str = ".syncignore", slice_ms: int = 3_600_000) -> tuple[DataFrame, DataFrame]:
    """debounce() of a batch for hot keys: (key, session, start, end, n_events, n_paths, full_rescan), and (key, session, path) as rows.

    Sessions and paths are counted map-side, so neither a long session nor one of very many paths is held in a row or a task.
    """
    facts, paths = _sessions(events, gap_ms, key, rules_file, slice_ms)
    counted = paths.groupBy(key, "session").agg(F.count("*").alias("n_paths"))
    out = facts.join(counted, [key, "session"], "left")
    return out.select(key, "session", "start", "end", "n_events", F.coalesce("n_paths", F.lit(0)).cast("long").alias("n_paths"), "full_rescan"), paths


def event_actions(paths: DataFrame, objects: DataFrame, ignored=None) -> DataFrame:
    """(path, action) of distinct paths: push if an object is there, delete if not, drop if ignored(path)."""
    now = objects.select(F.col("rel_path").alias("path"), F.lit(True).alias("_here"))
    drop = F.lit(False) if ignored is None else ignored(F.col("path"))
    return paths.join(now, "path", "left").select("path", F.when(drop, "drop").when(F.col("_here"), "push").otherwise("delete").alias("action"))


def dedup(messages: DataFrame, key: list[str], late: str | None = None) -> DataFrame:
    """Each key once: the first by ts in a batch, the first to come within `late` in a stream."""
    if messages.isStreaming:
        return messages.withWatermark("ts", late or "1 hour").dropDuplicatesWithinWatermark(key)
    order = Window.partitionBy(*key).orderBy("ts", "event_id")
    return messages.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def content_key(messages: DataFrame) -> DataFrame:
    """messages with content_key: a digest of sender, topic and the whole payload."""
    return messages.withColumn("content_key", F.sha2(F.concat_ws("|", "from_id", "topic", "payload_hex"), 256))


def fan_out(changes: DataFrame, peers: DataFrame, acked: DataFrame) -> DataFrame:
    """(peer, rel_path, cid): each change for each peer that hasn't acknowledged it."""
    return each_peer(changes, peers).select("peer", "rel_path", "cid").join(acked.select("peer", "rel_path", "cid"), ["peer", "rel_path", "cid"], "left_anti")


def judge_each(links: Callable[[SparkSession], DataFrame], roots: Callable[[SparkSession], DataFrame], revoked: Callable[[SparkSession], DataFrame], now: Callable[[], int], write: OnBatch) -> OnBatch:
    """For foreachBatch over a stream of requests: authz.authorize() with links, roots and revocations as they stand at each batch.

    A revocation holds from the next batch on; the trigger's interval bounds its delay. If a table can't be read the batch fails and
    is repeated: no request is judged by a list that may be out of date.
    """

    def each(requests: DataFrame, batch: int) -> None:
        spark = requests.sparkSession
        write(authorize(requests, links(spark), roots(spark), revoked(spark), now()), batch)

    return each


def reemit_each(changes: Callable[[SparkSession], DataFrame], peers: Callable[[SparkSession], DataFrame], acked: Callable[[SparkSession], DataFrame], write: OnBatch) -> OnBatch:
    """For foreachBatch over a stream of ticks (a rate source, every ten seconds): all that a peer has not acknowledged by then, again.

    This repairs lost messages and rows that came too late for a watermark; a change that every peer has is not sent again.
    """

    def each(ticks: DataFrame, batch: int) -> None:
        spark = ticks.sparkSession
        write(fan_out(changes(spark), peers(spark), acked(spark)), batch)

    return each


class _Tail(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "next_offset long, length long, exit_code int, done boolean")
        self.early = handle.getMapState("early", "offset long", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, length, code, done = self.now.get() if self.now.exists() else (0, None, None, False)
        if done:
            return
        waiting = {k[0]: v[0] for k, v in self.early.iterator()} if self.early.exists() else {}
        held = set(waiting)
        for r in pd.concat(rows).itertuples():
            if pd.notna(r.exit_code):
                length, code = int(r.offset), int(r.exit_code)
            elif r.data is not None and len(r.data) > len(waiting.get(int(r.offset), b"")):
                waiting[int(r.offset)] = bytes(r.data)
                held.discard(int(r.offset))
        parts = []
        for offset in sorted(waiting):
            if offset > at:
                break
            part = waiting.pop(offset)[at - offset :]
            parts.append(part)
            at += len(part)
        data = b"".join(parts)
        done = code is not None and at >= length
        if done:
            # bytes past the stated length don't count, in whichever batch they come
            over = min(at - length, len(data))
            data, at, waiting = data[: len(data) - over], at - over, {}
        stored = {k[0] for k in self.early.keys()} if self.early.exists() else set()
        for offset in stored - set(waiting):
            self.early.removeKey((offset,))
        for offset in set(waiting) - held:
            self.early.updateValue((offset,), (waiting[offset],))
        self.now.update((at, length, code, done))
        if data or done:
            yield pd.DataFrame({"job_id": [key[0]], "data": [data], "next_offset": [at], "exit_code": pd.array([code if done else None], "Int32")})

    def close(self) -> None:
        pass


def tail(pieces: DataFrame) -> DataFrame:
    """(job_id, data, next_offset, exit_code) of a stream of log pieces (job_id, offset, data, exit_code): each byte once, in order.

    A piece may come again, overlap or come before its turn, when it waits. A job ends by a row with an exit_code and the log's length
    as its offset; exit_code is set on the row that brings the last byte, and nothing follows it.
    """
    kind = pieces.schema["job_id"].dataType.simpleString()
    return pieces.groupBy("job_id").transformWithStateInPandas(_Tail(), f"job_id {kind}, data binary, next_offset long, exit_code int", "Append", "None")


class _Replay(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "cid string, mtime_ms long, n_conflicts long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            if isinstance(r.cid, str):
                self.now.update((r.cid, int(r.mtime_ms), int(r.n_conflicts)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cid, mtime, n = self.now.get() if self.now.exists() else (None, None, 0)
        now = Version(cid, mtime)
        for r in pd.concat(rows).sort_values(["seq", "cid"]).itertuples():
            now, _, conflict = meet(now, Version(r.cid, int(r.mtime_ms)), r.base if isinstance(r.base, str) else None)
            n += conflict
        self.now.update((now.cid, now.mtime, int(n)))
        yield pd.DataFrame({"rel_path": [key[0]], "cid": [now.cid], "mtime_ms": [now.mtime], "n_conflicts": [int(n)]})

    def close(self) -> None:
        pass


def stateful_replay(log: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """conflict.replay() over a stream of commits (rel_path, seq, cid, mtime_ms, base): the state of a path outlives its log.

    state: files that are there when the stream begins (rel_path, cid, mtime_ms, and n_conflicts if known), each path once; it is taken
    over by the first batch of a new checkpoint and is not read again after a restart. Rows come out for paths that have commits.
    """
    start = None
    if state is not None:
        count = F.col("n_conflicts") if "n_conflicts" in state.columns else F.lit(0)
        start = state.select("rel_path", "cid", F.col("mtime_ms").cast("long").alias("mtime_ms"), count.cast("long").alias("n_conflicts")).groupBy("rel_path")
    return log.groupBy("rel_path").transformWithStateInPandas(_Replay(), "rel_path string, cid string, mtime_ms long, n_conflicts long", "Update", "None", initialState=start)
