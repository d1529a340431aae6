"""Routing, authorisation and target resolution over tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casdelta.functions.rules import is_hex64, prefix_admits, program_fault, target_fault

TRANSFER = ("commit", "delete", "have", "list", "manifest")


def route(topic: Column) -> Column:
    """Handler of a topic by its prefix: sync, run, legacy or unknown."""
    return F.when(F.startswith(topic, F.lit("sync2/")), "sync").when(F.startswith(topic, F.lit("run/")), "run").when(F.startswith(topic, F.lit("legacy/")), "legacy").otherwise("unknown")


def decode(messages: DataFrame, schema: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """messages (…, payload_hex) with body and status (ok or bad_json); missing optional fields get their defaults."""
    body = F.from_json(F.try_validate_utf8(F.unhex("payload_hex").cast("string")), schema)
    out = messages.withColumn("body", body)
    for name, value in (defaults or {}).items():
        out = out.withColumn("body", F.when(F.col("body").isNotNull(), F.col("body").withField(name, F.coalesce(F.col(f"body.{name}"), value))))
    return out.withColumn("status", F.when(F.col("body").isNull(), "bad_json").otherwise("ok"))


def reply(ok: Column, error: Column | None = None, **fields: Column) -> Column:
    """A JSON reply."""
    return F.to_json(F.struct(ok.alias("ok"), (F.lit(None).cast("string") if error is None else error).alias("error"), *(c.alias(k) for k, c in fields.items())))


def transfer_gate(topic: Column, enabled: bool) -> Column:
    """Why a request is not handled at all: transfers are refused unless switched on."""
    return F.when(F.element_at(F.split(topic, "/"), -1).isin(*TRANSFER) & F.lit(not enabled), "transfer_disabled")


def authorize(requests: DataFrame, links: DataFrame, roots: DataFrame, revoked: DataFrame, now: int) -> DataFrame:
    """(request_id, allowed, reason, path_prefix) of requests (request_id, host, from_id, action).

    links: request_id, pos, issuer, audience, actions, not_after (0: never), path_prefix, nonce, sig_ok. A chain holds if it begins at
    the host or an accepted root, each link is issued by the one before it to its audience and the last to the requester, actions
    never grow, no link is expired, revoked or badly signed, and the last grants the action. reason names the first fault.
    """
    gone = revoked.select("issuer", "nonce", F.lit(True).alias("_gone")).distinct()
    trusted = roots.select(F.col("key").alias("issuer"), F.lit(True).alias("_root")).distinct()
    order = Window.partitionBy("request_id").orderBy("pos")
    each = links.join(gone, ["issuer", "nonce"], "left").join(trusted, "issuer", "left")
    before, granted = F.lag("audience").over(order), F.lag("actions").over(order)
    each = each.withColumn("_linked", before.isNull() | before.eqNullSafe(F.col("issuer"))).withColumn("_shrinks", granted.isNull() | (F.size(F.array_except("actions", granted)) == 0))
    chain = each.groupBy("request_id").agg(
        F.bool_and("sig_ok").alias("signed"),
        F.bool_and(F.col("_gone").isNull()).alias("live"),
        F.bool_and((F.col("not_after") == 0) | (F.col("not_after") >= now)).alias("fresh"),
        F.bool_and("_linked").alias("linked"),
        F.bool_and("_shrinks").alias("shrinks"),
        F.min_by("issuer", "pos").alias("first"),
        F.min_by(F.coalesce("_root", F.lit(False)), "pos").alias("rooted"),
        F.max_by("audience", "pos").alias("last"),
        F.max_by("actions", "pos").alias("granted"),
        F.max_by("path_prefix", "pos").alias("path_prefix"),
    )
    out = requests.join(chain, "request_id", "left")
    reason = (
        F.when(F.col("first").isNull(), "no_chain")
        .when(~F.col("signed"), "bad_signature")
        .when(~F.col("live"), "revoked")
        .when(~F.col("fresh"), "expired")
        .when(~(F.col("rooted") | (F.col("first") == F.col("host"))), "untrusted_root")
        .when(~F.col("linked"), "broken_chain")
        .when(~F.col("shrinks"), "actions_grow")
        .when(~F.col("last").eqNullSafe(F.col("from_id")), "wrong_audience")
        .when(~F.array_contains("granted", F.col("action")), "not_granted")
    )
    return out.select("request_id", reason.isNull().alias("allowed"), reason.alias("reason"), "path_prefix")


def path_scope(requests: DataFrame, links: DataFrame) -> DataFrame:
    """(request_id, fault) of requests (request_id, path): the last link's prefix and the rules of safe paths."""
    last = links.groupBy("request_id").agg(F.max_by("path_prefix", "pos").alias("_prefix"))
    out = requests.join(last, "request_id", "left")
    return out.select("request_id", target_fault(F.col("path"), F.col("_prefix")).alias("fault"))


def spawn_audit(requests: DataFrame, allowed: list[str]) -> DataFrame:
    """(request_id, reason) of requests (request_id, cmd, cwd, path_prefix); null: it may run. Nothing is launched."""
    scope = F.when(F.contains("cwd", F.lit("..")), "cwd_dotdot").when(~F.coalesce(prefix_admits(F.col("path_prefix"), F.col("cwd")), F.lit(True)), "cwd_outside")
    return requests.select("request_id", F.coalesce(program_fault(F.col("cmd"), allowed), scope).alias("reason"))


def resolve_targets(requests: DataFrame, aliases: DataFrame, wallet: DataFrame) -> DataFrame:
    """(request_id, node_id, cap, reason): a hex id, else an alias, else a wallet alias; cap: stated, the alias's, the wallet's by node.

    aliases: alias, node_id, cap. wallet: alias, node_id, cap.
    """
    a = aliases.select(F.col("alias").alias("target"), F.col("node_id").alias("_a"), F.col("cap").alias("_acap"))
    w = wallet.select(F.col("alias").alias("target"), F.col("node_id").alias("_w"))
    node = F.when(is_hex64(F.col("target")), F.lower("target")).otherwise(F.coalesce("_a", "_w"))
    out = requests.join(a, "target", "left").join(w, "target", "left").withColumn("node_id", node)
    caps = wallet.groupBy("node_id").agg(F.min("cap").alias("_wcap"))
    out = out.join(caps, "node_id", "left").withColumn("_cap", F.coalesce("cap", "_acap", "_wcap"))
    reason = F.when(F.col("node_id").isNull(), "unknown_target").when(F.col("_cap").isNull(), "no_capability")
    return out.select("request_id", "node_id", F.col("_cap").alias("cap"), reason.alias("reason"))


def from_peers(messages: DataFrame, peers: DataFrame, prefix: str) -> DataFrame:
    """Messages of known peers under a topic prefix."""
    return messages.where(F.startswith("topic", F.lit(prefix))).join(peers.select(F.col("peerNodeId").alias("from_id")).distinct(), "from_id", "left_semi")
