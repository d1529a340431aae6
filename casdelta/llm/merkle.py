"""A Merkle manifest of a dataset: subtrees by group, inclusion proofs for rows, and what has changed between two manifests.

Every level is one table of nodes (tree, at, digest). Its siblings come by equijoins of the level with itself on the computed places
of the siblings: at XOR 1 in a binary tree, the other slots of the run otherwise; the rows of slot zero, which then hold their whole
run, emit the level above. Levels shrink by the arity, so all of them together cost about two shuffles of the leaves. Proofs go down
again from the roots: a node's proof is its siblings and then its parent's proof.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casdelta.llm.common import numbered, staged
from casdelta.operators.skew import hot_join

#: Columns of documents, in the order in which a leaf takes them.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A level, or half of it, of at most so many nodes (some hundred bytes each at most, with their proofs two kilobytes) is broadcast.
FEW_NODES, FEW_PROOFS = 50_000, 5_000


def digest(*parts: Column) -> Column:
    """SHA-256 in lower-case hexadecimal of the parts, one behind the other; digests go in as text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A null is -, anything else its UTF-8 bytes with their number and a colon in front, so rows of different fields never look alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(*map(field, values))


@dataclass
class Level:
    """nodes: tree, at, digest, others (the other slots' digests in order, as bytes, of the node's run) of trees of more than one node."""

    nodes: DataFrame
    count: int


def _siblings(nodes: DataFrame, arity: int, count: int) -> DataFrame:
    """nodes with _slot and _sib: the digests of the run's other slots by their distance behind the node's own, null where there is none."""
    out, other = nodes.withColumn("_slot", F.col("at") % arity), nodes.select("tree", F.col("at").alias("_at"), "digest")
    for d in range(1, arity):
        place = F.col("at").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("at") - F.col("_slot") + (F.col("_slot") + d) % arity
        right = other.withColumnRenamed("digest", f"_s{d}")
        out = out.withColumn("_at", place).join(F.broadcast(right) if count <= FEW_NODES else right, ["tree", "_at"], "left").drop("_at")
    return out.withColumn("_sib", F.array(*(F.col(f"_s{d}") for d in range(1, arity)))).drop(*(f"_s{d}" for d in range(1, arity)))


def build(leaves: DataFrame, arity: int = 2) -> tuple[list[Level], DataFrame]:
    """The levels from the leaves up, and (tree, root) of all trees.

    leaves: tree (string, not null), at (0, 1, 2… in each tree), digest. Neighbouring runs of `arity` nodes, the last run maybe
    shorter and even of one, become their digest while a tree has more than one node. A lone leaf is its own root.
    """
    nodes, levels, roots = staged(leaves.select("tree", "at", "digest"), "merkle-leaves"), [], []
    count = nodes.count()
    while count:
        found = _siblings(nodes, arity, count)
        lone = (F.col("at") == 0) & F.forall("_sib", lambda x: x.isNull())
        other = lambda j: F.coalesce(F.unhex(F.get("_sib", F.pmod(F.lit(j) - F.col("_slot"), F.lit(arity)).cast("int") - 1)), F.lit(b""))
        others = F.concat(*(F.when(F.col("_slot") == j, F.lit(b"")).otherwise(other(j)) for j in range(arity)))
        up = F.when(~lone & (F.col("_slot") == 0), digest(F.col("digest"), F.array_join("_sib", "")))
        level = staged(found.select("tree", "at", "digest", lone.alias("root"), others.alias("others"), up.alias("up")), "merkle-level")
        roots.append(level.where("root").select("tree", F.col("digest").alias("root")))
        levels.append(Level(level.where("not root").select("tree", "at", "digest", "others"), count))
        nodes = level.where("up is not null").select("tree", F.expr(f"at div {arity}").alias("at"), F.col("up").alias("digest"))
        count = nodes.count()
    return levels, reduce(DataFrame.unionByName, roots, nodes.select("tree", F.col("digest").alias("root")).limit(0))


def proofs(levels: list[Level], arity: int = 2) -> DataFrame:
    """(tree, at, proof) of all leaves: the others of each run as bytes, from the leaf's run up to the one below the root.

    The leaf of a tree of one has no row. levels: of build(), with at least one.
    """
    path = levels[-1].nodes.select("tree", "at", F.array("others").alias("proof"))
    for level, above in reversed(list(zip(levels, levels[1:], strict=False))):
        up = path.select("tree", F.col("at").alias("_up"), F.col("proof").alias("_above"))
        mine = level.nodes.select("tree", "at", "others", F.expr(f"at div {arity}").alias("_up"))
        # a tree whose root is the level above has no row there
        met = mine.join(F.broadcast(up) if above.count <= FEW_PROOFS else up, ["tree", "_up"], "left")
        path = met.select("tree", "at", F.concat(F.array("others"), F.coalesce("_above", F.array().cast("array<binary>"))).alias("proof"))
    return path


def fold(leaf_digest: Column, at: Column, proof: Column, arity: int = 2) -> Column:
    """The root that a leaf's digest at a place gives with its proof."""

    def step(acc: Column, others: Column) -> Column:
        cut = (acc["at"] % arity * 32).cast("int")
        before, after = F.substring(others, F.lit(1), cut), F.substring(others, cut + 1, F.lit(32 * arity))
        return F.struct(digest(F.lower(F.hex(before)), acc["h"], F.lower(F.hex(after))).alias("h"), F.floor(acc["at"] / arity).alias("at"))

    return F.aggregate(proof, F.struct(leaf_digest.alias("h"), at.alias("at")), step)["h"]


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's digests as hexadecimal text, in order."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.lower(F.hex(x))), "").cast("binary"), 256)


def by_tree(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the facts of their tree (one row a tree); a tree may hold any share of the rows."""
    if facts.count() <= FEW_PROOFS:
        return rows.join(F.broadcast(facts), "tree")
    return hot_join(rows, facts, "tree", ["at"], "inner")


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, arity: int = 2, other: Column | None = None) -> DataFrame:
    """Return key, tree, at, leaf, other, subroot, root, proof, tree_at, tree_proof for each row of docs.

    leaf: digest of the row's fields; leaves of a group ascend by key, null first, then by digest; subroot is their root. The groups'
    subroots in order of the groups (null first, then by UTF-8 bytes) are the leaves of the tree of root. proof leads from leaf to
    subroot, tree_proof from subroot to root. other: a column of docs to carry, such as a second digest of the row. Rows that repeat
    all fields are leaves of their own beside each other; an empty table has no rows and no root. Other columns make no difference.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    none = F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("key"), tree.alias("tree"), leaf([F.col(c) for c in fields]).alias("digest"), (none if other is None else other).alias("other"))
    rows = staged(numbered(rows, [F.col("key").asc_nulls_first(), F.col("digest")], "at", "tree"), "merkle-rows")
    levels, roots = build(rows, arity)
    trees = staged(numbered(roots, [F.col("tree")], "tree_at"), "merkle-trees")
    top, root = build(trees.select(F.lit("").alias("tree"), F.col("tree_at").alias("at"), F.col("root").alias("digest")), arity)
    empty = F.array().cast("array<binary>")
    if top:
        paths = proofs(top, arity).select(F.col("at").alias("tree_at"), F.col("proof").alias("_path"))
        trees = trees.withColumnRenamed("root", "subroot").join(paths, "tree_at", "left").crossJoin(F.broadcast(root.select("root")))
        trees = staged(trees.select("tree", "subroot", "root", "tree_at", F.coalesce("_path", empty).alias("tree_proof")), "merkle-tops")
        rows = rows.join(proofs(levels, arity), ["tree", "at"], "left")
        rows = by_tree(rows, trees)
    else:
        rows = rows.select("*", none.alias("subroot"), none.alias("root"), empty.alias("proof"), F.lit(None).cast("long").alias("tree_at"), empty.alias("tree_proof"))
    return rows.select(F.col("key").alias(key), "tree", "at", F.col("digest").alias("leaf"), "other", "subroot", "root", F.coalesce("proof", empty).alias("proof"), "tree_at", "tree_proof")


def verified(rows: DataFrame, leaf_digest: Column, arity: int = 2) -> DataFrame:
    """manifest() rows with folded_root, what leaf_digest gives with the row's proofs, and verified, whether that is the root."""
    out = rows.withColumn("_sub", fold(leaf_digest, F.col("at"), F.col("proof"), arity))
    out = out.withColumn("folded_root", fold(F.col("_sub"), F.col("tree_at"), F.col("tree_proof"), arity)).drop("_sub")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
