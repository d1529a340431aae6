"""Content addressing on ordinary keyed tables: digests by bucket, delta between versions, three-way merge.

A bucket's digest is the sum of its rows' digests modulo a prime, so digests of parts add up to those of the whole: buckets are summed
map-side, a tree of buckets needs no second pass over rows, and a table's digests follow its changes by adding and taking away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casdelta.operators.chunking import streamed_digests
from casdelta.staging import staged

#: Sums are taken modulo this prime; a row's SHA-256 gives four numbers of 60 bits.
PRIME = 2**61 - 1
LIMBS = ["d0", "d1", "d2", "d3"]
#: Children of a node in the tree of buckets.
FAN = 16


def row_sha(columns: list[str]) -> Column:
    """Digest of a row: each field with its length in front, nulls marked, so that different rows never look alike."""
    field = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    return F.sha2(F.concat_ws("|", *map(field, columns)), 256)


def bucket_digests(df: DataFrame, keys: list[str], buckets: int, bucket: Column | None = None) -> DataFrame:
    """(bucket, digest, n): SHA-256 over a bucket's sorted row digests, streamed in constant memory, a bucket in one task.

    Choose buckets so that one holds some thousands of rows. leaf_digests() needs no order and no choice.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if bucket is None else bucket
    rows = df.select(at.alias("bucket"), row_sha(sorted(df.columns)).alias("sha"))
    return streamed_digests(rows, "bucket", F.col("sha"), ["sha"], "digest")


def limbs(sha: Column) -> list[Column]:
    """Four numbers of 60 bits from the first 60 hexadecimal digits of a digest."""
    return [F.conv(F.substring(sha, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)").alias(d) for i, d in enumerate(LIMBS)]


def summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums of n and the limbs by `by`, the limbs modulo PRIME."""
    mod = lambda d: F.pmod(F.sum(F.col(d).cast("decimal(38,0)")), F.lit(PRIME).cast("decimal(38,0)")).cast("long").alias(d)
    return rows.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), *map(mod, LIMBS))


def keyed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """(keys…, bucket, sha) of df's rows: all that the digests and the delta read of a table."""
    return df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"), row_sha(sorted(df.columns)).alias("sha"))


def leaf_digests(rows: DataFrame) -> DataFrame:
    """(bucket, n, d0…d3) of keyed() rows; rows may repeat, each counts. Buckets without rows are left out."""
    return summed(rows.select("bucket", F.lit(1).cast("long").alias("n"), *limbs(F.col("sha"))), ["bucket"])


def level_above(nodes: DataFrame) -> DataFrame:
    """The digests of the nodes' parents, FAN buckets to one."""
    return summed(nodes.withColumn("bucket", F.expr(f"bucket div {FAN}")), ["bucket"])


def updated(leaves: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """leaf_digests() after rows were added and removed (keyed() rows); an update is its old row removed and its new one added.

    The table itself is not read. Leaves that no row is left in go.
    """
    minus = [F.col("n") * -1, *(F.pmod(-F.col(d), F.lit(PRIME)).alias(d) for d in LIMBS)]
    less = leaf_digests(removed).select("bucket", minus[0].alias("n"), *minus[1:])
    return summed(leaves.unionByName(leaf_digests(added)).unionByName(less), ["bucket"]).where("n <> 0 or d0 <> 0 or d1 <> 0 or d2 <> 0 or d3 <> 0")


def levels(leaves: DataFrame, buckets: int) -> list[DataFrame]:
    """The tree over the leaves, these last: each level FAN times smaller, up to one root."""
    out = [leaves]
    while buckets > 1:
        buckets = -(-buckets // FAN)
        out.append(level_above(out[-1]))
    return out[::-1]


def differing(old: DataFrame, new: DataFrame, buckets: int) -> list[DataFrame]:
    """At each level of the trees over two sides' leaf_digests(), root first, the buckets (bucket) that differ; the last are leaves.

    Below a node that is equal on both sides nothing is looked at.
    """
    out: list[DataFrame] = []
    for a, b in zip(levels(old, buckets), levels(new, buckets), strict=True):
        if out:
            inside = lambda x: x.join(out[-1].withColumnRenamed("bucket", "_up"), F.expr(f"bucket div {FAN} = _up"), "left_semi")
            a, b = inside(a), inside(b)
        mark = lambda x, name: x.select("bucket", F.struct("n", *LIMBS).alias(name))
        both = mark(a, "_a").join(mark(b, "_b"), "bucket", "full_outer")
        out.append(both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("bucket"))
    return out


def table_delta(old: DataFrame, new: DataFrame, keys: list[str], buckets: int | None = None, rows_a_bucket: int = 2_000) -> DataFrame:
    """(keys…, op): insert, update or delete; only rows of buckets whose digests differ are compared.

    Each table is read once, for keys and row digests, which are staged; the rest works on these. Without a number of buckets there
    is one for each rows_a_bucket rows, so that a bucket does not grow with the table. A repeated key in a bucket that differs is an
    error; where all rows are equal it makes no difference.
    """
    if buckets is None:
        buckets = max(256, old.count() // rows_a_bucket)
    sides = [keyed(df, keys, buckets).withColumn("_side", F.lit(side)) for side, df in enumerate((old, new))]
    both = staged(sides[0].unionByName(sides[1]), "table-keys")
    leaves = summed(both.select("_side", "bucket", F.lit(1).cast("long").alias("n"), *limbs(F.col("sha"))), ["_side", "bucket"])
    # the leaves are at hand, so they are compared as they are; differing() is for sides whose leaves are kept
    seen = leaves.groupBy("bucket").agg(F.collect_list(F.struct("n", *LIMBS)).alias("d"))
    changed = seen.where((F.size("d") < 2) | (F.get("d", F.lit(0)) != F.get("d", F.lit(1)))).select("bucket")
    opened = both.join(changed, "bucket", "left_semi").groupBy(*keys)
    side = lambda i, name: (F.min(F.when(F.col("_side") == i, F.col("sha"))).alias(name), F.count(F.when(F.col("_side") == i, 1)).alias(f"{name}_n"))
    rows = opened.agg(*side(0, "_old"), *side(1, "_new"))
    again = F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys)))).cast("string")
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old") != F.col("_new"), "update")
    checked = F.when((F.col("_old_n") > 1) | (F.col("_new_n") > 1), again).otherwise(op)
    return rows.select(*keys, checked.alias("op")).where("op is not null")


def merge_tables(base: DataFrame, local: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The merged table, and the conflicts (keys…, column, local, incoming).

    A column that one side changed takes that side's value; both alike is no conflict; otherwise local stays and the other is in
    the second table. A row deleted on one side goes if the other left it as it was, else the edit stays and column '*' marks it.
    """
    columns = [c for c in base.columns if c not in keys]

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(f"{p}_here"), *[F.col(c).alias(f"{p}_{c}") for c in columns])

    both = side(base, "b").join(side(local, "l"), keys, "full_outer").join(side(incoming, "i"), keys, "full_outer")
    c = F.col
    here = {p: F.coalesce(c(f"{p}_here"), F.lit(False)) for p in "bli"}
    same = lambda x, y: F.forall(F.array(F.lit(True), *[c(f"{x}_{k}").eqNullSafe(c(f"{y}_{k}")) for k in columns]), lambda v: v)
    only = (here["b"] & ~here["l"] & here["i"], here["b"] & here["l"] & ~here["i"])
    gone = (here["b"] & ~here["l"] & ~here["i"]) | (only[0] & same("b", "i")) | (only[1] & same("b", "l"))

    def merged(k: str) -> Column:
        b, x, y = c(f"b_{k}"), c(f"l_{k}"), c(f"i_{k}")
        return F.when(~here["l"], y).when(~here["i"], x).when(here["b"] & x.eqNullSafe(b), y).otherwise(x)

    out = both.where(~gone).select(*keys, *[merged(k).alias(k) for k in columns])
    clash = lambda k: here["l"] & here["i"] & ~c(f"l_{k}").eqNullSafe(c(f"i_{k}")) & (~here["b"] | (~c(f"l_{k}").eqNullSafe(c(f"b_{k}")) & ~c(f"i_{k}").eqNullSafe(c(f"b_{k}"))))
    item = lambda name, when, x, y: F.when(when, F.struct(F.lit(name).alias("column"), x.cast("string").alias("local"), y.cast("string").alias("incoming")))
    none = F.lit(None).cast("string")
    items = [item(k, clash(k), c(f"l_{k}"), c(f"i_{k}")) for k in columns] + [item("*", (only[0] & ~same("b", "i")) | (only[1] & ~same("b", "l")), none, none)]
    lost = both.select(*keys, F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))
    return out, lost
