"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate divided by its quality weight, so that the first documents by key are a weighted sample
without replacement. A source's target is spent in complete epochs first; what is left is a prefix, by key, of the source's
documents, the last of them taken in part. All rows are dealt by ranges of source and key as they are found, so the ranges are about
equal whatever the weights; prefix sums go over the ranges first and then within each, so that a source that holds a third of all rows
is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casdelta.llm.common import WORD, free, staged, whole_text

#: Relative weights, repeating, of the sources in the order of their names, null last.
WEIGHTS = (3, 1, 2)


def quality_weight(text: Column) -> Column:
    """1 for a text without junk marks, less by four times their share, 0.1 at least; in steps of 1/1024."""
    junk = F.regexp_count(text, F.lit(r"[!*$#%&|]")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.1), F.floor((1 - 4 * junk) * 1024) / 1024)


def uniform(seed: Column) -> Column:
    """In (0, 1), from the first 12 hexadecimal digits of an md5."""
    return (F.conv(F.substring(F.md5(seed.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Return source, source_size, target for a table of source (unique, null allowed) and source_size.

    The sources get share times all sizes by weight; a target stops at most times its source's size and the excess is shared again by
    weight among the others until none is above. The table is ranked range by range, so any number of sources will do; the driver
    sees counts of ranges and sums only.
    """
    ranged = staged(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("_part", F.spark_partition_id()), "mix-sources")
    before = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    start, at = [], 0
    for part in sorted(before):
        start.append((part, at))
        at += before[part]
    offset = F.create_map(*[F.lit(x) for pair in start for x in pair]) if start else F.create_map(F.lit(0), F.lit(0))
    order = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    ranked = ranged.withColumn("_rank", F.row_number().over(order) - 1 + offset[F.col("_part")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = staged(ranked.select("source", "source_size", weight.alias("_weight")), "mix-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, most * F.col("source_size")
    while True:  # each round caps at least one more source, or ends
        above = cap <= F.lit(level) * F.col("_weight") if level else F.lit(False)
        capped, open_weight = table.agg(F.sum(F.when(above, F.col("source_size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("_weight")))).first()
        new = (share * total - most * (capped or 0)) / open_weight if open_weight else level
        if new <= level or not total:
            break
        level = new
    return table.select("source", "source_size", F.least(cap, F.lit(level) * F.col("_weight")).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, rows_a_range: int = 20_000, weight: Column | None = None) -> DataFrame:
    """Return doc_id, size, source_size, target, taken, epochs, for each row of docs (doc_id, text, source).

    size: words of the text (null: 0); taken: words the mix takes from this row, repeats counted, at most `most` times its size; the
    taken words of a source sum to its target, rounded down. A null source is a source of its own. Rows of one id and equal text are
    told apart by nothing, so ties among them are broken by size only; they take the same or neighbouring places. Empty texts take
    nothing. The key depends on doc_id, size and weight, so reruns agree. weight: a positive column of docs that draws better
    documents first; without it quality_weight() of the text. Other columns make no difference.
    """
    text = whole_text()
    words = F.regexp_count(text, F.lit(WORD))
    key = -F.log(uniform(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), words.cast("string")))) / (quality_weight(text) if weight is None else weight)
    slim = docs.select("doc_id", "source", words.cast("long").alias("size"), key.alias("_key"))
    slim = staged(slim, "mix-documents")
    ranges = slim.count() // rows_a_range + 8
    order = [F.col("source").isNull(), F.col("source"), F.col("_key"), F.col("doc_id"), F.col("size")]
    dealt = staged(slim.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    heads = staged(dealt.groupBy("source", "_range").agg(F.sum("size").alias("_sum")), "mix-sums")
    sums = heads.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    aim = targets(sums, share, most)
    by_source = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("source", "_range", F.coalesce(F.sum("_sum").over(by_source), F.lit(0)).alias("_head"))
    heads = heads.join(aim, heads["source"].eqNullSafe(aim["source"])).select(heads["source"], "_range", "_head", "source_size", "target")
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = placed.alias("d").join(heads.alias("h"), F.col("d.source").eqNullSafe(F.col("h.source")) & (F.col("d._range") == F.col("h._range")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("_head") - F.col("_before")
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest))
    return out.select(F.col("d.doc_id").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"), epochs.cast("long").alias("epochs"))


def repeated(docs: DataFrame, broadcast_rows: int = 500_000, **how: float) -> DataFrame:
    """docs with each row as often as mix() takes it: taken over size, rounded half up; rows not taken, or without words, go.

    Rows that share id and size are taken as one and keep their number. Columns of docs keep their names and values, whatever they are.
    A plan of at most broadcast_rows rows, as counted, is broadcast (20 bytes a row), so that whole texts stay where they are; a larger
    one is joined by shuffle, with the same rows.
    """
    words, copy = free(docs, "_words", "_copy")
    plan = mix(docs, **how).where("size > 0")
    times = plan.groupBy("doc_id", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    times = times.select("doc_id", "size", F.floor(F.col("taken") / (F.col("size") * F.col("rows")) + 0.5).cast("int").alias("times")).where("times > 0")
    times = staged(times, "mix-times")
    times = F.broadcast(times) if times.count() <= broadcast_rows else times
    held = docs.withColumn(words, F.regexp_count(whole_text(), F.lit(WORD))).alias("d")
    joined = held.join(times.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col(f"d.{words}") == F.col("t.size")))
    return joined.select("d.*", F.explode(F.sequence(F.lit(1), F.col("t.times"))).alias(copy)).drop(words, copy)
