"""Joins whose keys may be hot: a merged Misra-Gries sketch finds the keys that hold a large share, and only these are spread.

And the deal of rows to tasks that walk a key's rows in order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: A key is hot with a 200th of the rows or more, so there are 200 hot keys at most.
HOT_SHARE = 1 / 200


def dealt(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with all rows of a key in one task, a task's rows sorted by key and order.

    Rows are dealt by a digest of the key. Spark leaves out a shuffle by the key itself where df seems dealt by it already, and adaptive
    execution may then cut that deal apart (a union's sides, a join turned local), as functions over batches ask for none.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)


def cut(counts: dict, most: int) -> dict:
    """The Misra-Gries summary cut to `most` counters: all lose as much as the next one has, so none is overstated."""
    if len(counts) <= most:
        return counts
    less = heapq.nlargest(most + 1, counts.values())[-1]
    return {k: n - less for k, n in counts.items() if n > less}


def sketch(df: DataFrame, key: str, counters: int) -> DataFrame:
    """(key, least, total): a summary for each task; a task of n rows understates a key by n/(counters + 1) at most.

    total stands on one row a task, its number of rows. Nulls are no key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = {}, 0
        for batch in batches:
            found = pc.value_counts(batch.column(0).drop_null())
            total += len(batch.column(0)) - batch.column(0).null_count
            for k, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + n
            held = cut(held, counters) if len(held) > 8 * counters else held
        held = cut(held, counters)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([*held, None], batch.schema.field(0).type), pa.array([*held.values(), 0], pa.int64()), pa.array([0] * len(held) + [total], pa.int64())], ["key", "least", "total"])

    slim = df.select(F.col(key).alias("key"))
    return slim.mapInArrow(run, StructType([StructField("key", slim.schema["key"].dataType), StructField("least", LongType()), StructField("total", LongType())]))


def heavy_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list[tuple[object, int]]:
    """(key, rows) of all keys with at least that share of df's rows, and maybe some with half of it, with their least numbers of rows.

    Summaries add up by key; a key's sum is short by half the share at most. Only keys over half the share come to the driver, so
    there are 2/share of them at most.
    """
    counters = int(2 / share)
    found = sketch(df, key, counters).groupBy("key").agg(F.sum("least").alias("least"), F.sum("total").alias("total")).persist()
    try:
        total = found.agg(F.sum("total")).first()[0] or 0
        rows = found.where(F.col("key").isNotNull() & (F.col("least") >= max(1.0, total * share / 2))).select("key", "least").collect()
    finally:
        found.unpersist()
    return sorted(((r["key"], r["least"]) for r in rows), key=itemgetter(1), reverse=True)


def hot_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "left", share: float = HOT_SHARE, hot: list[tuple[object, int]] | None = None) -> DataFrame:
    """left join right (how: left or inner) on key, where a few keys may hold most of left; right has each key once.

    Rows of hot keys are dealt by key and a salt from the columns `spread`, which should tell a key's rows apart, and right's few rows of
    these keys are replicated once for each salt; a salt stands for about share/2 of all rows. All other rows are shuffled by key
    as ever. Null keys meet nothing, so they are not shuffled at all. hot: (key, rows) of the hot keys, most rows first, where they are
    known already.
    """
    found = heavy_keys(left, key, share) if hot is None else hot
    rest = left.where(F.col(key).isNotNull())
    lone = left.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key))
    if not found:
        out = rest.join(right, key, how)
    else:
        least = max(1, found[-1][1])
        keys = left.sparkSession.createDataFrame([(k, -(-n // least)) for k, n in found], StructType([StructField(key, left.schema[key].dataType), StructField("_salts", LongType())]))
        plain = rest.join(F.broadcast(keys), key, "left_anti").join(right, key, how)
        mine = rest.join(F.broadcast(keys), key).withColumn("_salt", F.pmod(F.xxhash64(*spread), F.col("_salts"))).drop("_salts")
        theirs = right.join(F.broadcast(keys), key).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
        out = plain.unionByName(mine.join(theirs, [key, "_salt"], how).drop("_salt"))
    return out.select(lone.columns).unionByName(lone) if how == "left" else out
