"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from casdelta.staging import shared_dir, staged

__all__ = ["WORD", "free", "hashed_share", "id_bucket", "numbered", "ranges", "read", "shared_dir", "slices", "staged", "whole_text"]

#: White space of the contracts: space and U+0009 to U+000D. Every other run of characters is a word.
WORD = r"[^\x20\x09-\x0D]+"


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most so many rows and, unless a single row has more, so many bytes in one of its columns."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(length):
        if i > first and (i - first >= rows or held + n > size):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


def hashed_share(df: DataFrame, by: list[Column], share: Column | float) -> DataFrame:
    """About that share of df's rows: those whose hash of `by` lies below it. Every task decides alone, so no task sends more than its part."""
    return df.where((F.pmod(F.xxhash64(*by, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)) < share)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ranges(spark: SparkSession, rows: int) -> int:
    """How many ranges to deal so many slim rows into: no fewer than keep all cores busy, and none of more than a million rows."""
    return max(rows // 1_000_000 + 1, min(rows // 2_000 + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def numbered(df: DataFrame, order: list[Column], name: str, group: str | None = None, broadcast_rows: int = 500_000) -> DataFrame:
    """df with `name`: the place, from 0, of each row in its group (a column of strings without nulls; None: all rows) by `order`.

    Rows are dealt by ranges of group and order and numbered within them as they stream by; the sizes of the ranges before are then
    added. No group needs a task of its own. Rows that tie in all of `order` take their places in the order they were written.
    """
    spark = df.sparkSession
    tie, part = free(df, "_tie", "_part")
    by = group or free(df, "_all")[0]
    held = staged(df.withColumn(tie, F.monotonically_increasing_id()), "numbered-rows")
    rows = held.count()
    keys = [*([F.col(group)] if group else []), *order, F.col(tie)]
    sorted_rows = held.repartitionByRange(ranges(spark, rows), *keys).sortWithinPartitions(*keys).drop(tie)
    sorted_rows = sorted_rows if group else sorted_rows.withColumn(by, F.lit(""))
    at = sorted_rows.columns.index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(at))
            ends, values = runs.run_ends.to_numpy(), runs.values.to_pylist()
            starts = np.concatenate([[0], ends[:-1]])
            if values[0] == now:
                starts[0] -= seen
            place = np.arange(batch.num_rows) - np.repeat(starts, np.diff(ends, prepend=0))
            now, seen = values[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, task, np.int32)), pa.array(place.astype(np.int64))], [*batch.schema.names, part, name])

    schema = StructType([*sorted_rows.schema.fields, StructField(part, IntegerType()), StructField(name, LongType())])
    dealt = staged(sorted_rows.mapInArrow(run, schema), "numbered")
    sizes = dealt.groupBy(by, part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = staged(sizes.select(by, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_head")), "numbered-heads")
    heads = F.broadcast(heads) if heads.count() <= broadcast_rows else heads
    out = dealt.join(heads, [by, part]).withColumn(name, F.col(name) + F.col("_head"))
    return out.select(*df.columns, name)
