"""Target-distribution importance resampling over hashed n-gram features.

The distinct words of each slice of texts go into an Aho-Corasick automaton, bounded by delimiters on both sides, with the CRC-32 and
the length of their bytes as payload. One scan of a text emits the payloads of its words in order; a run of words has the payload that
its neighbours' payloads compose to, as the CRC of a concatenation follows from the CRCs and the second length. So the text is read
once, whatever the length of the runs, and buckets come from payloads alone. Documents are drawn by their log-likelihood ratio between
target and corpus plus Gumbel noise, which is sampling without replacement by importance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from casdelta.llm.common import free, numbered, slices, staged

#: Bytes of a word stay, A to Z in lower case; the other ASCII bytes are delimiters.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
GAP = zlib.crc32(b" ")


@lru_cache(maxsize=64)
def _zeros(power: int) -> np.ndarray:
    """Four tables by byte: what 2**power zero bytes behind it do to a CRC; linear, so a power is the one before twice."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    if power:
        return _through(_through(values, power - 1), power - 1)
    one = values & np.uint32(255)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
    return one ^ (values >> 8)


def _through(crc: np.ndarray, power: int) -> np.ndarray:
    t = _zeros(power)
    return t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]


def composed(crc: np.ndarray, behind: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of concatenations: crc of what comes first, behind and length of what follows it."""
    out = crc.astype(np.uint32)
    for power in range(int(length.max(initial=0)).bit_length()):
        there = (length >> power) & 1 == 1
        out[there] = _through(out[there], power)
    return out ^ behind


def run_crcs(crc: np.ndarray, length: np.ndarray, n: int) -> list[np.ndarray]:
    """CRCs of all runs of 1 to n neighbouring words, joined by one space, from the words' payloads; shortest runs first."""
    out, gap = [crc], np.full(len(crc), GAP, np.uint32)
    for k in range(1, min(n, len(crc))):
        first = composed(out[-1][:-1], gap[k:], np.ones(len(crc) - k, np.int64))
        out.append(composed(first, crc[k:], length[k:]))
    return out


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8").translate(FOLD)


def dictionary(texts: list[bytes]) -> tuple[ahocorasick.Automaton, np.ndarray, np.ndarray]:
    """The automaton of the texts' distinct words between delimiters, and the words' CRCs and lengths by number."""
    words = list(set().union(*(t.split() for t in texts)))
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, w in enumerate(words):
        found.add_word(f" {w.decode('latin-1')} ", i)
    found.make_automaton()
    return found, np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words], np.int64)


def features(docs: DataFrame, keep: list[str], n: int = 1, buckets: int = 10_000, text: str = "text", rows: int = 5_000, size: int = 16 << 20) -> DataFrame:
    """Return keep, with n_words and buckets: an array of a bucket for each run of 1 to n words of the whole text, repeats included.

    A bucket is the CRC-32 of the run's UTF-8 bytes modulo `buckets`. A null text is as an empty one and has none. Rows stand alone;
    a task holds `size` bytes of text, or one text, at once.
    """
    slim = docs.select(*keep, docs[text].cast("string").alias(free(docs, "_text")[0]))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, rows, size):
                texts = [folded(t) for t in part.column(at).to_pylist()]
                automaton, crc, length = dictionary(texts)
                words, found, counts = [], [], []
                for t in texts:
                    ids = np.fromiter((i for _, i in automaton.iter(f" {t.decode('latin-1')} ")), np.int64) if len(crc) else np.empty(0, np.int64)
                    runs = run_crcs(crc[ids], length[ids], n)
                    words.append(len(ids))
                    counts.append(sum(map(len, runs)))
                    found += runs
                flat = (np.concatenate(found) % np.uint32(buckets)).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(words, pa.int64()), pa.ListArray.from_arrays(ends, flat)], [*keep, "n_words", "buckets"])

    return slim.mapInArrow(run, StructType([*slim.schema.fields[:at], StructField("n_words", LongType()), StructField("buckets", ArrayType(IntegerType()))]))


def bucket_counts(found: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) of all features of features() rows; a task hands on its sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        there = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of all buckets from both sides' counts: thousandths of the log ratio of their smoothed shares, rounded down."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    s, t = (c.select("bucket", F.col("n").alias(k)) for c, k in ((corpus, "s"), (target, "t")))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = lambda n, all_: (F.col(n) + 1).cast("double") * (F.col(all_) + buckets).cast("double")
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.lit(1000.0) * F.log(share("t", "all_s") / share("s", "all_t"))).alias("gain"))


def weights(found: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """keep, with n_features and weight, the sum of the features' gains (none: 0). gain: one number for each bucket."""
    table = found.sparkSession.sparkContext.broadcast(gain)
    slim = found.select(*keep, "buckets")
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            sums = np.concatenate([[0], np.cumsum(table.value[lists.flatten().to_numpy()])])
            n = np.array([len(x) for x in lists], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy()).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(n), pa.array(sums[ends[1:]] - sums[ends[:-1]])], [*keep, "n_features", "weight"])

    return slim.mapInArrow(run, StructType([*slim.schema.fields[:at], StructField("n_features", LongType()), StructField("weight", LongType())]))


def gumbel(doc_id: Column, seed: str = "2024") -> Column:
    """Thousandths of Gumbel noise, rounded down, from the first eight hexadecimal digits of sha256(seed:doc_id); a null id is as ''."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """Return doc_id, n_features, weight, score, rank for each row of docs (doc_id, text); target has a text too.

    rank: 1, 2, 3… of the drawn rows, the highest scores among rows of at least least_words words, as many as percent of these rows,
    rounded down; null for the others. Ties go to the smaller doc_id, null last; rows that repeat id and score take neighbouring
    ranks. Rows without words have weight 0. Texts are scanned once; what the driver sees is one gain for each bucket.
    """
    found = staged(features(docs, ["doc_id"], n, buckets), "importance-features")
    wanted = bucket_counts(features(target, [], n, buckets), buckets)
    table = np.zeros(buckets, np.int64)
    for r in gains(bucket_counts(found, buckets), wanted, buckets).collect():
        table[r["bucket"]] = r["gain"]
    scored = weights(found, table, ["doc_id", "n_words"]).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = staged(scored, "importance-scores")
    fit = scored.where(F.col("n_words") >= least_words).drop("n_words")
    drawn = fit.count() * percent // 100
    ranked = numbered(fit, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).drop("n_words").withColumn("rank", F.lit(None).cast("long")))
