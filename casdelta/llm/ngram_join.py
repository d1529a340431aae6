"""N-gram Jaccard join by MinHash banding.

Equal texts become one node. A node's word n-grams are hashed; minima under random permutations fill `bands` bands of `rows` each, and
nodes that share a band are candidates: with 40 bands of 8, a pair at similarity 0.8 shares one with probability 0.9994, one at
0.3 with 0.003. Candidates are gathered into components through one link a member and band, never through all pairs of a band.
Within a component every pair is verified on the full n-gram sets, block by block: nodes go to blocks of bounded size, and each
pair of blocks is one piece of work, so a component of any size is spread over many tasks. What leaves a piece is one row a
node: how many links it has there and the least node that it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casdelta.llm.common import free, slices, staged, whole_text
from casdelta.llm.graph import components

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(1 << bits, base)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least so many."""
    return _powers(max(16, length.bit_length()))


def ngrams(text: str, n: int = 5) -> np.ndarray:
    """64-bit hashes of the text's word n-grams in order, repeats included; a text of 1 to n-1 words has one n-gram, all its words."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(start):
        return np.empty(0, np.uint64)
    # sums of byte codes times powers of an odd base; the inverse power brings each word's sum to its own start
    power, back = powers(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_BYTE[raw] * power[: len(raw)])])
    words = mix64((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out * _BASE + words[i : len(words) - n + 1 + i] + np.uint64(i))
    return out


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit value for each band, the band's number mixed in; none without n-grams."""
    if not len(grams):
        return np.empty(0, np.int64)
    rng = np.random.default_rng(7)
    k = bands * rows
    times = rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 2**32, k, dtype=np.uint32)
    x = (mix64(grams) >> np.uint64(32)).astype(np.uint32)
    least = np.full(k, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 512):
        part = (x[None, at : at + 512] ^ flip[:, None]) * times[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    out = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in least.reshape(bands, rows).T:
        out = mix64(out * _BASE + column)
    return out.view(np.int64)


def links_of(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of pairs whose Jaccard similarity reaches the threshold, by exact intersection of the sets, in whole numbers."""
    size = np.array([len(s) for s in sets], np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    owner, column = owner[keep], column[at[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    width = 4096
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [first, first + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        common += (block @ block.T).astype(np.int64)  # counts up to `width` are exact in float32
    least = Fraction(str(threshold))
    p, q = least.numerator, least.denominator
    return (p + q) * common >= p * (size[:, None] + size[None, :])


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, bytes, band_hashes) of each row of docs; key: 64-bit hash of the text, which stands for equal texts; bytes: its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, 1000, 1 << 22):
                hashes = [band_hashes(ngrams(t, n), bands, rows) for t in part.column(3).to_pylist()]
                ends = np.cumsum([0, *map(len, hashes)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hashes)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], ["doc_id", "key", "bytes", "band_hashes"])

    text = whole_text()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("bytes"), text.alias("text"))
    return slim.mapInArrow(run, "doc_id long, key long, bytes long, band_hashes array<bigint>")


def verify(pieces: DataFrame, n: int, threshold: float) -> DataFrame:
    """(key, links, texts, label) from pieces (component, i, j, block, key, copies, text), a row for each node and piece.

    A piece with i = j verifies all pairs of block i, another those between its two blocks; label is the least node reached.
    """

    def solve(rows: list[dict]) -> list[tuple[int, int, int, int]]:
        rows = list({r["key"]: r for r in rows}.values())
        key, copies, block = (np.array([r[c] for r in rows], np.int64) for c in ("key", "copies", "block"))
        near = links_of([np.unique(ngrams(r["text"], n)) for r in rows], threshold)
        np.fill_diagonal(near, False)
        if rows[0]["i"] != rows[0]["j"]:
            near &= block[:, None] != block[None, :]
        label = key.copy()
        while True:
            new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (new == label).all():
                break
            label = new
        return list(zip(key.tolist(), (near @ copies).tolist(), near.sum(axis=1).tolist(), label.tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        for _, piece in groupby(rows(), key=lambda r: (r["component"], r["i"], r["j"])):
            got = solve(list(piece))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["key", "links", "texts", "label"])

    dealt = pieces.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInArrow(run, "key long, links long, texts long, label long")


def join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 8, block: int = 256, block_bytes: int = 8 << 20, broadcast_rows: int = 500_000
) -> DataFrame:
    """Return doc_id, key, class_id, n_links, n_texts, copies, label for each row of docs (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of n-grams is at least the threshold. n_links: other rows of docs
    linked to this one, copies included; n_texts: other texts among them; copies: rows with this text; class_id: the least id among
    all that links lead to. A text without words has no n-grams and no links: it is its own class (rows of equal, blank text share
    one, by their text). A null text is as an empty one; rows with a null id count, and a class of null ids only has a null id.
    Repeated rows are copies. Texts of under n words have one n-gram. Other columns of docs make no difference. label: the least key
    of the class, which tells classes apart even where ids are null or stand on different texts.

    A block holds about `block` texts and block_bytes of text at most, or a single text. A side of at most broadcast_rows rows, as
    counted, is broadcast (some tens of bytes a row); a larger one is joined by shuffle, with the same rows.
    """
    signed = staged(signatures(docs, n, bands, rows), "signatures")
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("bytes").alias("bytes"), F.first("band_hashes").alias("band_hashes"))
    nodes = staged(nodes, "nodes")
    banded = nodes.select("key", F.explode("band_hashes").alias("band"))
    centres = banded.groupBy("band").agg(F.min("key").alias("centre"), F.max("key").alias("last")).where("centre <> last")
    stars = banded.join(centres, "band").where("key <> centre").select(F.col("key").alias("a"), F.col("centre").alias("b"))
    candidates = staged(components(stars), "candidates")
    members = candidates.withColumnRenamed("node", "key").join(nodes.select("key", "rep", "copies", "bytes"), "key")
    members = staged(members, "members")
    many = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / block_bytes))
    sizes = members.groupBy("label").agg(F.least(many, F.count("*")).cast("int").alias("blocks"))
    placed = members.join(sizes, "label").select("key", "rep", "copies", "blocks", F.col("label").alias("component"), F.pmod(F.hash("key"), "blocks").alias("block"))
    placed = staged(placed, "placed")
    few = placed.count() <= broadcast_rows
    text = whole_text()
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_key"), text.alias("text"))
    side = F.broadcast(placed) if few else placed
    texts = texts.join(side, (texts["_key"] == side["key"]) & texts["_id"].eqNullSafe(side["rep"]))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pieces = texts.select("component", "block", "key", "copies", "text", other)
    pieces = pieces.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "copies", "text")
    found = staged(verify(pieces, n, threshold), "verified")
    merged = components(found.where("label <> key").select(F.col("key").alias("a"), F.col("label").alias("b")))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = nodes.select("key", "rep", "copies").join(counts, "key", "left").join(merged.withColumnRenamed("node", "key"), "key", "left")
    known = staged(known.withColumn("label", F.coalesce("label", "key")), "known")
    least = known.groupBy("label").agg(F.min("rep").alias("class_id"))
    blank = signed.select("doc_id", "key", (F.size("band_hashes") == 0).alias("_blank"))
    facts = known.join(least, "label").select("key", "label", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("n_texts"))
    out = blank.join(facts, "key")
    return out.select(
        "doc_id",
        "key",
        "class_id",
        F.when(F.col("_blank"), F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.col("n_texts").cast("long").alias("n_texts"),
        "copies",
        "label",
    )


def representatives(docs: DataFrame, broadcast_rows: int = 500_000, **how: int) -> DataFrame:
    """docs without near duplicates: of each class of join() one row stays, of least id, then of least text hash.

    Null ids come last, so a class whose ids are all null keeps one of its rows too. Of rows that repeat both id and text one stays;
    classes of different texts are told apart even if they share an id. Columns of docs keep their names and values.
    """
    joined = join(docs, broadcast_rows=broadcast_rows, **how)
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    rows = joined.groupBy("label", "doc_id", "key").agg(F.count("*").alias("rows"))
    best = rows.groupBy("label").agg(F.min_by(F.struct("doc_id", "key", "rows"), ranked).alias("best"))
    chosen = staged(best.select("best.doc_id", "best.key", "best.rows"), "chosen")
    few = chosen.count() <= broadcast_rows
    side = chosen.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    side = F.broadcast(side) if few else side
    key, number = free(docs, "_text_key", "_n")
    held = docs.withColumn(key, F.xxhash64(whole_text()))
    kept = held.join(side, held["doc_id"].cast("long").eqNullSafe(side["_id"]) & (held[key] == side["_key"]), "left_semi")
    if chosen.where("rows > 1").isEmpty():
        return kept.drop(key)
    order = Window.partitionBy("doc_id", key).orderBy(F.lit(1))
    return kept.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number, key)
