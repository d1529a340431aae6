"""Approximate nearest neighbours by additive quantisation.

A unit vector is the sum of one codeword from each of several full-dimensional codebooks, found by beam search on the residual; its
norm is stored beside the codes. A query's products with all codewords make a table, and the score of a vector is its norm times the
sum of its codewords' entries. The best of each pack by that score, a fixed share of its vectors, are ranked again by the exact inner
product beside the pack, so the share that is ranked exactly does not fall as the table grows.
Equal vectors are one class in the index, so that thousands of copies cannot crowd others out; their ids come back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casdelta.llm.common import hashed_share, numbered, staged


def nearest_codeword(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (2 * x @ book.T - (book * book).sum(axis=1)).argmax(axis=1)


def encode(x: np.ndarray, books: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) of the least squared error that the beam finds, and what is left of x."""
    n, words = len(x), books.shape[1]
    codes, rest = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
    error = (x * x).sum(axis=1)[:, None]
    rows = np.arange(n)[:, None]
    for book in books:
        cost = (error[:, :, None] - 2 * rest @ book.T + (book * book).sum(axis=1)).reshape(n, -1)
        keep = min(beam, cost.shape[1])
        top = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
        error = cost[rows, top]
        parent, word = top // words, top % words
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        rest = rest[rows, parent] - book[word]
    best = error.argmin(axis=1)
    return codes[rows[:, 0], best], rest[rows[:, 0], best]


def fit(x: np.ndarray, books: int, words: int, turns: int = 2, seed: int = 5) -> np.ndarray:
    """Codebooks from residual k-means, then refined: beam encoding and a joint least-squares fit in turn."""
    rng = np.random.default_rng(seed)
    out, rest = np.zeros((books, words, x.shape[1]), np.float32), x.astype(np.float32)
    for b in range(books):
        book = rest[rng.integers(0, len(rest), words)].copy()
        for _ in range(5):
            near = nearest_codeword(rest, book)
            order = np.argsort(near, kind="stable")
            used, first = np.unique(near[order], return_index=True)
            book[used] = np.add.reduceat(rest[order], first, axis=0) / np.diff(np.append(first, len(rest)))[:, None]
        out[b] = book
        rest = rest - book[nearest_codeword(rest, book)]
    for _ in range(turns):
        codes = np.concatenate([encode(x[i : i + 4096], out)[0] for i in range(0, len(x), 4096)])
        hot = np.zeros((len(x), books * words), np.float32)
        hot[np.arange(len(x))[:, None], codes.astype(int) + np.arange(books) * words] = 1
        gram = (hot.T @ hot).astype(float) + np.eye(books * words) * 0.5
        away = out.reshape(books * words, -1)
        out = (away + np.linalg.solve(gram, hot.T @ (x - hot @ away))).astype(np.float32).reshape(out.shape)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of every row with an id and a vector that is not zero and has no null or non-finite component."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)


def classes(rows: DataFrame, most: int, salt: int = 64) -> DataFrame:
    """(node, v, ids): each distinct vector with its `most` least ids, repeats included, found in parts first; nodes are numbered by least id."""
    part = Window.partitionBy("v", "_salt").orderBy("vec_id")
    few = rows.withColumn("_salt", F.pmod(F.hash("vec_id"), F.lit(salt))).withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= most)
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= most)
    each = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return numbered(each, [F.get("ids", F.lit(0))], "node").select("node", "v", "ids")


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # by the largest component first: squares of very large or small ones would leave the range
    top = np.abs(v).max(axis=1, keepdims=True)
    norm = np.linalg.norm(v / top, axis=1, keepdims=True)
    return (v / top / norm).astype(np.float32), (top * norm)[:, 0]


def packed(index: DataFrame, books: np.ndarray, size: int) -> DataFrame:
    """Rows (pack, nodes, norms, codes, vectors) of under 2 * `size` encoded vectors; nothing is left out."""
    shared = index.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0

        def pack(frames: list[pd.DataFrame]) -> pd.DataFrame:
            pdf = pd.concat(frames)
            v = np.stack(pdf["v"].to_numpy())
            x, norm = unit(v)
            with np.errstate(over="ignore"):
                short = v.astype(np.float32)
            v = short if (short == v).all() else v  # half the bytes where nothing is lost
            codes = np.concatenate([encode(x[i : i + 2048], shared.value)[0] for i in range(0, len(x), 2048)])
            node = pdf["node"].to_numpy(np.int64)
            return pd.DataFrame({"pack": [int(node[0])], "nodes": [node.tobytes()], "norms": [norm.astype(np.float64).tobytes()], "codes": [codes.tobytes()], "vectors": [v.tobytes()]})

        for pdf in batches:
            for i in range(0, len(pdf), size):
                held.append(pdf.iloc[i : i + size])
                count += len(held[-1])
                if count >= size:
                    yield pack(held)
                    held, count = [], 0
        if held:
            yield pack(held)

    return index.select("node", "v").mapInPandas(run, "pack long, nodes binary, norms binary, codes binary, vectors binary")


def shortlist(queries: DataFrame, packs: DataFrame, books: np.ndarray, share: float, least: int, kept: int, queries_a_block: int, packs_a_part: int = 64) -> DataFrame:
    """(query, node): each query's best `kept` nodes in each part of the index by exact inner product, ties to smaller nodes, which are those of smaller ids.

    The exact product is taken of the best by table lookup in each pack: `share` of its vectors, `least` at least.
    Query blocks meet index packs by a shared key, in blocks: a task holds one query block, its running best and one pack.
    """
    shared = queries.sparkSession.sparkContext.broadcast(books)
    n_blocks = max(1, -(-queries.count() // queries_a_block))
    n_parts = max(1, -(-packs.count() // packs_a_part))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, rows in pdf.groupby("block"):
                v = np.stack(rows["v"].to_numpy())
                yield pd.DataFrame({"block": [b], "nodes": [rows["node"].to_numpy(np.int64).tobytes()], "norms": [b""], "codes": [unit(v)[0].tobytes()], "vectors": [v.tobytes()]})

    asked = queries.select("node", "v", F.pmod(F.hash("node"), F.lit(n_blocks)).alias("block")).repartition("block").mapInPandas(block, "block int, nodes binary, norms binary, codes binary, vectors binary")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))).withColumn("pack", F.lit(None).cast("long"))
    stored = packs.withColumn("part", F.pmod(F.hash("pack"), F.lit(n_parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    columns = ["block", "part", "pack", "nodes", "norms", "codes", "vectors"]
    dealt = asked.select(columns).union(stored.select(columns)).repartition("block", "part").sortWithinPartitions("block", "part", F.col("pack").asc_nulls_first())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        m, words, dim = tables.shape
        now, asking, exact, table, best, names = None, None, None, None, None, None

        def done() -> pa.RecordBatch:
            live = names >= 0
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(asking, live.sum(axis=1))), pa.array(names[live])], ["query", "node"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["block"], r["part"]) != now:
                    if best is not None:
                        yield done()
                    now, asking, best = (r["block"], r["part"]), None, None
                nodes = np.frombuffer(r["nodes"], np.int64)
                if r["pack"] is None:  # a block may come in several rows
                    x = np.frombuffer(r["codes"], np.float32).reshape(-1, dim)
                    fresh = np.ascontiguousarray((tables.reshape(-1, dim) @ x.T).reshape(m, words, -1))
                    raw = np.frombuffer(r["vectors"], np.float64).reshape(-1, dim)
                    exact = raw if asking is None else np.concatenate([exact, raw])
                    asking = nodes if asking is None else np.concatenate([asking, nodes])
                    table = fresh if len(asking) == len(nodes) else np.concatenate([table, fresh], axis=2)
                    continue
                if asking is None:
                    continue
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(nodes), m)
                score = table[0][codes[:, 0]]
                for i in range(1, m):
                    score += table[i][codes[:, i]]
                score *= np.frombuffer(r["norms"], np.float64)[:, None]
                stored_as = np.float32 if len(r["vectors"]) == 4 * dim * len(nodes) else np.float64
                vectors = np.frombuffer(r["vectors"], stored_as).reshape(-1, dim)
                if best is None:
                    best, names = np.full((len(asking), 0), -np.inf), np.empty((len(asking), 0), np.int64)
                keep = min(len(nodes), max(least, int(np.ceil(share * len(nodes)))))
                top = np.argpartition(-score.T, keep - 1, axis=1)[:, :keep]
                near = np.stack([vectors[t].astype(np.float64) @ q for t, q in zip(top, exact, strict=True)])
                best, names = np.concatenate([best, near], axis=1), np.concatenate([names, nodes[top]], axis=1)
                top = np.lexsort((names, -best), axis=1)[:, :kept]
                best, names = np.take_along_axis(best, top, axis=1), np.take_along_axis(names, top, axis=1)
        if best is not None:
            yield done()

    return dealt.mapInArrow(scan, "query long, node long")


def search(vectors: DataFrame, k: int = 20, every: int = 20, books: int = 32, words: int = 64, most: int = 320, sample: int = 12_000, pack: int = 4096, queries_a_block: int = 256) -> DataFrame:
    """Return query_id, rank, vec_id, score: the k nearest found of every row whose vec_id is divisible by `every`.

    vectors: vec_id, embedding. Null vectors and ids, zero vectors and ones with null, NaN or infinite components take no part. Every
    other row counts: rows that share an id are candidates of each other, and each of them asks for itself. Vectors of different
    lengths have no inner product, so each length is searched on its own, with an index of its own. The score is the inner product
    of the original vectors in double precision; ties go to the smaller vec_id. The codebooks are fitted on about `sample` vectors,
    drawn by hash; every vector is encoded. `most` of each pack of `pack` vectors are compared exactly, the same share of a larger
    pack. With fewer candidates than k, all are returned; with none, no rows.
    """
    rows = staged(usable(vectors), "vectors")
    lengths = [r["n"] for r in rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").collect()]
    found = [search_length(rows.where(F.size("v") == n), k, every, books, words, most, sample, pack, queries_a_block) for n in lengths or [0]]
    return reduce(DataFrame.unionByName, found)


def search_length(rows: DataFrame, k: int, every: int, books: int, words: int, most: int, sample: int, pack: int, queries_a_block: int) -> DataFrame:
    """search() over usable vectors (vec_id, v) of one length."""
    index = staged(classes(rows, k + 1), "vector-classes")
    few = hashed_share(index.select("v"), [F.col("v")], sample / max(1, index.count())).toPandas()
    few = few.sort_values("v", key=lambda c: c.map(tuple)) if len(few) else few
    if not len(few):
        few = index.select("v").limit(1).toPandas()
    x = unit(np.stack(few["v"].to_numpy()))[0] if len(few) else np.zeros((1, 1), np.float32)
    codebooks = fit(x, books, words)
    packs = staged(packed(index, codebooks, pack), "vector-codes")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    nodes = asked.select(F.col("qv").alias("v")).distinct().join(index, "v")
    short = shortlist(nodes, packs, codebooks, most / pack, most, 2 * (k + 1), queries_a_block)
    pairs = short.join(index.select("node", F.col("v").alias("x")), "node").join(index.select(F.col("node").alias("query"), F.col("v").alias("q")), "query")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, q = (c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in (b.column("x"), b.column("q")))
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), pa.array(np.einsum("ij,ij->i", x, q))], ["query", "node", "score"])

    scored = pairs.select("query", "node", "x", "q").mapInArrow(exact, "query long, node long, score double")
    named = scored.join(index.select("node", "ids"), "node").select("query", "node", "score", F.posexplode("ids").alias("at", "vec_id"))
    # a class of queries shares its neighbours: the best k + 1 of them serve every member, who leaves itself out, once
    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "node", "at")
    best = named.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1)
    entry = F.struct((-F.col("score")).alias("s"), "vec_id", "node", "at")
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(entry)).alias("near"))
    mine = asked.join(index.select(F.col("node").alias("query"), F.col("v").alias("qv")), "qv").select("query_id", "query").join(lists, "query")
    own = F.array_position(F.transform("near", lambda p: (p["vec_id"] == F.col("query_id")) & (p["node"] == F.col("query"))), True)
    others = F.filter("near", lambda p, i: (i + 1) != own)
    out = mine.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "p"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("p.vec_id").alias("vec_id"), (-F.col("p.s")).alias("score"))
