"""LM scoring: a gated recurrent language model in numpy with a class-factored output softmax.

Word counts of all training texts give the vocabulary: the most frequent words have weights of their own and lie in classes of equal
size by rank; each other word, seen or not, belongs to a class by its shape (last character and accents): the network gives the
probability of that class, within which the word has its smoothed share of the class's counts. So p(word | state) = p(class | state) p(word | class, state) sums to one over all words.
Training is truncated backpropagation through time on all training texts, each read once, dealt over replicas whose weights are
averaged after each round. Scoring carries the state across windows from a document's first word to its end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, repeat
from math import log10
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casdelta.llm.common import id_bucket, staged, whole_text
from casdelta.operators.skew import heavy_keys

#: Accented letters that tell languages apart, and last characters, for the shape classes.
ACCENTS = [frozenset("äöüß"), frozenset("éèêçàâîôûù"), frozenset("ñóíáúü¿¡")]
ENDS = [".", ",", "!", "|", "*", "$", "%", "&", "#"]
SHAPES = (len(ENDS) + 1) * (len(ACCENTS) + 1)


def tokens(text: str | None) -> list[bytes]:
    """Words of the text between white space, A to Z in lower case, without the end."""
    return (text or "").encode("utf-8").lower().split()


#: Shape of an ASCII word by its last byte.
BY_END = [(ENDS.index(chr(b)) + 1 if chr(b) in ENDS else 0) * (len(ACCENTS) + 1) for b in range(256)]


def shape(word: bytes) -> int:
    if word.isascii():
        return BY_END[word[-1]]
    letters = word.decode("utf-8", "replace")
    return BY_END[word[-1]] + next((i for i, s in enumerate(ACCENTS, 1) if not s.isdisjoint(letters)), 0)


@dataclass
class Vocabulary:
    """words: the known ones by rank, the first `head` of which have weights; shapes: (tokens, types) of the others by shape."""

    words: list[bytes]
    counts: np.ndarray
    head: int
    shapes: np.ndarray
    ends: int
    total: int
    types: int
    a_class: int = 64
    ids: dict[bytes, int] = field(default_factory=dict)
    kinds: np.ndarray | None = None

    @property
    def head_classes(self) -> int:
        return -(-self.head // self.a_class) if self.head else 0

    @property
    def classes(self) -> int:
        """Head classes, shapes, and the end."""
        return self.head_classes + SHAPES + 1

    def index(self) -> Vocabulary:
        if not self.ids:
            self.ids = {w: i for i, w in enumerate(self.words)}
            self.kinds = np.array([i // self.a_class if i < self.head else self.head_classes + shape(w) for i, w in enumerate(self.words)] + [0], np.int32)
        return self

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ranks (-1: not among the known), classes, and the unknown words."""
        rank = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        kind = self.kinds[rank]
        odd = np.nonzero(rank < 0)[0]
        strange = [words[i] for i in odd]
        if len(odd):
            kind[odd] = [self.head_classes + shape(w) for w in strange]
        return rank, kind, strange


def count_words(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """(word binary, shape int, n long) of all texts of docs; each task sums up to `held` words before it hands them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(shape, words), pa.int32()), pa.array([seen[w] for w in words], pa.int64())], ["word", "shape", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(tokens(t))
                if len(seen) > held:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    got = docs.select(whole_text().alias("text")).mapInArrow(run, "word binary, shape int, n long")
    return got.groupBy("word", "shape").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, ends: int, known: int = 200_000, head: int = 4096) -> Vocabulary:
    """At most `known` of the most frequent words, and sums by shape over all, come to the driver, no more.

    The known words are those of the highest steps of frequency, 64 to each doubling, that hold no more than `known` in all.
    """
    step = F.floor(F.log2("n") * 64)
    least, held = None, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > known:
            break
        least = r["step"]
    top = counts.where(step >= least if least is not None else F.lit(False)).select("word", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
    words, n = [bytes(w) for w in top["word"]], top["n"].to_numpy(np.int64)
    sums = np.zeros((SHAPES, 2))
    for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        sums[r["shape"]] = r["n"], r["types"]
    total, types = int(sums[:, 0].sum()), int(sums[:, 1].sum())
    head = min(head, len(words))
    for w, c in zip(words[:head], n[:head].tolist(), strict=True):
        sums[shape(w)] -= c, 1
    return Vocabulary(words, n, head, sums, ends, total + ends, types + (ends > 0))


class Network:
    """The weights, as views of one flat float32 vector."""

    def __init__(self, vocab: Vocabulary, size: int = 24, flat: np.ndarray | None = None):
        self.head, self.classes, self.a_class, self.size = vocab.head, vocab.classes, vocab.a_class, size
        padded = vocab.head_classes * vocab.a_class
        #: inputs: head words, then shapes, then the end, which also begins a text
        shapes = {"x": (vocab.head + SHAPES + 1, 3 * size), "u": (size, 3 * size), "c": (size, self.classes), "cb": (self.classes,), "w": (padded, size), "wb": (padded,)}
        total = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(total, np.float32) if flat is None else flat
        at = 0
        for k, s in shapes.items():
            n = int(np.prod(s))
            setattr(self, k, self.flat[at : at + n].reshape(s))
            at += n
        if flat is None:
            rng = np.random.default_rng(11)
            for k, scale in (("x", 0.3), ("u", 0.3), ("c", 0.02), ("w", 0.02)):
                getattr(self, k)[...] = rng.normal(0, scale, getattr(self, k).shape)
            mass = np.full(padded, -1e4, np.float32)
            mass[: vocab.head] = np.log((vocab.counts[: vocab.head] + 1.0) / (vocab.total + 1))
            self.wb[...] = mass
            rows = np.exp(mass.reshape(-1, self.a_class)).sum(axis=1) if padded else np.empty(0)
            self.cb[...] = np.log(np.concatenate([rows, (vocab.shapes[:, 0] + 1) / (vocab.total + 1), [(vocab.ends + 1) / (vocab.total + 1)]]))

    def step(self, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after h, both gates side by side, the candidate, and what the reset gate scales."""
        k = self.size
        hu = h @ self.u
        zr = gates[:, : 2 * k] + hu[:, : 2 * k]
        zr *= -1
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :k], zr[:, k:]
        n = r * hu[:, 2 * k :]
        n += gates[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, zr, n, hu[:, 2 * k :]


def log_softmax(a: np.ndarray) -> np.ndarray:
    a = a - a.max(axis=1, keepdims=True)
    return a - np.log(np.exp(a).sum(axis=1, keepdims=True))


def exps(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of a's rows and their sums; logits are small as a rule, so a row's maximum is taken off only where it must be."""
    ones = np.ones(a.shape[-1], a.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(a)
        total = e @ ones
    if total.size and not (total.min() > 1e-30 and total.max() < 1e30):
        e = np.exp(a - a.max(axis=-1, keepdims=True))
        total = e @ ones
    return e, total


def picked(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log_softmax of a at one place of each row."""
    rows = np.arange(len(at))
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        total = np.exp(a) @ np.ones(a.shape[1], a.dtype)
        out = a[rows, at] - np.log(total)
    return out if ((total > 1e-30) & (total < 1e30)).all() else log_softmax(a)[rows, at]


#: Rows whose logits are held at once, so that they stay in a core's cache.
ROWS = 2048


def log_probability(net: Network, vocab: Vocabulary, h: np.ndarray, kind: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """ln of p(class | h), and for head words of p(word | class, h) too."""
    out = np.empty(len(kind), np.float32)
    for a in range(0, len(kind), ROWS):
        part = slice(a, a + ROWS)
        logits = h[part] @ net.c
        logits += net.cb
        out[part] = picked(logits, kind[part])
    of_head = np.flatnonzero(kind < vocab.head_classes)
    of_head = of_head[np.argsort(kind[of_head], kind="stable")]
    cuts = np.searchsorted(kind[of_head], np.arange(vocab.head_classes + 1))
    place = rank - kind * net.a_class
    for c in range(vocab.head_classes):
        w, b = (x[c * net.a_class : (c + 1) * net.a_class] for x in (net.w, net.wb))
        for a in range(cuts[c], cuts[c + 1], ROWS):
            at = of_head[a : min(a + ROWS, cuts[c + 1])]
            logits = h[at] @ w.T
            logits += b
            out[at] += picked(logits, place[at])
    return out


def blocks(kinds: np.ndarray, classes: int, rows: int) -> tuple[np.ndarray, ...]:
    """Tokens of head classes, dealt by class to blocks of `rows` slots: their places, their slots, and the class of each block.

    A block holds one class, so all of them go through one batched product; slots that are left over hold nothing.
    """
    at = np.flatnonzero(kinds < classes)
    at = at[np.argsort(kinds[at], kind="stable")]
    n = np.bincount(kinds[at], minlength=classes)
    many = -(-n // rows)
    slots = np.arange(len(at)) + np.repeat((np.cumsum(many) - many) * rows - (np.cumsum(n) - n), n)
    return at, slots, np.repeat(np.arange(classes), many)


def run_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at first: most runs are short and go side by side, the few others one by one."""
    n = np.diff(first, append=len(rows))
    out = rows[first]
    for r in range(1, 8):
        more = np.flatnonzero(n > r)
        out[more] += rows[first[more] + r]
    for i in np.flatnonzero(n > 8):
        out[i] += rows[first[i] + 8 : first[i] + n[i]].sum(axis=0)
    return out


def adagrad(past: np.ndarray, weights: np.ndarray, slope: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The sums of squares and the weights after a step against the clipped slope."""
    part = np.clip(slope, -1, 1)
    squares = part * part
    past = np.add(past, squares)
    part *= rate
    part /= np.sqrt(past, out=squares)
    return past, np.subtract(weights, part, out=part)


def inputs(vocab: Vocabulary, kind: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return np.where(kind < vocab.head_classes, rank, vocab.head + kind - vocab.head_classes)


def train_on(net: Network, vocab: Vocabulary, texts: Iterator[str], lanes: int = 48, window: int = 20, rate: float = 0.08) -> int:
    """Truncated backpropagation through time by Adagrad over the texts, whole and in order; returns the number of tokens.

    Texts follow each other on `lanes` lanes; a lane starts anew with each text, and state, not slope, crosses windows.
    """
    past = np.full_like(net.flat, 1e-4)
    grad = np.zeros_like(net.flat)
    past_x, rest = Network(vocab, net.size, past).x, slice(net.x.size, None)  # of x, only rows that occur are touched
    g = Network(vocab, net.size, grad)
    end, begin = vocab.classes - 1, vocab.head + SHAPES
    k, seen, source = net.size, 0, iter(texts)
    small = np.int16 if max(begin, vocab.classes) < 1 << 15 else np.int64  # short keys sort faster
    #: a lane's text, as rows kind, rank and input, and how far it is read
    lane: list[tuple[np.ndarray, int]] = [(np.empty((3, 0), np.int32), 0)] * lanes
    h = np.zeros((lanes, k), np.float32)
    slopes = np.zeros((vocab.head_classes, net.a_class, k + 1), np.float32)  # of head words' weights, and of their constants last

    def next_text() -> np.ndarray | None:
        for t in source:
            rank, kind, _ = vocab.lookup(tokens(t))
            text = np.empty((3, len(rank) + 1), np.int32)
            text[0, :-1], text[0, -1] = kind, end
            text[1, :-1], text[1, -1] = rank, -1
            text[2, 0], text[2, 1:] = begin, inputs(vocab, kind, rank)
            return text
        return None

    while True:
        now = np.full((len(lane), 3, window), -1, np.int32)
        for j, (text, pos) in enumerate(lane):
            at = 0
            while at < window:
                if pos == text.shape[1]:
                    if (more := next_text()) is None:
                        break
                    text, pos = more, 0
                n = min(window - at, text.shape[1] - pos)
                now[j, :, at : at + n] = text[:, pos : pos + n]
                at, pos = at + n, pos + n
            lane[j] = text, pos
        busy = now[:, 0, 0] >= 0
        if not busy.all():  # no text is left for these lanes: the others go on without them
            now, h = now[busy], h[busy]
            lane = [x for x, ok in zip(lane, busy, strict=True) if ok]
        if not len(lane):
            return seen
        kinds, ranks, xs = np.ascontiguousarray(now.transpose(1, 2, 0))
        live = np.flatnonzero(kinds.ravel() >= 0)
        whole = len(live) == kinds.size
        seen += len(live)
        fresh = xs == begin  # the end is no text's input but at its beginning
        any_fresh = fresh.any(axis=1)
        gates = net.x[xs]
        steps = []
        for t in range(window):
            if any_fresh[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            steps.append((h, *net.step(gates[t], h)))
            h = steps[-1][1]
        before, hs, zrs, ns, huns = map(np.stack, zip(*steps, strict=True))
        zs, rs = zrs[:, :, :k], zrs[:, :, k:]
        flat_h = hs.reshape(-1, k) if whole else hs.reshape(-1, k)[live]
        kind, rank = kinds.ravel()[live], ranks.ravel()[live]
        scale = np.float32(1.0 / lanes)
        p = flat_h @ net.c
        p += net.cb
        p, total = exps(p)
        p *= (scale / total)[:, None]
        p[np.arange(len(kind)), kind] -= scale
        grad[rest] = 0
        np.matmul(flat_h.T, p, out=g.c)
        np.matmul(np.ones(len(p), np.float32), p, out=g.cb)
        dh_flat = p @ net.c.T
        at, slots, cls = blocks(kind.astype(small), vocab.head_classes, 16)
        if len(at):
            inside = np.zeros((len(cls) * 16, k + 1), np.float32)
            inside[slots, :k], inside[slots, k] = flat_h[at], 1
            w = np.concatenate([net.w, net.wb[:, None]], axis=1).reshape(slopes.shape)[cls]
            q, total = exps(inside.reshape(len(cls), 16, k + 1) @ w.transpose(0, 2, 1))
            share = np.zeros(len(cls) * 16, np.float32)
            share[slots] = scale
            q *= (share.reshape(total.shape) / total)[..., None]
            flat_q = q.reshape(-1, net.a_class)
            flat_q[slots, rank[at] - kind[at] * net.a_class] -= scale
            slopes[...] = 0
            cuts = np.searchsorted(cls, np.arange(vocab.head_classes + 1)) * 16
            for c in range(vocab.head_classes):
                if cuts[c] < cuts[c + 1]:
                    np.matmul(flat_q[cuts[c] : cuts[c + 1]].T, inside[cuts[c] : cuts[c + 1]], out=slopes[c])
            g.w[...], g.wb[...] = slopes[:, :, :k].reshape(g.w.shape), slopes[:, :, k].ravel()
            dh_flat[at] += (q @ w).reshape(-1, k + 1)[slots, :k]
        if whole:
            dhs = dh_flat.reshape(hs.shape)
        else:
            dhs = np.zeros_like(hs)
            dhs.reshape(-1, k)[live] = dh_flat
        # slopes of the gates by the state's slope, at all steps at once
        by_n = (1 - zs) * (1 - ns * ns)
        by_z = (before - ns) * zs * (1 - zs)
        by_r = huns * rs * (1 - rs)
        dh = np.zeros((len(lane), k), np.float32)
        dus, dns = np.empty((window, len(lane), 3 * k), np.float32), np.empty(hs.shape, np.float32)
        for t in reversed(range(window)):
            dh += dhs[t]
            du, dn = dus[t], dns[t]
            np.multiply(dh, by_n[t], out=dn)
            np.multiply(dh, by_z[t], out=du[:, :k])
            np.multiply(dn, by_r[t], out=du[:, k : 2 * k])
            np.multiply(dn, rs[t], out=du[:, 2 * k :])
            dh *= zs[t]
            dh += du @ net.u.T
            if any_fresh[t]:
                dh[fresh[t]] = 0
        np.matmul(before.reshape(-1, k).T, dus.reshape(-1, 3 * k), out=g.u)
        dus[:, :, 2 * k :] = dns
        x = xs.ravel()[live]
        order = np.argsort(x.astype(small), kind="stable")
        x = x[order]
        first = np.flatnonzero(np.diff(x, prepend=-1))
        gx = run_sums(dus.reshape(-1, 3 * k)[live[order]], first)
        ids = x[first]
        past_x[ids], net.x[ids] = adagrad(past_x[ids], net.x[ids], gx, rate)
        past[rest], net.flat[rest] = adagrad(past[rest], net.flat[rest], grad[rest], rate)


def average(parts: DataFrame) -> DataFrame:
    """Mean by weight of (replica, block, weight, bytes), first among neighbouring replicas, then overall: no group grows with the input."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["weight"].to_numpy(float)
        stack = np.stack([np.frombuffer(b, np.float32) for b in pdf["bytes"]])
        order = np.argsort(pdf["replica"].to_numpy())
        out = (stack[order].astype(float) * w[order, None]).sum(axis=0) / w.sum()
        return pd.DataFrame({"replica": [pdf["replica"].min()], "block": [pdf["block"].iloc[0]], "weight": [w.sum()], "bytes": [out.astype(np.float32).tobytes()]})

    schema = "replica long, block int, weight double, bytes binary"
    first = parts.groupBy("block", F.floor(F.col("replica") / 64).alias("_few")).applyInPandas(lambda key, pdf: mean(pdf), schema)
    return first.groupBy("block").applyInPandas(mean, schema)


def dealt(docs: DataFrame, rounds: int, replicas: int, long_bytes: int) -> DataFrame:
    """(text, _turn, replica, _first, _mark) of docs: the round that a row trains in, by its text, and its replica, by text and doc_id.

    Rows that repeat both, so often that they would be felt in one replica (as a sketch counts them), go by row number instead.
    """
    mark, size = F.xxhash64(whole_text(), F.lit(5)), F.octet_length(whole_text())
    first = F.when(size > long_bytes, -F.log2(size)).otherwise(0.0)
    slim = docs.select(whole_text().alias("text"), F.pmod(mark, F.lit(rounds)).alias("_turn"), F.xxhash64(mark, *([F.col("doc_id")] if "doc_id" in docs.columns else [])).alias("_row"), first.alias("_first"), mark.alias("_mark"))
    hot = heavy_keys(slim, "_row", 1 / (8 * replicas)) if replicas > 1 else []
    many = docs.sparkSession.createDataFrame([(k,) for k, n in hot if n > 1], "_row long").withColumn("_many", F.lit(True))
    number = F.monotonically_increasing_id()
    slim = slim.withColumn("_number", number).join(F.broadcast(many), "_row", "left") if hot else slim.select("*", F.lit(0).alias("_number"), F.lit(None).cast("boolean").alias("_many"))
    replica = F.pmod(F.xxhash64("_row", F.when(F.col("_many"), F.col("_number"))), F.lit(replicas))
    return slim.select("text", "_turn", replica.alias("replica"), "_first", "_mark")


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = 2, tokens_a_replica: int = 2_000_000, size: int = 24, block: int = 1 << 16, lanes: int = 128, rate: float = 0.12, long_bytes: int = 20_000) -> np.ndarray:
    """Weights trained on all docs, whole texts; the number of replicas grows with the input.

    A replica is what its number says, whatever task it lands in, and replicas that share a task train apart, so the weights do not
    depend on the partitioning, unless rows repeat text and id very often: see dealt(). In a replica the texts of more than long_bytes come first, so that at its end no long one is left
    alone on a lane.
    """
    spark = docs.sparkSession
    replicas = max(1, round(vocab.total / tokens_a_replica))
    slim = dealt(docs, rounds, replicas, long_bytes)
    flat = Network(vocab, size).flat
    for turn in range(rounds):
        start, words = spark.sparkContext.broadcast(flat), spark.sparkContext.broadcast(vocab)

        def run(batches: Iterator[pd.DataFrame], start=start, words=words) -> Iterator[pd.DataFrame]:
            known = words.value.index()
            rows = ((r, t) for pdf in batches for r, t in zip(pdf["replica"], pdf["text"], strict=True))
            for replica, part in groupby(rows, key=itemgetter(0)):  # replicas that share a task stay apart
                net = Network(known, size, start.value.copy())
                if n := train_on(net, known, map(itemgetter(1), part), lanes, rate=rate):
                    parts = [net.flat[i : i + block].tobytes() for i in range(0, len(net.flat), block)]
                    yield pd.DataFrame({"replica": replica, "block": range(len(parts)), "weight": float(n), "bytes": parts})

        few = slim.where(F.col("_turn") == turn).repartitionByRange(replicas, "replica").sortWithinPartitions("replica", "_first", "_mark")
        got = average(few.select("replica", "text").mapInPandas(run, "replica long, block int, weight double, bytes binary"))
        parts = {r["block"]: bytes(r["bytes"]) for r in got.select("block", "bytes").collect()}
        if parts:
            flat = np.frombuffer(b"".join(parts[i] for i in sorted(parts)), np.float32).copy()
    return flat


def score_texts(net: Network, vocab: Vocabulary, texts: list[str | None], window: int = 32) -> list[tuple[float, int, int, float, float, list[bytes]]]:
    """Of each text: ln p of what the network gives, tokens, known tokens, base sum and class sum over known words, unknown words.

    All texts advance together, longest first, so the live ones are always the first rows; the state goes on from window to window.
    """
    end, k = vocab.classes - 1, net.size
    ranks, kinds, strange = [], [], []
    for t in texts:
        rank, kind, odd = vocab.lookup(tokens(t))
        ranks.append(np.append(rank, -1))
        kinds.append(np.append(kind, end))
        strange.append(odd)
    order = np.argsort([-len(r) for r in ranks], kind="stable")
    length = np.array([len(ranks[i]) for i in order])
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    rank = np.concatenate([ranks[i] for i in order])
    kind = np.concatenate([kinds[i] for i in order])
    x = np.empty(len(rank), np.int64)
    x[1:] = inputs(vocab, kind[:-1], rank[:-1])
    x[first] = vocab.head + SHAPES
    doc = np.repeat(np.arange(len(order)), length)
    total = np.zeros(len(order))
    h = np.zeros((len(order), k), np.float32)
    longest = int(length[0])
    many = len(order) - np.searchsorted(length[::-1], np.arange(longest), "right")  # texts that have a token at each step
    held, places, rows = [], [], 0
    for at in range(0, longest, window):
        steps = many[at : at + window].tolist()
        here = np.concatenate([first[:m] + t for t, m in enumerate(steps, at)])
        gates, done = net.x[x[here]], 0
        for m in steps:
            h = net.step(gates[done : done + m], h[:m])[0]
            held.append(h)
            done += m
        places.append(here)
        rows += done
        if rows >= 8 * ROWS or at + window >= longest:  # when few texts are left, the states of many windows go through the output together
            where = np.concatenate(places)
            total += np.bincount(doc[where], log_probability(net, vocab, np.concatenate(held), kind[where], rank[where]), len(total))
            held, places, rows = [], [], 0
    base, inner, known = np.zeros(len(order)), np.zeros(len(order)), np.zeros(len(order), np.int64)
    count = np.append(vocab.counts, 0)[rank].astype(float)
    count[kind == end] = vocab.ends
    shaped = (kind >= vocab.head_classes) & (kind < end)
    mass = np.log10(vocab.shapes.sum(axis=1) + 1)
    logs = np.log10(count + 1)
    base += np.bincount(doc, logs, len(order)) - length * log10(vocab.total + vocab.types + 1)
    inner += np.bincount(doc[shaped], logs[shaped] - mass[kind[shaped] - vocab.head_classes], len(order))
    known += np.bincount(doc, count > 0, len(order)).astype(np.int64)
    out: list = [None] * len(order)
    for i, j in enumerate(order):
        out[j] = (float(total[i]), int(length[i]), int(known[i]), float(base[i]), float(inner[i]), strange[j])
    return out


def score(docs: DataFrame, vocab: Vocabulary, flat: np.ndarray, counts: DataFrame, size: int = 24, most_tokens: int = 500_000) -> DataFrame:
    """docs' doc_id with n_tokens, n_known, train_tokens, base_score and score.

    Words beyond the known ones go to their counts through a join on the word; none of them is frequent. A null text is as an empty
    one: its end is its only token. Rows stand alone, repeated ones score alike; a task holds up to most_tokens at once.
    """
    spark = docs.sparkSession
    weights, words = spark.sparkContext.broadcast(flat), spark.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value.index()
        net = Network(known, size, weights.value)

        def solve(ids: list, texts: list) -> pa.RecordBatch:
            got = list(zip(*score_texts(net, known, texts), strict=True))
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c, t) for c, t in zip(got, kinds, strict=True))], ["_row", "_ln", "n_tokens", "_known", "_base", "_inner", "_strange"])

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t or "") // 5 + 1
                if held > most_tokens:
                    yield solve(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield solve(ids, texts)

    slim = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("n")).alias("_row"), whole_text().alias("text"))
    row = slim.schema["_row"].dataType.simpleString()
    got = slim.mapInArrow(run, f"_row {row}, _ln double, n_tokens long, _known long, _base double, _inner double, _strange array<binary>")
    got = staged(got.select("_row.n", "_row.doc_id", "_ln", "n_tokens", "_known", "_base", "_inner", "_strange"), "lm-scores")
    rare = got.select("n", F.explode("_strange").alias("word")).join(counts.select("word", F.col("n").alias("c")), "word")
    rare = rare.groupBy("n").agg(F.sum(F.log10(F.col("c") + 1)).alias("_logs"), F.count("*").alias("_seen"))
    out = got.drop("_strange").join(rare, "n", "left")
    logs = F.coalesce("_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("_known") + F.coalesce("_seen", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("_base") + logs).alias("base_score"),
        (F.col("_ln") / float(np.log(10)) + F.col("_inner") + logs).alias("score"),
    )


def fit_and_score(docs: DataFrame) -> DataFrame:
    """Train on the rows whose crc32(doc_id as text) modulo 7 is not 2 (a null id trains), then score all rows; adds held_out."""
    held = F.coalesce(id_bucket(F.col("doc_id"), 7) == 2, F.lit(False))
    training = docs.where(~held)
    counts = staged(count_words(training), "lm-counts")
    vocab = vocabulary(counts, training.count())
    flat = train(training, vocab)
    out = score(docs, vocab, flat, counts)
    return out.withColumn("held_out", F.coalesce(id_bucket(F.col("doc_id"), 7) == 2, F.lit(False)))
