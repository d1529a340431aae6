"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each byte of the text gets a distribution over languages from a network that has read up to it from both sides; the mean of
the log-probabilities over positions gives the document's. Texts are cut into windows that are read side by side, each with a run-up
in its neighbours on either side that warms up the states of both directions, so every byte is labelled once and with context.
Training goes the same way, over all bytes of every text of the sample, so it meets the states that labelling meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casdelta.llm.common import hashed_share, id_bucket, slices

LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Weights by name; languages in order. Gates are update, reset and candidate, side by side."""

    langs: list[str]
    w: dict[str, np.ndarray]
    size: int

    @staticmethod
    def new(langs: list[str], size: int = 8, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        w = {f"{k}{d}": draw(*s) for d in "fb" for k, s in (("x", (256, 3 * size)), ("u", (size, 3 * size)), ("o", (size, len(langs))))}
        return Network(langs, w | {"b": np.zeros(len(langs), np.float32)}, size)

    def run(self, x: np.ndarray, d: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """States after each step for byte columns x (steps, lanes); d: direction, 'b' reads from the end; keep: for training."""
        k, wx, wu = self.size, self.w["x" + d], self.w["u" + d]
        h = np.zeros((x.shape[1], k), np.float32)
        out, kept = np.empty((*x.shape, k), np.float32), []
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            gates, hu = wx[x[t]], h @ wu
            zr = gates[:, : 2 * k] + hu[:, : 2 * k]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(gates[:, 2 * k :] + r * hu[:, 2 * k :])
            if keep:
                kept.append((t, h, z, r, n, hu[:, 2 * k :]))
            h = out[t] = n + z * (h - n)
        return out, kept

    def logits(self, x: np.ndarray, keep: bool = True) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, list]]]:
        both = {d: self.run(x, d, keep) for d in "fb"}
        return both["f"][0] @ self.w["of"] + both["b"][0] @ self.w["ob"] + self.w["b"], both


def log_softmax(a: np.ndarray) -> np.ndarray:
    a = a - a.max(axis=-1, keepdims=True)
    return a - np.log(np.exp(a).sum(axis=-1, keepdims=True))


def windows(texts: list[bytes], window: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, and of each window its text, its first byte there and the byte behind its last."""
    size = np.array([len(t) for t in texts], np.int64)
    count = -(-size // window)
    raw = np.frombuffer(b" " * margin + b"".join(texts) + b" " * (window + margin), np.uint8)
    owner = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(size) - size
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = first[owner] + inside * window
    return raw, owner, start, np.minimum(start + window, first[owner] + size[owner])


def reading(raw: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, window: int, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of windows with their run-up, (steps, windows), spaces beyond the text that lies from low to high; and their places."""
    where = start[None, :] + np.arange(-margin, window + margin)[:, None]
    return np.where((where >= low) & (where < high), raw[where + margin], np.uint8(32)), where


def fit(texts: list[str], labels: list[str], passes: int = 1, lanes: int = 256, window: int = 96, margin: int = 16, rate: float = 0.03, updates: int = 200, seed: int = 3) -> Network:
    """Backpropagation through time by Adam over all windows of the texts, whole, in random order, until there were `updates` at least; the slope goes through the run-up too."""
    langs = sorted(set(labels))
    net = Network.new(langs, seed=seed)
    rng = np.random.default_rng(seed)
    encoded = [t.encode("utf-8") for t in texts]
    if len(langs) < 2 or not any(encoded):
        return net
    raw, owner, start, end = windows(encoded, window, margin)
    size = np.array([len(t) for t in encoded], np.int64)
    first = np.cumsum(size) - size
    target = np.array([langs.index(lang) for lang in labels])[owner]
    m, v, step = {k: np.zeros_like(a) for k, a in net.w.items()}, {k: np.zeros_like(a) for k, a in net.w.items()}, 0
    k = net.size
    for _ in range(max(passes, -(-updates // -(-len(start) // lanes)))):  # few texts are read more often
        order = rng.permutation(len(start))
        for at in range(0, len(order), lanes):
            rows = order[at : at + lanes]
            low = first[owner[rows]]
            x, where = reading(raw, low, low + size[owner[rows]], start[rows], window, margin)
            y = target[rows]
            logits, both = net.logits(x)
            d = np.exp(log_softmax(logits))
            d[:, np.arange(len(y)), y] -= 1
            d[(where < start[rows]) | (where >= end[rows])] = 0  # the run-up is not labelled
            d /= max(1, int((end[rows] - start[rows]).sum()))
            g = {"b": d.sum(axis=(0, 1))}
            for way, (out, kept) in both.items():
                g["o" + way] = np.tensordot(out, d, ([0, 1], [0, 1]))
                back, dh = d @ net.w["o" + way].T, np.zeros((len(y), k), np.float32)
                wu = net.w["u" + way]
                into, across, states = (np.empty((len(x), len(y), n), np.float32) for n in (3 * k, 3 * k, k))
                for t, h, z, r, n, hun in reversed(kept):
                    dh = dh + back[t]
                    dn = dh * (1 - z) * (1 - n * n)
                    du, dx = across[t], into[t]
                    dx[:, :k] = du[:, :k] = dh * (h - n) * z * (1 - z)
                    dx[:, k : 2 * k] = du[:, k : 2 * k] = dn * hun * r * (1 - r)
                    dx[:, 2 * k :] = dn
                    np.multiply(dn, r, out=du[:, 2 * k :])
                    states[t] = h
                    dh = dh * z + du @ wu.T
                g["u" + way] = np.tensordot(states, across, ([0, 1], [0, 1]))
                seen = np.argsort(x, axis=None, kind="stable")
                used, cut = np.unique(x.ravel()[seen], return_index=True)
                g["x" + way] = np.zeros_like(net.w["x" + way])
                g["x" + way][used] = np.add.reduceat(into.reshape(-1, 3 * k)[seen], cut, axis=0)
            step += 1
            for name in net.w:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.99 * v[name] + 0.01 * g[name] ** 2
                net.w[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def label_positions(net: Network, texts: list[bytes], window: int = 480, margin: int = 32, lanes: int = 1024) -> np.ndarray:
    """Sum over the bytes of each text of the log-probabilities of the languages: (texts, languages)."""
    total = np.zeros((len(texts), len(net.langs)))
    raw, owner, start, end = windows(texts, window, margin)
    size = np.array([len(t) for t in texts], np.int64)
    low = (np.cumsum(size) - size)[owner]
    high = low + size[owner]
    # windows are read in four lengths, by their own size alone, so that no text's result depends on its neighbours
    quarter = -(-window // 4)
    longest_of = -(-(end - start) // quarter) * quarter
    order = np.argsort(longest_of, kind="stable")
    cuts = np.searchsorted(longest_of[order], np.arange(5) * quarter, "right")
    for at, stop in ((a, min(a + lanes, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False) for a in range(lo, hi, lanes)):
        rows = order[at:stop]
        longest = int(longest_of[rows[0]])
        x, where = reading(raw, low[rows], high[rows], start[rows], longest, margin)
        p = log_softmax(net.logits(x, keep=False)[0][margin : margin + longest])
        live = where[margin : margin + longest] < end[rows]
        sums = np.where(live[:, :, None], p, 0).sum(axis=0)
        for j in range(len(net.langs)):
            total[:, j] += np.bincount(owner[rows], sums[:, j], len(texts))
    return total


def train(docs: DataFrame, rows_a_language: int = 200, bytes_a_language: int = 1_000_000) -> Network:
    """Fit on text and non-null lang of rows whose crc32(doc_id as text) modulo 4 is not 2, whole texts.

    About rows_a_language rows of each language, and about bytes_a_language of their bytes at most, drawn by a hash threshold, so that
    what reaches the driver grows with the languages alone, all of which are learned. Rows of a null id take part; texts without a
    letter teach nothing.
    """
    usable = docs.where((F.coalesce(id_bucket(F.col("doc_id"), 4), F.lit(0)) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    found = usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    if not found:
        return fit([], [])
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(rows_a_language / r["n"], bytes_a_language / r["size"])) for r in found], "_lang string, _share double")
    held = usable.join(F.broadcast(shares), F.col("lang") == F.col("_lang"))
    few = hashed_share(held, [F.col("doc_id"), F.col("text")], F.col("_share")).select("text", "lang").toPandas()
    few = few.sort_values(["lang", "text"])
    return fit(few["text"].tolist(), few["lang"].tolist())


def predict(docs: DataFrame, net: Network, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return (id_col, lang_pred, score, positions) for each row of docs.

    lang_pred: the language of largest mean log-probability over all bytes; score: its share when those means, taken to four times
    their size, are brought to sum to one; positions: bytes labelled. A text that is null or has no letter is 'und' with score
    0, and so is every text if no language was learned. Windows of a text never read bytes of another. Rows stand alone.
    """
    weights = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = weights.value
        for batch in batches:
            for part in slices(batch, 1, 4000, 1 << 22):
                texts = [t if t is not None and LETTER.search(t) else "" for t in part.column(1).to_pylist()]
                raw = [t.encode("utf-8") for t in texts]
                size = np.array([len(b) for b in raw])
                if model.langs and size.any():
                    mean = label_positions(model, raw) / np.maximum(size, 1)[:, None]
                    p = np.exp(log_softmax(4 * mean))
                    best = mean.argmax(axis=1)
                    langs = [model.langs[b] if n else "und" for b, n in zip(best, size, strict=True)]
                    score = np.where(size > 0, p[np.arange(len(best)), best], 0.0)
                else:
                    langs, score = ["und"] * len(raw), np.zeros(len(raw))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int64())], ["id", "lang_pred", "score", "positions"])

    out = docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text"))
    kind = out.schema["id"].dataType.simpleString()
    return out.mapInArrow(run, f"id {kind}, lang_pred string, score double, positions long").withColumnRenamed("id", id_col)
