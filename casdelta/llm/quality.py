"""Quality classifier: a sparse rule ensemble.

Boosted trees over text statistics give conjunctive rules (every path from a root); a logistic model with an l1 penalty weighs the
rules and leaves few of them; those are compiled into one Spark column expression, so that scoring is a projection in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casdelta.llm.common import hashed_share, WORD, id_bucket, whole_text

#: name -> (lower bound, feature, upper bound]; None: open.
Rule = tuple[tuple[str, float | None, float | None], ...]


def counts(text: Column) -> dict[str, Column]:
    """Raw statistics of a text, each one pass over it."""
    words, lines = F.split(text, r"[\x20\x09-\x0D]+"), F.split(text, "\n")
    return {
        "chars": F.length(text),
        "words": F.regexp_count(text, F.lit(WORD)),
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "letters": F.regexp_count(text, F.lit(r"\p{L}")),
        "marks": F.regexp_count(text, F.lit(r"[!*$#%&|]")),
        "bangs": F.regexp_count(text, F.lit("!!")),
        "bars": F.regexp_count(text, F.lit(r"\|")),
        "stops": F.regexp_count(text, F.lit(r"[.?]")),
        "distinct": F.size(F.array_distinct(words)),
        "lines": F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)),
    }


def features() -> dict[str, Column]:
    """Inputs of the rules, from the columns that counts() names."""
    share = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1))
    return {
        "f_words": F.col("words").cast("double"),
        "f_word_length": share("chars", "words"),
        "f_upper": share("upper", "letters"),
        "f_letters": share("letters", "chars"),
        "f_marks": share("marks", "words"),
        "f_bangs": share("bangs", "words"),
        "f_bars": share("bars", "words"),
        "f_stops": share("stops", "words"),
        "f_distinct": share("distinct", "words"),
        "f_lines": share("distinct_lines", "lines"),
    }


def with_features(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """_kept, a struct of the columns to keep, whatever their names, then the features of text (null: empty)."""
    base = docs.select(F.struct(*keep).alias("_kept"), whole_text(text).alias("_text"))
    out = base.select("_kept", *(c.cast("long").alias(k) for k, c in counts(F.col("_text")).items()))
    return out.select("_kept", *(c.cast("double").alias(k) for k, c in features().items()))


@dataclass
class Ensemble:
    """score = sigmoid(bias + the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            held = None
            for name, low, high in rule:
                for part in ([F.col(name) > low] if low is not None else []) + ([F.col(name) <= high] if high is not None else []):
                    held = part if held is None else held & part
            total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_rules(x: np.ndarray, residual: np.ndarray, hessian: np.ndarray, names: list[str], depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """One regression tree on the gradient; the rules of all its nodes, and its values at the rows."""
    rules: list[Rule] = []
    value = np.zeros(len(x))

    def grow(rows: np.ndarray, bounds: dict[str, tuple[float | None, float | None]], left: int) -> None:
        if bounds:
            rules.append(tuple((k, *v) for k, v in sorted(bounds.items())))
        g, h = residual[rows].sum(), hessian[rows].sum()
        best = (1e-6, None, None)
        if left:
            for j in range(x.shape[1]):
                order = np.argsort(x[rows, j], kind="stable")
                v = x[rows, j][order]
                cg, ch = residual[rows][order].cumsum(), hessian[rows][order].cumsum()
                at = np.nonzero(v[1:] > v[:-1])[0]
                at = at[(at >= least - 1) & (at < len(rows) - least)]
                if len(at):
                    gain = cg[at] ** 2 / (ch[at] + 1) + (g - cg[at]) ** 2 / (h - ch[at] + 1) - g**2 / (h + 1)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, float((v[at[i]] + v[at[i] + 1]) / 2))
        _, j, cut = best
        if j is None:
            value[rows] = g / (h + 1)
            return
        low, high = bounds.get(names[j], (None, None))
        inside = x[rows, j] <= cut
        grow(rows[inside], bounds | {names[j]: (low, cut)}, left - 1)
        grow(rows[~inside], bounds | {names[j]: (cut, high)}, left - 1)

    grow(np.arange(len(x)), {}, depth)
    return rules, value


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, low, high in rule:
        v = x[:, names.index(name)]
        out &= (v > low if low is not None else True) & (v <= high if high is not None else True)
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an l1 penalty on the weights, by accelerated proximal gradient."""
    n, k = r.shape
    w = z = np.zeros(k + 1)
    full, t = np.hstack([np.ones((n, 1)), r]), 1.0
    rate = 4 * n / max(1e-9, np.linalg.norm(full.T @ full, 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ z, -30, 30)))
        new = z - rate * full.T @ (p - y) / n
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - rate * penalty)
        t, past = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, w = new + (past - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 25, depth: int = 3, rate: float = 0.3, penalty: float = 0.002) -> Ensemble:
    """Fit the ensemble. With too few rows to split, or of one label only, it is a constant: the smoothed share of label 1."""
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        return Ensemble(bias, [])
    raw, found = np.full(len(y), bias), {}
    least = max(5, len(y) // 200)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        rules, value = tree_rules(x, y - p, p * (1 - p), names, depth, least)
        raw = raw + rate * value
        found |= dict.fromkeys(rules)
    rules = list(found)
    if not rules:
        return Ensemble(bias, [])
    r = np.stack([holds(q, x, names) for q in rules], axis=1).astype(float)
    bias, w = lasso(r, y, penalty)
    return Ensemble(bias, [(q, float(v)) for q, v in zip(rules, w, strict=True) if abs(v) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> Ensemble:
    """Fit on labelled documents whose crc32(doc_id) modulo 5 is not 0: all, or of more than max_rows ids about as many, by id hash.

    Each task draws alone. Only the features of these documents reach the driver. Rows without a label or an id take no part. An id that is labelled more
    than once counts with its least label, an id of several documents with the least of their features.
    """
    few = labels.where((id_bucket(F.col("doc_id"), 5) != 0) & F.col("quality").isNotNull())
    few = few.groupBy("doc_id").agg(F.min(F.col("quality").cast("double")).alias("_label"))
    few = hashed_share(few, [F.col("doc_id")], max_rows / max(1, few.count()))
    held = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_body")).join(F.broadcast(few), F.col("_id") == F.col("doc_id"))
    names = list(features())
    seen = with_features(held, [F.col("_id"), F.col("_label")], "_body")
    each = seen.groupBy("_kept._id").agg(F.min(F.struct(*names)).alias("f"), F.min("_kept._label").alias("_label"))
    got = each.select("f.*", "_label", "_id").toPandas().sort_values("_id")
    return fit(got[names].to_numpy(float), got["_label"].to_numpy(float), names)


def accepted(docs: DataFrame, model: Ensemble, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the model scores at the threshold or more, as they are, whatever their columns are called.

    The row number stands between features and filter: Spark would otherwise move the filter below the features and work out
    every statistic again for each rule that mentions it.
    """
    out = with_features(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_body")), [F.col("_row"), F.monotonically_increasing_id().alias("n")], "_body")
    out = out.select("_kept", F.monotonically_increasing_id().alias("_again"), model.score().alias("_score"))
    return out.where((F.col("_score") >= threshold) & (F.col("_again") >= 0) & (F.col("_kept.n") >= 0)).select("_kept._row.*")


def score(docs: DataFrame, model: Ensemble, keep: list[str], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """keep, then quality_score double and quality int (1 from threshold on), a row for each row of docs.

    Null and empty texts are scored by their statistics, all zero. No label, language, source or id takes part. Columns to keep that
    are called as the two results come back with an underscore in front.
    """
    names = [f"_{c}" if c in ("quality_score", "quality") else c for c in keep]
    out = with_features(docs, [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], text)
    return out.select("_kept.*", model.score().alias("quality_score")).withColumn("quality", (F.col("quality_score") >= threshold).cast("int"))
