"""Personal data by weak supervision, in Spark columns throughout.

Candidate spans come from strict patterns (those of the contract, whose valid matches always stay) and from loose ones (spelled-out
mail addresses, numbers without a country code, IPv6, cards with other separators). Four labelers vote on each candidate: strict
pattern, shape, gazetteer and context. The table of vote patterns with their counts, bounded by the number of labelers, is all that
leaves the executors: expectation-maximisation on it estimates, for each kind, each labeler's reliability and each pattern's
probability, and a logistic span classifier is trained on those. The classifier, compiled into a column, decides on the loose
candidates. Positions and overlaps are running sums and maxima over sorted arrays, by doubling distances, so a text with very many
matches takes little more than its length.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casdelta.llm.common import free, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Spans of the strict patterns that pass, those that fail, and spans of the loose patterns.
PASSED, FAILED, LOOSE = 0, 1, 2

#: Strict patterns. A match can only begin where a run of its first characters begins, or where the last match ended, so each text is
#: read in linear time; the possessive quantifiers change no match, as what follows a run is never in its class.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = "[0-9][0-9\\x01]+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

LOOSE_PATTERNS = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}(?:(?: ?\[at\] ?| ?\(at\) ?)[a-z0-9-]{1,63}(?:(?: dot | ?\[dot\] ?| ?\(dot\) ?|\.)[a-z0-9-]{2,63}){1,4}| at [a-z0-9-]{1,63}(?: dot [a-z0-9-]{2,63}){1,4})",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_])",
    "phone": r"(?<![0-9+./()-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9./-])",
}

#: Fixed values. Gazetteers: top-level domains; first octets never assigned to hosts; issuers' first digits; area codes never given.
DOMAINS = "com org net edu gov info biz io de fr es eu uk us ca ch at it nl be pl ru jp cn in br au mx"
NO_HOST = r"^0*(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38)"
NO_AREA = r"^[01]|^.11"
#: Context words before a span that speak for its kind, and ones that speak against any.
NEAR = {
    "email": r"mail|contact|write|reach|address|reply|courriel|correo|schreib",
    "ip": r"\bip\b|host|server|address|client|login|network",
    "card": r"card|visa|master|amex|credit|pay|carte|tarjeta|karte|kredit",
    "phone": r"call|phone|tel\b|tel\.|mobile|fax|whatsapp|ring|tél|llama|anruf",
}
AGAINST = r"version|release|isbn|issn|invoice|order no|serial|part no|doi|section|ticket"


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running join (a sum, a maximum) of an array of ints: each round reaches twice as far, so n values take n log n steps."""
    far = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(values))
    return F.aggregate(far, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, join(x, F.get(acc, i - d))).otherwise(x)))


def located(text: Column, pattern: str, kind: int, tier: int | None, ok: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, kind, end, tier, value, before) of the pattern's matches; starts and ends count code points.

    The pieces between matches and the matches themselves alternate, so their lengths add up to the positions. before: up to 40
    characters of the piece in front.
    """
    found = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def named(x: Column, end: Column) -> Column:
        level = F.lit(tier) if ok is None else F.when(ok(x["m"]), F.lit(PASSED)).otherwise(F.lit(FAILED))
        start = end - F.length(x["m"])
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), level.alias("tier"), x["m"].alias("value"), F.right(x["p"], F.lit(40)).alias("before"))

    def spans(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))), lambda a, b: a + b)
        # the last piece has no match behind it
        return F.transform(F.filter(F.arrays_zip(both.alias("x"), ends.alias("e")), lambda y: y["x"]["m"].isNotNull()), lambda y: named(y["x"], y["e"]))

    return let(found, spans)


SPANS = "array<struct<start:int,kind:int,end:int,tier:int,value:string,before:string>>"


def where_any(condition: Column, spans: Column) -> Column:
    """spans if the cheap condition holds, which it does wherever the pattern matches; else an empty array."""
    return F.when(condition, spans).otherwise(F.array().cast(SPANS))


def candidates(text: Column) -> Column:
    """All candidate spans of a text, strict ones first."""
    # a single separator between digits becomes a control character that the text itself no longer holds: runs are then one class
    joined = F.regexp_replace(F.translate(text, "\x01", "\x02"), "(?<=[0-9])[ -](?=[0-9])", "\x01")
    card = lambda v: F.length(digits(v)).between(12, 19) & F.coalesce(luhn(digits(v)), F.lit(False))
    ip = lambda v: v.rlike(rf"\A{IP_PART}\.{IP_PART}\.{IP_PART}\.{IP_PART}\z")
    phone = lambda v: F.length(digits(v)).between(9, 15)
    digit = text.rlike("[0-9]")
    return F.concat(
        where_any(text.contains("@"), located(text, EMAIL, 0, PASSED)),
        where_any(digit & text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), located(text, IP, 1, None, ip)),
        where_any(digit & text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), located(joined, CARD, 2, None, card)),
        where_any(text.contains("+"), located(text, PHONE, 3, None, phone)),
        where_any(text.rlike(r"(?i)[\[(]at[\])]| dot "), located(text, LOOSE_PATTERNS["email"], 0, LOOSE)),
        where_any(text.contains(":"), located(text, LOOSE_PATTERNS["ip"], 1, LOOSE)),
        where_any(digit & text.rlike(r"[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}"), located(text, LOOSE_PATTERNS["card"], 2, LOOSE)),
        where_any(digit & text.rlike(r"[0-9]{3}[ .-][0-9]{4}"), located(text, LOOSE_PATTERNS["phone"], 3, LOOSE)),
    )


def by_kind(kind: Column, choices: list[Column]) -> Column:
    out = F.lit(None)
    for k, c in reversed(list(enumerate(choices))):
        out = F.when(kind == k, c).otherwise(out)
    return out


def sign(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(-1))


def votes(x: Column) -> dict[str, Column]:
    """The labelers' votes on span x: 1 for, -1 against, 0 abstains; and the bucket of its length."""
    value, kind, n = x["value"], x["kind"], digits(x["value"])
    before = F.lower(x["before"])
    shape = [
        (F.length(value) <= 254) & ~value.contains(".."),
        ~value.rlike(r"(?:^|[.:])0[0-9]"),
        F.length(n).between(13, 19),
        F.length(n).between(10, 15),
    ]
    domain = F.lower(F.regexp_extract(value, r"([A-Za-z]+)\W*$", 1))
    number = F.when(value.startswith("+"), F.regexp_replace(n, "^1(?=[0-9]{10}$)", "")).otherwise(n)
    gazetteer = [domain.isin(*DOMAINS.split()), ~value.rlike(NO_HOST), n.rlike(ISSUERS), ~number.rlike(NO_AREA)]
    near = by_kind(kind, [before.rlike(NEAR[k]) for k in KINDS])
    return {
        "strict": F.when(x["tier"] == PASSED, 1).when(x["tier"] == FAILED, -1).otherwise(0),
        "shape": sign(by_kind(kind, shape)),
        "gazetteer": sign(by_kind(kind, gazetteer)),
        "context": F.when(before.rlike(AGAINST), -1).when(near, 1).otherwise(0),
        "long": F.least(F.lit(4), F.floor(F.length(value) / 8).cast("int")),
    }


LABELERS = ("strict", "shape", "gazetteer", "context")


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[dict[tuple[int, ...], float], list[dict[tuple[int, int], float]]]:
    """Expectation-maximisation over vote patterns with counts: each pattern's probability, and P(vote | truth) of each labeler.

    Starts from the majority of votes. Without patterns there is nothing to estimate.
    """
    belief = {v: min(0.9, max(0.1, 0.5 + 0.2 * sum(v))) for v, _ in patterns}
    tables: list[dict[tuple[int, int], float]] = []
    for _ in range(rounds):
        mass = {t: 1.0 + sum(n * (belief[v] if t else 1 - belief[v]) for v, n in patterns) for t in (0, 1)}
        tables = []
        for i in range(len(LABELERS)):
            table = {(vote, t): 0.5 + (2.0 if vote == (1 if t else -1) else 0.0) for vote in (-1, 0, 1) for t in (0, 1)}
            for v, n in patterns:
                table[v[i], 1] += n * belief[v]
                table[v[i], 0] += n * (1 - belief[v])
            for t in (0, 1):
                whole = sum(table[vote, t] for vote in (-1, 0, 1))
                for vote in (-1, 0, 1):
                    table[vote, t] /= whole
            tables.append(table)
        for v, _ in patterns:
            odds = math.log(mass[1] / mass[0]) + sum(math.log(tables[i][v[i], 1] / tables[i][v[i], 0]) for i in range(len(LABELERS)))
            belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief, tables


@dataclass
class SpanModel:
    """weights: of features named by text; reliabilities: P(vote | truth) by kind and labeler, as estimated."""

    weights: dict[str, float]
    reliabilities: dict[str, dict[str, dict[tuple[int, int], float]]]

    def probability(self, kind: Column, vote: dict[str, Column]) -> Column:
        total = F.lit(0.0)
        for name, w in self.weights.items():
            field, _, level = name.partition("=")
            total = total + F.when((kind if field == "kind" else vote[field]) == int(level), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def logistic(rows: list[tuple[list[str], float, float]], steps: int = 300, decay: float = 1e-3) -> dict[str, float]:
    """Weights of named 0/1 features from (features, probability, count), by gradient steps scaled to each feature's mass."""
    w: dict[str, float] = defaultdict(float)
    total = sum(n for *_, n in rows) or 1.0
    mass: dict[str, float] = defaultdict(float)
    for names, _, n in rows:
        for f in names:
            mass[f] += n
    for _ in range(steps):
        slope: dict[str, float] = defaultdict(float)
        for names, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[f] for f in names)))))
            for f in names:
                slope[f] += n * (y - p)
        for f in mass:
            w[f] += slope[f] / (0.25 * len(LABELERS) * (mass[f] + 1e-3 * total)) - decay * w[f]
    return dict(sorted(w.items()))


def train(docs: DataFrame, text: str = "text") -> SpanModel:
    """Estimate the labelers, kind by kind, and fit the classifier on the candidates of all docs; the driver sees counts of vote patterns only."""
    spans = docs.select(F.explode(candidates(whole_text(text))).alias("_x"))
    cast = votes(F.col("_x"))
    counted = spans.select(F.col("_x.kind").alias("kind"), *(c.cast("int").alias(k) for k, c in cast.items())).groupBy("kind", *cast).count().collect()
    rows = [(r["kind"], tuple(r[k] for k in LABELERS), r["long"], float(r["count"])) for r in sorted(counted)]
    reliabilities, lessons = {}, []
    for i, name in enumerate(KINDS):
        patterns: dict[tuple[int, ...], float] = defaultdict(float)
        for kind, v, _, n in rows:
            if kind == i:
                patterns[v] += n
        if not patterns:
            continue
        belief, tables = estimate(sorted(patterns.items()))
        reliabilities[name] = dict(zip(LABELERS, tables, strict=True))
        for kind, v, long, n in rows:
            if kind == i:
                lessons.append(([f"kind={kind}", f"long={long}"] + [f"{k}={vote}" for k, vote in zip(LABELERS[1:], v[1:], strict=True)], belief[v], n))
    return SpanModel(logistic(lessons) if lessons else {}, reliabilities)


def apart(spans: Column, from_: Column) -> Column:
    """Those of spans that no span of from_ overlaps, in one pass over both, sorted by where they begin and end."""
    none = F.lit(None).cast(SPANS.removeprefix("array<").removesuffix(">"))
    # a span that begins where another ends does not overlap it: at one position ends come first
    marks = F.array_sort(
        F.concat(
            F.transform(from_, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("order"), b["end"].alias("reach"), none.alias("x"))),
            F.transform(spans, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("order"), F.lit(-1).alias("reach"), x.alias("x"))),
        )
    )
    reached = lambda m: running(F.transform(m, lambda y: y["reach"]), F.greatest)
    left = let(marks, lambda m: F.filter(F.arrays_zip(m.alias("m"), reached(m).alias("r")), lambda y: (y["m"]["order"] == 0) & (y["r"] <= y["m"]["x"]["start"])))
    return F.when(F.size(spans) == 0, spans).otherwise(F.transform(left, lambda y: y["m"]["x"]))


def first_of_overlaps(spans: Column) -> Column:
    """Spans without those that an earlier one, by start and kind, overlaps."""

    def of(s: Column) -> Column:
        reached = running(F.transform(s, lambda x: x["end"]), F.greatest)
        pairs = F.arrays_zip(s.alias("x"), F.concat(F.array(F.lit(-1)), reached).alias("r"))
        return F.transform(F.filter(pairs, lambda y: y["x"].isNotNull() & (y["r"] <= y["x"]["start"])), lambda y: y["x"])

    return let(F.array_sort(spans), of)


def detect(docs: DataFrame, model: SpanModel, text: str = "text", threshold: float = 0.5, out: str = "_spans") -> DataFrame:
    """docs with the column `out`: array of (start, kind, end, base), by start, then kind; base marks the strict patterns' spans.

    start and end count code points, end exclusive; kind is a place in KINDS. A null text is as an empty one and has none. A loose
    span is added if the classifier gives it the threshold's probability, it passes its kind's test (Luhn for cards) and it overlaps
    no span that stays. Every row stands alone, so repeated rows get the same spans; other columns of docs stay as they are, one
    called as `out` gives way.
    """
    found, sure, more = free(docs.drop(out), "_candidates", "_base", "_more")
    slim = lambda x, base: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(base).alias("base"))
    lawful = lambda x: (x["kind"] != 2) | F.coalesce(luhn(digits(x["value"])), F.lit(False))
    likely = lambda x: model.probability(x["kind"], votes(x)) >= threshold
    rows = docs.drop(out).withColumn(found, candidates(whole_text(text)))
    rows = rows.withColumn(sure, F.filter(found, lambda x: x["tier"] == PASSED))
    loose = F.filter(found, lambda x: (x["tier"] == LOOSE) & lawful(x) & likely(x)) if model.weights else F.array().cast(SPANS)
    rows = rows.withColumn(more, loose)
    alone = F.when(F.size(more) == 0, F.col(more)).otherwise(first_of_overlaps(apart(F.col(more), F.col(sure))))
    spans = F.array_sort(F.concat(F.transform(sure, lambda x: slim(x, True)), F.transform(alone, lambda x: slim(x, False))))
    return rows.withColumn(out, spans).drop(found, sure, more)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, block: int = 2048) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first to start names the whole stretch.

    The text is cut into blocks of so many characters, since finding a place in a text takes as long as the way there.
    """
    name = lambda x: F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), x["kind"] + 1)

    def part(blocks: Column, start: Column, end: Column) -> Column:
        """Characters from start to before end."""
        first, last = F.floor(start / block).cast("int"), F.floor(end / block).cast("int")
        head = F.substring(F.coalesce(F.get(blocks, first), F.lit("")), start - first * block + 1, F.when(first == last, end - start).otherwise(F.lit(block)))
        tail = F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), end - last * block)
        middle = F.array_join(F.slice(blocks, first + 2, F.greatest(F.lit(0), last - first - 1)), "")
        return F.when(first == last, head).otherwise(F.concat(head, middle, tail))

    def rebuilt(blocks: Column, s: Column, size: Column) -> Column:
        reached = running(F.transform(s, lambda x: x["end"]), F.greatest)
        pairs = F.arrays_zip(s.alias("x"), F.concat(F.array(F.lit(0)), reached).alias("r"))
        # the pair behind the last span has no span: it closes the text
        pieces = F.transform(
            pairs,
            lambda y: F.when(y["x"].isNull(), part(blocks, y["r"], size)).when(y["x"]["start"] < y["r"], F.lit("")).otherwise(F.concat(part(blocks, y["r"], y["x"]["start"]), name(y["x"]))),
        )
        return F.array_join(pieces, "")

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    whole = let(F.struct(blocks.alias("b"), spans.alias("s")), lambda v: rebuilt(v["b"], v["s"], F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(whole)
