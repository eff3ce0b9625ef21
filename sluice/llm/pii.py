"""Personal data by weak supervision, in DataFrame functions only.

Base kinds (email, ip, card, phone) are what their patterns and checks accept; all of these are kept. Wider patterns give
further candidates, most of them harmless: opaque runs of characters that may be secrets, groups of digits that may be phone numbers,
dates that may be of birth, capitalised words after titles, numbered streets, and e-mail addresses written out. Three labelers vote yes,
no or not at all on each candidate, each by what the others don't read: a pattern by the form of the candidate itself, a
gazetteer by the words before it, and a context labeler by the punctuation right before it. Expectation-maximisation over the
counts of vote patterns estimates by kind how reliable each labeler is. The posteriors train the final span
classifier, naive Bayes over features of a candidate that aren't votes (length, share of digits, case, what stands behind it);
candidates that it accepts are the added spans.

Only counts of vote patterns and features come to the driver: 3^3 patterns and FEATURES cells of each added kind.

Spans count code points, ends exclusive. Defined results: null text is empty, with no spans; a base span may overlap spans of
other kinds; an added span that overlaps a base span is dropped. Repeated rows give a row each. Texts of any length
are read whole. Patterns repeat possessively, so that long runs need no deep stack, and a run in which a match can't
begin is tried once. Other columns are not read and may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import materialise

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Patterns of the base kinds, in the order of the result. Where a match can't begin at the start of a run of the first
#: class, it can't begin within it: \G is where the match before ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match has: texts without it are not searched.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
@dataclass(frozen=True)
class Wider:
    """A wider kind: its pattern, forms that speak for and against a candidate, words before it that speak for it, endings of what
    stands before it that speak for and against it, and a character that every match has."""

    kind: str
    pattern: str
    form: str
    no_form: str
    words: str
    ending: str
    no_ending: str
    needs: str | None = None


_PROSE = r"\p{L}[,.;]?\s$"
WIDER = (
    Wider("local_phone", r"(?<![0-9+.])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.])", r"^\(?[2-9]", r"^\(?[01]", r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|tel[eé]fono)\b", r"[:#]\s?$", _PROSE),
    Wider("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+", r"^(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z].*[A-Za-z].*[A-Za-z])[A-Za-z0-9+/_-]{20,}$", r"^[\p{L}/_-]+$", r"(?i)(?:password|passwd|pwd|secret|token|api[\x20_-]?key|credential|passwort|contrase[nñ]a|mot\x20de\x20passe)", r"[=:]\s{0,3}[\x22']?$", _PROSE),
    Wider("birth", r"(?<![0-9])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9])", r"-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$", r"-00|-1[3-9]|-3[2-9]$", r"(?i)\b(?:born|birth|birthday|dob|geboren|nacid[oa]|n[eé]e?)\b", r"[:(*]\s?$", r"[,;]\s$", "-"),
    Wider("person", r"(?<!\p{L})(?:Mrs|Mr|Ms|Dr|Prof|Herr|Frau|Se[nñ]or|Se[nñ]ora|Mme|Madame)\b\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?+", r"\p{Ll}\x20\p{Lu}\p{Ll}+\x20\p{Lu}|\.\x20\p{Lu}", r"(?i)\x20(?:the|this|and|of)$", r"(?i)\b(?:name|dear|patient|client|contact|regards|sincerely)\b", r"[:(]\s?$", r"\p{Lu}\p{L}*\s$"),
    Wider("address", r"(?<![0-9])[0-9]{1,5}\x20(?:\p{Lu}\p{Ll}++\x20){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b", r"(?:Street|Road|Avenue|Lane|Drive|Boulevard)$", r"^0", r"(?i)\b(?:address|live|lives|reside|resides|home|ship|mail)\b", r"[:,(]\s?$", r"[=+*/]\s?$"),
    Wider("spelt_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20(?:at|\[at\]|\(at\))\x20[A-Za-z0-9-]{1,63}+\x20(?:dot|\[dot\]|\(dot\))\x20[A-Za-z]{2,24}+", r"[\[(]|\x20(?:com|org|net|edu|gov|io|de|fr|es)$", r"(?i)^(?:the|a|was|is|be|look|up)\x20", r"(?i)\b(?:e-?mail|contact|write|reach|address)\b", r"[:(<]\s?$", r"[.!?]\s$", "dot"),
)
#: Characters before a candidate whose words the gazetteer reads, and of which the context labeler reads the last NEAR.
CONTEXT, NEAR = 40, 4
#: Votes, by the labeler's digit in base 3.
NOTHING, YES, NO = 0, 1, 2
LABELERS = ("form", "words", "ending")
#: Numbers of values of the classifier's features: length, share of digits, case, what stands behind.
FEATURES = (5, 4, 4, 3)
KINDS = [*BASE, *(w.kind for w in WIDER)]
#: Posterior from which the classifier accepts a candidate.
ACCEPT = 0.5
#: Parts of a text that prefix sums go over one by one; longer lists are summed by blocks.
_BLOCK = 512


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where the body uses it for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefix_sums(sizes: Column) -> Column:
    """Sums of the elements before each element of an array, by blocks: a long list isn't copied once per element."""

    def running(values: Column) -> Column:
        """n + 1 sums of an array of n."""
        return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def joined(inner: Column) -> Column:
        ends = running(F.transform(inner, lambda s: F.element_at(s, -1)))
        return _let(ends, lambda outer: F.flatten(F.transform(inner, lambda s, k: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x + F.element_at(outer, k + 1)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")), lambda k: F.slice(sizes, k * _BLOCK + 1, _BLOCK))
    return F.when(F.size(sizes) <= _BLOCK, running(sizes)).otherwise(_let(F.transform(blocks, running), joined))


def matches(text: Column, pattern: str, needs: str | None) -> Column:
    """array<struct<at (from 0), end, found>> of the leftmost non-overlapping matches: the text between matches and the matches
    themselves give the places, by sums of lengths."""
    p = F.lit(pattern)

    def placed(parts: Column) -> Column:
        gaps, found = parts["gaps"], parts["found"]
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
        ends = lambda step: _let(_prefix_sums(step), lambda sums: F.zip_with(F.slice(sums, 1, F.size(found)), F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m"))), one))
        return _let(steps, ends)

    def one(before: Column, part: Column) -> Column:
        at = before + F.length(part["gap"])
        return F.struct(at.alias("at"), (at + F.length(part["m"])).alias("end"), part["m"].alias("found"))

    spans = _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("found")), placed)
    has = F.lit(True) if needs is None else F.instr(text, needs) > 0
    return F.when(has & F.regexp_like(text, p), spans).otherwise(F.array().cast("array<struct<at:bigint,end:bigint,found:string>>"))


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits have a sound check digit: from the right, every second digit doubled, nines taken out."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CHECKS = {
    "ip": lambda s: F.regexp_like(s["found"], F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    "card": lambda s: F.when(F.length(_digits(s["found"])).between(13, 19), _luhn(_digits(s["found"]))).otherwise(False),
    "phone": lambda s: F.length(_digits(s["found"])).between(9, 15),
}


def _base(text: Column, kind: str) -> Column:
    found = matches(text, BASE[kind], NEEDS.get(kind))
    return F.filter(found, _CHECKS[kind]) if kind in _CHECKS else found


def _candidates(text: Column, w: Wider) -> Column:
    """array<struct<at, end, votes (a digit in base 3 for each labeler), shape (the features as one number)>>"""

    def vote(where: Column, yes: str, no: str | None) -> Column:
        against = F.when(F.regexp_like(where, F.lit(no)), NO).otherwise(NOTHING) if no else F.lit(NOTHING)
        return F.when(F.regexp_like(where, F.lit(yes)), YES).otherwise(against)

    def described(s: Column) -> Column:
        first = F.greatest(s["at"] - CONTEXT, F.lit(0)).cast("int")
        before = F.substring(text, first + 1, (s["at"] - first).cast("int"))
        last, behind = F.right(before, F.lit(NEAR)), F.substring(text, (s["end"] + 1).cast("int"), F.lit(1))
        votes = vote(s["found"], w.form, w.no_form) + 3 * vote(before, w.words, None) + 9 * vote(last, w.ending, w.no_ending)
        size = s["end"] - s["at"]
        share = F.length(_digits(s["found"])) / size
        length = F.when(size < 12, 0).when(size < 20, 1).when(size < 28, 2).when(size < 48, 3).otherwise(4)
        digits = F.when(share == 0, 0).when(share < 0.3, 1).when(share < 0.9, 2).otherwise(3)
        upper, lower = F.regexp_like(s["found"], F.lit(r"\p{Lu}")).cast("int"), F.regexp_like(s["found"], F.lit(r"\p{Ll}")).cast("int")
        after = F.when(F.regexp_like(behind, F.lit(r"^[\x22']$")), 2).when(F.regexp_like(behind, F.lit(r"^[\s.,;!?)]?$")), 0).otherwise(1)
        shape = ((length * FEATURES[1] + digits) * FEATURES[2] + 2 * upper + lower) * FEATURES[3] + after
        return F.struct(s["at"].alias("at"), s["end"].alias("end"), votes.cast("int").alias("votes"), shape.cast("int").alias("shape"))

    return F.transform(matches(text, w.pattern, w.needs), described)


def _free(candidates: Column) -> Callable[[Column], Column]:
    """The candidates that overlap none of the spans taken."""
    return lambda taken: F.filter(candidates, lambda s: ~F.exists(taken, lambda b: (b["at"] < s["end"]) & (s["at"] < b["end"])))


def _with_spans(rows: DataFrame) -> DataFrame:
    """`rows` (row, text) with a column of spans for each kind; added kinds hold candidates that overlap no base span."""
    out = rows
    for kind in BASE:
        out = out.withColumn(kind, F.transform(_base(F.col("text"), kind), lambda s: F.struct(s["at"].alias("at"), s["end"].alias("end"))))
    taken = F.concat(*[F.col(k) for k in BASE])
    for w in WIDER:
        out = out.withColumn(w.kind, _let(taken, _free(_candidates(F.col("text"), w))))
    return out


@dataclass
class Model:
    """Kind and shape of what the classifier accepts; of each kind that has candidates, each labeler's rates of (nothing, yes, no)
    on true and on false ones."""

    accepted: list[tuple[str, int]]
    rates: dict[str, list[tuple[tuple[float, ...], tuple[float, ...]]]]

    def accepts(self, kind: str, span: Column) -> Column:
        own = [s for k, s in self.accepted if k == kind]
        return span["shape"].isin(own) if own else F.lit(False)


#: Rates (nothing, yes, no) that labelers start from, on true and on false candidates; WEIGHT candidates of each are given, so
#: that no rate reaches 0 or 1. PRIOR is the share of true candidates that it starts from.
START, WEIGHT, PRIOR = ((0.3, 0.6, 0.1), (0.5, 0.1, 0.4)), 2.0, 0.3


def _votes(code: int) -> list[int]:
    return [code // 3**j % 3 for j in range(len(LABELERS))]


def estimate(patterns: dict[int, int], rounds: int = 100) -> tuple[list, dict[int, float]]:
    """Expectation-maximisation over counts of vote patterns. Each labeler has a rate of each vote on true and another on
    false candidates, given which votes are independent. Gives these rates and the posterior of each pattern."""
    prior, rates = PRIOR, [START] * len(LABELERS)
    total = sum(patterns.values())
    post: dict[int, float] = {}
    for _ in range(rounds if total else 0):
        for code in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(true[v] / false[v]) for (true, false), v in zip(rates, _votes(code), strict=True))
            post[code] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        true = sum(n * post[c] for c, n in patterns.items())
        prior = (true + WEIGHT * PRIOR) / (total + WEIGHT)
        rates = []
        for j in range(len(LABELERS)):
            seen = [[WEIGHT * start for start in START[state]] for state in (0, 1)]
            for c, n in patterns.items():
                seen[0][_votes(c)[j]] += n * post[c]
                seen[1][_votes(c)[j]] += n * (1 - post[c])
            rates.append(tuple(tuple(x / sum(own) for x in own) for own in seen))
    return rates, post


def _features(shape: int) -> list[int]:
    found = []
    for n in reversed(FEATURES):
        found.append(shape % n)
        shape //= n
    return found[::-1]


def classify(counts: dict[tuple[int, int], int], post: dict[int, float]) -> list[int]:
    """Naive Bayes on the features, trained on the posteriors of (votes, shape): the shapes that it accepts."""
    true: list[dict[int, float]] = [{} for _ in FEATURES]
    false: list[dict[int, float]] = [{} for _ in FEATURES]
    all_true = sum(n * post[v] for (v, _), n in counts.items())
    all_false = sum(counts.values()) - all_true
    for (votes, shape), n in counts.items():
        for k, value in enumerate(_features(shape)):
            true[k][value] = true[k].get(value, 0.0) + n * post[votes]
            false[k][value] = false[k].get(value, 0.0) + n * (1 - post[votes])
    found = []
    for shape in {s for _, s in counts}:
        odds = math.log((all_true + 0.5) / (all_false + 0.5))
        for k, value in enumerate(_features(shape)):
            odds += math.log((true[k][value] + 0.5) / (all_true + 0.5 * FEATURES[k])) - math.log((false[k][value] + 0.5) / (all_false + 0.5 * FEATURES[k]))
        if odds >= math.log(ACCEPT / (1 - ACCEPT)):
            found.append(shape)
    return sorted(found)


def _of_kind(kind: str, *fields: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), *[s[f].alias(f) for f in fields])


def fit(spans: DataFrame) -> Model:
    """A model of all candidates of a table that `_with_spans` made."""
    each = F.flatten(F.array(*[F.transform(w.kind, _of_kind(w.kind, "votes", "shape")) for w in WIDER]))
    rows = spans.select(F.explode(each).alias("c")).groupBy("c.kind", "c.votes", "c.shape").count().collect()
    accepted, rates = [], {}
    for w in WIDER:
        counts = {(r.votes, r.shape): r["count"] for r in rows if r.kind == w.kind}
        if not counts:
            continue
        patterns: dict[int, int] = {}
        for (votes, _), n in counts.items():
            patterns[votes] = patterns.get(votes, 0) + n
        rates[w.kind], post = estimate(patterns)
        accepted += [(w.kind, s) for s in classify(counts, post)]
    return Model(accepted, rates)


def _chosen(kind: str, model: Model) -> Column:
    spans = F.col(kind)
    if kind in BASE:
        return spans
    return F.transform(F.filter(spans, lambda s: model.accepts(kind, s)), lambda s: F.struct(s["at"].alias("at"), s["end"].alias("end")))


def _joined(kinds: list[str], model: Model) -> Column:
    def shown(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.concat(F.lit(f"{kind}:"), s["at"].cast("string"), F.lit(":"), s["end"].cast("string"))

    each = [F.transform(_chosen(k, model), shown(k)) for k in kinds]
    return F.array_join(F.flatten(F.array(*each)), ",")


def searched(docs: DataFrame, text: str, keep: list[str], with_text: bool) -> DataFrame:
    """Struct `row` of the columns to keep, the text if asked for, and the spans of each kind of each row, written to the shared
    folder, so that texts are searched once."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    spans = _with_spans(docs.select(row, F.coalesce(F.col(text), F.lit("")).alias("text")))
    return materialise(spans if with_text else spans.drop("text"), "pii-spans")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the number of base spans of each kind, the digest of the base spans, and all spans, of each row."""
    spans = searched(docs, text, [key], False)
    model = fit(spans)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select(F.col(f"row.`{key}`").alias(key), *counts, F.sha2(_joined(list(BASE), model), 256).alias("base_sha256"), _joined(KINDS, model).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with each span of the text replaced by its kind in angle brackets; of spans that overlap, the
    one that starts first, then the longest, is replaced whole and of the others what lies behind it. Null text stays null."""
    spans = searched(docs, text, docs.columns, True)
    model = fit(spans)

    def sortable(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["at"].alias("at"), (-s["end"]).alias("back"), F.lit(kind).alias("kind"))

    named = [F.transform(_chosen(k, model), sortable(k)) for k in KINDS]
    ordered = F.array_sort(F.flatten(F.array(*named)))
    whole = F.col("text")

    def replaced(acc: Column, s: Column) -> Column:
        between = F.substring(whole, (acc["past"] + 1).cast("int"), F.greatest(s["at"] - acc["past"], F.lit(0)).cast("int"))
        parts = F.concat(acc["parts"], F.array(between, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        return F.when(-s["back"] <= acc["past"], acc).otherwise(F.struct((-s["back"]).alias("past"), parts.alias("parts")))

    start = F.struct(F.lit(0).cast("long").alias("past"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(ordered, start, replaced, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(whole, (acc["past"] + 1).cast("int"), F.length(whole))))
    own = F.col(f"row.`{text}`")
    out = F.when(F.size(ordered) > 0, done).otherwise(own)
    return spans.select(*[(out if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
