"""Personal data by weak supervision.

Base kinds are found by fixed patterns and always stay. Further candidates
(secrets, identity numbers, phone numbers without a country code) come from
loose patterns; labelers vote on each one:

* regex: the candidate has the strict shape of its kind,
* gazetteer: a word that announces personal data stands just before it,
* context: it follows an assignment or a quote,
* mixture: its share of digits and of different characters look random.

A labeler may abstain. Expectation-maximisation over the counts of vote
patterns estimates how often each labeler is right (a Dawid-Skene model with
two classes). Its posteriors are the soft labels of a naive Bayes classifier
over span features, which gives the final verdict on candidates, also where
all labelers abstain. Both read only the counts of patterns, whose number is
fixed by the code, so the driver's share does not grow with the documents.

Positions are code points, end exclusive. They follow from the pieces between
the matches, so a text is scanned twice per kind that it holds and not at all
for others. Patterns use possessive and bounded repeats and look-behinds, so
long runs of letters or digits take linear time and no deep recursion.

Null text holds nothing. Rows may repeat or lack an id; other columns are kept
by :func:`candidates` and ignored otherwise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ["email", "ip", "card", "phone"]
EXTRA = ["secret", "identity", "local_phone"]

#: The base kinds, with repeats rewritten to the same matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/-])(?:(?=[A-Za-z+/]*[0-9])(?=[0-9+/]*[A-Za-z])(?=[A-Za-z0-9/]*[+=])[A-Za-z0-9+/]{16,}+={0,2}|(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}+)",
    "identity": r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9-])",
    "local_phone": r"(?<![0-9+.-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])",
}
#: Words that announce personal data.
GAZETTEER = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "key", "auth", "bearer", "credential", "ssn", "passport", "iban", "account", "phone", "tel", "call", "mobile", "fax"]

VOTES = ["v_regex", "v_gazetteer", "v_context", "v_mixture"]
FEATURES = ["kind", "f_length", "f_digits", "f_before", "f_cue"]
CONTEXT = 24
_SPAN = "struct<start:int,end:int,m:string>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    d = _digits(c)
    digit = lambda i: F.substring(d, -i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    match kind:
        case "ip":
            return F.regexp_like(m, F.lit(f"^{part}\\.{part}\\.{part}\\.{part}$"))
        case "card":
            return _luhn(m)
        case "phone":
            return F.length(_digits(m)).between(9, 15)
        case _:
            return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Array of (start, end, m) of the kind's valid matches."""
    pattern = F.lit(PATTERNS[kind])
    found, between = F.regexp_extract_all(text, pattern, 0), F.split(text, PATTERNS[kind], -1)
    step = F.arrays_zip(found.alias("m"), between.alias("gap"))
    init = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("pos"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))).alias("out"))

    spans = F.aggregate(F.filter(step, lambda x: x["m"].isNotNull()), init, add, lambda acc: acc["out"])
    must = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.lit(True))
    return F.when(must & F.regexp_like(text, pattern), F.filter(spans, lambda s: _valid(kind, s["m"]))).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _candidate(text: Column, kind: str, s: Column) -> Column:
    """Votes (1 yes, 0 no, -1 abstain) and features of an extra candidate."""
    m = s["m"]
    before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), s["start"])))
    size, digits = F.length(m), F.length(_digits(m))
    kinds = F.array_size(F.array_distinct(F.split(F.lower(m), "")))
    cue = F.regexp_like(before, F.lit("(?:^|[^a-z])(?:" + "|".join(GAZETTEER) + ")[^a-z]{0,6}$"))
    assigned = F.regexp_like(before, F.lit("[=:] ?[\"']?$"))
    strict = {"secret": F.regexp_like(m, F.lit("^(?:[0-9a-f]{16,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20,})$")), "identity": F.lit(True), "local_phone": F.lit(True)}[kind]
    return F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        strict.cast("int").alias("v_regex"), F.when(cue, 1).otherwise(-1).alias("v_gazetteer"), F.when(assigned, 1).when(F.regexp_like(before, F.lit("[a-z] $")) & ~cue, 0).otherwise(-1).alias("v_context"),
        F.when((digits * 5 >= size) & (kinds * 6 >= F.least(size, F.lit(36))), 1).when(digits * 10 < size, 0).otherwise(-1).alias("v_mixture"),
        F.least(F.floor(size / 8), F.lit(6)).cast("int").alias("f_length"), F.floor(digits * 5 / size).cast("int").alias("f_digits"),
        F.when(assigned, 2).when(F.regexp_like(before, F.lit("[a-z0-9_]$")), 1).otherwise(0).alias("f_before"), cue.cast("int").alias("f_cue"))


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii_base`` (kind, start, end) and ``pii_extra`` (candidates with votes and features); columns of these names are replaced."""
    t = F.coalesce(F.col("text"), F.lit(""))
    own = [c for c in docs.columns if not c.startswith("pii_")]
    rows = docs.select(*own, *(_spans(t, k).alias(f"pii_{k}") for k in PATTERNS))
    rows = rows.withColumn("pii_base", F.concat(*(_kind(k) for k in BASE)))
    free = lambda s: ~F.exists("pii_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return rows.select(*own, "pii_base", F.concat(*(_extra(t, k, free) for k in EXTRA)).alias("pii_extra"))


def _kind(kind: str) -> Column:
    return F.transform(f"pii_{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _extra(text: Column, kind: str, free) -> Column:
    return F.transform(F.filter(f"pii_{kind}", free), lambda s: _candidate(text, kind, s))


@dataclass
class SpanClassifier:
    """Naive Bayes log-odds: a prior and one number per feature value."""

    prior: float
    odds: list[dict]

    def accepts(self, x: Column) -> Column:
        total = F.lit(self.prior)
        for name, table in zip(FEATURES, self.odds, strict=True):
            value = F.lit(0.0)
            for key, odds in sorted(table.items()):
                value = F.when(x[name] == key, odds).otherwise(value)
            total = total + value
        return total >= 0


def fit(cands: DataFrame, rounds: int = 60) -> SpanClassifier | None:
    """EM over vote patterns, then naive Bayes on its posteriors; None without candidates."""
    x = cands.select(F.explode("pii_extra").alias("x")).select("x.*")
    rows = [r.asDict() for r in x.groupBy(*VOTES, *FEATURES).count().collect()]
    if not rows:
        return None
    weight = [r["count"] for r in rows]
    # Start from the majority of the votes, so that the classes keep their meaning.
    q = [(1 + sum(r[v] == 1 for v in VOTES)) / (2 + sum(r[v] >= 0 for v in VOTES)) for r in rows]
    for _ in range(rounds):
        prior = (1 + sum(w * p for w, p in zip(weight, q, strict=True))) / (2 + sum(weight))
        rates = []
        for v in VOTES:
            table = {}
            for y in (0, 1):
                part = [w * (p if y else 1 - p) for w, p in zip(weight, q, strict=True)]
                total = sum(part)
                for value in (-1, 0, 1):
                    table[value, y] = (1 + sum(c for c, r in zip(part, rows, strict=True) if r[v] == value)) / (3 + total)
            rates.append(table)
        q = []
        for r in rows:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[r[v], 1] / t[r[v], 0]) for v, t in zip(VOTES, rates, strict=True))
            q.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
    yes = 1 + sum(w * p for w, p in zip(weight, q, strict=True))
    no = 1 + sum(w * (1 - p) for w, p in zip(weight, q, strict=True))
    tables = []
    for f in FEATURES:
        values = sorted({r[f] for r in rows})
        table = {}
        for value in values:
            a = 1 + sum(w * p for w, p, r in zip(weight, q, rows, strict=True) if r[f] == value)
            b = 1 + sum(w * (1 - p) for w, p, r in zip(weight, q, rows, strict=True) if r[f] == value)
            table[value] = math.log((a / (yes + len(values))) / (b / (no + len(values))))
        tables.append(table)
    return SpanClassifier(math.log(yes / no), tables)


def all_spans(model: SpanClassifier | None) -> Column:
    """Base spans and accepted candidates (kind, start, end), by kind as listed, then start."""
    if model is None:
        return F.col("pii_base")
    kept = F.filter("pii_extra", model.accepts)
    return F.concat("pii_base", F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        piece = F.array(F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["pos"], -s["neg"]).alias("pos"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(by_start, init, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
