"""Quality rules: a learned decision list over document statistics.

Statistics are SQL functions of one row. Words are runs of characters other
than space and tab to carriage return. ``n_repeat_words`` counts the words that
lie in a five-word window found at least twice in the text.

The list is learned by sequential covering. Labelled rows are split into a
grow and a prune part by a hash of the id. A rule grows from threshold
conditions by FOIL gain on the grow part, and is pruned from its end to the
prefix with the best worth on the prune part. It joins the list if most rows it
catches there are bad; the rows it catches then leave both parts. Each step is
one aggregation by feature and bin in Spark; the driver sees only those sums.
The list becomes one ordered ``CASE WHEN`` over the statistics.

Null text has no words, so it fails the base rule. Rows without a label or a
doc_id take no part in learning; a doc_id that repeats in ``labels`` counts
once per label row. Without labels the list is empty and the base rule decides
alone. Repeated rows are judged alike, other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.session import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
BINS = 24
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper_words", "n_marks"]
_SPACE = "[\\x20\\x09-\\x0D]+"


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS) per row. Columns used more than once are steps of their own, so each is computed once."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    d = d.select("doc_id", "t", F.filter(F.split("t", _SPACE), lambda w: w != "").alias("w"), lines.alias("lines"))
    windows = F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("w"), i + j) for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    d = d.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"), _count(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"), F.size(F.filter("w", lambda w: (w == F.upper(w)) & (w != F.lower(w)))).cast("long").alias("n_upper_words"),
        _count(F.col("t"), "!?.,;:").alias("n_marks"), windows.alias("h"))
    base = [c for c in d.columns if c != "h"]
    # Most texts repeat no window; only the others are sorted.
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.select(*base, pairs.alias("p"))
    same = lambda k, x: F.coalesce(F.get(F.col("p"), k)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("p", lambda x, k: F.when((k > 0) & same(k - 1, x), True).otherwise(same(k + 1, x))), lambda x: x["i"]))
    d = d.select(*base, starts.alias("s"))
    cover = F.transform("s", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("s"), k + 1) - x, F.lit(WINDOW))))
    repeat = F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return d.select("doc_id", *(repeat.alias(c) if c == "n_repeat_words" else F.col(c) for c in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Threshold features of the learned rules: sizes and shares."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / words, "symbols_per_word": F.col("n_symbols") / words, "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words, "distinct_share": F.col("n_distinct_words") / words, "upper_share": F.col("n_upper_words") / words, "marks_per_word": F.col("n_marks") / words,
        "words_per_line": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = features()[self.feature]
        return f > self.threshold if self.above else f <= self.threshold


@dataclass
class DecisionList:
    """Rules tried in order; the first that holds rejects, and no rule keeps."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self) -> Column:
        case = None
        for i, rule in enumerate(self.rules, 1):
            cond = rule[0].column()
            for c in rule[1:]:
                cond = cond & c.column()
            case = F.when(cond, i) if case is None else case.when(cond, i)
        return F.lit(None).cast("int") if case is None else case


def _holds(rule: list[tuple[int, bool, int]]) -> Column:
    """The conditions (feature, above, bin) on binned rows."""
    cond = F.lit(True)
    for f, above, b in rule:
        cond = cond & (F.col(f"b{f}") > b if above else F.col(f"b{f}") <= b)
    return cond


def _bin(name: str, cuts: list[float]) -> Column:
    """Number of cuts below the value."""
    return F.aggregate(F.array(*(F.lit(float(x)) for x in cuts)), F.lit(0), lambda a, x: a + (F.col(name) > x).cast("int"))


def learn(stats: DataFrame, labels: DataFrame, max_rules: int = 8, max_conditions: int = 4, min_bad: int = 5) -> DecisionList:
    names = list(features())
    rows = stats.where(~base_failed()).join(labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("bad")).where("bad is not null"), "doc_id")
    rows = cut_lineage(rows.select((F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), "bad", *(c.alias(n) for n, c in features().items())), "labelled")
    cuts = [sorted(set(q)) for q in rows.approxQuantile(names, [i / BINS for i in range(BINS + 1)], 0.001)]
    if not any(cuts):
        return DecisionList()
    # Bin b holds the values above cut b - 1 and up to cut b.
    binned = [_bin(n, c).alias(f"b{i}") for i, (n, c) in enumerate(zip(names, cuts, strict=True))]
    table = cut_lineage(rows.select("prune", "bad", *binned).groupBy("prune", "bad", *(f"b{i}" for i in range(len(names)))).agg(F.count("*").alias("n")), "binned")

    def sums(part: DataFrame) -> tuple[int, int]:
        r = part.agg(F.sum(F.col("n") * F.col("bad")), F.sum(F.col("n") * (1 - F.col("bad")))).first()
        return r[0] or 0, r[1] or 0

    out, left = DecisionList(), table
    for _ in range(max_rules):
        rule: list[tuple[int, bool, int]] = []
        p, n = sums(left.where("not prune"))
        while p >= min_bad and n > 0 and len(rule) < max_conditions:
            bins = F.posexplode(F.array(*(F.col(f"b{i}") for i in range(len(names)))))
            held = left.where("not prune").where(_holds(rule)).select("bad", "n", bins.alias("f", "b")).groupBy("f", "b").agg(F.sum(F.col("n") * F.col("bad")).alias("p"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("q")).collect()
            best = None
            for f in range(len(names)):
                by_bin = {r["b"]: (r["p"], r["q"]) for r in held if r["f"] == f}
                low = (0, 0)
                for b in range(len(cuts[f])):
                    low = (low[0] + by_bin.get(b, (0, 0))[0], low[1] + by_bin.get(b, (0, 0))[1])
                    for above, (x, y) in ((False, low), (True, (p - low[0], n - low[1]))):
                        if x >= min_bad and (x, y) != (p, n):
                            gain = x * (math.log2(x / (x + y)) - math.log2(p / (p + n)))
                            if best is None or gain > best[0]:
                                best = (gain, f, above, b, x, y)
            if best is None or best[0] <= 0:
                break
            rule.append(best[1:4])
            p, n = best[4:]
        if not rule:
            break
        worth = []
        for k in range(len(rule), 0, -1):
            x, y = sums(left.where("prune").where(_holds(rule[:k])))
            worth.append(((x - y) / (x + y) if x + y else -1.0, x, k))
        score, _, k = max(worth)
        if score <= 0:
            break
        rule = rule[:k]
        out.rules.append([Condition(names[f], above, cuts[f][b]) for f, above, b in rule])
        left = left.where(~_holds(rule))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, STATS, base_failed, rule, kept) per row; ``rule`` is the number of the learned rule that rejects."""
    stats = cut_lineage(statistics(docs), "statistics")
    rule = learn(stats, labels).rejects()
    return stats.select("*", base_failed().alias("base_failed"), F.when(~base_failed(), rule).alias("rule")).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
