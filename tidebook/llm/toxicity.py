"""Toxicity by a weighted lexicon.

Text is folded (lower case, homoglyphs of other scripts to Latin letters, digit
and sign substitutions to letters; accents stay, they tell words apart) and
scanned once by an Aho-Corasick automaton of lexicon terms and exception
phrases. A term is a whole word or a stem (written ``stem*``) with which a word
begins; it counts where it does not stand inside an exception phrase. The sum
of weights, divided by the logarithm of the number of words, gives the score
through a logistic curve.

The lexicon is learned from a sample of at most ``sample`` labelled documents
of each class (the lowest hashed ids). Words and word beginnings are ranked by
log-likelihood ratio (ties: the longer one), then picked in that order while
they explain toxic documents that the earlier ones do not, so words that merely
accompany others are left out; a term at least a quarter as strong as the
strongest that clean documents hardly use is kept all the same. A pair of a term and a neighbour word that clean
documents use becomes an exception. The curve's intercept is corrected for the
share of toxic labels.

Training looks at the ``candidates`` terms most used in toxic documents, at as
many exceptions, and for those at the neighbours of the ``NEIGHBOURED``
strongest terms; these bound the model, not the scoring.

Null and empty texts score as texts without a hit. Without toxic labels every
score is 0; where no term tells the classes apart, every text has the score of
the toxic share. Rows may repeat or lack an id; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like Latin ones, and their Latin forms.
HOMOGLYPHS = ("абвгеѕіјкӏмнорстухԁԛԝһαβγεικνορτυχω", "abbresijklmhopctyxdqwhabyeiknoptuxw")
#: Digits and signs that stand for letters.
SUBSTITUTES = ("013457@$", "oieastas")


STEMS = range(4, 9)
FLUSH = 1 << 18
NEIGHBOURED = 200


def fold_table() -> dict[int, str]:
    """Code point to folded text, for str.translate after lower-casing."""
    table = {}
    for glyphs, latin in (HOMOGLYPHS, SUBSTITUTES):
        table |= {ord(g): x for g, x in zip(glyphs, latin, strict=True)}
    for cp in range(0xFF41, 0xFF5B):
        table[cp] = chr(cp - 0xFF41 + ord("a"))
    return table | dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF), "")


def words(folded: str) -> list[str]:
    """Whitespace-separated words without punctuation at their ends."""
    return [w for w in (x.strip(".,;:!?\"'()[]{}<>|*#%&-_") for x in folded.split()) if w]


def terms_of(seq: list[str]) -> set[str]:
    """The words of a text and their beginnings of STEMS letters."""
    distinct = set(seq)
    return distinct | {w[:k] + "*" for w in distinct for k in STEMS if len(w) > k}


def _matches(automaton, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Whole-word term matches and exception spans."""
    terms, exceptions = [], []
    for end, (size, term) in automaton.iter(text) if automaton is not None else ():
        start = end - size + 1
        stem = term is not None and term[-1] == "*"
        if (start == 0 or not text[start - 1].isalnum()) and (stem or end + 1 == len(text) or not text[end + 1].isalnum()):
            if term is None:
                exceptions.append((start, end))
            else:
                terms.append((start, end, term))
    return terms, exceptions


def _automaton(lexicon: dict[str, float], exceptions: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    # A word and a stem of the same letters share an entry; the stem matches wherever the word does.
    for term in sorted(lexicon):
        plain = term.rstrip("*")
        if term != plain or plain + "*" not in lexicon:
            out.add_word(plain, (len(plain), term))
    for phrase in exceptions:
        out.add_word(phrase, (len(phrase), None))
    if not len(out):  # an automaton without words can't be searched
        return None
    out.make_automaton()
    return out


def scorer(lexicon: dict[str, float], exceptions: list[str]) -> Callable[[str | None], float]:
    """A function from text to its normalised sum of weights."""
    table, automaton = fold_table(), _automaton(lexicon, exceptions)

    def score(text: str | None) -> float:
        parts = (text or "").lower().translate(table).split()
        folded = " ".join(parts)
        terms, spans = _matches(automaton, folded)
        total = sum(lexicon[t] for a, b, t in terms if not any(x <= a and b <= y for x, y in spans))
        return total / math.log(math.e + len(parts)) if terms else 0.0

    return score


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, held = fold_table(), Counter()

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array(list(held.values()), pa.int64())], ["word", "toxic", "n"])
        held.clear()
        return out

    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            held.update((w, y) for w in terms_of(words((text or "").lower().translate(table))))
            if len(held) > FLUSH:
                yield emit()
    yield emit()


def _llr(a: int, b: int, n1: int, n0: int) -> float:
    """Signed log-likelihood ratio of a word in ``a`` of n1 toxic and ``b`` of n0 clean documents."""
    p = (a + b) / (n1 + n0)
    value = sum(k * math.log(k / n / q) for k, n, q in ((a, n1, p), (n1 - a, n1, 1 - p), (b, n0, p), (n0 - b, n0, 1 - p)) if k and q)
    return value if a * n0 > b * n1 else -value


def _nested(a: str, b: str) -> bool:
    a, b = a.rstrip("*"), b.rstrip("*")
    return a.startswith(b) or b.startswith(a)


class Model:
    def __init__(self, lexicon: dict[str, float], exceptions: list[str], intercept: float, slope: float):
        self.lexicon, self.exceptions, self.intercept, self.slope = lexicon, exceptions, intercept, slope


def train(docs: DataFrame, labels: DataFrame, sample: int = 10000, candidates: int = 4000, min_docs: int = 3) -> Model | None:
    """Lexicon, exceptions and curve from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if not share.get(1) or not share.get(0):
        return None
    picked = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    # At most two samples of ids, so the broadcast is bounded.
    rows = docs.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("text", "toxic")
    counted = rows.mapInArrow(_word_counts, "word string, toxic int, n long").groupBy("word").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("a"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("b"))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return None
    lift = F.col("a") * F.log((F.col("a") + 0.5) / (F.col("b") + 0.5) * n0 / n1)
    top = counted.where(F.col("a") >= min_docs).where(F.col("a") * n0 > F.col("b") * n1).orderBy(F.desc(lift), "word").limit(candidates).collect()
    ranked = sorted(((r["word"], r["a"], r["b"]) for r in top), key=lambda r: (-_llr(r[1], r[2], n1, n0), -len(r[0]), r[0]))
    vocabulary = {w: i for i, (w, _, _) in enumerate(ranked)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table()
        for batch in batches:
            found, near = [], []
            for text in batch.column("text").to_pylist():
                seq = words((text or "").lower().translate(table))
                found.append(sorted({vocabulary[w] for w in terms_of(seq) if w in vocabulary}))
                at = [i for i, w in enumerate(seq) if vocabulary.get(w, NEIGHBOURED) < NEIGHBOURED]
                near.append(sorted({" ".join(seq[max(0, i - d) : i + 1 + e]) for i in at for d, e in ((1, 0), (0, 1)) if (i if d else i + 1 < len(seq))}))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.string()))], ["toxic", "found", "near"])

    sets = rows.mapInArrow(present, "toxic int, found array<int>, near array<string>")
    grouped = sets.groupBy("toxic", "found").count().toPandas()
    toxic = [(set(f), c) for y, f, c in grouped.itertuples(index=False) if y == 1]
    lexicon: dict[str, float] = {}
    while len(lexicon) < len(ranked):
        gain = Counter()
        for f, c in toxic:
            gain.update({int(v): c for v in f})
        # Among the terms that explain further documents, the strongest over all documents is next.
        fresh = [v for v in gain if gain[v] >= max(min_docs, 0.002 * n1)]
        if not fresh or _llr(*ranked[min(fresh)][1:], n1, n0) < 6:
            break
        best = min(fresh)
        word, a, b = ranked[best]
        lexicon[word] = math.log((a + 0.5) / (n1 + 1) * (n0 + 1) / (b + 0.5))
        toxic = [(f, c) for f, c in toxic if best not in f]
    # Strong terms that clean documents hardly use stay, also where others explain most of their documents.
    for word, a, b in ranked:
        if _llr(a, b, n1, n0) < _llr(*ranked[0][1:], n1, n0) / 4:
            break
        if b * n1 <= 0.01 * a * n0 and not any(_nested(word, other) for other in lexicon):
            lexicon[word] = math.log((a + 0.5) / (n1 + 1) * (n0 + 1) / (b + 0.5))
    phrases = sets.select("toxic", F.explode("near").alias("phrase")).groupBy("phrase").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    phrases = phrases.where((F.col("b") >= min_docs) & (F.col("b") * n1 > 4 * F.col("a") * n0)).orderBy(F.desc("b"), "phrase").limit(candidates).collect()
    exceptions = [r["phrase"] for r in phrases if any(w in lexicon for w in r["phrase"].split(" "))]

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(lexicon, exceptions)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([round(score(t), 3) for t in batch.column("text").to_pylist()], pa.float64())], ["toxic", "x"])

    points = rows.mapInArrow(raw, "toxic int, x double").groupBy("toxic", "x").count().toPandas()
    x, y, w = points["x"].to_numpy(), points["toxic"].to_numpy(float), points["count"].to_numpy(float)
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        grad = design.T @ (w * (y - p)) - 0.01 * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        beta += np.linalg.solve(hess, grad)
    prior = math.log(share[1] / share[0]) - math.log(n1 / n0)
    return Model(lexicon, exceptions, float(beta[0] + prior), float(beta[1]))


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) per row of ``docs(doc_id, text)``."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    lexicon, exceptions, intercept, slope = model.lexicon, model.exceptions, model.intercept, model.slope

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(lexicon, exceptions)
        for batch in batches:
            x = np.array([score(t) for t in batch.column("text").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(intercept + slope * x, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
