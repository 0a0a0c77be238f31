"""Merkle manifest, token counts and phrase mining against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidebook.llm import collocations, merkle_manifest, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, r string, n string, item string, kids string, word string, h string, w1 string, f string"


def documents(spark, rows):
    """Rows (doc_id, text, lang), with columns whose names the operators use inside."""
    full = [(i, t, g, f"s{(i or 0) % 3}" if (i or 0) % 5 else None, None if t is None else len(t), *["x"] * 9) for i, t, g in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


# Merkle manifest -----------------------------------------------------------------------------------------------------


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fan):
    """(root, siblings of each node as a list of (left, right))."""
    paths, owners, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        up, up_owners = [], []
        for a in range(0, len(level), fan):
            run = level[a : a + fan]
            for k in range(len(run)):
                for o in owners[a + k]:
                    paths[o].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            up_owners.append([o for os in owners[a : a + fan] for o in os])
        level, owners = up, up_owners
    return level[0], paths


def brute_manifest(rows, fan):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in ordered[g]], fan) for g in langs}
    root, crown = tree([trees[g][0] for g in langs], fan)
    out = []
    for g, above in zip(langs, crown, strict=True):
        for row, below in zip(ordered[g], trees[g][1], strict=True):
            path = below + above
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                changed = (*row[:4], "".join(c.lower() if c.isascii() else c for c in row[4]))
            folded = reduce(lambda node, s: sha(s[0] + node + s[1]), path, leaf(changed))
            out.append((row[0], leaf(row), trees[g][0], root, sha("".join(a + b for a, b in path)), folded, folded == root, g))
    return Counter(out)


def found_manifest(docs, fan=8, levels=3):
    rows = merkle_manifest.verified(merkle_manifest.manifest(docs, merkle_manifest.lowered_thirds(), fan, levels))
    return Counter(tuple(r) for r in rows.collect())


@pytest.mark.parametrize(("fan", "levels", "size"), [(8, 3, 700), (2, 2, 90), (3, 1, 60)])
def test_manifest_equals_brute_force(spark, fan, levels, size):
    random.seed(size)
    rows = [(random.choice([None, *range(-3, size)]), random.choice(["Some Text é", "", None, "plain", "A" * random.randrange(9)]), random.choice([None, "", "de", "en", "en", "en", "fr"])) for _ in range(size)]
    rows += [(5, "Twice", "en")] * 3 + [(1, "Alone", "zz")]
    docs = documents(spark, rows)
    plain = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert found_manifest(docs, fan, levels) == brute_manifest(plain, fan)


def test_manifest_of_one_row_long_texts_and_no_rows(spark):
    docs = documents(spark, [(3, "Q" * 3_000_000, None)])
    (row,) = merkle_manifest.verified(merkle_manifest.manifest(docs, F.lower("text"))).collect()
    assert row.leaf == row.subroot == row.root and not row.verified and row.proof_sha256 == sha("")
    assert merkle_manifest.verified(merkle_manifest.manifest(docs.where("false"), merkle_manifest.lowered_thirds())).count() == 0
    assert [r.tampered_leaf for r in merkle_manifest.manifest(docs).collect()] == [None]


# Token counts --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_equal_the_library(spark, tokenizer):
    random.seed(3)
    odd = ["".join(random.choice("aAé漢 \n\t  \x1c'st1٣!<|endoftext|>🙂") for _ in range(random.randrange(60))) for _ in range(400)]
    odd += [None, "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "  x  ", "it's we'll I'D", "\r\n\r\n x", "ab" * 5000, "x" * 70_000, "word " * 300_000, "\n" * 100_000]
    odd += ["".join(random.choice("abcdefghij") for _ in range(9000)), "same", "same"]
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(odd)] + [(None, "no id", None)])
    got = {r.doc_id: r for r in token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert [got[i].n_tokens for i in range(len(odd))] == library(tokenizer, odd)
    assert [got[i].n_bytes for i in range(len(odd))] == [len((t or "").encode()) for t in odd]
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.values()) and None in got
    assert token_counts.token_counts(docs.where("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_counts_on_whole_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert [got[r.doc_id] for r in rows] == library(tokenizer, [r.text for r in rows])


def test_linked_positions_equal_the_ragged_rounds():
    merger = token_counts.PairMerger(token_counts.vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    random.seed(9)
    for letters in ("a", "ab", "etaoin ", "0123456789"):
        words = ["".join(random.choice(letters) for _ in range(random.randrange(1, 900))).encode() for _ in range(30)]
        assert merger.counts(words).tolist() == [merger._long(merger.bytes[np.frombuffer(w, np.uint8)]) for w in words]


def test_parts_of_long_texts_end_where_a_pre_token_ends(tokenizer, monkeypatch):
    monkeypatch.setattr(token_counts, "PART", 50)
    counter = token_counts.TokenCounter(token_counts.vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    random.seed(5)
    texts = ["".join(random.choice("ab  \n.1'") for _ in range(700)) for _ in range(60)]
    assert counter(texts) == library(tokenizer, texts)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="not a plain byte-level"):
        token_counts.vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# Phrases -------------------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for end in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(end, ".")
        for piece in low.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    inner = {}
    for (lang, *p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inner[lang, *p[i : i + k]] = max(a, inner.get((lang, *p[i : i + k]), 0))
    out = {}
    for (lang, *p), a in candidates.items():
        if inner.get((lang, *p), 0) >= a:
            continue
        n = totals[lang]
        cuts = [(1000 * a * n // (counts[lang, *p[:k]] * counts[lang, *p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, *p[:k]], counts[lang, *p[k:]], n))
    return {(lang, place, p.decode(), -a, left, r, n, -s) for lang, rows in out.items() for place, (s, a, p, left, r, n) in enumerate(sorted(rows)[:top], 1)}


@pytest.mark.parametrize(("sample", "coded", "batch"), [(4096, 1 << 17, 10_000), (50, 3, 50), (2, 0, 7)])
def test_phrases_equal_brute_force(spark, monkeypatch, sample, coded, batch):
    """Few codes spell most words, a small sample deals windows unevenly, small batches cut runs of prefixes: the result must not change."""
    monkeypatch.setattr(collocations, "SAMPLE", sample)
    random.seed(4)
    vocabulary = ["new", "york", "NEW", "city", "of", "the", "é", "x.y", "a,b", "c\td", "\x00", " ", "stock", "exchange", "in", "a", "b", "c", "d", "e"]
    rows = []
    for i in range(150):
        words = random.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=random.randrange(80))
        words = [w if random.random() > 0.1 else random.choice(["new york stock exchange", "\n", ". ", "!?", "in the city of new york"]) for w in words]
        rows.append((i, random.choice([" ", "  ", "\t"]).join(words), random.choice([None, "und", "en", "en", "de"])))
    rows += [(None, None, None), (1, "", "en"), (2, ". . .", "fr"), *[(3, "copy of a copy of a copy", "de")] * 40]
    rows += [(5, "=en ! = %20", "a %20b"), *[(6, "= =x %20 ==", "a %20b")] * 9]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = collocations.collocations(documents(spark, rows), 8, coded=coded).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == brute_phrases(rows, 8) and len(got) == len({(r.lang, r.rank) for r in got})


def test_phrases_in_long_texts_are_cut_between_pieces_only(spark, monkeypatch):
    rows = [(1, "alpha beta gamma delta epsilon zeta. " * 20_000, "en"), (2, "no end " * 30_000, "en")]
    docs = documents(spark, rows)
    assert {tuple(r) for r in collocations.collocations(docs, 10).collect()} == brute_phrases(rows, 10)
    data = np.frombuffer(b"a b. c d e f! g", np.uint8)
    monkeypatch.setattr(collocations, "PART", 3)
    parts = [p.tobytes() for p, _ in collocations._parts(data, np.array([0, len(data)]))]
    assert parts == [b"a b.", b" c d e f!", b" g"]


def test_phrase_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    """The four counts stand for a corpus of 10**13 words."""
    n, a, left, right = 10_000_000_000_037, 3_000_000_000_011, 7_000_000_000_003, 3_100_000_000_019
    counts = [("en", 0, [], "", n), ("en", 1, ["p"], "p", left), ("en", 1, ["q"], "q", right), ("en", 2, ["p", "q"], "p q", a)]
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: spark.createDataFrame(counts, "lang string, k int, words array<string>, phrase string, f long"))
    (row,) = collocations.collocations(documents(spark, [(1, "p q", "en")])).collect()
    assert row.score == 1000 * a * n // (left * right) and (row.a, row.l, row.r, row.n) == (a, left, right, n)


def test_phrases_top_and_empty_tables(spark):
    rows = [(i, "red green. red green. blue pink", "en") for i in range(30)] + [(99, "blue pink " * 3, "de")]
    docs = documents(spark, rows)
    assert {tuple(r) for r in collocations.collocations(docs, 5, top=1).collect()} == brute_phrases(rows, 5, 1)
    assert {r.phrase for r in collocations.collocations(docs, 5, top=None).collect()} == {"red green", "blue pink"}
    assert collocations.collocations(docs.where("false"), 5).count() == 0 and collocations.collocations(docs, 10**6).count() == 0
