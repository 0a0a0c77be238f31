"""Corpus operators against brute force on small tables, with nulls, blanks, repeats and clashing columns."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import jaccard_join, language_id, pii, sentencepieces, toxicity
from tidebook.llm.bytegrams import HashIndex, position_keys
from tidebook.llm.decontaminate import contamination
from tidebook.llm.jaccard_join import jaccard_components
from tidebook.llm.license_scan import known_digests, license_scan
from tidebook.llm.quality_lm import quality_scores
from tidebook.llm.quality_rules import learn, quality_rules, statistics
from tidebook.llm.url_filter import rule_table, url_verdicts

A = " ".join(f"w{i}" for i in range(60))
B = " ".join(f"w{i}" for i in range(58)) + " x y"
C = " ".join(f"v{i}" for i in range(60))
LONG = " ".join(f"u{i % 977}" for i in range(30000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, A), (2, B), (3, C), (4, None), (5, ""), (6, "  \n\t "), (7, A), (7, A), (8, LONG), (9, "one two"), (10, "ONE  two"), (None, C), (11, "é ü ▁ 日本")]
    return spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], "doc_id long, text string, key string, fp string, n int")


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_jaccard_components(spark, docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    n = len({tuple(LONG.split()[i : i + 5]) for i in range(29996)})
    assert {(1, 56, 1), (2, 56, 1), (7, 56, 1), (3, 56, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (8, n, 8), (9, 1, 9), (10, 1, 9), (None, 56, 3), (11, 1, 11)} == got
    assert jaccard_components(docs).count() == 13 and jaccard_components(_empty(spark)).count() == 0


@pytest.mark.parametrize("frequent", [2, 24])
def test_jaccard_components_against_all_pairs(spark, frequent):
    """Groups of near copies, so that prefixes hold frequent tokens; with frequent=2 nearly all go through combinations."""
    rng = np.random.default_rng(5)
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(20, 200)))]
        for _ in range(40):
            t = list(base)
            for i in rng.integers(0, len(t), int(rng.integers(0, 1 + len(t) // 25))):
                t[i] = f"e{rng.integers(1_000_000)}"
            texts.append(" ".join(t))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(df, frequent=frequent).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def _linked(sets, pairs):
    """Smallest place that each set reaches by ``pairs``."""
    root = list(range(len(sets)))
    for _ in sets:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_joining_links_near_the_limit():
    """One group whose members stand on both sides of the limit; the links join exactly what all pairs join."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 150).astype(np.uint64)
    sets = []
    for _ in range(120):
        h = base.copy()
        k = int(rng.integers(8, 32))
        h[rng.choice(150, k, replace=False)] = rng.integers(0, 1 << 62, k).astype(np.uint64)
        sets.append(np.sort(h[: int(rng.integers(120, 151))]))
    similar = [(i, j) for i in range(120) for j in range(i) if jaccard_join._similar(sets[i], sets[j], 75)]
    links = jaccard_join._joining_links(np.arange(120), np.zeros(120, int), sets, 75)
    assert 0 < len(links) < 120 and len(similar) > len(links)
    assert _linked(sets, links) == _linked(sets, similar)
    assert len(set(_linked(sets, links))) > 1
    # Of two blocks, pairs across; equal roots need no link.
    blocks = np.arange(120) % 2
    across = [(i, j) for i, j in similar if blocks[i] != blocks[j]]
    assert _linked(sets, jaccard_join._joining_links(np.arange(120), blocks, sets, 75)) == _linked(sets, across)
    assert jaccard_join._joining_links(np.zeros(120, int), blocks, sets, 75) == []


def test_jaccard_homes_dealt_into_tiles(spark, monkeypatch):
    """The components do not depend on how many tiles a home takes."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        t = list(base)
        for at in rng.choice(100, int(rng.integers(1, 5)), replace=False):
            t[at] = f"e{rng.integers(1_000_000)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in jaccard_components(df).collect()}
    monkeypatch.setattr(jaccard_join, "HOME_BYTES", 1 << 16)
    assert {r.doc_id: r.component_id for r in jaccard_components(df).collect()} == want
    sets = [{tuple(w[i : i + 5]) for i in range(96)} for w in (t.split() for _, t in rows)]
    similar = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert want == dict(enumerate(_linked(sets, similar)))


def test_quality_rules(spark, docs):
    x = "a b c d e\na b c d e\nf # a b c d e $\n\nf # a b c d e $"
    stats = {r.doc_id: r for r in statistics(docs.unionByName(spark.createDataFrame([(20, x, "", "", 0)], docs.schema))).collect()}
    w = x.split()
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    cover = {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(5)}
    assert (stats[20].n_words, stats[20].n_repeat_words, stats[20].n_dup_lines, stats[20].n_symbols) == (len(w), len(cover), 2, 4)
    assert stats[4].n_words == 0 and stats[6].n_lines == 0
    good = [(i, " ".join(f"w{i}{j}" for j in range(40)), 1) for i in range(120)]
    bad = [(200 + i, " ".join(f"W{i}{j} #" for j in range(40)), 0) for i in range(60)]
    df = spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in good + bad], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules(df, labels).collect()}
    assert kept == {r[0]: r[2] == 1 for r in good + bad}
    assert learn(statistics(df), labels.limit(0)).rules == []


def test_license_scan(spark, docs):
    extra = spark.createDataFrame([(1, "Copyright 2020 X\nRELEASED under the MIT Licence"), (2, "text\nLicensed under CC BY-NC 4.0.\nmore")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(extra, known_digests(spark)).collect()}
    assert (got[1].license, got[1].notices) == ("MIT", "MIT") and (got[2].license, got[2].notices) == (None, "CC-BY-NC-4.0")
    assert license_scan(docs, known_digests(spark)).count() == 13


def test_pii(spark):
    texts = ["mail a.b@c-d.example.com_x@y.zz", "ip 1.2.3.45.6.7.8 300.1.1.1 010.0.0.1", "card 4111 1111-1111 1111, 4111111111111112 1 2 3", "call +1 (988) 555-2485. +12 3", "😀 +4111 1111 1111 1111 9", None, "", "9" * 5000, "1 2 " * 3000, "a@b" * 2000, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.candidates(df)
    spans = pii.all_spans(pii.fit(rows))
    got = {r[0]: (r[1], r[2], r[3]) for r in rows.select("doc_id", pii.joined(F.col("pii_base")), pii.joined(spans), pii.masked(F.col("text"), spans)).collect()}
    base = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in base for m in re.finditer(p, t or "") if valid(k, m[0]))
        assert got[i][0] == want, t
    assert got[10][1].startswith("secret:") and got[10][2] == 'token = "<SECRET>"'
    assert got[3][2].startswith("call <PHONE>.") and got[5][2] is None
    assert pii.fit(rows.limit(0)) is None


def test_contamination(spark, docs):
    bench = spark.createDataFrame([(5, " ".join(f"W{i}" for i in range(3, 15))), (12, "one, TWO"), (9, None), (3, "...")], "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, bench).drop("key").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {(1, 60, 12, 1, sha("5"), True), (7, 60, 12, 1, sha("5"), True), (9, 2, 2, 1, sha("12"), True), (10, 2, 2, 1, sha("12"), True), (3, 60, 0, 0, sha(""), False), (4, 0, 0, 0, sha(""), False)} <= got
    assert contamination(docs, bench).count() == 13 and contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://A.net/x", "http://a.example.net/en/1", "http://example.net/en", "https://x.org/fr/?a", "ftp://org/de/", "http://example.com/de/#z", "http://net", "http://net/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rule_table(spark)).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.net", "/x", "net/", "block"), 4: ("a.example.net", "/en/1", "example.net/en/", "allow"), 5: ("example.net", "/en", "net/", "block"),
        6: ("x.org", "/fr/", "org/fr/", "allow"), 7: ("org", "/de/", None, "allow"), 8: ("example.com", "/de/", "example.com/de/", "block"), 9: ("net", "", None, "allow"), 10: ("net", "/", "net/", "block")}


def test_language_id(spark):
    rows = [(i, f"the of and with thing number {i} " * 5, "en") for i in range(20)] + [(50 + i, f"der die das und nicht nummer {i} " * 5, "de") for i in range(20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    probe = spark.createDataFrame([(1, "nicht und die"), (2, "with the thing"), (3, None), (4, "12 34"), (5, ""), (5, "")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(probe, model).orderBy("doc_id").collect()]
    assert got == [(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (5, "und")]
    assert language_id.train(_empty(spark)) is None and language_id.identify(probe, None).count() == 6


def test_ppm_code_length(spark):
    """Two symbols after one context, by hand: method C on order 1."""
    table = language_id.flatten({"x": (np.array([ord("a"), ord("a") << 8 | ord("b"), ord("b") << 8 | ord("a")], np.uint64), np.array([1.0, 3.0, 2.0]))}, 1)
    ab, ac = np.array([ord("a") << 8 | ord("b"), ord("a") << 8 | ord("c")], np.uint64)
    assert table.values(np.array([ab]), 2)[0, 0] == pytest.approx(-np.log2(3 / 4))
    assert table.values(np.array([ac]), 2)[0, 0] == pytest.approx(-np.log2(1 / 4) - np.log2(2 / 8) + 8)


def test_hash_index_and_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64))
    index = HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1 << 50)) == -1).all()
    got = position_keys(np.frombuffer(b"abcd", np.uint8), np.array([0, 3, 3, 4]), 3)
    assert [int(k).to_bytes(3, "big") for k in got] == [b"\0\0a", b"\0ab", b"abc", b"\0\0d"]


def test_quality_lm(spark):
    """Shards add up to the same code lengths, probabilities of a context sum to one, and noise is rejected."""
    rng = np.random.default_rng(3)
    words = ["stone", "river", "cloud", "amber", "north", "table"]
    clean = [(i, " ".join(rng.choice(words, 60)), "en") for i in range(120)]
    noise = [(500 + i, "".join(rng.choice(list("#%&qzxj"), 200)), "en") for i in range(10)]
    df = spark.createDataFrame([*clean, *noise, (900, None, "en"), (901, "", None), (None, "stone river", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    one = {r.doc_id: (r.perplexity, r.kept) for r in quality_scores(df, labels).collect()}
    many = {r.doc_id: (r.perplexity, r.kept) for r in quality_scores(df, labels, shard_rows=40).collect()}
    assert all(not one[500 + i][1] for i in range(10)) and sum(one[i][1] for i in range(120)) >= 117
    assert one[900] == (None, False) and one[901] == (None, False)
    assert all(one[k][0] == pytest.approx(many[k][0], rel=1e-5) for k in range(120))
    assert quality_scores(df, labels.limit(0)).where("kept").count() == 131


def test_quality_limits(spark):
    from collections import Counter

    from tidebook.llm.quality_lm import MAD, squared_counts, trusted_ids

    draw = np.random.default_rng(7)
    texts = [bytes(draw.choice(list(b"ab "), draw.integers(0, 60))) for _ in range(50)]
    keys = np.concatenate([position_keys(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 5) for t in texts])
    got = squared_counts(keys, np.repeat(np.arange(50), [len(t) for t in texts]), 50)
    assert got.tolist() == [sum(c * c for c in Counter((b"\0" * 4 + t)[i : i + 5] for i in range(len(t))).values()) for t in texts]

    words = ["river", "stone", "light", "garden", "winter", "market", "letter", "morning", "silver", "window", "bridge", "people"]
    rows = [(i, " ".join(draw.choice(words, 40)), "en") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    odd = min(r.doc_id for r in trusted_ids(labels).where("held").collect())
    rows[odd] = (odd, "%#@!~^&*" * 40, "en")  # one odd trusted document
    rows += [(900, "river " * 60, "en"), (901, "stone " * 5, "en"), (902, " ".join(rows[1 if odd != 1 else 2][1].split()[::-1]), "en"), (903, "qz vx jk wq " * 30 + "zzx kq vj " * 9, "en")]
    scores = {r.doc_id: r for r in quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert [scores[i].kept for i in (900, 901, 902, 903, odd)] == [False, False, True, False, False]
    x = sorted(np.log2(scores[r.doc_id].perplexity) for r in trusted_ids(labels).where("held").collect())
    low = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    limit = low(x) + 4 * MAD * low([abs(v - low(x)) for v in x])
    assert scores[902].threshold == pytest.approx(2**limit)


def test_toxicity(spark):
    rows = [(i, f"you are a {'scumbag' if i % 2 else 'vermin'} number{i} today") for i in range(40)] + [(100 + i, f"you are a friend number{i} today") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(df, labels)
    probe = spark.createDataFrame([(1, "SCUMBAG!"), (2, "ѕсumb4g"), (3, "a friend"), (4, None), (5, "xscumbagx")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(probe, model).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert toxicity.train(df, labels.limit(0)) is None and toxicity.toxicity(probe, None).count() == 5


def test_sentencepieces(spark, docs):
    vocabulary = sentencepieces.vocabulary()
    encoder, decoder = sentencepieces.Encoder(vocabulary), sentencepieces.Decoder(vocabulary)

    def encode(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return encoder(*sentencepieces._lead(data, np.array([0, len(data)])))[0]

    def decode(ids):
        return decoder(ids, np.array([0, len(ids)]))[0][1:].tobytes().decode()

    pieces = {p: s for p, s, b in vocabulary if b == -1}
    low = min(pieces.values()) - sentencepieces.UNKNOWN

    def optimum(text):
        best = [0.0] + [float("-inf")] * len(text)
        for e in range(1, len(text) + 1):
            best[e] = max([best[s] + pieces[text[s:e]] for s in range(max(0, e - 16), e) if text[s:e] in pieces] + ([] if text[e - 1] in pieces else [best[e - 1] + low]))
        return best[-1]

    for text in ["hello world", "a  b\n\nc", " lead", "straße ünïcode 日本語 😀", "x" * 300, "", "tab\there", "▁"]:
        ids = encode(text)
        assert decode(ids) == text
        if text and "▁" not in text:
            marked = "▁" + text.replace(" ", "▁")
            score = sum(vocabulary[i][1] for i in ids if vocabulary[i][2] == -1) + low * sum(c not in pieces for c in marked)
            assert score == pytest.approx(optimum(marked))
    draw = np.random.default_rng(5)
    parts = ["".join(draw.choice(list("▁abcthein é漢😀\t\0"), draw.integers(1, 40))) or "a" for _ in range(500)]
    ids, sizes = encoder.search_all(parts)
    for part, got in zip(parts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == encoder.search(part).tolist()
    rows = sentencepieces.round_trip(docs)
    assert sentencepieces.decode(sentencepieces.encode(docs)).where("decoded <=> text").count() == 13
    assert rows.where("restored").count() == 13 and rows.where("pieces is null").count() == 1 and set(docs.columns) < set(rows.columns)


def test_pieces_equal_sentencepiece(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    draw = np.random.default_rng(6)
    texts = ["hello world", "a  b\n\nc", "   lead ", "tab\there\r\n", "ﬁ½ straße ünïcode 日本語 😀 a\0b", "x" * 3000, "abab" * 50, "日本国の東京都において" * 30, " ", "\n", LONG, open(__file__).read().replace("▁", "_")]
    texts += ["".join(draw.choice(list("  abctheinrs é漢😀\t\0\n"), draw.integers(1, 300))) for _ in range(300)]
    rows = sentencepieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert r.pieces == sp.encode(r.text), r.text[:80]
    encoder = sentencepieces.MergeEncoder(sentencepieces.vocabulary())
    parts = [p for t in texts[-300:] for p in t.replace(" ", "▁").split("\n") if p]
    ids, sizes = encoder.search_all(parts)
    for part, got in zip(parts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == encoder.search(part).tolist()


def test_pipeline_handles_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(1, A), (2, B), (3, C), (4, None), (7, A), (7, A), (None, C), (20, A.upper() + " a@b.example")]], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, C[:120])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert sorted(r.doc_id for r in stage["n-gram Jaccard join"](spark, table, str(tmp_path)).collect()) == [1, 3, 4]
    assert sorted(r.doc_id or 0 for r in stage["benchmark decontamination"](spark, table, str(tmp_path)).collect()) == [1, 2, 4, 7, 7, 20]
    masked = {r.doc_id: (r.text, r.n_chars) for r in stage["PII"](spark, table, str(tmp_path)).collect()}
    assert masked[20] == (A.upper() + " <EMAIL>", len(A) + 8) and masked[4][0] is None
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:5] == table.columns


def test_near_duplicates_by_row(spark):
    """Repeated and missing ids: the decision belongs to the row, not to its id."""
    import corpus_pipeline

    d = " ".join(f"z{i}" for i in range(60))
    rows = [(1, A), (1, C), (5, A + " tail"), (5, d), (None, d.upper()), (None, LONG), (None, LONG + " end"), (None, LONG.upper()), (6, None), (6, None), (7, "")]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, table, "").collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in got)) == sorted([(1, A), (1, C), (5, d), (0, LONG.upper()), (6, ""), (7, "")])


def test_license_blocks_in_any_wrapping(spark):
    """Every known text of six words or more, re-wrapped, alone and inside other text, against a plain search of words."""
    import re
    import textwrap

    from tidebook.llm.license_scan import known_digests, license_scan
    from tidebook.llm.license_texts import KNOWN

    rows, want = [], {}
    for license_, body in KNOWN:
        for width in (40, 61, 79, 120):
            wrapped = "\n".join(textwrap.wrap(body.upper(), width, break_long_words=False))
            for text in (wrapped, "Copyright (c) 2020 A. Person\n" + wrapped, "Some prose about licence terms.\n\nCopyright 2021 X\n" + wrapped + "\nmore prose"):
                want[len(rows)] = (license_, text == wrapped or text.startswith("Copyright"))
                rows.append((len(rows), text))
    rows.append((len(rows), "Permission is hereby granted, free of charge, to nobody at all under any licence"))
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known_digests(spark)).collect()}
    for i, (license_, whole) in want.items():
        if whole:
            assert got[i].license == license_, rows[i]
        elif len(re.findall(r"\w+", rows[i][1])) > 20:
            assert license_ in got[i].notices.split(","), rows[i]
    assert got[len(rows) - 1].license is None and got[len(rows) - 1].notices == ""


def test_long_and_base64_secrets(spark):
    import random

    from tidebook.llm import pii

    random.seed(1)
    pick = lambda letters, n: "".join(random.choice(letters) for _ in range(n))
    plain = "abcdefghijABCDEFGHIJ0123456789"
    secrets = ["a1" + pick(plain, n) for n in (14, 127, 142, 10_000)] + ["A1z+" + pick(plain + "+/", 40) + "==", "A1z" + pick(plain, 40) + "="]
    docs = spark.createDataFrame([(i, f"token = \"{s}\" and more") for i, s in enumerate(secrets)], "doc_id long, text string")
    rows = pii.candidates(docs).selectExpr("doc_id", "text", "transform(pii_extra, x -> substring(text, x.start + 1, x.end - x.start)) as found").collect()
    assert {r.doc_id: r.found for r in rows} == {i: [s] for i, s in enumerate(secrets)}


def test_toxicity_without_a_lexicon_and_ties(spark):
    from tidebook.llm import toxicity

    docs = spark.createDataFrame([(i, f"word{i} plain text", "x") for i in range(10)] + [(None, None, "x"), (3, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.toxicity(docs, model).collect()
    assert not model.lexicon and len(rows) == 12 and len({r.score for r in rows}) == 1 and 0 <= rows[0].score <= 1
    assert toxicity.toxicity(docs.where("false"), model).count() == 0


def test_toxicity_against_a_plain_search(spark):
    """Scores of long, folded and repeated texts equal a word-by-word search."""
    import math

    from tidebook.llm import toxicity

    lexicon, exceptions = {"scum": 2.0, "patheti*": 1.5}, ["scum pond"]
    score = toxicity.scorer(lexicon, exceptions)
    texts = ["SCUM", "sсum", "5cum!", "pathetic, scum", "scum pond", "the scum pond scum", "empathetic", "pathetically " * 3, "a " * 200_000 + "scum", ""]
    for text in texts:
        seq = text.lower().translate(toxicity.fold_table()).split()
        bare = [w.strip(".,!") for w in seq]
        hits = sum((w == "scum" and bare[i + 1 : i + 2] != ["pond"]) * 2.0 + w.startswith("patheti") * 1.5 for i, w in enumerate(bare))
        assert abs(score(text) - (hits / math.log(math.e + len(seq)) if hits else 0.0)) < 1e-9, text[:40]
