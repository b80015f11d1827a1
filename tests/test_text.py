"""Sentences, coordinates and mentions against literals and brute force."""

import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hypograph.functions import text as tx
from hypograph.functions.arrays import sums_before
from hypograph.operators import mentions as mt
from hypograph.operators import sentences as st

TEXT = [
    "The KCNQ1 gene (p < 0.05) works. It does! Really?  Yes",
    "",
    "Größe of KCNQ1, kcnq1 and kcnq1/x. Type 2 diabetes mellitus, type 2 diabetes",
]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([("a", TEXT), ("b", ["one line only"])], "article_id string, paragraphs array<string>")


@pytest.fixture(scope="module")
def sents(articles):
    return st.sentences(articles).cache()


def test_sentences_concatenate_back_and_offsets_fit(sents):
    got = sorted((r.article_id, r.sent_pos, r.offset, r.para_pos, r.text) for r in sents.collect())
    for article, paragraphs in (("a", TEXT), ("b", ["one line only"])):
        mine = [g for g in got if g[0] == article]
        clean = ["".join(c for c in p if ord(c) < 128).lower() for p in paragraphs]
        joined = "".join(clean)
        assert "".join(m[4] for m in mine) == joined
        assert [m[1] for m in mine] == list(range(len(mine)))
        for _, _, offset, _, text in mine:
            assert joined[offset : offset + len(text)] == text
    assert [g[4] for g in got if g[0] == "a"][:4] == ["the kcnq1 gene (p < 0.05) works. ", "it does! ", "really?  ", "yes"]
    assert {g[3] for g in got if g[0] == "a"} == {0, 2}  # an empty paragraph counts but has no sentence


def test_repeated_tokens_have_their_own_offset(spark, sents):
    vocab = spark.createDataFrame([("B", "kcnq1"), ("B", "kcnq1x")], "cat string, term string")
    found = mt.single_word_mentions(sents, vocab)
    joined = "".join("".join(c for c in p if ord(c) < 128).lower() for p in TEXT)
    second = joined.index("kcnq1,")
    # "kcnq1," keeps its comma and is no match; "kcnq1/x." becomes "kcnq1x".
    assert rows(found, "word", "doc_pos") == [
        ("kcnq1", joined.index("kcnq1")),
        ("kcnq1", joined.index("kcnq1", second + 6)),
        ("kcnq1x", joined.index("kcnq1/x")),
    ]
    stripped = mt.single_word_mentions(sents, vocab, strip_punct=True)
    assert ("kcnq1", second) in rows(stripped, "word", "doc_pos")


def test_overlapping_terms_and_leading_punctuation(spark):
    arts = spark.createDataFrame(
        [("a", ["aa aa aa (aa aa) xaa aa. ab cd, ab cde"])], "article_id string, paragraphs array<string>"
    )
    vocab = spark.createDataFrame([("A", "aa aa"), ("A", "ab cd"), ("A", "(aa aa)")], "cat string, term string")
    found = mt.multi_word_mentions(st.sentences(arts), vocab)
    text = "aa aa aa (aa aa) xaa aa. ab cd, ab cde"
    starts = [i for i in range(len(text)) if text.startswith("aa aa", i) and (i == 0 or not text[i - 1].isalnum())]
    # The token "(aa" is not "aa": its key matches, so the term inside the brackets is found as well.
    expected = [("(aa aa)", text.index("(aa aa)"))] + [("aa aa", i) for i in starts]
    expected += [("ab cd", i) for i in range(len(text)) if text.startswith("ab cd", i)]
    assert rows(found, "word", "doc_pos") == sorted(expected)


def test_large_vocabularies_take_the_shuffle_path_with_the_same_result(spark, sents, monkeypatch):
    vocab = spark.createDataFrame(
        [("B", "kcnq1"), ("C", "type 2"), ("C", "diabetes mellitus, type 2"), ("A", "works")], "cat string, term string"
    )
    small = rows(mt.mentions(sents, vocab), "article_id", "cat", "word", "doc_pos", "para_pos", "sent_pos")
    monkeypatch.setattr(mt, "small_side", lambda df, *a: (df, False))
    large = rows(mt.mentions(sents, vocab), "article_id", "cat", "word", "doc_pos", "para_pos", "sent_pos")
    assert small == large and len(small) == 6


def test_single_word_mentions_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "be.ta", "gam/ma", "delta,", "x"]
    docs = [(str(i), [" ".join(rng.choices(words, k=rng.randint(0, 30))) + ". end" for _ in range(3)]) for i in range(20)]
    vocab = [("A", "alpha"), ("B", "beta"), ("C", "gamma"), ("C", "alpha")]
    arts = spark.createDataFrame(docs, "article_id string, paragraphs array<string>")
    found = mt.single_word_mentions(st.sentences(arts), spark.createDataFrame(vocab, "cat string, term string"))
    want = []
    for doc, paragraphs in docs:
        at = 0
        for paragraph in paragraphs:
            pos = 0
            for token in paragraph.split(" "):
                bare = token.replace(".", "").replace("/", "")
                want += [(doc, cat, bare, at + pos) for cat, term in vocab if term == bare]
                pos += len(token) + 1
            at += len(paragraph)
    assert rows(found, "article_id", "cat", "word", "doc_pos") == sorted(want)


def test_padded_mentions_first_hit_only(spark):
    arts = spark.createDataFrame([("a", ["see p53 and p53 of mdm2. p53"])], "article_id string, paragraphs array<string>")
    vocab = spark.createDataFrame([("A", "p53"), ("A", "of"), ("A", "mdm2"), ("A", "p53 of")], "cat string, term string")
    found = mt.padded_mentions(st.sentences(arts), vocab)
    text = "see p53 and p53 of mdm2. p53"
    assert rows(found, "word", "doc_pos") == sorted(
        [("p53", text.index(" p53 ")), ("mdm2", text.index(" mdm2")), ("p53 of", text.index("p53 of"))]
    )


def test_noise_pattern(spark):
    words = ["(3) word", "3.1 fold", "7", "= x", "n = 4", "see doi: 10", "kinase"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert [r.word for r in mt.drop_noise(df).orderBy("word").collect()] == ["7", "kinase"]


def test_concept_ids_default(spark):
    found = spark.createDataFrame([("a-b 1",), ("zz",)], "word string")
    dictionary = spark.createDataFrame([("ab1", "D1")], "key string, concept_id string")
    assert rows(mt.concept_ids(found, dictionary), "word", "concept_id") == [("a-b 1", "D1"), ("zz", "-1")]


def test_phrases_are_merged_from_the_left(spark):
    corpus = spark.createDataFrame([(1, ["a", "b", "a", "b", "b"]), (2, ["x"])], "k int, tokens array<string>")
    phrases = spark.createDataFrame([("a", "b"), ("b", "a")], "w1 string, w2 string")
    out = {r.k: r.tokens for r in mt.join_phrases(corpus, phrases, ["k"]).collect()}
    assert out == {1: ["a_b", "a_b", "b"], 2: ["x"]}


def test_token_offset_and_strip(spark):
    df = spark.createDataFrame([("ab  cd\te\nf",), ("",)], "s string")
    lengths = F.transform(tx.word_split(F.col("s")), lambda w: F.length(w) + 1)
    assert [r[0] for r in df.select(sums_before(lengths)).collect()] == [[0, 3, 4, 7, 9], [0]]


def test_running_sums_restart_in_every_row(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([],), ([5],), ([1, 1],)], "x array<int>").repartition(1)
    assert sorted(r[0] for r in df.select(sums_before("x")).collect()) == [[], [0], [0, 1], [0, 3, 4]]


def test_forty_thousand_sentences_in_one_paragraph(spark):
    text = "word alpha. " * 40_000
    arts = spark.createDataFrame([("a", [text])], "article_id string, paragraphs array<string>")
    found = mt.single_word_mentions(st.sentences(arts), spark.createDataFrame([("A", "alpha")], "cat string, term string"))
    assert found.agg(F.count("*"), F.max("doc_pos"), F.max("sent_pos")).first() == (40_000, 12 * 39_999 + 5, 39_999)


ODD = "protein kinase c at first,\n(protein kinase c) and\nprotein\tkinase\nc; xprotein kinase c ( foo bar) foo\nbar (foo bar"


@pytest.mark.parametrize("large", [False, True])
def test_terms_behind_line_ends_and_punctuation(spark, large, monkeypatch):
    """Every place where the text has the term and only punctuation stands between it and white space before."""
    import re

    from hypograph.operators import sizing

    if large:
        monkeypatch.setattr(mt, "small_side", lambda df, *a: (df, False))
        monkeypatch.setattr(sizing, "small_side", lambda df, *a: (df, False))
    arts = spark.createDataFrame([("a", [ODD])], "article_id string, paragraphs array<string>")
    terms = [("A", "protein kinase c"), ("B", "( foo bar"), ("B", "foo bar"), ("C", "foo"), ("C", "(foo bar"), ("C", "!!! ?")]
    vocab = spark.createDataFrame(terms, "cat string, term string")
    flat = re.sub(r"\s", " ", ODD)
    want = []
    for cat, term in terms:
        if " " in term:
            lead = len(term) - len(term.lstrip("( "))
            starts = [m.start() for m in re.finditer(f"(?={re.escape(term)})", flat)]
            want += [(cat, term, at) for at in starts if re.search(r"(^| )[^\w ]*$", flat[: at + lead]) and term != "!!! ?"]
    want += [("C", "foo", m.start()) for m in re.finditer(r"(?<![^ ])foo(?![^ ])", flat)]
    assert rows(mt.mentions(st.sentences(arts), vocab), "cat", "word", "doc_pos") == sorted(want)
    assert ("A", "protein kinase c", 0) in want and sum(w[1] == "protein kinase c" for w in want) == 3


def test_padded_mentions_meet_terms_behind_line_ends(spark):
    arts = spark.createDataFrame([("a", ["x\nprotein kinase c", "see (protein kinase c) p53\tand"])], "article_id string, paragraphs array<string>")
    vocab = spark.createDataFrame([("A", "protein kinase c"), ("B", "p53")], "cat string, term string")
    found = rows(mt.padded_mentions(st.sentences(arts), vocab), "word", "doc_pos", "para_pos")
    assert found == [("p53", 18 + 22, 1), ("protein kinase c", 2, 0), ("protein kinase c", 18 + 5, 1)]


def test_mentions_need_one_step_outside_the_engine(spark, sents):
    """One running sum per article: every further Python step would be one more worker beside each task."""
    vocab = spark.createDataFrame([("A", "type 2 diabetes"), ("B", "kcnq1")], "cat string, term string")
    text = spark.createDataFrame([("a", TEXT), ("n", None), ("m", ["x kcnq1.", None, "so\tkcnq1"])], "article_id string, paragraphs array<string>")
    found = mt.mentions(st.sentences(text), vocab)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert rows(found.filter("article_id = 'm'"), "word", "doc_pos", "para_pos", "sent_pos") == [("kcnq1", 2, 0, 0), ("kcnq1", 11, 2, 1)]


def test_a_word_is_counted_with_its_follower_only(spark, monkeypatch):
    """Counts of words come from those of pairs: one row per word of the text is grouped, not two."""
    sentences = [["a", "b", "", "a", "b"], ["b"], [], None, ["a", "b", "a", "c"], ["c", "", ""]]
    stored = {}

    def kept(df, name):
        stored[name] = df
        return df

    monkeypatch.setattr(mt, "written", kept)
    toks = spark.createDataFrame([(s,) for s in sentences], "tokens array<string>")
    got = {(r["w1"], r["w2"]): tuple(r)[2:] for r in mt.phrase_scores(toks, min_count=1, threshold=-1.0).collect()}
    words = [[t for t in s or [] if t] for s in sentences]
    n = Counter(t for s in words for t in s)
    n12 = Counter(p for s in words for p in zip(s, s[1:]))
    assert got == {p: (k, n[p[0]], n[p[1]], (k - 1) * len(n) / (n[p[0]] * n[p[1]])) for p, k in n12.items()}
    assert sum(r["n"] for r in stored["grams"].collect()) == sum(n.values())
