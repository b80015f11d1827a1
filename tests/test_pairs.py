"""Pairs, matching, triples and facts against literals and brute force."""

import random

from conftest import rows
from pyspark.sql import functions as F

from hypograph.operators import evaluation as ev
from hypograph.operators import facts as fc
from hypograph.operators import pairs as pr
from hypograph.plans import pair_queries

MENTIONS = "article_id string, cat string, word string, doc_pos int, para_pos int, sent_pos int"


def test_distance_bounds_are_strict(spark):
    m = spark.createDataFrame(
        [("x", "A", "a", 1000, 0, 0)] + [("x", "B", f"b{d}", 1000 + d, 0, 0) for d in (0, 1, 799, 800, 801)], MENTIONS
    )
    assert rows(pr.cooccurrences(m), "r", "doc_dist") == [("b1", 1), ("b799", 799)]
    assert rows(pr.cooccurrences(m, include_zero=True), "r") == [("b0",), ("b1",), ("b799",)]


def _random_mentions(seed, articles=4, n=60, words=3, reach=3000):
    rng = random.Random(seed)
    out = []
    for a in range(articles):
        for _ in range(n):
            pos = rng.randrange(reach)
            cat = rng.choice("ABC")
            out.append((f"d{a}", cat, f"{cat}{rng.randrange(words)}", pos, pos // 900, pos // 90))
    return out


def _brute(found, combos, threshold, zero=False):
    out = []
    for code, lc, rc in combos:
        for a in found:
            for b in found:
                if a[0] == b[0] and a[1] == lc and b[1] == rc:
                    d = abs(a[3] - b[3])
                    if d < threshold and (zero or d > 0):
                        out.append((a[0], code, a[2], b[2], a[3], b[3], d, abs(a[4] - b[4]), abs(a[5] - b[5])))
    return sorted(out)


def test_blocks_find_every_pair_once(spark):
    found = _random_mentions(1)
    m = spark.createDataFrame(found, MENTIONS)
    cols = ["article_id", "code", "l", "r", "l_pos", "r_pos", "doc_dist", "para_dist", "sent_dist"]
    for threshold in (50, 800, 8000):
        got = rows(pr.cooccurrences(m, threshold=threshold), *cols)
        assert got == _brute(found, (pr.AB, pr.BC, pr.AC), threshold)


def test_one_article_is_spread_over_many_groups(spark):
    """A single article with a third of all mentions still forms blocks of bounded size."""
    found = [("hot", "AB"[i % 2], "ab"[i % 2], i * 10, 0, i) for i in range(3000)]
    found += [(f"c{i}", "A", "a", 0, 0, 0) for i in range(6000)]
    m = spark.createDataFrame(found, MENTIONS)
    out = pr.shortest_pairs(pr.cooccurrences(m, (pr.AB,)))
    assert rows(out, "article_id", "l", "r", "doc_dist", "l_pos") == [("hot", "a", "b", 10, 0)]


def test_shortest_pair_and_ties(spark):
    found = _random_mentions(2)
    m = spark.createDataFrame(found, MENTIONS)
    best = {}
    for p in _brute(found, (pr.AB, pr.BC, pr.AC), 800):
        key = p[:4]
        rank = (1000000 * p[7] + 100000 * p[8] + p[6], p[4], p[5])
        best[key] = min(best.get(key, rank), rank)
    got = rows(pr.shortest_pairs(pr.cooccurrences(m)), "article_id", "code", "l", "r", "uber_dist", "l_pos", "r_pos")
    assert got == sorted((*k, *v) for k, v in best.items())


def _as_mentions(spark, left, right):
    data = [("x", "A", w, p, 0, 0) for w, p in left] + [("x", "B", w, p, 0, 0) for w, p in right]
    return spark.createDataFrame(data, MENTIONS)


def test_equivalence_one_by_one(spark):
    m = _as_mentions(spark, [("LeftWord0", 100)], [("RightWord0", 150)])
    got = rows(pr.equivalence_sets(m, (pr.AB,)), "l", "r", "doc_dist", "l_pos", "r_pos")
    assert got == [("LeftWord0", "RightWord0", 50, 100, 150)]


def test_equivalence_three_by_two(spark):
    m = _as_mentions(
        spark, [("LeftWord0", 100), ("LeftWord0", 150), ("LeftWord1", 150)], [("RightWord0", 115), ("RightWord0", 160)]
    )
    got = rows(pr.equivalence_sets(m, (pr.AB,)), "l", "r", "doc_dist", "l_pos", "r_pos")
    assert got == [
        ("LeftWord0", "RightWord0", 10, 150, 160),
        ("LeftWord0", "RightWord0", 15, 100, 115),
        ("LeftWord1", "RightWord0", 10, 150, 160),
    ]


def test_equivalence_equals_greedy_loop(spark):
    for seed, words, reach in ((3, 2, 2500), (4, 1, 9000), (5, 1, 400)):
        found = _random_mentions(seed, articles=3, n=50, words=words, reach=reach)
        m = spark.createDataFrame(found, MENTIONS)
        combos = (pr.AB, pr.BC, pr.AC, pr.BB)
        groups = {}
        for p in _brute(found, combos, 800, zero=True):
            if p[2] != p[3]:
                groups.setdefault(p[:4], set()).add((p[6], p[4], p[5]))
        # A position repeated by two equal mentions gives the same pair twice; greedy keeps one.
        want = []
        for key, items in groups.items():
            left, right = set(), set()
            for d, lp, rp in sorted(items):
                if lp not in left and rp not in right:
                    left.add(lp)
                    right.add(rp)
                    want.append((*key, d, lp, rp))
        got = rows(pr.equivalence_sets(m, combos), "article_id", "code", "l", "r", "doc_dist", "l_pos", "r_pos")
        assert got == sorted(want)


def test_long_dense_run_is_matched_in_linear_time(spark):
    n = 4000
    m = spark.range(n).selectExpr(
        "'x' article_id", "if(id % 2 = 0, 'A', 'B') cat", "if(id % 2 = 0, 'a', 'b') word",
        "cast(id * 10 as int) doc_pos", "0 para_pos", "0 sent_pos",
    )
    out = pr.equivalence_sets(m, (pr.AB,))
    assert out.count() == n // 2 and out.filter("doc_dist <> 10 or r_pos <> l_pos + 10").count() == 0


def test_triples_and_frequency(spark):
    p = spark.createDataFrame(
        [("1", 1, "a", "b"), ("1", 2, "b", "c"), ("1", 2, "b", "d"), ("2", 1, "a", "b"), ("2", 2, "b", "c"), ("3", 1, "a", "z")],
        "article_id string, code int, l string, r string",
    )
    t = pr.triples(p)
    assert rows(t, "article_id", "a", "b", "c") == [("1", "a", "b", "c"), ("1", "a", "b", "d"), ("2", "a", "b", "c")]
    assert [tuple(r) for r in pr.triple_frequency(t).collect()] == [("a", "b", "c", 2), ("a", "b", "d", 1)]


FACTS = "code int, l string, r string, refs array<string>"


def test_facts_tag_and_refs(spark):
    facts = spark.createDataFrame(
        [(1, "A", "B", ["1", "2", ""]), (3, "a", "b", ["2"]), (2, "b", "c", []), (3, "a", "c", ["9"])], FACTS
    )
    pairs = spark.createDataFrame(
        [("1", 1, "a", "b"), ("1", 2, "b", "c"), ("1", 3, "a", "c"), ("1", 1, "q", "b")],
        "article_id string, code int, l string, r string",
    )
    refs = fc.fact_refs(facts)
    assert rows(refs, "code", "l", "r", "pmid") == [(1, "a", "b", "1"), (1, "a", "b", "2"), (3, "a", "b", "2"), (3, "a", "c", "9")]
    tagged = fc.tag_facts(pairs, facts)
    assert rows(tagged, "l", "r", "fact") == [("a", "b", True), ("a", "c", False), ("b", "c", True), ("q", "b", False)]
    with_ac = fc.tag_facts(pairs, facts, codes=(1, 2, 3))
    assert ("a", "c", True) in rows(with_ac, "l", "r", "fact")
    assert rows(fc.pair_support(pairs, refs), "l", "r", "n_refs", "first_ref") == [("a", "b", 2, "1"), ("a", "c", 1, "9")]
    with_refs = fc.tag_facts(pairs, facts, with_refs=True)
    assert rows(with_refs, "l", "r", "refs") == [("a", "b", ["1", "2"]), ("a", "c", []), ("b", "c", []), ("q", "b", [])]
    assert rows(fc.fact_counts(tagged), "code", "n_predicted", "n_curated") == [(1, 2, 1), (2, 1, 1), (3, 1, 0)]


def test_outcomes(spark):
    found = spark.createDataFrame([("a", "b", "1", 5), ("a", "b", "1", 9), ("a", "x", "1", 3)], "l string, r string, pmid string, doc_dist int")
    refs = spark.createDataFrame([("a", "b", "1"), ("a", "b", "1"), ("c", "d", "2"), ("c", "d", "7")], "l string, r string, pmid string")
    arts = spark.createDataFrame([("1",), ("2",)], "article_id string")
    rel = ev.relevant_facts(refs, arts)
    assert rows(ev.true_positives(found, rel), "r", "doc_dist") == [("b", 5), ("b", 9)]
    assert rows(ev.false_positives(found, rel), "r") == [("x",)]
    assert rows(ev.false_negatives(found, rel), "l", "r", "pmid") == [("c", "d", "2")]
    out = ev.evaluation_set(found, rel)
    assert rows(out, "outcome", "l", "r") == [("FN", "c", "d"), ("FP", "a", "x"), ("TP", "a", "b"), ("TP", "a", "b")]
    assert out.filter("outcome = 'FN'").first()["doc_dist"] is None


def test_training_split_and_targets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("12",), ("13",), ("PMC8",)], "pmid string")
    assert rows(df.withColumn("s", ev.training_split(F.col("pmid"))), "pmid", "s") == [("12", "train"), ("13", "test"), ("PMC8", "test")]
    assert len(ev.TARGET_GENES) == 86 and len(set(ev.TARGET_GENES)) == 86


def test_metrics_agree_with_mllib(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

    rng = random.Random(3)
    data = [(float(rng.random() < 0.3), float(rng.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(data, "label double, prediction double")
    labels = ev.label_metrics(df)
    weighted = ev.weighted_metrics(labels).first()
    for name, column in (("weightedPrecision", "weighted_precision"), ("weightedRecall", "weighted_recall"), ("weightedFMeasure", "weighted_f_measure"), ("weightedFalsePositiveRate", "weighted_fpr")):
        expected = MulticlassClassificationEvaluator(metricName=name, beta=2.0).evaluate(df)
        assert abs(weighted[column] - expected) < 1e-12
    r = ev.regression_metrics(df).first()
    for name, column in (("var", "explained_variance"), ("mae", "mae"), ("mse", "mse"), ("rmse", "rmse"), ("r2", "r2")):
        assert abs(r[column] - RegressionEvaluator(metricName=name).evaluate(df)) < 1e-12


def test_tagging_reads_stored_pairs(spark):
    """Close pairs and facts are made once, whatever measures and counts them afterwards; facts are those of all wide pairs."""
    from hypograph.plans import fixtures as fx
    from hypograph.plans import pair_queries as pq

    d = "/root/testdata/sf0.001"
    close, facts = pq._tagging(spark, d)
    assert close.inputFiles() and all("close-" in f for f in close.inputFiles())
    assert facts.inputFiles() and all("facts-" in f for f in facts.inputFiles())
    wide = fx.wide_pairs(spark, d)
    assert rows(facts, "code", "l", "r", "refs") == rows(fx.facts(spark, d, wide), "code", "l", "r", "refs")
    near = wide.filter((F.col("doc_dist") > 0) & (F.col("doc_dist") < pr.PAIR_THRESHOLD))
    assert rows(close, *close.columns) == rows(pr.shortest_pairs(near), *close.columns)


def test_the_text_is_read_once_for_both_lists(spark):
    """Scores, read-back digests and corpora that several parts of a plan use are stored, not made again for each."""
    from hypograph.plans import catalogue

    d = "/root/testdata/sf0.001"
    for name in ("hypothesis_scores", "roundtrip_json", "bigram_corpus"):
        read = catalogue.QUERIES[name](spark, d).inputFiles()
        assert read and not any(f.endswith(("documents.parquet", ".json")) for f in read), name


def test_chains_are_made_of_the_two_lists_they_need(spark, monkeypatch):
    stored = {}

    def kept(df, name):
        stored[name] = df
        return df

    monkeypatch.setattr(pair_queries, "written", kept)
    for query, name in ((pair_queries.hypotheses, "scored"), (pair_queries.best_hypotheses, "scored"), (pair_queries.ranked_hypotheses, "close")):
        if query is pair_queries.ranked_hypotheses:
            monkeypatch.setattr(pair_queries.rl, "ranked_hypotheses", lambda train, data, n: data)
        query(spark, "/root/testdata/sf0.001")
        assert {r["code"] for r in stored[name].select("code").distinct().collect()} == {1, 2}
