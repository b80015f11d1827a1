"""Queries on pairs, facts, outcomes, triples and hypotheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.measures import composite_distance
from ..operators import evaluation as ev
from ..operators import facts as fc
from ..operators import pairs as pr
from ..operators import relevance as rl
from ..operators.sizing import written
from ..sources.articles import sample_rows
from . import fixtures as fx
from .fixtures import with_cte


def pairs_raw(spark, d):
    return pr.cooccurrences(fx.found(spark, d))


def pairs_shortest(spark, d):
    return fx.close_pairs(spark, d)


def pairs_flat(spark, d):
    """The lists in one table, as counts per article and list."""
    p = fx.close_pairs(spark, d)
    p = p.withColumn("again", composite_distance(F.col("para_dist"), F.col("sent_dist"), F.col("doc_dist")))
    return p.groupBy("article_id", "code").agg(
        F.count("*").alias("n"), F.min("uber_dist").alias("closest"), F.max("again").alias("farthest")
    )


def pairs_wide(spark, d):
    """Wide window with distance zero, summed up per article and terms."""
    p = pr.kinase_pairs(fx.found(spark, d))
    return p.groupBy("article_id", "l", "r").agg(
        F.count("*").alias("n"), F.min("doc_dist").alias("closest"), F.max("doc_dist").alias("farthest")
    )


def pairs_sorted(spark, d):
    """Rank of every pair by distance inside its group."""
    from pyspark.sql import Window

    w = Window.partitionBy("article_id", "code", "l", "r").orderBy("doc_dist", "l_pos", "r_pos")
    p = pr.cooccurrences(fx.found(spark, d))
    return p.select("article_id", "code", "l", "r", "l_pos", "r_pos", "doc_dist", F.row_number().over(w).alias("rank"))


def equivalence_sets(spark, d):
    return pr.equivalence_sets(fx.found(spark, d), (pr.AB, pr.BC, pr.AC, pr.BB))


def gene_pairs_unordered(spark, d):
    p = pr.unordered(pr.equivalence_sets(fx.found(spark, d), (pr.BB,)))
    return p.groupBy("l", "r").agg(F.count("*").alias("n"), F.countDistinct("article_id").alias("n_articles"))


def distance_unpivot(spark, d):
    return pr.unpivot_distances(fx.close_pairs(spark, d), ["article_id", "code", "l", "r"])


def triples(spark, d):
    return pr.triples(fx.close_pairs(spark, d))


def triple_frequency(spark, d):
    return pr.triple_frequency(pr.triples(fx.close_pairs(spark, d)))


def _facts(spark, d):
    return fx.facts(spark, d, fx.wide_pairs(spark, d))


def fact_refs(spark, d):
    return fc.fact_refs(_facts(spark, d))


#: The lists that chains are made of.
_CHAINED = (pr.AB, pr.BC)


def _tagging(spark, d, combos=(pr.AB, pr.BC, pr.AC)):
    """Close pairs of the lists ``combos``, and facts, from one reading of the text; both are written, since joins
    measure and count them first."""
    hits = written(fx.found(spark, d), "mentions")
    close = pr.shortest_pairs(pr.cooccurrences(hits, combos, distinct_words=True))
    return written(close, "close"), written(fx.facts_of(spark, d, hits), "facts")


def pairs_known(spark, d):
    return fc.known_pairs(*_tagging(spark, d))


def pairs_tagged(spark, d):
    return fc.tag_facts(*_tagging(spark, d))


def pair_support(spark, d):
    close, facts = _tagging(spark, d)
    pairs = close.select("article_id", "l", "r").distinct()
    return fc.pair_support(pairs, fc.fact_refs(facts))


def fact_counts(spark, d):
    return fc.fact_counts(fc.tag_facts(*_tagging(spark, d)))


_GUESS = ["pmid", "code", "l", "r", "l_pos", "r_pos", "doc_dist"]


def _outcome_inputs(spark, d):
    wide = fx.wide_pairs(spark, d, shared=True)
    found = ev.guesses(fx.equivalence_guesses(wide))
    articles = fx.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"))
    relevant = ev.relevant_facts(fc.fact_refs(fx.facts(spark, d, wide)), articles)
    return found, relevant


def relevant_facts(spark, d):
    """Facts whose reference is an article of every second month."""
    articles = fx.articles(spark, d).filter(F.month("pub_date") % 2 == 0)
    return ev.relevant_facts(fc.fact_refs(_facts(spark, d)), articles)


def true_positive(spark, d):
    return ev.true_positives(*_outcome_inputs(spark, d)).select(*_GUESS)


def false_positive(spark, d):
    return ev.false_positives(*_outcome_inputs(spark, d)).select(*_GUESS)


def false_negative(spark, d):
    return ev.false_negatives(*_outcome_inputs(spark, d))


def evaluation_set(spark, d):
    out = ev.evaluation_set(*_outcome_inputs(spark, d))
    missing = F.lit(-1)
    return out.select("pmid", "l", "r", "outcome", *[F.coalesce(c, missing).alias(c) for c in ("code", "l_pos", "r_pos", "doc_dist")])


def train_test(spark, d):
    out = ev.evaluation_set(*_outcome_inputs(spark, d))
    pmid = F.when(F.col("pmid").cast("int") % 9 == 0, F.concat(F.lit("PMC"), "pmid")).otherwise(F.col("pmid"))
    return out.groupBy(ev.training_split(pmid).alias("split"), "outcome").agg(F.count("*").alias("n"))


def earliest_confirmation(spark, d):
    wide = fx.wide_pairs(spark, d, shared=True)
    found = ev.guesses(fx.equivalence_guesses(wide))
    refs = fc.fact_refs(fx.facts(spark, d, wide))
    dates = fx.pmid_dates(spark, d)
    relevant = refs.select("l", "r", "pmid").distinct()
    out = ev.earliest_confirmation(ev.true_positives(found, relevant), refs, dates, dates)
    return out.select("pmid", "code", "l", "r", "l_pos", "r_pos", "time_until_verified")


def special_interest(spark, d):
    """Whether a term of the pair is on the list of targets: here the terms of eight letters that are found."""
    close = fx.close_pairs(spark, d)
    named = fx.vocab(spark, d).filter("length(term) = 8 or term like 'th%'").select("term")
    targets = named.unionByName(spark.createDataFrame([(x,) for x in ev.TARGET_GENES], "term string"))
    return ev.mark_special_interest(close, targets).select("article_id", "code", "l", "r", "special")


def sampled_pairs(spark, d):
    """All pairs of a tenth of the articles, chosen by a digest of their id."""
    return sample_rows(fx.close_pairs(spark, d), 0.1).select("article_id", "code", "l", "r", "doc_dist")


def pair_export(spark, d):
    """Closest pairs in the export layout with a display key."""
    from ..sources.tables import pair_csv_rows

    p = fx.close_pairs(spark, d).withColumn("pmid", F.col("article_id").cast("string"))
    p = p.join(fx.pmid_dates(spark, d), "pmid").withColumn("fact", F.col("code") == 1)
    p = p.withColumn("time_until_verified", F.lit(None).cast("bigint")).withColumn("freq_sec_deriv", F.lit(None).cast("double"))
    rows = pair_csv_rows(p).withColumn("pair_key", F.concat_ws("@", "l", "r"))
    return rows.drop("time_until_verified", "freq_sec_deriv")


def pair_ids(spark, d):
    """Pairs found again by their row ids, which are made of the identifying columns alone."""
    p = fx.close_pairs(spark, d).select("article_id", "code", "l", "r")
    stored = written(p.withColumn("id", pr.pair_id()), "ids")
    again = p.repartition(3, "r").withColumn("id", pr.pair_id())
    return stored.join(again.select("id", F.col("l").alias("l2"), F.col("r").alias("r2")), "id").select("article_id", "code", "l", "r", "l2", "r2")


def pairs_by_key(spark, d):
    """All mentions of a pair key summed up, without gathering them."""
    from ..operators.timeline import key_profiles

    p = fx.close_pairs(spark, d).withColumn("pmid", F.col("article_id").cast("string"))
    dated = p.join(fx.pmid_dates(spark, d), "pmid").withColumn("fact", F.col("doc_dist") < 100)
    return key_profiles(dated, ["l", "r"], ts="pub_ts")


def distance_boxplot(spark, d):
    from ..operators.timeline import distance_distribution

    tagged = fc.tag_facts(*_tagging(spark, d))
    out = distance_distribution(tagged)
    return out.select("fact", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("fact", "n")])


def hypothesis_scores(spark, d):
    """A-B and B-C scores joined on B; the score of a pair falls with its closest distance."""
    close = fx.close_pairs(spark, d, _CHAINED)
    best = close.groupBy("code", "l", "r").agg((1 / (1 + F.min("doc_dist"))).alias("p"))
    best = written(best, "best")  # both lists, and the counts before their join, are read from it instead of the text
    out = rl.hypotheses(best.filter("code = 1"), best.filter("code = 2"))
    return out.select("a", "b", "c", F.round("score", 9).alias("score"))


def relevance_model(spark, d):
    """One model per list. Where a fit with intercept has converged, the probabilities of its training pairs sum
    up to the number of facts, also when weighted with the feature."""
    tagged = fc.tag_facts(*_tagging(spark, d)).filter(F.col("code").isin(1, 2))
    data = written(rl.labelled(tagged), "labelled")
    sums = None
    for code in (1, 2):
        own = data.filter(F.col("code") == code)
        scored = rl.score(rl.fit_relevance(own, ["doc_dist"], max_iter=500, tolerance=1e-12), own)
        part = scored.agg(
            F.lit(code).alias("code"),
            F.count("*").alias("n"),
            F.round(F.sum("p"), 1).alias("sum_p"),
            F.round(F.sum(F.col("p") * F.col("doc_dist")) / 1000, 1).alias("sum_p_dist"),
        )
        sums = part if sums is None else sums.unionByName(part)
    return sums


def hypotheses(spark, d):
    """Chains of scored pairs through a model whose coefficients are given: p = 1 / (1 + exp(0.01 * distance - 2))."""
    close = fx.close_pairs(spark, d, _CHAINED).withColumn("p", 1 / (1 + F.exp(F.lit(0.01) * F.col("doc_dist") - 2)))
    stored = written(close, "scored")
    out = rl.hypotheses(rl.pair_scores(stored, 1), rl.pair_scores(stored, 2))
    return out.select("a", "b", "c", F.round("score", 9).alias("score"))


def best_hypotheses(spark, d):
    """The hundred best chains of the same scores, without making the others."""
    close = fx.close_pairs(spark, d, _CHAINED).withColumn("p", 1 / (1 + F.exp(F.lit(0.01) * F.col("doc_dist") - 2)))
    stored = written(close, "scored")
    out = rl.best_hypotheses(rl.pair_scores(stored, 1), rl.pair_scores(stored, 2), 100)
    return out.select("a", "b", "c", F.round("score", 9).alias("score"))


def ranked_hypotheses(spark, d):
    """Models fitted on the known facts of four fifths of the pairs, all pairs scored, the hundred best chains."""
    tagged = fc.tag_facts(*_tagging(spark, d, _CHAINED))
    data = written(tagged, "tagged")
    train, _ = rl.split_80_20(data)
    return rl.ranked_hypotheses(train, data, n=100)


def pairs_tagged_refs(spark, d):
    """All references of the facts that closest pairs turn out to be, as one sorted list."""
    tagged = fc.tag_facts(*_tagging(spark, d), with_refs=True)
    return tagged.select("article_id", "code", "l", "r", "fact", F.array_join("refs", ",").alias("refs"))


QUERIES = {
    f.__name__: f
    for f in (
        pairs_raw,
        pairs_shortest,
        pairs_flat,
        pairs_wide,
        pairs_sorted,
        equivalence_sets,
        gene_pairs_unordered,
        distance_unpivot,
        triples,
        triple_frequency,
        fact_refs,
        pairs_known,
        pairs_tagged,
        pairs_tagged_refs,
        pair_support,
        fact_counts,
        relevant_facts,
        true_positive,
        false_positive,
        false_negative,
        evaluation_set,
        train_test,
        earliest_confirmation,
        special_interest,
        sampled_pairs,
        pair_export,
        pair_ids,
        pairs_by_key,
        distance_boxplot,
        hypothesis_scores,
        relevance_model,
        hypotheses,
        best_hypotheses,
        ranked_hypotheses,
    )
}

_TRIPLES = """SELECT DISTINCT ab.article_id, ab.l AS a, ab.r AS b, bc.r AS c FROM pairs ab JOIN pairs bc
ON bc.article_id = ab.article_id AND ab.code = 1 AND bc.code = 2 AND bc.l = ab.r"""
_KEYS = "(SELECT l, r, count(*) AS n_facts FROM facts GROUP BY l, r)"
_TAGGED = f"""(SELECT p.*, (n_facts IS NOT NULL AND code IN (1, 2)) AS fact FROM pairs p LEFT JOIN {_KEYS} k ON k.l = p.l AND k.r = p.r)"""
# Four lists for the matching, the fourth within one category.
_FOUR = "SELECT * FROM (VALUES (1, 'A', 'B'), (2, 'B', 'C'), (3, 'A', 'C'), (4, 'B', 'B')) t(code, lc, rc)"
_THREE = "SELECT * FROM (VALUES (1, 'A', 'B'), (2, 'B', 'C'), (3, 'A', 'C')) t(code, lc, rc)"
_EVAL = """(SELECT coalesce(g.pmid, f.pmid) AS pmid, coalesce(g.l, f.l) AS l, coalesce(g.r, f.r) AS r, g.code, g.l_pos, g.r_pos, g.doc_dist,
CASE WHEN g.pmid IS NULL THEN 'FN' WHEN f.pmid IS NULL THEN 'FP' ELSE 'TP' END AS outcome
FROM guesses g FULL OUTER JOIN relevant f ON f.l = g.l AND f.r = g.r AND f.pmid = g.pmid)"""
_EPOCH = "CAST(epoch(DATE '2010-01-01' + CAST(CAST({0} AS BIGINT) % 3650 AS INTEGER)) AS BIGINT)"
_DISTS = [
    f"round(quantile_cont({c}_dist, {q}), 6) AS {c}_dist_{n}"
    for c in ("doc", "para", "sent")
    for q, n in ((0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "high"))
]

ORACLE = {
    "pairs_raw": with_cte("near", "SELECT * FROM near"),
    "pairs_shortest": with_cte(
        "pairs", "SELECT article_id, code, l, r, uber_dist, l_pos, r_pos, doc_dist, para_dist, sent_dist FROM pairs"
    ),
    "pairs_flat": with_cte(
        "pairs", "SELECT article_id, code, count(*) AS n, min(uber_dist) AS closest, max(uber_dist) AS farthest FROM pairs GROUP BY ALL"
    ),
    "pairs_wide": with_cte(
        "raw_pairs",
        """SELECT article_id, l, r, count(*) AS n, min(doc_dist) AS closest, max(doc_dist) AS farthest
        FROM raw_pairs WHERE code = 1 GROUP BY ALL""",
    ),
    "pairs_sorted": with_cte(
        "near",
        """SELECT article_id, code, l, r, l_pos, r_pos, doc_dist,
        row_number() OVER (PARTITION BY article_id, code, l, r ORDER BY doc_dist, l_pos, r_pos) AS rank FROM near""",
    ),
    "equivalence_sets": with_cte(
        "guesses",
        "SELECT article_id, code, l, r, doc_dist, l_pos, r_pos, para_dist, sent_dist, uber_dist FROM guesses",
    ).replace(_THREE, _FOUR),
    "gene_pairs_unordered": with_cte(
        "guesses",
        """SELECT l, r, count(*) AS n, count(DISTINCT article_id) AS n_articles FROM guesses WHERE code = 4 AND l < r GROUP BY l, r""",
    ).replace(_THREE, _FOUR),
    "distance_unpivot": with_cte(
        "pairs",
        """SELECT article_id, code, l, r, 'doc' AS kind, doc_dist AS value FROM pairs
        UNION ALL SELECT article_id, code, l, r, 'sent', sent_dist FROM pairs
        UNION ALL SELECT article_id, code, l, r, 'para', para_dist FROM pairs""",
    ),
    "triples": with_cte("pairs", _TRIPLES),
    "triple_frequency": with_cte("pairs", f"SELECT a, b, c, count(*) AS n_articles FROM ({_TRIPLES}) GROUP BY a, b, c"),
    "fact_refs": with_cte("facts", "SELECT code, l, r, pmid FROM facts"),
    "pairs_known": with_cte(
        "pairs facts",
        f"""SELECT p.article_id, p.code, p.l, p.r, uber_dist, l_pos, r_pos, doc_dist, para_dist, sent_dist, n_facts
        FROM pairs p JOIN {_KEYS} k ON k.l = p.l AND k.r = p.r""",
    ),
    "pairs_tagged": with_cte(
        "pairs facts",
        f"SELECT article_id, code, l, r, uber_dist, l_pos, r_pos, doc_dist, para_dist, sent_dist, fact FROM {_TAGGED}",
    ),
    "pair_support": with_cte(
        "pairs facts",
        """SELECT p.article_id, p.l, p.r, count(*) AS n_refs, min(pmid) AS first_ref FROM (SELECT DISTINCT article_id, l, r FROM pairs) p
        JOIN (SELECT DISTINCT l, r, pmid FROM facts) f ON f.l = p.l AND f.r = p.r GROUP BY ALL""",
    ),
    "fact_counts": with_cte(
        "pairs facts",
        f"SELECT code, count(*) AS n_predicted, count(*) FILTER (fact) AS n_curated FROM {_TAGGED} GROUP BY code",
    ),
    "relevant_facts": with_cte(
        "facts",
        """SELECT DISTINCT l, r, pmid FROM facts
        WHERE month(DATE '2010-01-01' + CAST(CAST(pmid AS BIGINT) % 3650 AS INTEGER)) % 2 = 0""",
    ),
    "true_positive": with_cte(
        "guesses relevant",
        "SELECT pmid, code, l, r, l_pos, r_pos, doc_dist FROM guesses g WHERE EXISTS (FROM relevant f WHERE f.l = g.l AND f.r = g.r AND f.pmid = g.pmid)",
    ),
    "false_positive": with_cte(
        "guesses relevant",
        "SELECT pmid, code, l, r, l_pos, r_pos, doc_dist FROM guesses g WHERE NOT EXISTS (FROM relevant f WHERE f.l = g.l AND f.r = g.r AND f.pmid = g.pmid)",
    ),
    "false_negative": with_cte(
        "guesses relevant",
        "SELECT l, r, pmid FROM relevant f WHERE NOT EXISTS (FROM guesses g WHERE f.l = g.l AND f.r = g.r AND f.pmid = g.pmid)",
    ),
    "evaluation_set": with_cte(
        "guesses relevant",
        f"""SELECT pmid, l, r, outcome, coalesce(code, -1) AS code, coalesce(l_pos, -1) AS l_pos, coalesce(r_pos, -1) AS r_pos,
        coalesce(doc_dist, -1) AS doc_dist FROM {_EVAL}""",
    ),
    "train_test": with_cte(
        "guesses relevant",
        f"""SELECT CASE WHEN CAST(pmid AS BIGINT) % 9 <> 0 AND CAST(pmid AS BIGINT) % 2 = 0 THEN 'train' ELSE 'test' END AS split,
        outcome, count(*) AS n FROM {_EVAL} GROUP BY ALL""",
    ),
    "earliest_confirmation": with_cte(
        "guesses facts",
        f"""SELECT pmid, code, g.l, g.r, l_pos, r_pos, first_ts - {_EPOCH.format('pmid')} AS time_until_verified FROM guesses g
        JOIN (SELECT l, r, min({_EPOCH.format('pmid')}) AS first_ts FROM facts GROUP BY l, r) f ON f.l = g.l AND f.r = g.r
        WHERE EXISTS (FROM facts x WHERE x.l = g.l AND x.r = g.r AND x.pmid = g.pmid)""",
    ),
    "special_interest": with_cte(
        "pairs vocab",
        """SELECT article_id, code, l, r, (length(l) = 8 OR length(r) = 8 OR l LIKE 'th%' OR r LIKE 'th%') AS special FROM pairs""",
    ),
    "sampled_pairs": with_cte(
        "pairs",
        """SELECT article_id, code, l, r, doc_dist FROM pairs
        WHERE CAST('0x' || substr(md5('1234:' || article_id), 1, 8) AS BIGINT) < CAST(floor(0.1 * 4294967296) AS BIGINT)""",
    ),
    "pair_export": with_cte(
        "pairs",
        f"""SELECT CAST(article_id AS VARCHAR) AS pmid, {_EPOCH.format('article_id')} AS pub_ts,
        strftime(DATE '2010-01-01' + CAST(article_id % 3650 AS INTEGER), '%d-%m-%Y') AS date_text, l, r, para_dist, sent_dist, doc_dist,
        code = 1 AS fact, l || '@' || r AS pair_key FROM pairs""",
    ),
    "pair_ids": with_cte("pairs", "SELECT article_id, code, l, r, l AS l2, r AS r2 FROM pairs"),
    "pairs_by_key": with_cte(
        "pairs",
        f"""SELECT l, r, count(*) AS n, min({_EPOCH.format('article_id')}) AS first_ts, max({_EPOCH.format('article_id')}) AS last_ts,
        bool_or(doc_dist < 100) AS any_fact FROM pairs GROUP BY l, r""",
    ),
    "distance_boxplot": with_cte(
        "pairs facts", f"SELECT fact, count(*) AS n, {', '.join(_DISTS)} FROM {_TAGGED} GROUP BY fact"
    ),
    "pairs_tagged_refs": with_cte(
        "pairs facts",
        """, k AS (SELECT l, r, string_agg(DISTINCT pmid, ',' ORDER BY pmid) AS refs FROM facts GROUP BY l, r)
        SELECT article_id, code, p.l, p.r, k.refs IS NOT NULL AND code IN (1, 2) AS fact, CASE WHEN code IN (1, 2) THEN coalesce(refs, '') ELSE '' END AS refs
        FROM pairs p LEFT JOIN k ON k.l = p.l AND k.r = p.r""",
    ),
    "relevance_model": with_cte(
        "pairs facts",
        f"""SELECT code, count(*) AS n, round(CAST(count(*) FILTER (fact) AS DOUBLE), 1) AS sum_p,
        round(coalesce(sum(doc_dist) FILTER (fact), 0) / 1000, 1) AS sum_p_dist FROM {_TAGGED} WHERE code IN (1, 2) GROUP BY code""",
    ),
    "hypotheses": with_cte(
        "pairs",
        """, best AS (SELECT code, l, r, 1 / (1 + exp(0.01 * min(doc_dist) - 2)) AS p FROM pairs WHERE code IN (1, 2) GROUP BY code, l, r)
        SELECT ab.l AS a, ab.r AS b, bc.r AS c, round(ab.p * bc.p, 9) AS score FROM best ab JOIN best bc
        ON ab.code = 1 AND bc.code = 2 AND bc.l = ab.r""",
    ),
    "best_hypotheses": with_cte(
        "pairs",
        """, best AS (SELECT code, l, r, 1 / (1 + exp(0.01 * min(doc_dist) - 2)) AS p FROM pairs WHERE code IN (1, 2) GROUP BY code, l, r)
        SELECT ab.l AS a, ab.r AS b, bc.r AS c, round(ab.p * bc.p, 9) AS score FROM best ab JOIN best bc
        ON ab.code = 1 AND bc.code = 2 AND bc.l = ab.r ORDER BY ab.p * bc.p DESC, ab.p DESC, bc.p DESC, ab.l, ab.r, bc.r LIMIT 100""",
    ),
    "hypothesis_scores": with_cte(
        "pairs",
        """, best AS (SELECT code, l, r, 1 / (1 + min(doc_dist)) AS p FROM pairs WHERE code IN (1, 2) GROUP BY code, l, r)
        SELECT ab.l AS a, ab.r AS b, bc.r AS c, round(ab.p * bc.p, 9) AS score FROM best ab JOIN best bc
        ON ab.code = 1 AND bc.code = 2 AND bc.l = ab.r""",
    ),
}
