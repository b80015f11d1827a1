"""Composite jobs: chains of operators from sources to sinks.

Each job reads its text once. Where several results follow from one table, that table is written to the
shared scratch folder and read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds, parse_date
from ..operators import citations as ct
from ..operators import embeddings as em
from ..operators import evaluation as ev
from ..operators import facts as fc
from ..operators import graph as gr
from ..operators import interactions as ia
from ..operators import mentions as mt
from ..operators import pairs as pr
from ..operators import relevance as rl
from ..operators import timeline as tl
from ..operators import vocab as vc
from ..operators.sentences import sentences, token_corpus
from ..operators.sizing import written
from ..sources import articles as sa
from ..sources import records as sr
from ..sources import tables as sb


@dataclass(frozen=True)
class JobOptions:
    """Options shared by the jobs."""

    threshold: int = pr.PAIR_THRESHOLD
    strip_punct: bool = False
    sample: float = 1.0
    slices: int = 1
    slice_number: int = 0
    fact_codes: tuple[int, ...] = (1, 2)


def load_facts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The curated tables (kind -> path) in one table; ``pathway`` is the tab-separated gene-gene table."""
    parts = [
        sb.read_pathways(spark, path) if kind == "pathway" else sb.read_facts(spark, path, kind)
        for kind, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def build_vocabulary(spark: SparkSession, thesaurus: str | None, facts: DataFrame) -> DataFrame:
    """Thesaurus terms by branch, proteins without disease names, extended by the terms of the facts."""
    if thesaurus:
        base = vc.subtract_category(vc.classify_trees(sr.read_thesaurus(spark, thesaurus)))
    else:
        base = spark.createDataFrame([], "cat string, term string")
    return vc.extend_vocabulary(base, facts)


@dataclass(frozen=True)
class ArticleTables:
    """Flat results of the article job."""

    articles: DataFrame
    sentences: DataFrame
    mentions: DataFrame
    pairs: DataFrame
    triples: DataFrame

    def digests(self) -> DataFrame:
        return sa.digests(self.articles, self.mentions, self.pairs, self.triples)

    def triple_frequency(self) -> DataFrame:
        return pr.triple_frequency(self.triples)


def analyse_articles(articles: DataFrame, vocab: DataFrame, facts: DataFrame, options: JobOptions | None = None) -> ArticleTables:
    """Articles to mentions, tagged closest pairs and triples."""
    o = options or JobOptions()
    arts = sa.valid_articles(articles)
    if o.sample < 1.0:
        arts = sa.sample_rows(arts, o.sample)
    if o.slices > 1:
        arts = arts.filter(sa.slice_of(F.col("article_id"), o.slices) == o.slice_number)
    sents = sentences(arts.select("article_id", "paragraphs"))
    found = written(mt.mentions(sents, vocab, strip_punct=o.strip_punct), "mentions")
    pairs = pr.shortest_pairs(pr.cooccurrences(found, threshold=o.threshold))
    tagged = written(fc.tag_facts(pairs, facts, o.fact_codes, with_refs=True), "pairs")
    return ArticleTables(arts, sents, found, tagged, pr.triples(tagged))


def evaluate_pairs(
    found: DataFrame,
    refs: DataFrame,
    articles: DataFrame,
    pmid_date: DataFrame,
    out: str | None = None,
    with_genes: bool = False,
) -> DataFrame:
    """Mentions against fact references: outcomes with dates, confirmation time and split; optional sinks."""
    combos = (pr.AB, pr.BC, pr.AC, pr.BB) if with_genes else (pr.AB, pr.BC, pr.AC)
    pairs = pr.equivalence_sets(found, combos)
    guess = ev.guesses(pairs).withColumn("pmid", F.col("article_id").cast("string"))
    relevant = ev.relevant_facts(refs, articles)
    dates = articles.select(
        F.col("article_id").cast("string").alias("pmid"), epoch_seconds(F.col("pub_date")).alias("pub_ts")
    )
    outcome = ev.evaluation_set(guess, relevant)
    fact_only = F.col("outcome") != "FP"
    confirmed = ev.earliest_confirmation(outcome.filter(fact_only), refs, pmid_date, dates)
    rest = (
        outcome.filter(~fact_only)
        .join(dates, "pmid", "left")
        .withColumn("first_ts", F.lit(None).cast("bigint"))
        .withColumn("time_until_verified", F.lit(None).cast("bigint"))
    )
    result = confirmed.unionByName(rest).withColumn("fact", F.col("outcome") != "FP")
    result = result.withColumn("split", ev.training_split(F.col("pmid"))).withColumn(
        "freq_sec_deriv", F.lit(None).cast("double")
    )
    if out:
        result = written(result, "evaluation")
        sb.write_split(result, f"{out}/annotated")
        sb.write_pair_csv(result, f"{out}/annotated.csv")
    return result


def augment_pairs(annotated: DataFrame) -> DataFrame:
    """Annotated pairs with the second derivative of their mention frequency; undated rows keep NULL."""
    rows = annotated.drop("freq_sec_deriv")
    keyed = rows.withColumn("_id", F.concat_ws("|", "pmid", F.xxhash64(*rows.columns).cast("string")))
    dated = tl.frequency_derivative(keyed, ["l", "r"], ts="pub_ts", id_col="_id").drop("seq", "_id")
    undated = keyed.filter(F.col("pub_ts").isNull()).drop("_id").withColumn("freq_sec_deriv", F.lit(None).cast("double"))
    return dated.unionByName(undated)


@dataclass(frozen=True)
class RelevanceReport:
    model: object
    scored: DataFrame
    labels: DataFrame
    weighted: DataFrame
    regression: DataFrame
    errors: DataFrame


def train_relevance(annotated: DataFrame, model_path: str | None = None) -> RelevanceReport:
    """Fit on 80 %, report on the rest; error rates of both parts."""
    data = written(rl.labelled(annotated.na.drop(subset=rl.FEATURES)), "labelled")
    train, test = rl.split_80_20(data)
    model = rl.fit_relevance(train)
    if model_path:
        model.write().overwrite().save(model_path)
    part = F.col("part")
    scored = rl.score(
        model, train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    )
    on_test = scored.filter(part == "test")
    labels = ev.label_metrics(on_test)
    return RelevanceReport(
        model,
        scored,
        labels,
        ev.weighted_metrics(labels),
        ev.regression_metrics(on_test),
        ev.error_rates(scored, split="part"),
    )


def stored_series(spark: SparkSession, store: str, mentions: DataFrame, keys: list[str], min_size: int = 400, ts: str = "pub_ts") -> DataFrame:
    """Sorted series of the keys with at least ``min_size`` dated mentions: from the store, else built and stored.

    A store holds a table for each threshold and content of ``mentions``: other mentions are another table.
    """
    def build():
        dated = mentions.filter(F.col(ts).isNotNull())
        return tl.mention_series(tl.long_series(dated, keys, min_size), keys, ts=ts)

    return sb.read_or_build(spark, f"{store}/series-{min_size}", build, [mentions], (tuple(keys), ts, min_size))


@dataclass(frozen=True)
class MentionProfiles:
    profiled: DataFrame
    unprofiled: DataFrame
    histogram: DataFrame
    gap_histogram: DataFrame
    distances: DataFrame


def mention_profiles(annotated: DataFrame, sample: float = 1.0) -> MentionProfiles:
    """Series of keys worth showing, gaps of the false ones, distance distribution by truth."""
    keys = ["l", "r"]
    profiles = tl.key_profiles(annotated, keys, ts="pub_ts")
    shown = tl.profiled(profiles, ev.special_interest(F.col("l"), F.col("r")))
    rows = annotated.join(shown.select(*keys), keys, "left_semi")
    false_rows = annotated.join(shown.filter("kind = 'false'").select(*keys), keys, "left_semi")
    return MentionProfiles(
        shown,
        tl.remaining(profiles.select(*keys), shown.filter("kind = 'true'").select(*keys)),
        tl.time_histogram(rows, keys, ts="pub_ts"),
        tl.equal_width_histogram(tl.gap_counts(false_rows, keys, ts="pub_ts"), keys, "gap"),
        tl.distance_distribution(annotated if sample >= 1 else sa.sample_rows(annotated, sample, "pmid")),
    )


def window_embeddings(
    sents: DataFrame,
    articles: DataFrame,
    store: str,
    synonyms: DataFrame | None = None,
    english: DataFrame | None = None,
    params: DataFrame | None = None,
    min_size: int = em.MIN_CORPUS,
    **options,
) -> list[tuple]:
    """Vectors of every trailing and cumulative window, of words and of bigrams, stored per key.

    ``synonyms`` and ``english`` make gene names canonical first. Keys that the store has are skipped. Returns
    the keys trained.
    """
    keys = ["article_id", "sent_pos"]
    corpus = token_corpus(sents, min_sentences=2).select(*keys, "tokens")
    if synonyms is not None:
        corpus = em.canonical_corpus(corpus, synonyms, english, keys)
    months = articles.filter(F.col("pub_date").isNotNull()).select("article_id", F.trunc("pub_date", "month").alias("month"))
    stored = em.training_corpus(corpus.join(months, "article_id"), keys)
    grid = tl.model_grid(months.select("month").distinct()) if params is None else params
    return em.train_grid(stored, grid, store, min_size, **options)


def citation_job(spark: SparkSession, path: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Term triples and publication dates of citation records."""
    records = sr.read_citations(spark, path)
    triples, dates = ct.citation_triples(records), ct.citation_dates(records)
    if out:
        sb.write_json(triples, f"{out}/triples")
        sb.write_table(dates, f"{out}/pmid_date")
    return triples, dates


def crawl_interactions(
    articles: DataFrame, kinases: DataFrame, target_terms: DataFrame, interactions: DataFrame, pmid_date: DataFrame
) -> DataFrame:
    """Kinase-target pairs found in articles before the interaction was published."""
    vocab = kinases.select(F.lit("A").alias("cat"), "term").unionByName(target_terms.select(F.lit("B").alias("cat"), "term"))
    sents = sentences(articles.select("article_id", "paragraphs"))
    pairs = pr.kinase_pairs(mt.padded_mentions(sents, vocab))
    dated = pairs.join(
        articles.select("article_id", "file_name", epoch_seconds(parse_date(F.col("date_text"))).alias("pub_ts")), "article_id"
    )
    return ia.found_before(dated, interactions, pmid_date)


def crawl_neighbours(vectors: DataFrame, terms: DataFrame, n: int = 10) -> DataFrame:
    """Nearest words of every one-word term (term) of the crawl that has a vector."""
    asked = vectors.join(terms.select(F.col("term").alias("word")).distinct(), "word", "left_semi")
    return em.nearest_rows(vectors, asked, n)


def relation_graph(spark: SparkSession, sources: list[str], store: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges, from the store if both are there, else built and stored."""
    if not all(sb.path_exists(spark, f"{store}/{part}/_SUCCESS") for part in ("vertices", "edges")):
        spo = sb.read_triples(spark, *sources)
        sb.save_graph(gr.vertices(spo), gr.edges(spo), store)
    return sb.load_graph(spark, store)


def annotate_similarity(spark: SparkSession, features: str, width: int, vectors: DataFrame, out: str) -> None:
    """Feature vectors with the similarity of their two entities appended."""
    rows = em.similarity(sb.read_feature_vectors(spark, features, width), vectors)
    sb.write_feature_vectors(rows, out)


def summarise_digests(spark: SparkSession, path: str, skip: str | None = None) -> DataFrame:
    """Word counts per article and list of stored digests, optionally without files of a given name part."""
    rows = sa.read_digests(spark, path)
    if skip:
        rows = rows.filter(~F.col("fileName").contains(skip))
    return mt.word_counts(sa.digest_mentions(rows))
