"""Relevance model of pairs and ranked A-B-C hypotheses."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sizing import keyed_join, written

FEATURES = ["para_dist", "sent_dist", "doc_dist"]
#: Groups that the partners of one B are ranked in first.
RANK_SALTS = 16


def labelled(pairs: DataFrame, fact: str = "fact") -> DataFrame:
    return pairs.withColumn("label", F.col(fact).cast("double"))


def fit_relevance(train: DataFrame, features: list[str] | None = None, max_iter: int = 100, tolerance: float = 1e-6) -> PipelineModel:
    """Logistic regression of ``label`` on the pair distances."""
    assembler = VectorAssembler(inputCols=features or FEATURES, outputCol="features")
    model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, tol=tolerance)
    return Pipeline(stages=[assembler, model]).fit(train)


def score(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Probability of the positive class and the predicted class."""
    return (
        model.transform(pairs)
        .withColumn("p", vector_to_array("probability")[1])
        .drop("features", "rawPrediction", "probability")
    )


def split_80_20(pairs: DataFrame, seed: int = 12345) -> tuple[DataFrame, DataFrame]:
    """Four fifths of the rows and the rest, by a hash of all their columns.

    The same rows on every run, whatever the files and partitions; rows that are equal throughout stay together.
    """
    share = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in pairs.columns]), F.lit(1000)) < 800
    return pairs.filter(share), pairs.filter(~share)


def pair_scores(scored: DataFrame, code: int) -> DataFrame:
    """Best probability per distinct (l, r) of one list."""
    return scored.filter(F.col("code") == code).groupBy("l", "r").agg(F.max("p").alias("p"))


def chains(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """A-B scores and B-C scores joined on B, with the product of the two; a B with many A and C is spread."""
    left = ab.select(F.col("l").alias("a"), F.col("r").alias("b"), F.col("p").alias("p_ab"))
    right = bc.select(F.col("l").alias("b"), F.col("r").alias("c"), F.col("p").alias("p_bc"))
    return keyed_join(left, right, ["b"]).select("a", "b", "c", (F.col("p_ab") * F.col("p_bc")).alias("score"))


def hypotheses(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """Chains in order of their score."""
    return chains(ab, bc).orderBy(F.desc("score"), "a", "b", "c")


def _best_partners(scores: DataFrame, partner: str, n: int) -> DataFrame:
    """(b, partner, p, rank): the ``n`` best partners of each B, ranked from 1, ties to the smaller name.

    Ranked in salted groups first, so a B that most pairs have is not ranked in one task.
    """
    order = [F.desc("p"), partner]
    salted = scores.withColumn("_salt", F.pmod(F.xxhash64(partner), F.lit(RANK_SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("b", "_salt").orderBy(*order))).filter(F.col("rank") <= n)
    ranked = some.select("b", partner, "p").withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def best_hypotheses(ab: DataFrame, bc: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` best chains (a, b, c, score) of A-B scores and B-C scores, as ``hypotheses`` would list them first.

    A rank join: the chain of the i-th best A and the j-th best C of a B is beaten by i * j - 1 others of that B,
    so only chains with i * j <= n are made, at most n (1 + ln n) for a B with any number of partners. Before
    that, the n-th best of the chains of first partners is a bound that most B do not reach. Nothing is sorted
    as a whole. Chains with equal scores are in the order of the A-B score, the B-C score and the names.
    Probabilities must not be negative.
    """
    left = written(_best_partners(ab.select(F.col("r").alias("b"), F.col("l").alias("a"), "p"), "a", n), "best-a")
    right = written(_best_partners(bc.select(F.col("l").alias("b"), F.col("r").alias("c"), "p"), "c", n), "best-c")
    left = left.select("b", "a", F.col("p").alias("p_ab"), F.col("rank").alias("i"))
    right = right.select("b", "c", F.col("p").alias("p_bc"), F.col("rank").alias("j"))
    score = (F.col("p_ab") * F.col("p_bc")).alias("score")
    firsts = left.filter("i = 1").join(right.filter("j = 1"), "b").select(score).orderBy(F.desc("score")).limit(n)
    found, least = firsts.agg(F.count("*"), F.min("score")).first()
    pairs = left.join(right, (left["b"] == right["b"]) & (F.col("i") * F.col("j") <= n)).select(left["b"], "a", "c", "p_ab", "p_bc", score)
    if found == n:
        pairs = pairs.filter(F.col("score") >= F.lit(least))
    return pairs.orderBy(F.desc("score"), F.desc("p_ab"), F.desc("p_bc"), "a", "b", "c").limit(n).select("a", "b", "c", "score")


def _list_scores(train: DataFrame, pairs: DataFrame, max_iter: int) -> list[DataFrame]:
    """Scores of the A-B and of the B-C list, each by a model of its own that is fitted on ``train``."""
    scores = []
    for code in (1, 2):
        model = fit_relevance(labelled(train.filter(F.col("code") == code)), max_iter=max_iter)
        scores.append(pair_scores(score(model, pairs.filter(F.col("code") == code)), code))
    return scores


def ranked_hypotheses(train: DataFrame, pairs: DataFrame, max_iter: int = 100, n: int | None = None) -> DataFrame:
    """One model per list (A-B and B-C), fitted on ``train``, then the ranked chains of ``pairs``: all, or the best ``n``."""
    scores = _list_scores(train, pairs, max_iter)
    return hypotheses(*scores) if n is None else best_hypotheses(*scores, n=n)
