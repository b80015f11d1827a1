"""Found pairs against curated facts: outcomes, train/test split, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import ratio
from .sizing import keyed_join, written
from .vocab import STOP_EVALUATION

KEY = ["l", "r", "pmid"]

# Genes whose pairs are of special interest.
TARGET_GENES = [
    "akap10", "akap11", "akap12", "akap2", "akap6", "cask", "ccnh", "cdc42bpa", "cdc42bpg", "cdk1", "chuk", "ckb",
    "cks1b", "cks2", "clk1", "clk2", "fes", "fgfr1", "fgfr2", "fgfr3", "ilkap", "insr", "irak1", "irak2", "irak3",
    "stk16", "stk24", "stk25", "stk26", "stk36", "stk38", "syk", "tab1", "tab2", "tab3", "taok1", "tbk1", "tek",
    "tjp2", "wasf1", "wee1", "wnk2", "zap70", "atm", "atr", "bmx", "cdk2", "cdkn1a", "cdkn2a", "cdkn2c", "chek1",
    "chek2", "clk3", "csnk1d", "csnk1e", "csnk2a1", "csnk2a2", "csnk2b", "gsk3b", "hipk1", "hipk2", "hipk3", "ick",
    "ikbkb", "lrrk2", "mapk1", "mapk11", "mapk14", "mapk8", "mapkapk5", "mpp5", "mtor", "nuak1", "pbk", "plk1",
    "prkab2", "prkcd", "ptk2", "rb1cc1", "skp1", "srpk1", "stk11", "stk4", "tk1", "tp53", "vrk1",
]


def guesses(pairs: DataFrame) -> DataFrame:
    """Candidate pairs without the stop words of the evaluation."""
    return pairs.filter(~F.col("l").isin(STOP_EVALUATION) & ~F.col("r").isin(STOP_EVALUATION))


def relevant_facts(refs: DataFrame, articles: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Facts whose reference is one of the processed articles, distinct on (l, r, pmid)."""
    ids = articles.select(F.col(id_col).cast("string").alias("pmid"))
    return refs.select(*KEY).distinct().join(ids, "pmid", "left_semi").select(*KEY)


def true_positives(found: DataFrame, relevant: DataFrame) -> DataFrame:
    return found.join(relevant.select(*KEY), KEY, "left_semi")


def false_positives(found: DataFrame, relevant: DataFrame) -> DataFrame:
    return found.join(relevant.select(*KEY), KEY, "left_anti")


def false_negatives(found: DataFrame, relevant: DataFrame) -> DataFrame:
    return relevant.select(*KEY).join(found, KEY, "left_anti")


def evaluation_set(found: DataFrame, relevant: DataFrame) -> DataFrame:
    """All guesses and missed facts with ``outcome`` TP, FP or FN, by one full outer join.

    Missed facts have NULL distances.
    """
    g = found.withColumn("_guess", F.lit(True))
    f = relevant.select(*KEY).withColumn("_fact", F.lit(True))
    both = g.join(f, KEY, "full_outer")
    outcome = (
        F.when(F.col("_guess") & F.col("_fact"), "TP").when(F.col("_guess"), "FP").otherwise("FN")
    )
    return both.withColumn("outcome", outcome).drop("_guess", "_fact")


def earliest_confirmation(
    positives: DataFrame, refs: DataFrame, pmid_date: DataFrame, dates: DataFrame
) -> DataFrame:
    """Seconds from the pair's article date to the earliest dated reference of its fact.

    The minimum per (l, r) is taken before joining with the pairs, so the join stays small.
    """
    first = (
        refs.select("l", "r", "pmid")
        .join(pmid_date.select("pmid", F.col("pub_ts").alias("ref_ts")), "pmid")
        .groupBy("l", "r")
        .agg(F.min("ref_ts").alias("first_ts"))
    )
    # Written, since the join counts its keys before it is made.
    dated = written(positives.join(dates.select("pmid", "pub_ts"), "pmid", "left"), "positives")
    return keyed_join(dated, first, ["l", "r"], "left").withColumn(
        "time_until_verified", F.col("first_ts") - F.col("pub_ts")
    )


def training_split(pmid: Column) -> Column:
    """Even numeric ids train, all others test."""
    number = pmid.cast("string").try_cast("bigint")
    return F.when(number % 2 == 0, F.lit("train")).otherwise(F.lit("test"))


def special_interest(l: Column, r: Column, targets: list[str] | None = None) -> Column:
    names = TARGET_GENES if targets is None else targets
    return l.isin(names) | r.isin(names)


def mark_special_interest(pairs: DataFrame, targets: DataFrame, term: str = "term") -> DataFrame:
    """``pairs`` (l, r, any others) with ``special``: whether ``l`` or ``r`` is one of the ``targets``, a table of any size.

    Two keyed joins, in which the targets are broadcast if they were measured as small; nothing is collected.
    """
    columns = pairs.columns
    names = written(targets.select(F.col(term).alias("_term")).filter("_term is not null").distinct(), "targets")
    for side in ("l", "r"):
        known = names.select(F.col("_term").alias(side), F.lit(True).alias(f"_{side}"))
        pairs = keyed_join(pairs, known, [side], "left")
    special = F.coalesce("_l", F.lit(False)) | F.coalesce("_r", F.lit(False))
    return pairs.withColumn("special", special).select(*[F.col(f"`{c}`") for c in columns], "special")


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(label, prediction).agg(F.count("*").alias("n"))


def label_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction", beta: float = 2.0) -> DataFrame:
    """Precision, recall, F-measure and false-positive rate of both labels (0 and 1), one pass."""
    y, p = F.col(label), F.col(prediction)
    total = F.count("*").alias("n")
    cells = scored.agg(
        total,
        *[
            agg
            for k in (0, 1)
            for agg in (
                F.count_if((y == k) & (p == k)).alias(f"tp{k}"),
                F.count_if((y != k) & (p == k)).alias(f"fp{k}"),
                F.count_if((y == k) & (p != k)).alias(f"fn{k}"),
                F.count_if((y != k) & (p != k)).alias(f"tn{k}"),
            )
        ],
    )
    rows = cells.select(
        "n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("label"),
                        *[F.col(f"{c}{k}").alias(c) for c in ("tp", "fp", "fn", "tn")],
                    )
                    for k in (0, 1)
                ]
            )
        ).alias("x"),
    ).select("n", "x.*")
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    b2 = beta * beta
    return (
        rows.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f_measure",
            ratio((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall")),
        )
        .withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))
        .withColumn("weight", (F.col("tp") + F.col("fn")) / F.col("n"))
    )


def weighted_metrics(per_label: DataFrame) -> DataFrame:
    """Label metrics weighted by label frequency, in one row."""
    names = ["precision", "recall", "f_measure", "fpr"]
    return per_label.agg(*[F.sum(F.col(c) * F.col("weight")).alias(f"weighted_{c}") for c in names])


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Explained variance, MAE, MSE, RMSE and R2 from sums of one pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = scored.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(y).alias("my"),
        F.avg(p).alias("mp"),
        F.avg(p * p).alias("mpp"),
        F.var_pop(y).alias("vy"),
    )
    # Mean of (prediction - mean label)^2.
    explained = F.col("mpp") - 2 * F.col("mp") * F.col("my") + F.col("my") * F.col("my")
    return sums.select(
        "n",
        explained.alias("explained_variance"),
        "mae",
        "mse",
        F.sqrt("mse").alias("rmse"),
        (1 - ratio(F.col("mse"), F.col("vy"))).alias("r2"),
    )


def error_rates(scored: DataFrame, split: str = "split", label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of wrong predictions, each split on its own rows."""
    wrong = (F.col(label) != F.col(prediction)).cast("double")
    return scored.groupBy(split).agg(F.avg(wrong).alias("error_rate"), F.count("*").alias("n"))
