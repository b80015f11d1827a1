"""Curated facts joined with found pairs.

``facts(code, l, r, refs ARRAY<STRING>)`` as read; ``fact_refs(code, l, r, pmid)`` has one row per
reference. References stay rows: a fact that is cited everywhere never becomes one long array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import keyed_join


def fact_refs(facts: DataFrame) -> DataFrame:
    """One row per fact and reference id, lower-cased terms, empty references dropped, no duplicates."""
    return (
        facts.select(
            "code", F.lower("l").alias("l"), F.lower("r").alias("r"), F.explode("refs").alias("pmid")
        )
        .filter(F.col("pmid") != "")
        .distinct()
    )


def fact_keys(facts: DataFrame) -> DataFrame:
    """One row per (l, r), whatever the code, with the number of fact rows."""
    return facts.groupBy(F.lower("l").alias("l"), F.lower("r").alias("r")).agg(F.count("*").alias("n_facts"))


def known_pairs(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs that are curated facts under any code."""
    keyed = pairs.withColumn("l", F.lower("l")).withColumn("r", F.lower("r"))
    return keyed_join(keyed, fact_keys(facts), ["l", "r"])


def tag_facts(pairs: DataFrame, facts: DataFrame, codes=(1, 2), with_refs: bool = False) -> DataFrame:
    """Mark every pair of the given codes that is a curated fact; the others stay unmarked.

    ``with_refs`` adds all references of the fact, distinct and sorted, over all its rows. They are gathered
    per (l, r) before the join; as rows they are in ``fact_refs``.
    """
    keys = fact_keys(facts)
    if with_refs:
        refs = fact_refs(facts).groupBy("l", "r").agg(F.sort_array(F.collect_set("pmid")).alias("refs"))
        keys = keys.join(refs, ["l", "r"], "left")
    known = F.col("n_facts").isNotNull() & F.col("code").isin(list(codes))
    out = keyed_join(pairs, keys, ["l", "r"], "left").withColumn("fact", known)
    if with_refs:
        none = F.expr("cast(array() as array<string>)")
        out = out.withColumn("refs", F.when(known, F.coalesce("refs", none)).otherwise(none))
    return out.drop("n_facts")


def pair_support(pairs: DataFrame, refs: DataFrame) -> DataFrame:
    """Pairs that are facts, with the number of references and the first of them.

    References are counted per (l, r) before the join, so a fact found in many articles and cited many
    times gives one row per pair, not one per pair and reference.
    """
    support = refs.groupBy("l", "r").agg(F.countDistinct("pmid").alias("n_refs"), F.min("pmid").alias("first_ref"))
    return keyed_join(pairs, support, ["l", "r"])


def fact_counts(tagged: DataFrame) -> DataFrame:
    """Predicted pairs, and predicted pairs that are curated, per code."""
    return tagged.groupBy("code").agg(
        F.count("*").alias("n_predicted"), F.count_if("fact").alias("n_curated")
    )
