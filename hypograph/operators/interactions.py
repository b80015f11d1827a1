"""Known interactions: synonyms, partners, and pairs found before they were published.

``interactions(a, b, alt_a, alt_b, pmid)`` where the alternative names are bar-separated lists such as
``hgnc:<name>(gene name)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizing import keyed_join
from .vocab import STOP_KINASES, union_terms

# Accession of the target and the form of a name in the export.
TARGET = "uniprotkb:P04637"
SYNONYM = r"(?i).*:([\w ]+)\(.*\)$"


def synonyms_of(field: Column) -> Column:
    """Lower-cased names inside a bar-separated list; entries of another form are dropped."""
    names = F.transform(F.split(field, r"\|"), lambda s: F.lower(F.regexp_extract(s, SYNONYM, 1)))
    return F.filter(names, lambda s: s != "")


def reference_id(field: Column) -> Column:
    """The first ``pubmed:`` id of a bar-separated list, NULL if there is none."""
    found = F.regexp_extract(field, r"(?:^|\|)pubmed:([^:|]*)", 1)
    return F.when(found != "", found)


def partner_names(interactions: DataFrame, target: str = TARGET, side: str = "a") -> DataFrame:
    """(name, pmid) of the partner: the other side's names if ``side`` is the target, else alt_a."""
    field = F.when(F.col(side) == target, F.col("alt_b")).otherwise(F.col("alt_a"))
    return interactions.select(F.explode(synonyms_of(field)).alias("name"), "pmid")


def kinase_vocabulary(
    interactions: DataFrame, gene_protein: DataFrame, kinase_names: DataFrame, thesaurus: DataFrame, target: str = TARGET
) -> DataFrame:
    """Kinase terms of all sources, lower-cased, distinct, without stop words."""
    both = gene_protein.select(F.explode(F.array("key", "synonym")).alias("term"))
    return union_terms(
        partner_names(interactions, target, "a").select("name"), both, kinase_names, thesaurus, stop=STOP_KINASES
    )


def interaction_facts(pairs: DataFrame, interactions: DataFrame, target: str = TARGET) -> DataFrame:
    """Found pairs whose left term names a partner of the target, with the interaction's reference."""
    names = partner_names(interactions, target, "a").select(F.col("name").alias("l"), F.col("pmid").alias("ref_pmid"))
    return keyed_join(pairs, names.distinct(), ["l"])


def found_before(
    pairs: DataFrame, interactions: DataFrame, pmid_date: DataFrame, target: str = TARGET, date: str = "pub_ts"
) -> DataFrame:
    """Pairs in an article older than a reference that published the interaction, with ``ref_ts``, distinct.

    The dates of a name's references are one sorted array, as long as the calendar, so a pair meets one row
    and takes the dates after its own.
    """
    dates = (
        partner_names(interactions, target, "a")
        .join(pmid_date.select("pmid", F.col("pub_ts").alias("ref_ts")), "pmid")
        .groupBy(F.col("name").alias("l"))
        .agg(F.sort_array(F.collect_set("ref_ts")).alias("_dates"))
    )
    later = F.filter("_dates", lambda ref: ref > F.col(date))
    return keyed_join(pairs, dates, ["l"]).withColumn("ref_ts", F.explode(later)).drop("_dates").distinct()
