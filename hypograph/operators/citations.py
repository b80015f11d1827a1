"""Bibliographic citations: heading classes, term triples, publication dates.

``citations(pmid, created, published, chemicals ARRAY<STRING>, headings ARRAY<STRUCT<name, major, ui,
qualifiers ARRAY<STRUCT<text, ui>>>>)``
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds, parse_date


def term_lists(citations: DataFrame) -> DataFrame:
    """(pmid, A, B, C): chemicals are A; descriptor ``D0*`` is C; qualifiers ``C*``, ``F*`` are C and
    ``Q*``, ``D12*`` are B. Everything is decided inside the citation's row."""
    named = F.transform(
        F.filter("headings", lambda h: h["ui"].startswith("D0")), lambda h: F.lower(h["name"])
    )
    marked = F.filter("headings", lambda h: h["major"].isin("Y", "N"))
    qualifiers = F.flatten(F.transform(marked, lambda h: h["qualifiers"]))

    def texts(pattern):
        return F.transform(F.filter(qualifiers, lambda q: q["ui"].rlike(pattern)), lambda q: F.lower(q["text"]))

    def known(terms):
        return F.filter(terms, lambda t: t.isNotNull())

    return citations.select(
        "pmid",
        known(F.transform("chemicals", lambda c: F.lower(c))).alias("A"),
        known(texts("^(Q|D12)")).alias("B"),
        known(F.concat(named, texts("^[CF]"))).alias("C"),
    )


def heading_terms(citations: DataFrame) -> DataFrame:
    """The term lists as rows (pmid, cat, term)."""
    lists = F.array(*[F.struct(F.lit(c).alias("cat"), F.col(c).alias("terms")) for c in ("A", "B", "C")])
    return (
        term_lists(citations)
        .select("pmid", F.explode(lists).alias("x"))
        .select("pmid", "x.cat", F.explode("x.terms").alias("term"))
    )


def citation_triples(citations: DataFrame) -> DataFrame:
    """A x B x C of each citation record, whose lists are as long as that record; nothing is shuffled."""
    return (
        term_lists(citations)
        .select("pmid", F.explode("A").alias("a"), "B", "C")
        .select("pmid", "a", F.explode("B").alias("b"), "C")
        .select("pmid", "a", "b", F.explode("C").alias("c"))
    )


def citation_dates(citations: DataFrame) -> DataFrame:
    """(pmid, pub_ts): the earlier of creation and publication date, NULL if neither is readable.

    ``created`` is ``d-M-yyyy``, ``published`` is ``1-M-yyyy`` or ``1-MMM-yyyy``.
    """
    first = F.least(parse_date(F.col("created")), parse_date(F.col("published")))
    return citations.select("pmid", epoch_seconds(first).alias("pub_ts"))
