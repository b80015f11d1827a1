"""Record-oriented XML: thesaurus descriptors and bibliographic citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CITATION, DESCRIPTOR


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """Descriptors (ui, name, trees ARRAY); descriptors without tree numbers have an empty array."""
    raw = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(DESCRIPTOR).load(path)
    return raw.select(
        F.col("DescriptorUI").alias("ui"),
        F.lower(F.trim("DescriptorName.String")).alias("name"),
        F.coalesce("TreeNumberList.TreeNumber", F.expr("cast(array() as array<string>)")).alias("trees"),
    )


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "MedlineCitation").schema(CITATION).load(path)
    return flatten_citations(raw)


def _date_text(day, month, year):
    return F.when(month.isNotNull() & year.isNotNull(), F.concat_ws("-", day, month, year))


def flatten_citations(raw: DataFrame) -> DataFrame:
    """Citation records with only the fields that are used, dates still as text."""
    created, published = "DateCreated", "Article.Journal.JournalIssue.PubDate"
    return raw.select(
        F.col("PMID._VALUE").alias("pmid"),
        _date_text(F.col(f"{created}.Day"), F.col(f"{created}.Month"), F.col(f"{created}.Year")).alias("created"),
        _date_text(F.lit("1"), F.col(f"{published}.Month"), F.col(f"{published}.Year")).alias("published"),
        F.coalesce(
            F.transform("ChemicalList.Chemical", lambda c: c["NameOfSubstance"]["_VALUE"]),
            F.expr("cast(array() as array<string>)"),
        ).alias("chemicals"),
        F.coalesce(
            F.transform(
                "MeshHeadingList.MeshHeading",
                lambda h: F.struct(
                    h["DescriptorName"]["_VALUE"].alias("name"),
                    h["DescriptorName"]["_MajorTopicYN"].alias("major"),
                    h["DescriptorName"]["_UI"].alias("ui"),
                    F.transform(
                        F.coalesce(
                            h["QualifierName"],
                            F.expr("cast(array() as array<struct<_VALUE:string,_UI:string,_MajorTopicYN:string>>)"),
                        ),
                        lambda q: F.struct(q["_VALUE"].alias("text"), q["_UI"].alias("ui")),
                    ).alias("qualifiers"),
                ),
            ),
            F.expr(
                "cast(array() as array<struct<name:string,major:string,ui:string,"
                "qualifiers:array<struct<text:string,ui:string>>>>)"
            ),
        ).alias("headings"),
    )
