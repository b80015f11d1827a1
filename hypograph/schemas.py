"""Schemas of the stored records."""

from __future__ import annotations

from pyspark.sql import types as T

MENTION = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("docPos", T.IntegerType()),
        T.StructField("paraPos", T.IntegerType()),
        T.StructField("sentPos", T.IntegerType()),
    ]
)

PAIR = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("L", T.StringType()),
        T.StructField("R", T.StringType()),
        T.StructField("docDist", T.DoubleType()),
        T.StructField("paraDist", T.DoubleType()),
        T.StructField("sentDist", T.DoubleType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("fact", T.BooleanType()),
        T.StructField("refs", T.ArrayType(T.StringType())),
        T.StructField("uberDist", T.LongType()),
        T.StructField("leftDocPos", T.IntegerType()),
        T.StructField("rightDocPos", T.IntegerType()),
    ]
)

TRIPLE = T.StructType([T.StructField(c, T.StringType()) for c in ("A", "B", "C")])

# One JSON document per article.
DIGEST = T.StructType(
    [
        T.StructField("fileName", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("generator", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField(
            "paragraphs",
            T.ArrayType(T.StructType([T.StructField("sentences", T.ArrayType(T.StringType()))])),
        ),
        *[T.StructField(k, T.ArrayType(MENTION)) for k in ("A", "B", "C")],
        *[T.StructField(k, T.ArrayType(PAIR)) for k in ("AB", "BC", "AC", "BB")],
        T.StructField("ABC", T.ArrayType(TRIPLE)),
    ]
)

# One record of a bibliographic citation file. The leading underscore marks attributes.
_YMD = [T.StructField(c, T.StringType()) for c in ("Year", "Month", "Day")]
_NAMED = [
    T.StructField("_VALUE", T.StringType()),
    T.StructField("_UI", T.StringType()),
    T.StructField("_MajorTopicYN", T.StringType()),
]
CITATION = T.StructType(
    [
        T.StructField(
            "PMID",
            T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_Version", T.StringType())]),
        ),
        T.StructField("DateCreated", T.StructType(_YMD)),
        T.StructField(
            "Article",
            T.StructType(
                [
                    T.StructField(
                        "Journal",
                        T.StructType(
                            [
                                T.StructField(
                                    "JournalIssue",
                                    T.StructType([T.StructField("PubDate", T.StructType(_YMD))]),
                                )
                            ]
                        ),
                    )
                ]
            ),
        ),
        T.StructField(
            "ChemicalList",
            T.StructType(
                [
                    T.StructField(
                        "Chemical",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("RegistryNumber", T.StringType()),
                                    T.StructField("NameOfSubstance", T.StructType(_NAMED[:2])),
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
        T.StructField(
            "MeshHeadingList",
            T.StructType(
                [
                    T.StructField(
                        "MeshHeading",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("DescriptorName", T.StructType(_NAMED)),
                                    T.StructField("QualifierName", T.ArrayType(T.StructType(_NAMED))),
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)

# One record of a thesaurus file.
DESCRIPTOR = T.StructType(
    [
        T.StructField("DescriptorUI", T.StringType()),
        T.StructField("DescriptorName", T.StructType([T.StructField("String", T.StringType())])),
        T.StructField(
            "TreeNumberList",
            T.StructType([T.StructField("TreeNumber", T.ArrayType(T.StringType()))]),
        ),
    ]
)

# Annotated pairs as written to CSV, in column order.
PAIR_CSV = T.StructType(
    [
        T.StructField("pmid", T.StringType()),
        T.StructField("pub_ts", T.LongType()),
        T.StructField("date_text", T.StringType()),
        T.StructField("l", T.StringType()),
        T.StructField("r", T.StringType()),
        T.StructField("para_dist", T.LongType()),
        T.StructField("sent_dist", T.LongType()),
        T.StructField("doc_dist", T.LongType()),
        T.StructField("fact", T.BooleanType()),
        T.StructField("time_until_verified", T.LongType()),
        T.StructField("freq_sec_deriv", T.DoubleType()),
    ]
)
