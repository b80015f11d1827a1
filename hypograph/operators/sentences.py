"""Articles to sentences with running coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import sums_before
from ..functions.text import clean_ascii, corpus_tokens, split_sentences


def prepared_paragraphs(paragraphs: Column) -> Column:
    """ASCII-only, lower-cased paragraphs."""
    return F.transform(paragraphs, lambda p: F.lower(clean_ascii(p)))


def sentences(articles: DataFrame, id_col: str = "article_id", paragraphs: str = "paragraphs") -> DataFrame:
    """Sentences of every article: (id, para_pos, sent_pos, offset, text, para_sents).

    ``offset`` counts characters from the article start, ``sent_pos`` runs through the whole article,
    ``para_sents`` is the number of sentences of the paragraph. Everything is computed inside the
    article's own row, so the text is never shuffled; the one running sum sees the lengths only.
    """
    none = F.expr("cast(array() as array<string>)")

    def placed(p, i):
        own = F.coalesce(split_sentences(p), none)
        return F.transform(own, lambda s: F.struct(i.alias("para_pos"), s.alias("text")))

    by_para = articles.select(id_col, F.transform(prepared_paragraphs(F.col(paragraphs)), placed).alias("paras"))
    sized = F.transform("paras", lambda p: F.transform(p, lambda s: F.struct(s["para_pos"].alias("para_pos"), s["text"].alias("text"), F.size(p).alias("para_sents"))))
    listed = by_para.select(id_col, F.flatten(sized).alias("own"))
    summed = listed.withColumn("before", sums_before(F.transform("own", lambda s: F.length(s["text"]))))
    flat = summed.select(id_col, F.posexplode(F.arrays_zip("own", "before")).alias("sent_pos", "s"))
    return flat.select(
        id_col,
        F.col("s.own.para_pos").alias("para_pos"),
        "sent_pos",
        F.col("s.before").alias("offset"),
        F.col("s.own.text").alias("text"),
        F.col("s.own.para_sents").alias("para_sents"),
    )


def article_text(articles: DataFrame, id_col: str = "article_id", paragraphs: str = "paragraphs") -> DataFrame:
    """Paragraphs of every article as one text (id, raw), joined by newline, inside the article's row."""
    return articles.select(id_col, F.array_join(paragraphs, "\n").alias("raw"))


def token_corpus(sents: DataFrame, min_sentences: int = 0, id_col: str = "article_id") -> DataFrame:
    """Token arrays per sentence for embedding training, of paragraphs with more than ``min_sentences``."""
    kept = sents.filter(F.col("para_sents") > min_sentences) if min_sentences else sents
    return kept.select(id_col, "para_pos", "sent_pos", corpus_tokens(F.col("text")).alias("tokens"))
