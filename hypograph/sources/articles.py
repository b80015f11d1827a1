"""Full-text article XML and article digests."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_date
from ..functions.text import base_name, clean_ascii, split_sentences
from ..operators.pairs import pair_id
from ..operators.sentences import prepared_paragraphs
from ..operators.sizing import shuffles_freed, written
from ..schemas import DIGEST

ARTICLE_GLOB = "*.fxml"
_DOCTYPE = re.compile(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>")
_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]*;)")
# Fixed value: the entities that every XML parser knows.
_OWN_ENTITIES = ["amp;", "apos;", "gt;", "lt;", "quot;"]
_PARSED = "path string, article_id string, date_text string, paragraphs array<string>, reason string"


def corpus_files(spark: SparkSession, root: str, glob: str = ARTICLE_GLOB) -> DataFrame:
    """Article files below ``root`` with path, size and modification time; no content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return files.select("path", "length", "modificationTime")


def article_xml(spark: SparkSession, root: str, glob: str = ARTICLE_GLOB) -> DataFrame:
    """(path, xml) of every article file; Spark packs small files into read tasks."""
    return (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    )


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _resolved(found: re.Match) -> str:
    """The character of a standard named entity; the parser's own and unknown ones stay as they are."""
    name = found[1]
    return found[0] if name in _OWN_ENTITIES else html.entities.html5.get(name, found[0])


def _parse(xml: str) -> tuple[str | None, str | None, list[str] | None, str | None]:
    """Id, date text and paragraph texts of one article, or the reason why it cannot be read."""
    try:
        text = _ENTITY.sub(_resolved, _DOCTYPE.sub("", xml, count=1))
        root = ET.fromstring(text.encode("utf-8"))
    except (ET.ParseError, ValueError) as error:
        return None, None, None, str(error)
    ids: dict[str, str] = {}
    date = None
    paragraphs = []
    for node in root.iter():
        tag = _local(node.tag)
        if tag == "article-id":
            ids.setdefault(node.get("pub-id-type", ""), (node.text or "").strip())
        elif tag == "pub-date" and node.get("pub-type") == "epub" and date is None:
            parts = {_local(c.tag): (c.text or "").strip() for c in node}
            date = "-".join(parts.get(k, "") for k in ("day", "month", "year"))
        elif tag == "p":
            paragraphs.append("".join(node.itertext()))
    return ids.get("pmid") or ids.get("pmc"), date, paragraphs, None


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(path, *_parse(xml or "")) for path, xml in zip(batch["path"], batch["xml"], strict=True)]
        yield pd.DataFrame(rows, columns=["path", "article_id", "date_text", "paragraphs", "reason"])


def failed_articles(xml: DataFrame) -> DataFrame:
    """(path, reason) of the files that are not well-formed."""
    return xml.select("path", "xml").mapInPandas(_parse_batches, _PARSED).filter("reason is not null").select("path", "reason")


def parse_articles(xml: DataFrame) -> DataFrame:
    """(path, xml) to articles. Standard named entities are resolved; files that are not well-formed are
    rows of ``failed_articles`` instead.

    Paragraph text mixes with inline tags, which Spark's XML reader cannot rebuild in order.
    """
    parsed = xml.select("path", "xml").mapInPandas(_parse_batches, _PARSED).filter("reason is null")
    return parsed.select(
        "article_id",
        base_name(F.col("path")).alias("file_name"),
        "date_text",
        parse_date(F.col("date_text")).alias("pub_date"),
        "paragraphs",
        "path",
    )


def read_articles(spark: SparkSession, root: str, glob: str = ARTICLE_GLOB) -> DataFrame:
    return parse_articles(article_xml(spark, root, glob))


def valid_articles(articles: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Articles that have an id and text."""
    return articles.filter(F.col(id_col).isNotNull() & (F.size("paragraphs") > 0))


def slice_of(key: Column, slices: int) -> Column:
    """Batch number of a row; every row falls into exactly one batch."""
    return F.pmod(F.xxhash64(key), F.lit(slices))


def sample_rows(df: DataFrame, fraction: float, key: str = "article_id", seed: int = 1234) -> DataFrame:
    """Rows whose key falls into the given share of all keys: the same ones on every run and retry."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.filter(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < F.lit(int(fraction * 2**32)))


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose output does not exist yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def _mention_list(cat: str) -> Column:
    item = F.struct(
        "word",
        F.col("doc_pos").alias("docPos"),
        F.col("para_pos").alias("paraPos"),
        F.col("sent_pos").alias("sentPos"),
    )
    return F.sort_array(F.collect_list(F.when(F.col("cat") == cat, item))).alias(cat)


def _pair_list(code: int, name: str) -> Column:
    item = F.struct(
        pair_id().alias("id"),
        F.col("l").alias("L"),
        F.col("r").alias("R"),
        F.col("doc_dist").cast("double").alias("docDist"),
        F.col("para_dist").cast("double").alias("paraDist"),
        F.col("sent_dist").cast("double").alias("sentDist"),
        "code",
        "fact",
        "refs",
        F.col("uber_dist").alias("uberDist"),
        F.col("l_pos").alias("leftDocPos"),
        F.col("r_pos").alias("rightDocPos"),
    )
    return F.collect_list(F.when(F.col("code") == code, item)).alias(name)


def digests(articles: DataFrame, found: DataFrame, tagged: DataFrame, triples: DataFrame) -> DataFrame:
    """One nested row per article, whose lists are as long as that article.

    ``tagged`` are pairs with ``fact`` and ``refs``. Sentences are nested inside the article's own row.
    """
    # The parts have the same key, so they meet without moving again. They are stored, so that what was shuffled for them is gone
    # when the text moves, once, to the last join; what is made of the text, twice its size, is made there.
    mention_part = found.groupBy("article_id").agg(*[_mention_list(c) for c in ("A", "B", "C")])
    pair_part = tagged.groupBy("article_id").agg(
        *[_pair_list(code, name) for code, name in ((1, "AB"), (2, "BC"), (3, "AC"), (4, "BB"))]
    )
    triple_part = triples.groupBy("article_id").agg(
        F.collect_list(F.struct(F.col("a").alias("A"), F.col("b").alias("B"), F.col("c").alias("C"))).alias("ABC")
    )
    lists_of = mention_part.join(pair_part, "article_id", "full").join(triple_part, "article_id", "full")
    lists_of = written(lists_of, "lists")
    out = articles.select("article_id", "file_name", "pub_date", F.col("paragraphs").alias("_paragraphs")).join(lists_of, "article_id", "left")
    out = out.withColumn(
        "paragraphs",
        F.transform(prepared_paragraphs(F.col("_paragraphs")), lambda p: F.struct(split_sentences(p).alias("sentences"))),
    )
    lists = ["paragraphs", "A", "B", "C", "AB", "BC", "AC", "BB", "ABC"]
    types = {f.name: f.dataType for f in DIGEST.fields}
    return out.select(
        F.col("file_name").alias("fileName"),
        F.date_format("pub_date", "d-M-yyyy").alias("date"),
        F.col("article_id").cast("string").alias("id"),
        F.lit("hypograph").alias("generator"),
        F.array_join(F.transform("_paragraphs", clean_ascii), "\n").alias("raw"),
        *[F.coalesce(F.col(c), F.array().cast(types[c])).cast(types[c]).alias(c) for c in lists],
    )


#: Digests of a compressed file, which is read by one task.
DIGEST_RECORDS = 5_000


def write_digests(rows: DataFrame, path: str, by_name: bool = False, compression: str | None = None) -> None:
    """JSON digests; ``by_name`` spreads them over folders by the first two letters of the file name.

    With ``compression`` (as of Spark's JSON writer) files have at most ``DIGEST_RECORDS`` each, whatever the number of
    tasks that write. A digest has its text twice and a name beside every number, so its files get far smaller.
    """
    options = {} if compression is None else {"compression": compression, "maxRecordsPerFile": DIGEST_RECORDS}
    with shuffles_freed(rows.sparkSession):
        if by_name:
            rows.withColumn("c1", F.substring("fileName", 1, 1)).withColumn(
                "c2", F.substring("fileName", 2, 1)
            ).write.mode("overwrite").options(**options).partitionBy("c1", "c2").json(path)
        else:
            rows.write.mode("overwrite").options(**options).json(path)


def _digest_lines(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    schema = T.StructType([*DIGEST.fields, T.StructField("_malformed", T.StringType())])
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_malformed")
    return reader.option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)


def failed_digests(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(path, id, text) of documents that are no digest; the id as far as it could be read."""
    rows = _digest_lines(spark, path, multi_line).select(F.col("_metadata.file_path").alias("path"), "id", F.col("_malformed").alias("text"))
    return rows.filter("text is not null")


def read_digests(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Digests with defaults for missing parts; unreadable documents are rows of ``failed_digests`` instead."""
    # The reader refuses queries on the mark of unreadable documents alone, so another field is looked at too.
    readable = F.col("_malformed").isNull() & (F.coalesce(F.length("id"), F.lit(0)) >= 0)
    raw = _digest_lines(spark, path, multi_line).filter(readable).drop("_malformed")
    types = {f.name: f.dataType for f in DIGEST.fields}
    lists = ["A", "B", "C", "AB", "BC", "AC", "BB", "ABC"]
    return raw.withColumns({c: F.coalesce(F.col(c), F.array().cast(types[c])) for c in lists})


def digest_mentions(rows: DataFrame) -> DataFrame:
    """Flat mentions of digests: (article_id, cat, word, doc_pos, para_pos, sent_pos)."""
    cats = F.array(*[F.struct(F.lit(c).alias("cat"), F.col(c).alias("items")) for c in ("A", "B", "C")])
    return (
        rows.select(F.col("id").alias("article_id"), F.explode(cats).alias("x"))
        .select("article_id", "x.cat", F.explode("x.items").alias("m"))
        .select(
            "article_id",
            "cat",
            F.col("m.word").alias("word"),
            F.col("m.docPos").alias("doc_pos"),
            F.col("m.paraPos").alias("para_pos"),
            F.col("m.sentPos").alias("sent_pos"),
        )
    )


def digest_pairs(rows: DataFrame) -> DataFrame:
    """Flat pairs of digests with a missing fact mark read as false."""
    return (
        rows.select(
            F.col("id").alias("article_id"), F.explode(F.concat("AB", "BC", "AC", "BB")).alias("p")
        )
        .select("article_id", "p.*")
        .withColumn("fact", F.coalesce("fact", F.lit(False)))
        .withColumn("refs", F.coalesce("refs", F.expr("cast(array() as array<string>)")))
    )


def digest_guesses(rows: DataFrame) -> DataFrame:
    """Pairs read back that are not facts."""
    return digest_pairs(rows).filter(~F.col("fact"))
