"""Token totals by source, language and tokenizer version, kept by signed deltas.

A change of a document is a signed row: +1 and its tokens when it comes in, -1 when it goes, both when it is
counted anew. A batch of changes is summed and committed once, under its own name; totals are the sum of the
committed batches. Committing a name again changes nothing, whatever the retry carries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "tokenizer"]
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


@cache
def _encoding(path: str, pattern: str):
    """The tokenizer of a ranks file, read once in each worker process, which serves many tasks."""
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) per row of ``docs``; null texts have no tokens.

    ``tokenizer`` names the version. Without a path, tokens are words between white space; with one, those of
    the byte-level ranks file there (on every executor) under ``pattern``.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(c).cast("string").alias(c) for c in ("source", "lang")],
        F.lit(tokenizer).alias("tokenizer"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    if path is None:
        return rows.withColumn("n_tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(x)) for x in batch.column("text").to_pylist()]
            columns = [batch.column(x) for x in ("doc_id", *GROUP)] + [pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *GROUP, "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    """Signed rows of documents that come in."""
    return counts.select("doc_id", *GROUP, "n_tokens", F.lit(1).alias("sign"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed rows of documents that go, as they were counted."""
    return counts.select("doc_id", *GROUP, "n_tokens", F.lit(-1).alias("sign"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows of documents that are counted anew: the old count out, the new one in."""
    return deletes(old).unionByName(inserts(new))


def _batch_path(store: str, batch: str) -> str:
    return f"{store.rstrip('/')}/batch={batch}"


def _marker(store: str, batch: str) -> str:
    return f"{store.rstrip('/')}/committed={batch}"


def _published(spark: SparkSession, store: str, batch: str) -> str | None:
    """The folder of a batch that is there as a whole: its marker, a row in a table of its own, names it."""
    try:
        found = spark.read.schema("folder string").parquet(_marker(store, batch)).take(1)
    except AnalysisException:
        return None
    return found[0]["folder"] if found else None


def committed(spark: SparkSession, store: str, batch: str) -> bool:
    """Whether the batch is there as a whole."""
    return _published(spark, store, batch) is not None


def _publish(sums: DataFrame, store: str, batch: str) -> bool:
    """Write a batch under a name of this attempt, then its marker in one move: of two writers at once one counts."""
    spark, attempt = sums.sparkSession, uuid.uuid4().hex
    folder = f"{_batch_path(store, batch)}/attempt={attempt}"
    sums.write.parquet(folder)
    draft = f"{store.rstrip('/')}/_marker-{attempt}"
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.parquet(draft)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    source, target = hadoop_path(draft), hadoop_path(_marker(store, batch))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    # A move onto a marker that another writer made meanwhile fails, or ends inside it under a name that readers pass over.
    if files.exists(target) or not files.rename(source, target):
        files.delete(source, True)
    return _published(spark, store, batch) == folder


def commit(changes: DataFrame, store: str, batch: str) -> bool:
    """Add a batch of signed rows to the totals in ``store``; False if that batch was committed before.

    Sums are made before the shuffle, so a source that holds a third of all rows costs one row per task. A
    batch that was broken off leaves no marker and is written again. Nulls in the group are groups of their own.
    """
    spark = changes.sparkSession
    if committed(spark, store, batch):
        return False
    sums = changes.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
    return _publish(sums.filter("n_docs != 0 or n_tokens != 0"), store, batch)


def totals(spark: SparkSession, store: str, batches: list[str]) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens) over the committed ones of ``batches``; groups that have gone are left out."""
    rows = spark.createDataFrame([], _TOTALS)
    for batch in batches:
        if folder := _published(spark, store, batch):
            rows = rows.unionByName(spark.read.schema(_TOTALS).parquet(folder))
    sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.filter("n_docs != 0 or n_tokens != 0")


def compact(spark: SparkSession, store: str, batches: list[str], into: str) -> str:
    """Sum committed batches into one under a new name and return it; the caller lists it in their place."""
    if not committed(spark, store, into):
        _publish(totals(spark, store, batches), store, into)
    return into
