"""New articles only, batch by batch, with the batch operators: each article once, whatever is delivered again.

A target holds two tables, ``rows`` (what the transformation gave) and ``done`` (the ids of the articles it was
given, also of those it found nothing in). Both are written in folders per run and micro-batch; the ids come
last, and a batch counts only when they are there, so rows of a batch that broke off are never seen. Runs that
go by files, without a key, write to ``plain``.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import path_exists

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A name that no file has.
_NO_FILE = "_none_"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException:
        return None  # nothing written yet


def done_articles(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The ids (key) of all articles that runs into ``target`` have finished, those without a hit among them."""
    done = _stored(spark, f"{target}/done")
    return spark.createDataFrame([], T.StructType([T.StructField(key, T.StringType())])) if done is None else done.select(key).distinct()


def _known_ids(spark: SparkSession, target: str, key: str, source_key: str, kind: T.DataType) -> DataFrame:
    """The ids that runs into ``target`` have finished, as the source has them; of runs without a key those of their rows."""
    out = spark.createDataFrame([], T.StructType([T.StructField(source_key, kind)]))
    for table, column in (("done", source_key), ("plain", key)):
        stored = _stored(spark, f"{target}/{table}")
        if stored is not None and column in stored.columns:
            out = out.unionByName(stored.select(F.col(column).cast(kind).alias(source_key)))
    return out.distinct()


def _prime(spark: SparkSession, schema: T.StructType, target: str, checkpoint: str, key: str, source_key: str) -> str:
    """A folder with the ids that the state of a new checkpoint begins with: those that ``target`` has finished."""
    folder = f"{target}/known/{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"
    if not path_exists(spark, f"{checkpoint}/offsets"):
        _known_ids(spark, target, key, source_key, schema[source_key].dataType).write.mode("overwrite").parquet(folder)
    return folder


def run_incremental(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    file_format: str = "parquet",
    glob: str | None = None,
    key: str | None = None,
    source_key: str | None = None,
) -> None:
    """Process what is new in ``source``, then stop. ``transform`` must work on each article by itself.

    Without ``key``, every file is processed once under a checkpoint. With it, every article is: ``source_key`` (by
    default ``key``) is its id in the source. An article that comes again, in the same batch, a later one, a later
    run or under another checkpoint, is left out; its first copy counts, and copies are taken as equal. Rows with
    a null id are left out.

    Ids that were seen are keyed state of the stream (in RocksDB, so not in memory), and a batch looks up its own
    ids only: its cost does not grow with the target. A new checkpoint, also one that replaces a lost one, takes the
    finished ids from the target into its state first, in a run of its own that sees no article.

    Every micro-batch writes its own folders, named by the run (which the checkpoint keeps) and the batch, in
    overwrite mode: a batch repeated after a failure replaces its own output and nothing else.
    """
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    id_col = source_key or key
    known = _prime(spark, schema, target, checkpoint, key, id_col) if key else None

    def drain(pattern: str | None) -> None:
        reader = spark.readStream.format(file_format).schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        rows = reader.load(source)
        if key:
            ids = spark.readStream.schema(T.StructType([T.StructField(id_col, schema[id_col].dataType)])).parquet(known)
            rows = rows.filter(F.col(id_col).isNotNull()).withColumn("_known", F.lit(False))
            rows = rows.unionByName(ids.withColumn("_known", F.lit(True)), allowMissingColumns=True).dropDuplicates([id_col])
        started, run = threading.Event(), []

        def write(batch: DataFrame, batch_id: int) -> None:
            started.wait()
            folder = f"run={run[0]}/batch={batch_id}"
            if not key:
                transform(batch).write.mode("overwrite").parquet(f"{target}/plain/{folder}")
                return
            fresh = batch.filter("not _known").drop("_known").persist()
            transform(fresh).write.mode("overwrite").parquet(f"{target}/rows/{folder}")
            fresh.select(F.col(id_col)).write.mode("overwrite").parquet(f"{target}/done/{folder}")
            fresh.unpersist()

        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.append(query.id)
        started.set()
        query.awaitTermination()

    before = spark.conf.get(_PROVIDER, None)
    try:
        if key:
            spark.conf.set(_PROVIDER, _ROCKSDB)
            if not path_exists(spark, f"{checkpoint}/commits/0"):
                drain(_NO_FILE)
        drain(glob)
    finally:
        if key and before is None:
            spark.conf.unset(_PROVIDER)
        elif key:
            spark.conf.set(_PROVIDER, before)


def incremental_result(spark: SparkSession, target: str) -> DataFrame:
    """Everything that finished batches have written so far."""
    rows, done, plain = (_stored(spark, f"{target}/{x}") for x in ("rows", "done", "plain"))
    if rows is not None:
        finished = spark.createDataFrame([], rows.select("run", "batch").schema) if done is None else done.select("run", "batch").distinct()
        rows = rows.join(F.broadcast(finished), ["run", "batch"], "left_semi")
    parts = [x.drop("run", "batch") for x in (rows, plain) if x is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
