"""Measured broadcasts, joins on skewed keys, and the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 * 1024 * 1024
#: Rows of one key that a task of a shuffled join gets; a key with more is split.
GROUP_ROWS = 1_000_000
#: Keys that a join splits at most, so that their list can always be broadcast.
HEAVY_KEYS = 100_000
#: Whether an action's shuffle files are removed when it has ended.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Groups that rows with a null in the key are spread over: they match nothing.
NULL_SALTS = 1024


def _width(field: T.StructField):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        return F.octet_length(F.to_json(F.struct(column)))
    return F.lit(16)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a side: the count stops at ``max_rows + 1``, so a large side costs little to reject."""
    width = F.lit(0)
    for field in df.schema.fields:
        width = width + _width(field)
    seen = df.select(width.alias("w")).limit(max_rows + 1)
    with shuffles_freed(df.sparkSession):
        rows, size = seen.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """The side with a broadcast hint if it was measured as small, else unchanged (shuffle join)."""
    if fits_broadcast(df, max_rows, max_bytes):
        return F.broadcast(df), True
    return df, False


def heavy_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """(_key, _salts) of the keys with more than ``GROUP_ROWS`` rows, ``_key`` being the hash of the columns ``on``.

    Keys are counted with partial aggregation, so what is shuffled is a row per distinct key and map task. A key is
    listed if it has more than ``GROUP_ROWS`` rows and more than one in ``HEAVY_KEYS`` of all rows; so the list has
    fewer than ``HEAVY_KEYS`` rows whatever the input.
    """
    counts = written(rows.groupBy(F.xxhash64(*[F.col(f"`{c}`") for c in on]).alias("_key")).agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(GROUP_ROWS, total // HEAVY_KEYS)
    return counts.filter(F.col("n") > limit).select("_key", F.ceil(F.col("n") / limit).cast("int").alias("_salts"))


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on columns of the same names, where keys of ``left`` may be hot.

    ``right`` is broadcast if it was measured as small. Otherwise the keys of ``left`` are counted, a key with more
    than ``GROUP_ROWS`` rows is split into as many groups as it fills, and only the rows of ``right`` with such a
    key are repeated, once for each group. Rows with a null in the key, which match nothing, are spread. For inner,
    left, semi and anti joins; the result is the same either way. Rows of ``left`` are dealt out by a hash of all
    their columns, so only rows that are equal throughout stay together.
    """
    side, is_small = small_side(right)
    if is_small:
        return left.join(side, on, how)
    typed = [F.col(f"`{c}`").cast(left.schema[c].dataType) for c in on]
    heavy = F.broadcast(heavy_keys(left, on))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    absent = F.lit(False)
    for c in on:
        absent = absent | F.col(f"`{c}`").isNull()
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.when(absent, F.lit(NULL_SALTS)).otherwise(salts)).cast("int")
    split = left.withColumn("_key", F.xxhash64(*typed)).join(heavy, "_key", "left").withColumn("_salt", spread).select(*left.columns, "_salt")
    repeated = right.withColumn("_key", F.xxhash64(*typed)).join(heavy, "_key", "left")
    repeated = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(*right.columns, "_salt")
    return split.join(repeated, [*on, "_salt"], how).drop("_salt")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder shared by all executors.

    The cluster names that folder in ``spark.checkpoint.dir``; where it does not, the warehouse is shared as
    well. There is no other choice: a folder of the driver's own machine would be lost on executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffle files from all executors when they end.

    Else the files stay until the driver happens to collect its garbage, so a job of many steps keeps those of all of
    them. A plan that needs such files again makes them again.
    """
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared scratch folder.

    Cuts the lineage where several jobs follow on one result; the files outlive lost executors, and the shuffle files
    that made them go. ``dropped`` removes a table that is not read again; the others are cleared by whoever owns the
    shared folder, when the application has ended.
    """
    path = scratch_dir(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave, after all that reads them is stored itself; others are left alone."""
    for table in tables:
        if (path := getattr(table, "__dict__", {}).get("_written_to")) is not None:
            removed(table.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder under ``scratch_dir`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
