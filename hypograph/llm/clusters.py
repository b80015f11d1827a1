"""Centroid clustering of vectors with expressions alone.

Components become integers, so distances, sums and means are exact and do not depend on the order of rows. The
centroids of a round are literals of its plan: ``zip_with`` and ``aggregate`` give the squared distance to each,
``array_min`` over (distance, number) the nearest. Sums per cluster are column sums with partial aggregation, so
a cluster that holds most vectors costs each task one row. What the driver sees is one row per cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import written

Centroids = Sequence[Sequence[int]]


def integer_vectors(table: DataFrame, size: int, scale: int, column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of the components of vectors with exactly ``size`` finite ones.

    Null vectors, other lengths, null and non-finite components are left out. Repeated rows stay.
    """
    doubles = F.transform(f"`{column}`", lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # noqa: E731  NaN is above infinity
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v"))
    rows = rows.filter((F.size("v") == size) & F.forall("v", finite))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors (all, if fewer) with the least SHA-256 of ``seed:vec_id``, ties by components."""
    order = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), "utf-8"), 256)
    found = vectors.filter("vec_id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(k)
    return [list(r["v"]) for r in found.collect()]


def _distance(centroid: Sequence[int]) -> str:
    """Squared distance of ``v`` to a literal centroid, in SQL: one text is planned much faster than 40 trees of columns."""
    literal = f"cast(split('{','.join(map(str, centroid))}', ',') AS array<bigint>)"
    return f"aggregate(zip_with(v, {literal}, (x, c) -> (x - c) * (x - c)), 0L, (total, x) -> total + x)"


def assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """``vectors`` with cluster and distance (squared Euclidean) of the nearest centroid, ties to the smaller number."""
    choices = ", ".join(f"struct({_distance(c)} AS distance, {i} AS cluster)" for i, c in enumerate(centroids))
    return vectors.withColumn("nearest", F.expr(f"array_min(array({choices}))")).select(*vectors.columns, "nearest.cluster", "nearest.distance")


def updated(vectors: DataFrame, centroids: Centroids) -> list[list[int]]:
    """Centroids after one round: the floor of the mean of each cluster's vectors; an empty cluster keeps its own."""
    size = len(centroids[0])
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(size)]
    new = [list(c) for c in centroids]
    for r in assigned(vectors, centroids).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return new


def clusters(table: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector of ``table`` (vec_id, embedding).

    Vectors take part if they have exactly ``size`` components, none null or non-finite; each component x counts
    as floor(scale * x). ``cluster_inertia`` and ``inertia`` are the distances summed over the cluster and over all,
    ``centroid_sha256`` the hash of the final centroid's components as decimal integers with commas between.

    * A null vec_id is no starting centroid, but such a row is assigned and counts in the means.
    * Rows that repeat are vectors of their own; those that repeat an id with other components start in the
      order of their components. Fewer than ``k`` vectors are as many centroids.
    * An empty table, or one without a vector that takes part, gives an empty result.
    * Distances and sums are longs; what does not fit is an error of the job, never a wrong number.
    * Other columns are ignored, whatever their names.

    The table is read once a round (``rounds`` + 2 times) and never shuffled; only the last assignment, without
    the components, is written to the shared folder.
    """
    vectors = integer_vectors(table, size, scale)
    centroids = first_centroids(vectors, k, seed)
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return table.sparkSession.createDataFrame([], empty)
    for _ in range(rounds):
        centroids = updated(vectors, centroids)
    last = written(assigned(vectors, centroids).select("vec_id", "cluster", "distance"), "clusters")
    inertia = {r["cluster"]: r["s"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    by_cluster = lambda values: F.get(F.array(*values), F.col("cluster"))
    own = by_cluster([F.lit(inertia.get(i, 0)).cast("long") for i in range(len(centroids))])
    digest = by_cluster([F.sha2(F.encode(F.lit(",".join(map(str, c))), "utf-8"), 256) for c in centroids])
    total = F.lit(sum(inertia.values())).cast("long")
    return last.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), total.alias("inertia"), digest.alias("centroid_sha256"))
