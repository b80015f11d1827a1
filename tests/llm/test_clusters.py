"""Clustering against plain Python."""

import hashlib
import math
import random

import pytest
from llm_corpus import CLASHING

from hypograph.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds, size, scale=256, seed=2):
    """Rows of single-precision numbers that are exact in the fixture."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(cents)):
            own = [v for (_, v), (_, m) in zip(kept, near, strict=True) if m == n]
            cents[n] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else cents[n]
    near = assign()
    per = {n: sum(d for d, m in near if m == n) for n in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, d, per[n], sum(per.values()), sha[n]) for (i, _), (d, n) in zip(kept, near, strict=True)), key=repr)


def found(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n, size, seed=1):
    r = random.Random(seed)
    return [(i, [r.randrange(-512, 512) / 128 + (i % 5) for _ in range(size)]) for i in range(n)]


@pytest.mark.parametrize(("k", "rounds"), [(7, 4), (1, 2), (60, 1)])
def test_clusters(spark, k, rounds):
    rows = vectors(50, 6)
    table = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA).repartition(3)
    assert found(clusters.clusters(table, k, rounds, 6)) == plain(rows, k, rounds, 6)


def test_odd_rows(spark):
    """Nulls anywhere, wrong sizes, not finite, repeats, ties between equal centroids, a null id, clashing names."""
    rows = vectors(12, 4, 5)
    rows += [rows[0], rows[0], (3, rows[4][1]), (None, rows[5][1]), (90, None), (91, [1.0, None, 1.0, 1.0]), (92, [1.0] * 3), (93, [1.0] * 5), (94, [])]
    rows += [(95, [1.0, float("nan"), 1.0, 1.0]), (96, [1.0, float("inf"), 1.0, 1.0]), (97, [float("-inf")] * 4), (98, [-0.001953125] * 4), (99, [-0.0] * 4)]
    names = [*CLASHING, "v", "cluster", "distance", "nearest"]
    table = spark.createDataFrame([(*x, 1, *("z" for _ in names)) for x in rows], SCHEMA + "".join(f", `{c}` string" for c in names))
    assert found(clusters.clusters(table, 20, 3, 4)) == plain(rows, 20, 3, 4)


def test_empty_clusters_keep_their_centroid(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)]
    got = found(clusters.clusters(spark.createDataFrame([(*x, 0) for x in rows], SCHEMA), 5, 3, 2))
    assert got == plain(rows, 5, 3, 2) and {r[1] for r in got} == {0}


def test_nothing_takes_part(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0], 0)]):
        assert found(clusters.clusters(spark.createDataFrame(rows, SCHEMA), 3, 2, 2)) == []


def test_values_beyond_long_are_an_error(spark):
    rows = [(i, [3e30, 1.0 * i], 0) for i in range(3)] + [(9, [-3e30, 0.0], 0)]
    with pytest.raises(Exception, match="(?i)overflow"):
        clusters.clusters(spark.createDataFrame(rows, SCHEMA), 2, 1, 2).collect()


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(*x, 1) for x in vectors(9, 6)], SCHEMA)
    found_ = clusters.assigned(clusters.integer_vectors(table, 6, 256), [[0] * 6, [1] * 6])
    plan = found_._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(spark, tmp_path):
    from hypograph.llm import queries

    rows = vectors(45, 64, 8)
    spark.createDataFrame([(*x, 1) for x in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert found(queries.op13_clusters(spark, str(tmp_path))) == plain(rows, 40, 5, 64)
