"""Largest inner products against all of them."""

import math
import random

import pytest
from hypograph.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k):
    import numpy as np

    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in kept}:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in kept if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=10, block=8192):
    vectors = topk.integer_vectors(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA))
    out = topk.top_inner_products(vectors, vectors.filter("vec_id % 100 = 0"), k, block)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())


@pytest.mark.parametrize("block", [3, 8192])
def test_equals_all_products(spark, block):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1 / (d + 1)) * (1 + 5 * (i % 17 == 0)) for d in range(24)]) for i in range(900)]
    assert run(spark, rows, 10, block) == brute(rows, 10)


def test_ties_nulls_and_ragged_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5]) for i in range(230)] + [(300, [0.0, 0.0]), (400, []), (401, [1.0]), (402, [1.0, 0.5, 9.0])]
    rows += [(403, None), (404, [1.0, None]), (405, [nan, 1.0]), (500, [inf, 1.0]), (5, [1.0, 0.5]), (None, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows, 10)


def test_very_large_components(spark):
    rows = [(i, [float(2**20 + i), -float(i)]) for i in range(120)]
    assert run(spark, rows) == brute(rows, 10)


def test_fewer_than_k_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 2048 * 1024)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []
