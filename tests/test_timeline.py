"""Mention series against numpy and plain loops, with skewed keys and dates."""

import random
from datetime import date

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from hypograph.functions import dates as dt
from hypograph.operators import timeline as tl

DAY = 86400
SCHEMA = "k string, id bigint, ts bigint"


def _series(seed, sizes, days):
    rng = random.Random(seed)
    out, n = [], 0
    for k, size in enumerate(sizes):
        for _ in range(size):
            ts = None if rng.random() < 0.1 else rng.randrange(days) * DAY
            out.append((f"k{k}", n, ts))
            n += 1
    return out


def _ordered(data):
    groups = {}
    for k, i, ts in data:
        if ts is not None:
            groups.setdefault(k, []).append((ts, i))
    return {k: sorted(v) for k, v in groups.items()}


@pytest.mark.parametrize(("seed", "sizes", "days"), [(1, [3, 8, 60, 1], 400), (2, [50, 30], 4), (3, [25], 1)])
def test_frequency_derivative_equals_numpy(spark, seed, sizes, days):
    data = _series(seed, sizes, days)
    df = spark.createDataFrame(data, SCHEMA)
    got = rows(tl.frequency_derivative(df, ["k"]).na.fill(-99.0), "k", "seq", "id", "freq_sec_deriv")
    want = []
    for k, items in _ordered(data).items():
        stamps = [x[0] for x in items]
        for seq, (_, i) in enumerate(items):
            value = -99.0
            if seq >= 3:
                hist, _ = np.histogram(stamps[:seq])
                value = float(sum(np.gradient(np.gradient(hist))))
            want.append((k, seq, i, value))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=1e-9)


def test_hot_key_on_one_date(spark):
    """A key with most rows, nearly all on one date, is numbered in several parts."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        "id",
        F.when(F.col("id") % 100 == 0, F.col("id") * DAY).otherwise(F.lit(5 * DAY)).cast("bigint").alias("ts"),
    )
    out = tl.mention_series(df, ["k"])
    check = out.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.max("seq").alias("m"))
    assert check.filter("n <> d or m <> n - 1").count() == 0
    back = out.join(out.withColumnRenamed("ts", "t2").withColumn("seq", F.col("seq") - 1).select("k", "seq", "t2"), ["k", "seq"])
    assert back.filter("t2 < ts").count() == 0


def test_order_is_date_and_id_whatever_the_parts(spark):
    data = _series(7, [60, 300, 5], 3)
    df = spark.createDataFrame(data, SCHEMA)
    want = [(k, seq, i) for k, items in _ordered(data).items() for seq, (_, i) in enumerate(items)]
    for parts in (1, 3, 11):
        assert rows(tl.mention_series(df, ["k"], parts=parts), "k", "seq", "id") == sorted(want)
    windows = [rows(tl.neighbour_windows(df, ["k"], "id", n=3, parts=parts), "k", "last_seq", "window") for parts in (1, 7)]
    assert windows[0] == windows[1]


def test_gaps(spark):
    data = _series(4, [1, 2, 30, 40], 12)
    df = spark.createDataFrame(data, SCHEMA)
    want = []
    for k, items in _ordered(data).items():
        stamps = [x[0] for x in items]
        want += [(k, i, abs(v - stamps[(i + 1) % len(stamps)])) for i, v in enumerate(stamps)]
    assert rows(tl.mention_gaps(df, ["k"]), "k", "seq", "gap") == sorted(want)
    counts = {}
    for k, _, gap in want:
        counts[k, gap] = counts.get((k, gap), 0) + 1
    assert rows(tl.gap_counts(df, ["k"]), "k", "gap", "n") == sorted((*key, n) for key, n in counts.items())


def test_histogram_equals_numpy(spark):
    rng = random.Random(5)
    data = [("a", rng.randrange(1000)) for _ in range(200)] + [("b", 7)] * 5 + [("c", 1), ("c", 11)]
    df = spark.createDataFrame(data, "k string, x bigint").groupBy("k", "x").agg(F.count("*").alias("n"))
    got = {(r.k, r.bin): r.n for r in tl.equal_width_histogram(df, ["k"], "x").collect()}
    for key in "abc":
        hist, _ = np.histogram([x for k, x in data if k == key])
        assert [got.get((key, b), 0) for b in range(10)] == list(hist)


def test_time_histogram_fills_empty_bins(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 5 * DAY), ("a", 3, 100 * DAY), ("b", 4, 3 * DAY)], SCHEMA)
    out = rows(tl.time_histogram(df, ["k"]), "k", "bin", "n")
    assert out == [("a", 0, 2), ("a", 1, 0), ("a", 2, 1), ("b", 0, 1)]


def test_neighbour_windows(spark):
    df = spark.createDataFrame([("a", i, i * DAY) for i in range(5)] + [("b", 9, 0)], SCHEMA)
    out = rows(tl.neighbour_windows(df, ["k"], "id", n=3), "k", "last_seq", "window")
    assert out == [("a", 2, [0, 1, 2]), ("a", 3, [1, 2, 3]), ("a", 4, [2, 3, 4])]


def test_profile_rules(spark):
    data = [("t", 501, True), ("t2", 500, True), ("f", 1001, False), ("f2", 1000, False), ("s", 201, False), ("s2", 2, True), ("s3", 200, False)]
    df = spark.createDataFrame(data, "k string, n int, any_fact boolean")
    out = tl.profiled(df, F.col("k").startswith("s"))
    assert rows(out, "k", "kind") == [("f", "false"), ("s", "false"), ("s2", "true"), ("t", "true")]


def test_windows_of_months(spark):
    df = spark.createDataFrame([(date(2010, 1, 5),), (date(2010, 2, 1),), (date(2010, 2, 9),), (date(2011, 1, 1),), (None,)], "pub_date date")
    months = tl.monthly(df)
    trailing = tl.trailing_windows(months, {"month": 1, "year": 12})
    got = {(r.window, str(r.window_end)): r.n for r in trailing.collect()}
    assert got["year", "2010-12-01"] == 3 and got["year", "2011-01-01"] == 3 and got["month", "2010-02-01"] == 2
    assert ("month", "2010-03-01") not in got
    assert rows(tl.cumulative_windows(months, 3), "n_until") == [(3,), (4,)]
    assert tl.model_grid(months).count() == 3 * 5 * 2 + 2 * 2


def test_dates_ignore_the_session_zone(spark):
    df = spark.createDataFrame([("14-8-2010",), ("1-Aug-2010",), ("--2010",), ("31-2-2010",), ("8-2010",), ("4-5-2010x",)], "d string")
    out = {r.d: (r.ts, r.y, r.m) for r in df.select("d", dt.epoch_seconds(dt.parse_date(F.col("d"))).alias("ts"), dt.year_of(F.col("d")).alias("y"), dt.month_of(F.col("d")).alias("m")).collect()}
    assert out["14-8-2010"] == (1281744000, 2010, 8)
    assert out["1-Aug-2010"] == (1280620800, 2010, None)
    assert out["--2010"] == (None, 2010, None)
    assert out["31-2-2010"] == (None, 2010, 2)
    assert out["8-2010"] == (None, None, None)
    tags = spark.createDataFrame([("PMC_2010_Aug_12.fxml",), ("none.fxml",)], "p string")
    assert [str(r[0]) for r in tags.select(dt.tagged_month(F.col("p"))).collect()] == ["2010-08-01", "None"]
