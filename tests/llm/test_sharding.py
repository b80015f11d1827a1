"""Shards by histogram sort."""

import random
import zlib

import llm_corpus as c
import pytest
from hypograph.llm import queries, sharding

SCHEMA = "key long, size long, tag string"


def shards(rows, n):
    out = {i: [] for i in range(n)}
    for r in rows:
        out[r["shard"]].append(r)
    for own in out.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert [r["key"] for r in sorted(own, key=lambda r: r["slot"])] == sorted(r["key"] for r in own)
    return out


@pytest.mark.parametrize("range_rows", [7, 500_000])
def test_sizes_are_near_equal_and_keys_in_order(spark, range_rows):
    r = random.Random(3)
    rows = [(r.randrange(-(2**62), 2**62), r.choice([1, 5, 40]), "x") for _ in range(3000)]
    out = shards(sharding.shard(spark.createDataFrame(rows, SCHEMA), 24, range_rows).collect(), 24)
    sizes = [sum(x["size"] for x in own) for own in out.values()]
    assert max(sizes) - min(sizes) <= 100 and sum(map(len, out.values())) == 3000
    ends = [(min(x["key"] for x in own), max(x["key"] for x in own)) for own in out.values()]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_ties_and_a_hot_key_stay_whole(spark):
    rows = [(7, 10, "hot")] * 300 + [(i, 10, "x") for i in range(600)] + [(None, 3, "none"), (2**63 - 1, 4, "last"), (-(2**63), 4, "least")]
    out = shards(sharding.shard(spark.createDataFrame(rows, SCHEMA), 4).collect(), 4)
    assert sum(map(len, out.values())) == len(rows)
    assert len({k for k, own in out.items() for x in own if x["key"] == 7}) == 1


def test_fewer_rows_than_shards_and_none(spark):
    out = sharding.shard(spark.createDataFrame([(1, 5, "x"), (2, 5, "y")], SCHEMA), 24).collect()
    assert sorted(r["slot"] for r in out) in ([0, 0], [0, 1])
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 24).count() == 0


def test_query(spark, tmp_path):
    texts = ["", None, "é" * 10, *[c.text(i, 1 + i) for i in range(200)], *["copy of one"] * 100]
    c.docs(spark, texts, extra=c.CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op2_histogram_shards(spark, str(tmp_path)).collect()
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(b) + 8, zlib.crc32(b)) for i, b in raw.items()}
    total = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(24)]
    assert max(total) <= sum(total) / 24 + max(len(b) + 8 for b in raw.values())
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
