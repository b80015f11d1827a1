"""Prefix trie against a plain Python version."""

import hashlib
import random
import zlib

import pytest

from hypograph.llm import trie
from llm_corpus import CLASHING

SCHEMA = "conv_id long, turn long, role string, text string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Expected rows; turns with one number and role must have one text here."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + x[h:]
    members = {}
    for c, x in full.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), set()).add(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = [out[k] for k in kids.get(node, [])]
        m = members[node]
        saved = (len(m) - 1) * len(node[-1][1]) if node else 0
        ends = ",".join(str(c) for c in sorted(c for c in m if len(full[c]) == len(node)))
        out[node] = [
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(below), sum(x[5] for x in below) or 1,
            saved + sum(x[6] for x in below), hashlib.sha256(ends.encode()).hexdigest(),
        ]
    return sorted((tuple(x) for x in out.values()), key=repr)


def found(df):
    assert df.columns == OUT
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(seed, n):
    """Conversations that share long beginnings, some equal, some inside others, one long, some without a base."""
    r, rows = random.Random(seed), []
    for c in [*range(0, n), *range(700, 703), 1500]:
        if c % 100 == 50:
            continue
        path, turns = [], r.choice([0, 1, 2, 3, 8, 9, 30]) if c else 8
        for d in range(turns):
            path.append("a" if r.random() < 0.9 else r.choice("bcdé"))
            rows.append((c, d + 1, "user" if d % 2 else None, "".join(path[-1:]) * (d % 3)))
    return rows


@pytest.mark.parametrize("batches", [1, 3])
def test_trie(spark, monkeypatch, batches):
    monkeypatch.setattr(trie, "GROWTH", 2)
    rows = conversations(batches, 120)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(trie.prefix_trie(table, batches)) == plain(rows)


def test_chunks_of_one_conversation(spark, monkeypatch):
    """A conversation with most of all turns goes through many ranges and chunks."""
    monkeypatch.setattr(trie, "CHUNK", 4)
    rows = [(7, i, "user", "x" * (i % 5)) for i in range(60)] + [(8, i, "user", "x" * (i % 5)) for i in range(30)] + [(9, 1, "user", "y")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(trie.prefix_trie(table)) == plain(rows)


def test_odd_rows(spark):
    """Nulls in any column, repeated rows, ties, empty and very long texts, clashing names, ids beyond the base."""
    rows = [
        (None, 1, "user", "no id"), (3, None, None, None), (3, None, None, None), (3, 2, "user", ""), (3, 2, "bot", "x"),
        (100, 1, "user", "long " * 200_000), (101, 1, "user", "long " * 200_000), (101, 2, None, "end"), (5, 1, "user", "alone"), (200, 1, "user", None),
        (-150, 1, "user", "below zero"), (2**62, 1, "user", "far"),
    ]
    wide = [(*x, *("clash" for _ in CLASHING), "c", 1) for x in rows]
    table = spark.createDataFrame(wide, SCHEMA + "".join(f", `{c}` string" for c in CLASHING) + ", c string, p int")
    # Remainders of ids below zero are those of SQL here.
    assert found(trie.prefix_trie(table)) == plain([(c, *x) for c, *x in rows])


def test_ties_do_not_depend_on_partitions(spark):
    rows = [(1, 1, "user", f"t{i}") for i in range(9)]
    one, two = (found(trie.prefix_trie(spark.createDataFrame(x, SCHEMA).repartition(n))) for x, n in ((rows, 1), (rows[::-1], 6)))
    assert one == two and len(one) > 1


def test_empty(spark):
    assert found(trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    assert found(trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    best = [max(range(a + 1, b + 1), key=lambda x: x & -x) for a, b in pairs]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", trie.two_fattest("a", "b").alias("f"))
    assert {(r["a"], r["b"]): r["f"] for r in df.collect()} == dict(zip(pairs, best, strict=True))


def test_query(spark, tmp_path):
    from hypograph.llm import queries

    rows = conversations(9, 40)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(queries.op11_prefix_trie(spark, str(tmp_path))) == plain(rows)
