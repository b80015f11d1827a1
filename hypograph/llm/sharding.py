"""Balanced shards by histogram sort.

Keys are long integers. Splitters between shards are found by counting, not sampling: each round counts the
exact bytes (and rows) below a set of candidate boundaries over all partitions, keeps for every splitter the
interval that still holds its target, and probes that interval more finely, until all splitters are within the
tolerance or their interval is a single key. Only then the rows move, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBES = 64
TOLERANCE = 0.001
#: Rows that one task of the exchange sorts; a shard has as many ranges as it takes.
RANGE_ROWS = 500_000

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Splitters:
    """Shard i holds the keys from ``keys[i - 1]`` (included) to ``keys[i]``; ``rows`` and ``bytes`` lie below each."""

    keys: list[int]
    rows: list[int]
    bytes: list[int]


def _place(rows: DataFrame, keys: np.ndarray, name: str) -> DataFrame:
    """The number of boundaries that are not above each key, as one more column."""
    shared = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(shared.value, batch.column("key").to_numpy(zero_copy_only=False), side="right")
            yield batch.append_column(name, pa.array(at, pa.int32()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.IntegerType())]))


def _below(rows: DataFrame, probes: list[int]) -> tuple[dict[int, int], dict[int, int]]:
    """Exact bytes and rows under every probe: partial sums per task, a row per gap between probes."""
    counts = _place(rows, np.array(probes, dtype=np.int64), "gap").groupBy("gap").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    found = {x["gap"]: (x["bytes"], x["rows"]) for x in counts.collect()}
    low_bytes, low_rows, total, n = {}, {}, 0, 0
    for i, probe in enumerate(probes):
        more = found.get(i, (0, 0))
        total, n = total + more[0], n + more[1]
        low_bytes[probe], low_rows[probe] = total, n
    return low_bytes, low_rows


def find_splitters(rows: DataFrame, shards: int, probes: int = PROBES, tolerance: float = TOLERANCE) -> Splitters:
    """Splitters of (key long, size long) rows into ``shards`` ranges of nearly equal bytes.

    What comes to the driver is one sum per probe: shards x probes numbers a round, about ten rounds at most.
    """
    total, n, low, high = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.min("key"), F.max("key")).first()
    if not n:
        return Splitters([_HIGH] * (shards - 1), [0] * (shards - 1), [0] * (shards - 1))
    targets = np.array([total * i / shards for i in range(1, shards)])
    slack = tolerance * total / shards
    # Nothing lies below the least key, everything below the one after the greatest.
    known = {low: (0, 0), high + 1: (total, n)}
    while True:
        keys = sorted(known)
        below = np.array([known[k][0] for k in keys], dtype=np.float64)
        right = np.minimum(np.searchsorted(below, targets), len(keys) - 1)
        left = np.maximum(right - 1, 0)
        nearest = np.where(np.abs(below[left] - targets) <= np.abs(below[right] - targets), left, right)
        unmet = np.flatnonzero(np.abs(below[nearest] - targets) > slack)
        wanted: set[int] = set()
        for a, b in {(keys[left[i]], keys[right[i]]) for i in unmet}:
            wanted |= {a + (b - a) * i // (probes + 1) for i in range(1, probes + 1)}
        wanted -= set(known)
        if not wanted:
            break
        sizes, counts = _below(rows, sorted(wanted))
        known |= {k: (sizes[k], counts[k]) for k in wanted}
    chosen = [keys[i] for i in nearest]
    return Splitters(chosen, [known[k][1] for k in chosen], [known[k][0] for k in chosen])


def shard(rows: DataFrame, shards: int, range_rows: int = RANGE_ROWS, probes: int = PROBES, tolerance: float = TOLERANCE) -> DataFrame:
    """``rows`` (key long, size long, any others) with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0).

    Shards are ranges of the key with nearly equal bytes, slots follow the key. Shards are found as groups of
    finer ranges of at most about ``range_rows`` rows, so one exchange gives every task a bounded sort, and a
    slot is the rank in its range plus the exact count of rows below the range. ``rows`` is read once per
    round, so it should be a written table of few columns.

    Rows with the same key stay together, so equal shards need keys that repeat little. Null keys come first.
    Ties in the key are ordered by size and then by the other columns; equal rows are interchangeable. An empty
    table gives an empty result. The columns ``shard``, ``slot``, ``range``, ``gap`` and ``below`` are taken.
    """
    key = F.least(F.coalesce("key", F.lit(_LOW)), F.lit(_HIGH - 1))
    narrow = rows.select(key.alias("key"), "size")
    ranges = max(1, -(-narrow.count() // (range_rows * shards)))
    found = find_splitters(narrow, shards * ranges, probes, tolerance)
    below = np.array([0, *found.rows], dtype=np.int64)
    placed = _place(rows.withColumn("key", key), np.array(found.keys, dtype=np.int64), "range")
    first = below[::ranges]
    bases = rows.sparkSession.createDataFrame(
        [(i, i // ranges, int(below[i] - first[i // ranges])) for i in range(shards * ranges)], "range int, shard int, below long"
    )
    others = [c for c in rows.columns if c not in ("key", "size")]
    rank = F.row_number().over(Window.partitionBy("range").orderBy("key", "size", *others)) - 1
    # One row per range: shards x rows / (range_rows x shards) of them.
    ranked = placed.withColumn("slot", rank.cast("long")).join(F.broadcast(bases), "range")
    return ranked.withColumn("slot", F.col("slot") + F.col("below")).drop("range", "below")
