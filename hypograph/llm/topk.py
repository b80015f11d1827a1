"""Exact search for the largest inner products, on norm-sorted integer vectors.

Vectors are rotated by the singular vectors of the whole set, so most of an inner product lies in the first
coordinates. A task meets its vectors by descending length and, for a block of queries, adds up partial sums:
lengths alone, then the leading coordinates, each with a Cauchy-Schwarz bound on what is left, against the
k-th best score so far. Only what survives is scored, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sizing import written

SCALE = 1024
#: Queries that one pass holds in a task; more queries take more passes over the vectors.
QUERY_BLOCK = 8192
#: Vectors that are met at once.
ITEM_BLOCK = 1024
#: Leading rotated coordinates of the first partial sum.
LEADING = 8


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) with floor(scale * x) of every component; rows with a null or non-finite one are left out."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter("x is not null and vec_id is not null").filter(finite)
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * float(scale))).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A row per vector; shorter ones are filled up with zeros, which changes no inner product."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, the largest first, from the sum of their outer products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("v"), dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    sums = rows.select("v").mapInArrow(run, "i int, row array<double>").groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(dim)])
    gram = np.zeros((dim, dim))
    for row in sums.collect():  # dim x dim numbers
        gram[row["i"]] = row[1:]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


class Search:
    """The best k of a stream of vectors for a block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int, floors: np.ndarray):
        self.ids, self.queries, self.turn, self.k = ids, queries, turn, k
        self.rotated = queries @ turn
        self.norms = np.linalg.norm(self.rotated, axis=1)
        self.rest = np.linalg.norm(self.rotated[:, LEADING:], axis=1)
        self.exact = np.abs(queries).max(initial=0) < 1 << 20
        #: Scores that each query is known to reach k times over
        self.floors = floors.copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def meet(self, ids: np.ndarray, items: np.ndarray) -> None:
        order = np.argsort(-np.einsum("ij,ij->i", items.astype(np.float64), items.astype(np.float64)), kind="stable")
        ids, items = ids[order], items[order]
        exact = self.exact and np.abs(items).max(initial=0) < 1 << 20
        rotated = items @ self.turn
        norms = np.linalg.norm(rotated, axis=1)
        rest = np.linalg.norm(rotated[:, LEADING:], axis=1)
        for at in range(0, len(ids), ITEM_BLOCK):
            end = min(at + ITEM_BLOCK, len(ids))
            slack = 1e-6 * (1 + self.norms * norms[at])
            # The longest vector of the block bounds all scores of the block and of those after it.
            open_queries = np.flatnonzero(self.norms * norms[at] + slack >= self.floors)
            if not len(open_queries):
                return
            lead = self.rotated[open_queries, :LEADING] @ rotated[at:end, :LEADING].T
            bound = lead + self.rest[open_queries, None] * rest[None, at:end] + slack[open_queries, None]
            alive = bound >= self.floors[open_queries, None]
            wanted = np.flatnonzero(alive.any(axis=1))
            if not len(wanted):
                continue
            rows = open_queries[wanted]
            if exact:
                scores = np.rint(self.queries[rows].astype(np.float64) @ items[at:end].T.astype(np.float64)).astype(np.int64)
            else:
                scores = self.queries[rows] @ items[at:end].T
            for i, q in enumerate(rows.tolist()):
                hit = np.flatnonzero(alive[wanted[i]] & (scores[i] >= self.floors[q]) & (ids[at:end] != self.ids[q]))
                if len(hit):
                    self._add(q, scores[i][hit], ids[at:end][hit])

    def _add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            keep = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[keep], ids[keep]
        self.best[q] = sorted([*self.best[q], *zip((-scores).tolist(), ids.tolist(), strict=True)])[: self.k]
        if len(self.best[q]) == self.k:
            self.floors[q] = max(self.floors[q], -self.best[q][-1][0])


def _pass(items: DataFrame, shared: Broadcast, dim: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of every partition, for one block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value)
        for batch in batches:
            search.meet(batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dim))
        flat = [(int(search.ids[q]), vec, -negative) for q, best in enumerate(search.best) for negative, vec in best]
        for at in range(0, len(flat), 10_000):
            columns = [pa.array([x[i] for x in flat[at : at + 10_000]], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return items.mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def top_inner_products(items: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query, ties to the smaller vec_id.

    ``items`` and ``queries`` are (vec_id, v array<long>) as ``integer_vectors`` makes them; a query never meets
    rows with its own id. ``items`` is spread by length, the longest in the first partitions. Queries are taken
    in blocks of about ``query_block``, chosen by a hash of their id, so what a task holds does not grow with
    their number. For each block the longest vectors are searched first; the k-th score found there is where
    all tasks begin to prune.

    Shorter vectors count as filled up with zeros. Every row is a candidate, repeated ones as well; a query row
    that is repeated is asked once, and different vectors under one query id share its ranks. Without items or
    queries the result is empty.
    """
    spark = items.sparkSession
    stored = written(items.withColumn("length2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), "vectors")
    n, dim = stored.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    asked = written(queries.select("vec_id", "v").distinct(), "queries")
    n_queries, query_dim = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(dim, query_dim, 1)
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(stored, dim)
    partitions = max(1, -(-n // 65_536), min(spark.sparkContext.defaultParallelism, -(-n // 4096)))
    by_length = written(stored.repartitionByRange(partitions, F.desc("length2")).sortWithinPartitions(F.desc("length2")), "by_length")
    longest = by_length.orderBy(F.desc("length2")).limit(max(4 * k, 512))
    blocks = -(-n_queries // query_block)
    results = []
    for block in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == block)
        taken = own.collect()  # about ``query_block`` rows
        if not taken:
            continue
        ids = np.array([x["vec_id"] for x in taken], dtype=np.int64)
        matrix = np.zeros((len(taken), dim), dtype=np.int64)
        for i, x in enumerate(taken):
            matrix[i, : len(x["v"])] = x["v"]
        none = np.full(len(ids), -np.inf)
        send = spark.sparkContext.broadcast
        shared = send((ids, matrix, turn, k, none))
        first = _ranked(_pass(longest.coalesce(1), shared, dim), k).filter(F.col("rank") == k)
        reached = {x["query_id"]: x["score"] for x in first.select("query_id", "score").collect()}
        shared.unpersist()
        values, times = np.unique(ids, return_counts=True)
        shared_ids = set(values[times > 1].tolist())
        floors = np.array([-np.inf if x in shared_ids else reached.get(x, -np.inf) for x in ids.tolist()])
        shared = send((ids, matrix, turn, k, floors))
        found = _ranked(_pass(by_length, shared, dim), k)
        if blocks > 1:
            # Written, so that its queries need not stay broadcast while others are asked.
            found = written(found, "ranked")
            shared.unpersist()
        results.append(found)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return _ranked(out.drop("rank"), k).select("query_id", "rank", "vec_id", "score") if blocks > 1 else out.select("query_id", "rank", "vec_id", "score")
