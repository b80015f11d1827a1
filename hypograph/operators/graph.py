"""Relation graph: vertices (id, attr) and edges (src, dst, relationship) from triples (s, p, o)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizing import keyed_join, written


def trim_uri(uri: Column) -> Column:
    """The last two path parts of a ``<http://...>`` reference, anything else unchanged."""
    short = F.substring_index(F.replace(uri, F.lit(">"), F.lit("")), "/", -2)
    return F.when(uri.startswith("<http://"), short).otherwise(uri)


def edges(spo: DataFrame) -> DataFrame:
    return spo.select(
        trim_uri(F.col("s")).alias("src"),
        trim_uri(F.col("o")).alias("dst"),
        trim_uri(F.col("p")).alias("relationship"),
    )


def vertices(spo: DataFrame, distinct: bool = False) -> DataFrame:
    """Subjects as ``attr0`` and objects as ``attr1``; repeated unless ``distinct``."""
    rows = spo.select(
        F.explode(
            F.array(
                F.struct(trim_uri(F.col("s")).alias("id"), F.lit("attr0").alias("attr")),
                F.struct(trim_uri(F.col("o")).alias("id"), F.lit("attr1").alias("attr")),
            )
        ).alias("v")
    ).select("v.*")
    return rows.distinct() if distinct else rows


def in_degrees(graph_edges: DataFrame) -> DataFrame:
    return graph_edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))


def top_in_degrees(graph_edges: DataFrame, n: int = 3) -> DataFrame:
    return in_degrees(graph_edges).orderBy(F.desc("in_degree"), "id").limit(n)


def edges_like(graph_edges: DataFrame, pattern: str) -> DataFrame:
    """Edges whose relationship matches a SQL LIKE pattern."""
    return graph_edges.filter(F.col("relationship").like(pattern))


def named_subjects(graph_edges: DataFrame, pattern: str, subject: str, value: str) -> DataFrame:
    """Six-character code at the end of the subject with its object, as in a drug-name lookup."""
    return edges_like(graph_edges, pattern).select(
        F.expr("substring(src, length(src) - 7, 6)").alias(subject), F.col("dst").alias(value)
    )


def relationship_counts(graph_edges: DataFrame) -> DataFrame:
    return graph_edges.groupBy("relationship").agg(F.count("*").alias("n"))


def edge_motif(graph_edges: DataFrame, pattern: str) -> DataFrame:
    """The motif ``()-[e]->()`` with a predicate on e."""
    return edges_like(graph_edges, pattern)


def two_hop_counts(graph_edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Number of paths ``(x)-[e1]->(m)-[e2]->(y)`` per (x, y), for the given ``starts`` (id).

    Parallel edges are counted before the join. A hub meets the given starts only, not all its neighbours.
    """
    first = keyed_join(graph_edges, starts.select(F.col("id").alias("src")).distinct(), ["src"], "left_semi")
    first = first.groupBy("src", F.col("dst").alias("mid")).agg(F.count("*").alias("n1"))
    second = graph_edges.groupBy(F.col("src").alias("mid"), "dst").agg(F.count("*").alias("n2"))
    return (
        keyed_join(second, first, ["mid"])
        .groupBy("src", "dst")
        .agg(F.sum(F.col("n1") * F.col("n2")).alias("n_paths"))
    )


def walk_counts(graph_edges: DataFrame, hops: int = 2) -> DataFrame:
    """(id, n_paths): paths of ``hops`` edges ``(x)-[]->()-[]->...`` from every vertex that has one.

    No path is listed: the paths from x are those from its neighbours one edge shorter, so every hop is one join
    of edges (parallel ones counted) with a number per vertex, in which hubs are split, and one sum.
    """
    links = written(graph_edges.groupBy("src", "dst").agg(F.count("*").alias("n")), "links")
    counts = links.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("n_paths"))
    for _ in range(hops - 1):
        step = keyed_join(links, written(counts, "walks").withColumnRenamed("id", "dst"), ["dst"])
        counts = step.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("n") * F.col("n_paths")).alias("n_paths"))
    return counts


def _numbered(ends: DataFrame) -> DataFrame:
    """(id, n): the vertices of the edges (x, y), numbered in the order of their number of neighbours, then their name."""
    degrees = ends.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
    return written(degrees.orderBy("k", "id").select("id", F.monotonically_increasing_id().alias("n")), "vertices")


def _third_vertices(lists: DataFrame) -> DataFrame:
    """(u, v, w) for the edges u to v of ``lists`` (u, vs), v with edges of its own: each w that v leads to, where these
    are no more than those of u, else one row with a null."""
    steps = lists.select("u", F.size("vs").alias("n"), F.explode("vs").alias("v"))
    met = keyed_join(steps, lists.select(F.col("u").alias("v"), F.col("vs").alias("ws")), ["v"])
    none = F.array(F.lit(None).cast("long"))
    return met.select("u", "v", F.explode(F.when(F.size("ws") <= F.col("n"), F.col("ws")).otherwise(none)).alias("w"))


def triangle_counts(graph_edges: DataFrame) -> DataFrame:
    """(id, n_triangles) of every vertex in a triangle; direction, parallel edges and loops do not count.

    Edges go from the end with fewer neighbours to the one with more (ties by name), so a vertex has at most
    the square root of twice the number of edges going out, and a hub few. A triangle u, v, w is met once, at its
    edge u to v, where the third vertex is sought among the neighbours of that end which has fewer going out: those
    of v need an edge from u, those of u one from v. Names are met only where vertices are numbered and at the end.
    """
    ends = graph_edges.filter("src != dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    ends = written(ends, "ends")
    numbers = _numbered(ends)
    for side in ("x", "y"):
        named = keyed_join(ends, numbers.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}")), [side])
        ends = written(named.drop(side), "ends")
    out = written(ends.select(F.least("n_x", "n_y").alias("u"), F.greatest("n_x", "n_y").alias("v")), "oriented")
    lists = written(out.groupBy("u").agg(F.collect_list("v").alias("vs")), "neighbours")
    thirds = written(_third_vertices(lists), "thirds")
    # At most as many rows of one u and w as u has edges, so no key is hot.
    by_v = thirds.filter("w is not null").join(out.withColumnRenamed("v", "w"), ["u", "w"], "left_semi")
    wedges = thirds.filter("w is null").select("u", "v").join(out.withColumnRenamed("v", "w"), "u").filter("v < w")
    by_u = keyed_join(wedges, out.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"], "left_semi")
    closed = by_v.select("u", "v", "w").unionByName(by_u.select("u", "v", "w"))
    counts = closed.select(F.explode(F.array("u", "v", "w")).alias("n")).groupBy("n").agg(F.count("*").alias("n_triangles"))
    return numbers.join(counts, "n").select("id", "n_triangles")
