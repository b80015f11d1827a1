"""Term pairs within a character distance, and their reductions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import composite_distance
from .sizing import written
from .vocab import STOP_EQUIVALENCE

# List code, left category, right category.
AB, BC, AC, BB = (1, "A", "B"), (2, "B", "C"), (3, "A", "C"), (4, "B", "B")
PAIR_THRESHOLD = 800
KINASE_THRESHOLD = 8000
#: Pairs of a stretch of text that are matched inside one row.
FEW_PAIRS = 48
#: Pairs of a stretch of text that one task goes through in rank order; those of longer ones are matched in rounds.
STREAM_PAIRS = 50_000


def cooccurrences(
    mentions: DataFrame,
    combos=(AB, BC, AC),
    threshold: int = PAIR_THRESHOLD,
    include_zero: bool = False,
    distinct_words: bool = False,
    id_col: str = "article_id",
) -> DataFrame:
    """All (left, right) mentions of an article closer than ``threshold`` characters.

    Positions are cut into blocks of four thresholds. A left mention goes to its own block, a right
    mention to every block it can reach (one, or two near a border), and blocks are formed by one
    grouping on (article, block). So the text is read once, a long article is spread over many tasks, no
    pair is made twice, and a block spans at most six thresholds of text whatever the article's length.
    """
    left_cats = sorted({c[1] for c in combos})
    right_cats = sorted({c[2] for c in combos})
    def block_of(position):
        return F.floor(position / F.lit(4 * threshold)).cast("int")

    pos = F.col("doc_pos")
    own = F.when(
        F.col("cat").isin(left_cats), F.array(F.struct(block_of(pos).alias("block"), F.lit(True).alias("left")))
    )
    near = F.when(
        F.col("cat").isin(right_cats),
        F.transform(
            F.sequence(block_of(F.greatest(pos - threshold, F.lit(0))), block_of(pos + threshold)),
            lambda b: F.struct(b.alias("block"), F.lit(False).alias("left")),
        ),
    )
    empty = F.expr("cast(array() as array<struct<block:int,left:boolean>>)")
    placed = mentions.select(
        id_col,
        F.struct("cat", "word", "doc_pos", "para_pos", "sent_pos").alias("m"),
        F.explode(F.concat(F.coalesce(own, empty), F.coalesce(near, empty))).alias("at"),
    )
    blocks = (
        placed.groupBy(id_col, F.col("at.block").alias("block"))
        .agg(
            F.collect_list(F.when(F.col("at.left"), F.col("m"))).alias("lefts"),
            F.collect_list(F.when(~F.col("at.left"), F.col("m"))).alias("rights"),
        )
        .filter((F.size("lefts") > 0) & (F.size("rights") > 0))
    )
    code = F.lit(None).cast("int")
    for number, left, right in combos:
        code = F.when((F.col("a.cat") == left) & (F.col("b.cat") == right), F.lit(number)).otherwise(code)
    def fits(x):
        """Whether a right mention can be the partner of ``a``: decided inside the row, before pairs are made."""
        wanted = F.lit(False)
        for _, left, right in combos:
            wanted = wanted | ((F.col("a.cat") == left) & (x["cat"] == right))
        return (F.abs(F.col("a.doc_pos") - x["doc_pos"]) < threshold) & wanted

    raw = (
        blocks.select(id_col, F.explode("lefts").alias("a"), "rights")
        .select(id_col, "a", F.explode(F.filter("rights", fits)).alias("b"))
        .withColumn("code", code)
        .withColumn("doc_dist", F.abs(F.col("a.doc_pos") - F.col("b.doc_pos")))
        .filter(F.col("code").isNotNull() & (F.col("doc_dist") < threshold))
    )
    if not include_zero:
        raw = raw.filter(F.col("doc_dist") > 0)
    if distinct_words:
        raw = raw.filter(F.col("a.word") != F.col("b.word"))
    para = F.abs(F.col("a.para_pos") - F.col("b.para_pos"))
    sent = F.abs(F.col("a.sent_pos") - F.col("b.sent_pos"))
    return raw.select(
        id_col,
        "code",
        F.col("a.word").alias("l"),
        F.col("b.word").alias("r"),
        F.col("a.doc_pos").alias("l_pos"),
        F.col("b.doc_pos").alias("r_pos"),
        "doc_dist",
        para.alias("para_dist"),
        sent.alias("sent_dist"),
        composite_distance(para, sent, F.col("doc_dist")).alias("uber_dist"),
    )


def pair_id(id_col: str = "article_id") -> Column:
    """Row id of a pair, from the columns that identify it."""
    return F.xxhash64(id_col, "code", "l", "r")


def shortest_pairs(pairs: DataFrame, id_col: str = "article_id") -> DataFrame:
    """One pair per (article, code, l, r): the closest, ties by left then right position."""
    best = F.min(F.struct("uber_dist", "l_pos", "r_pos", "doc_dist", "para_dist", "sent_dist"))
    return (
        pairs.groupBy(id_col, "code", "l", "r")
        .agg(best.alias("x"))
        .select(id_col, "code", "l", "r", "x.*")
    )


def equivalence_sets(
    mentions: DataFrame,
    combos=(AB, BC, AC, BB),
    threshold: int = PAIR_THRESHOLD,
    id_col: str = "article_id",
    stop: list[str] | None = None,
) -> DataFrame:
    """Greedy one-to-one matching of left and right mentions per (article, code, l, r)."""
    usable = mentions.filter(~F.col("word").isin(STOP_EQUIVALENCE if stop is None else stop))
    pairs = cooccurrences(usable, combos, threshold, include_zero=True, distinct_words=True, id_col=id_col)
    return match_one_to_one(pairs, id_col)


_ITEM = ["doc_dist", "l_pos", "r_pos", "para_dist", "sent_dist", "uber_dist"]


def _picked_in_row(ranked: Column) -> Column:
    """The pairs that a greedy matching keeps of a short list in rank order."""
    none = F.expr("cast(array() as array<int>)")
    start = F.struct(F.filter(ranked, lambda x: F.lit(False)).alias("kept"), none.alias("ls"), none.alias("rs"))

    def step(state, x):
        free = ~F.array_contains(state["ls"], x["l_pos"]) & ~F.array_contains(state["rs"], x["r_pos"])
        taken = F.struct(
            F.array_append(state["kept"], x).alias("kept"), F.array_append(state["ls"], x["l_pos"]).alias("ls"), F.array_append(state["rs"], x["r_pos"]).alias("rs")
        )
        return F.when(free, taken).otherwise(state)

    return F.aggregate(ranked, start, step, lambda state: state["kept"])


def _round_picks(pairs: DataFrame, key: list[str]) -> DataFrame:
    """``pairs`` with ``picked``: whether the greedy matching is sure to keep the pair, judged by its neighbours.

    A pair is ripe if no other one of its left or right position is closer. Ripe pairs of one distance that
    touch form chains, each one distance further than the last, and the matching goes through a chain from its
    low end: it keeps the first pair, drops the second, keeps the third. What comes before the chain decides
    about its first pair, so a chain that follows on a pair which is not ripe waits. The least distance of all
    is always ripe, so there are at most as many rounds as distances, which the pair threshold bounds.
    """
    by_left, by_right = (Window.partitionBy(*key, c) for c in ("l_pos", "r_pos"))
    d, low = F.col("doc_dist"), F.least("l_pos", "r_pos")
    ripe = (d == F.min("doc_dist").over(by_left)) & (d == F.min("doc_dist").over(by_right))
    # Left and right positions alternate along a chain, so it has one remainder of twice the distance.
    phase = F.when(d > 0, F.pmod(low + F.when(F.col("l_pos") < F.col("r_pos"), 0).otherwise(d), 2 * F.greatest(d, F.lit(1)))).otherwise(low)
    marked = pairs.withColumns({"ripe": ripe, "low": low, "phase": phase})
    chain = Window.partitionBy(*key, "doc_dist", "phase").orderBy("low")
    follows = F.coalesce(F.lag("low").over(chain) == low - d, F.lit(False))
    begins = F.col("ripe") & ~(follows & F.lag("ripe").over(chain))
    first = F.last(F.when(begins, F.struct("low", follows.alias("waits"))), ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, 0))
    place = F.when(d > 0, (F.col("low") - F.col("first.low")) / F.greatest(d, F.lit(1))).otherwise(F.lit(0))
    return marked.withColumn("first", first).withColumn("picked", F.col("ripe") & ~F.col("first.waits") & (place % 2 == 0)).select(*pairs.columns, "picked")


def _match_in_rounds(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Greedy matching of all ``pairs`` at once, round by round; every round is written, and no list is gathered."""
    done = None
    # Mentions that stand twice give the same pair twice.
    rest = pairs.groupBy(*key, "doc_dist", "l_pos", "r_pos").agg(F.min(F.struct(*_ITEM[3:])).alias("x")).select(*key, *_ITEM[:3], "x.*")
    by_left, by_right = (Window.partitionBy(*key, c) for c in ("l_pos", "r_pos"))
    while True:
        judged = written(_round_picks(rest, key), "round")
        picked = judged.filter("picked").drop("picked")
        done = picked if done is None else done.unionByName(picked)
        gone = F.bool_or("picked").over(by_left) | F.bool_or("picked").over(by_right)
        rest = written(judged.withColumn("gone", gone).filter("not gone").drop("gone", "picked"), "rest")
        if rest.isEmpty():
            return done


def _picked_in_order(stretch: list[str]):
    """Rows come stretch by stretch in rank order; kept are those whose positions no kept row before them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lefts, rights = None, set(), set()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).dictionary_encode(null_encoding="encode") for c in stretch]
            codes = np.column_stack([k.indices.to_numpy() for k in keys])
            begins = np.any(np.diff(codes, axis=0) != 0, axis=1).tolist()
            own = tuple(k[0].as_py() for k in keys)
            kept = np.zeros(batch.num_rows, dtype=bool)
            for i, (begin, l, r) in enumerate(zip([own != current, *begins], batch.column("l_pos").to_pylist(), batch.column("r_pos").to_pylist(), strict=True)):
                if begin:
                    lefts, rights = set(), set()
                if l not in lefts and r not in rights:
                    lefts.add(l)
                    rights.add(r)
                    kept[i] = True
            current = tuple(k[batch.num_rows - 1].as_py() for k in keys)
            yield batch.filter(pa.array(kept))

    return run


def match_one_to_one(pairs: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Take the closest pair, drop all pairs sharing its left or right position, repeat.

    Ties go to the lower left, then the lower right position. Pairs of two words in one article fall into
    stretches of text that no pair reaches across. Short ones, of up to ``FEW_PAIRS`` pairs, are matched inside
    a row. Pairs of longer ones stay rows: of up to ``STREAM_PAIRS`` pairs, they are sorted, and a task goes through
    them once, holding the positions taken in one stretch; so the text's size adds no jobs. All still longer ones
    are matched together in rounds that settle every pair whose neighbours leave no doubt. All give the same result.
    """
    key = [id_col, "code", "l", "r"]
    low, high = F.least("l_pos", "r_pos"), F.greatest("l_pos", "r_pos")
    ahead = Window.partitionBy(*key).orderBy("_low")
    reached = F.max("_high").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    spans = pairs.select(*key, *_ITEM).withColumns({"_low": low, "_high": high})
    opened = spans.withColumn("_new", F.coalesce(F.col("_low") > reached, F.lit(True)).cast("int"))
    stretched = opened.withColumn("_stretch", F.sum("_new").over(ahead.rangeBetween(Window.unboundedPreceding, 0)))
    counted = stretched.withColumn("_n", F.count("*").over(Window.partitionBy(*key, "_stretch")))
    stored = written(counted.select(*key, *_ITEM, "_stretch", "_n"), "stretches")
    alone = stored.filter("_n = 1").select(*key, *_ITEM)
    few = stored.filter(F.col("_n").between(2, FEW_PAIRS)).groupBy(*key, "_stretch")
    few = few.agg(F.sort_array(F.collect_list(F.struct(*_ITEM))).alias("ranked")).select(*key, F.explode(_picked_in_row(F.col("ranked"))).alias("x"))
    out = alone.unionByName(few.select(*key, "x.*"))
    middle = stored.filter((F.col("_n") > max(FEW_PAIRS, 1)) & (F.col("_n") <= STREAM_PAIRS)).drop("_n")
    if not middle.isEmpty():
        ranked = middle.repartition(*key, "_stretch").sortWithinPartitions(*key, "_stretch", *_ITEM)
        picked = ranked.mapInArrow(_picked_in_order([*key, "_stretch"]), middle.schema)
        out = out.unionByName(written(picked.select(*key, *_ITEM), "matched"))
    many = stored.filter(F.col("_n") > max(FEW_PAIRS, STREAM_PAIRS, 1)).select(*key, *_ITEM)
    return out if many.isEmpty() else out.unionByName(_match_in_rounds(many, key))


def unordered(pairs: DataFrame, code: int = 4) -> DataFrame:
    """For pairs within one category keep one order, since (x, y) and (y, x) say the same."""
    return pairs.filter((F.col("code") != code) | (F.col("l") < F.col("r")))


def triples(pairs: DataFrame, id_col: str = "article_id") -> DataFrame:
    """A-B and B-C pairs of one article sharing B, chained to (a, b, c).

    One grouping by (article, B term) instead of a self-join, which would compute the pairs twice.
    """
    distinct = pairs.filter(F.col("code").isin(1, 2)).select(id_col, "code", "l", "r").distinct()
    sides = (
        distinct.select(
            id_col,
            F.when(F.col("code") == 1, F.col("r")).otherwise(F.col("l")).alias("b"),
            F.when(F.col("code") == 1, F.col("l")).alias("a"),
            F.when(F.col("code") == 2, F.col("r")).alias("c"),
        )
        .groupBy(id_col, "b")
        .agg(F.collect_list("a").alias("lefts"), F.collect_list("c").alias("rights"))
    )
    return sides.select(id_col, "b", F.explode("lefts").alias("a"), "rights").select(
        id_col, "a", "b", F.explode("rights").alias("c")
    )


def triple_frequency(found: DataFrame) -> DataFrame:
    """Number of articles per triple, most frequent first."""
    return (
        found.groupBy("a", "b", "c")
        .agg(F.count("*").alias("n_articles"))
        .orderBy(F.desc("n_articles"), "a", "b", "c")
    )


def kinase_pairs(mentions: DataFrame, threshold: int = KINASE_THRESHOLD, id_col: str = "article_id") -> DataFrame:
    """A-B pairs within the wide window, distance zero allowed."""
    return cooccurrences(mentions, (AB,), threshold, include_zero=True, id_col=id_col)


def unpivot_distances(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """The three distances of a pair as (kind, value) rows."""
    return pairs.selectExpr(
        *ids,
        "stack(3, 'doc', cast(doc_dist as bigint), 'sent', cast(sent_dist as bigint), "
        "'para', cast(para_dist as bigint)) as (kind, value)",
    )
