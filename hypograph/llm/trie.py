"""Prefix trie of conversations as a z-fast trie in tables.

A turn is known by two 64-bit hashes, a prefix by the exclusive or of its turns' hashes, each mixed with its place.
Prefix hashes of all depths come from one running exclusive or, and from a prefix and its last turn follows the
prefix before.

The trie is compacted: only prefixes at which conversations part or end are nodes. A node is stored under its
handle, the prefix whose length is the two-fattest number (the one with most trailing zero bits) between its
parent's depth and its own. Conversations are inserted in batches that grow. A batch finds its exit nodes by fat
binary search, all conversations at once, a join with the handles a step, so in as many steps as the length has
bits. Where a conversation leaves an edge the edge is split; what lies beyond its exit is grouped by prefix hash,
and prefixes with several continuations or an end become nodes. In the end sums go up the compacted tree and
edges are expanded to one row per prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sizing import small_side, written

#: Each batch is so many times the one before.
GROWTH = 8
BATCHES = 3
#: Turns whose running hashes are formed in one group.
CHUNK = 1 << 16

_AT = ["h1", "h2"]


def numbered(table: DataFrame) -> DataFrame:
    """(conv_id, r, t1, t2, size) of rows (conv_id, turn, role, text): the turn's number from 1, its hashes, its code points.

    Turns are ordered by ``turn``, null first; those with the same by role, then by the hash of role and text.
    Ranges of the order are sorted apart, so a conversation with a third of all turns is spread over tasks.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turns = table.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), role, text).alias("t2"),
        F.length(text).cast("long").alias("size"),
    ).filter("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "t1", "t2"]
    sorted_ = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(sorted_.select("conv_id", "t1", "t2", "size", F.monotonically_increasing_id().alias("i")), "turns")
    # The number holds the range above bit 33 and, below, the place in it, in which a conversation's turns are consecutive.
    rows = rows.withColumn("part", F.shiftright("i", 33))
    parts = rows.groupBy("conv_id", "part").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("i") + F.col("shift") + 1).alias("r"), "t1", "t2", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, n) and their turns (c, n, p, t1, t2, size) after the first ones come from the base.

    The first ``h`` turns of conversation c - c % 100 (as many as there are) stand before the own turns after the
    first ``h``, with h = crc32 of c in decimal, modulo 6.
    """
    counts = written(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "counts")
    head = F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % 6
    convs = counts.select(F.col("conv_id").alias("c"), "own", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    bases = counts.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("b", F.least("h", F.coalesce("there", F.lit(0))))
    convs = written(convs.withColumn("n", F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("c", "base", "h", "b", "n"), "conversations")
    side, _ = small_side(convs.select("c", "h", "b", "n"))
    own = turns.withColumnRenamed("conv_id", "c").join(side, "c").filter("r > h")
    own = own.select("c", "n", (F.col("b") + F.col("r") - F.col("h")).alias("p"), "t1", "t2", "size")
    heads = turns.filter("conv_id % 100 = 0 and r <= 5").withColumnRenamed("conv_id", "base")
    taken = convs.filter("b > 0").join(heads, "base").filter("r <= b").select("c", "n", F.col("r").alias("p"), "t1", "t2", "size")
    return convs.select("c", "n"), own.unionByName(taken)


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, n, p, h1, h2, b1, b2, upto, size) per turn: hashes of the prefix with and without it, code points up to it.

    Running values are formed in chunks of places and carried from chunk to chunk by their totals.
    """
    lanes = {f"g{i}": F.xxhash64(F.lit(i), "p", "t1", "t2") for i in (1, 2)}
    rows = written(turns.withColumns(lanes).withColumn("chunk", F.floor((F.col("p") - 1) / CHUNK)).drop("t1", "t2"), "rebuilt")
    totals = rows.filter(F.col("n") > CHUNK).groupBy("c", "chunk").agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2"), F.sum("size").alias("size"))
    ahead = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("c", "chunk", *[F.bit_xor(g).over(ahead).alias(f"c{i}") for i, g in ((1, "g1"), (2, "g2"))], F.sum("size").over(ahead).alias("c_size"))
    carried, _ = small_side(written(carried.filter("chunk > 0"), "carried"))
    w = Window.partitionBy("c", "chunk").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({"x1": F.bit_xor("g1").over(w), "x2": F.bit_xor("g2").over(w), "s": F.sum("size").over(w)}).join(carried, ["c", "chunk"], "left")
    hashes = {f"h{i}": F.col(f"x{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))) for i in (1, 2)}
    run = run.withColumns({**hashes, "upto": F.col("s") + F.coalesce("c_size", F.lit(0))})
    return run.withColumns({f"b{i}": F.col(f"h{i}").bitwiseXOR(F.col(f"g{i}")) for i in (1, 2)}).select("c", "n", "p", *_AT, "b1", "b2", "upto", "size")


def two_fattest(low: str, high: str) -> Column:
    """The number above ``low``, up to ``high``, with most trailing zero bits."""
    return F.expr(f"{high} & shiftleft(-1L, length(bin({low} ^ {high})) - 1)")


def _keyed(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes of edges (x, s, e), x any conversation that has the prefix: handle f, and hashes and sizes at their depths.

    ``s``: depth of the parent, ``p*``: its hash; ``k*``: hash at s + 1, which names the edge below the parent;
    ``f*``: hash of the handle; ``e*``: hash of the node; ``from_size``, ``upto``: code points above and up to it.
    """
    edges = edges.withColumn("f", two_fattest("s", "e"))
    wanted = edges.select("x", "s", "e", "f", F.explode(F.array_distinct(F.array(F.col("s") + 1, "f", "e"))).alias("p"))
    found = wanted.join(paths.select("x", "p", *_AT, "b1", "b2", "upto", "size"), ["x", "p"])
    at = lambda depth, column: F.max(F.when(F.col("p") == depth, F.col(column)))
    first = F.col("s") + 1
    parts = {"p1": at(first, "b1"), "p2": at(first, "b2"), "k1": at(first, "h1"), "k2": at(first, "h2")}
    parts |= {"f1": at(F.col("f"), "h1"), "f2": at(F.col("f"), "h2"), "e1": at(F.col("e"), "h1"), "e2": at(F.col("e"), "h2")}
    parts |= {"from_size": F.max(F.when(F.col("p") == first, F.col("upto") - F.col("size"))), "upto": at(F.col("e"), "upto")}
    return found.groupBy("x", "s", "e", "f").agg(*[v.alias(k) for k, v in parts.items()])


def _located(batch: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The exit of each conversation (x, n): the deepest node (node_x, e, f) whose handle it has, by fat binary search.

    Depths in (a, b] are still open. A handle that is met takes ``a`` to its node's depth, one that is not takes
    ``b`` below it. Conversations that meet none are left at the root, at depth 0.
    """
    handles, _ = small_side(nodes.select("f", F.col("f1").alias("h1"), F.col("f2").alias("h2"), F.col("e").alias("to"), F.col("x").alias("to_x"), F.col("e1").alias("to_1"), F.col("e2").alias("to_2")))
    zero = F.lit(0).cast("long")
    state = batch.select("x", "n", zero.alias("a"), F.col("n").alias("b"), F.lit(None).cast("long").alias("node_x"), zero.alias("node_f"), zero.alias("n1"), zero.alias("n2"))
    done = None
    while True:
        probe = state.withColumn("f", two_fattest("a", "b")).join(paths.select("x", F.col("p").alias("f"), *_AT), ["x", "f"])
        met, hit = probe.join(handles, ["f", *_AT], "left"), F.col("to").isNotNull()
        step = met.select(
            "x",
            "n",
            F.when(hit, F.col("to")).otherwise(F.col("a")).alias("a"),
            F.when(hit, F.col("b")).otherwise(F.col("f") - 1).alias("b"),
            F.when(hit, F.col("to_x")).otherwise(F.col("node_x")).alias("node_x"),
            F.when(hit, F.col("f")).otherwise(F.col("node_f")).alias("node_f"),
            F.when(hit, F.col("to_1")).otherwise(F.col("n1")).alias("n1"),
            F.when(hit, F.col("to_2")).otherwise(F.col("n2")).alias("n2"),
        )
        step = written(step, "search")
        over = step.filter("a >= b")
        done = over if done is None else done.unionByName(over)
        state = step.filter("a < b")
        if state.isEmpty():
            return done.select("x", "n", F.col("a").alias("e"), "node_x", "node_f", "n1", "n2")


def _exits(batch: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x, n, exit, edge_x, s, e) per conversation: the depth to which the trie has it, and the edge it leaves.

    The edge is null where it goes on from a node, or ends at one. A conversation has all of the node found, and
    then may have part of the edge below that its next turn names; or it leaves the edge above that node.
    """
    found = _located(batch, paths, nodes).withColumn("p", F.least(F.col("e") + 1, F.col("n")))
    found = found.join(paths.select("x", "p", *_AT, "b1", "b2"), ["x", "p"])
    goes_on = F.col("n") > F.col("e")
    same = [F.when(goes_on, F.col(f"b{i}")).when(F.col("n") == F.col("e"), F.col(f"h{i}")) == F.col(f"n{i}") for i in (1, 2)]
    found = found.withColumn("whole", F.coalesce(same[0] & same[1], F.lit(False)))
    below, _ = small_side(nodes.select((F.col("s") + 1).alias("p"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("x").alias("below_x"), F.col("s").alias("below_s"), F.col("e").alias("below_e")))
    above, _ = small_side(nodes.select(F.col("x").alias("node_x"), F.col("e"), F.col("s").alias("above_s")))
    inner = found.filter("whole").filter(goes_on).join(below, ["p", *_AT], "left")
    inner = inner.select("x", "n", F.col("below_x").alias("edge_x"), F.col("below_s").alias("s"), F.col("below_e").alias("to"), F.col("e").alias("low"))
    ended = found.filter("whole").filter(~goes_on).select("x", "n", *[F.lit(None).cast("long").alias(c) for c in ("edge_x", "s", "to")], F.col("e").alias("low"))
    left = found.filter("not whole").join(above, ["node_x", "e"]).select("x", "n", F.col("node_x").alias("edge_x"), F.col("above_s").alias("s"), F.col("e").alias("to"), F.col("node_f").alias("low"))
    edge = written(inner.unionByName(ended).unionByName(left), "edges")

    mine = paths.select("x", "p", *_AT).join(edge.filter("edge_x is not null").select("x", "edge_x", "low", "to"), "x").filter("p > low and p <= to")
    theirs = paths.select(F.col("x").alias("edge_x"), "p", F.col("h1").alias("o1"), F.col("h2").alias("o2"))
    shared = mine.join(theirs, ["edge_x", "p"]).filter("h1 = o1 and h2 = o2").groupBy("x").agg(F.max("p").alias("shared"))
    return edge.join(shared, "x", "left").select("x", "n", F.coalesce("shared", "low").alias("exit"), "edge_x", "s", F.col("to").alias("e"))


def insert(nodes: DataFrame | None, batch: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes of the trie after the conversations ``batch`` (x, n) of ``paths`` are put into it."""
    paths = written(paths, "prefixes") if nodes is None else paths
    if nodes is None:
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
        exits = batch.select("x", "n", zero.alias("exit"), none.alias("edge_x"), none.alias("s"), none.alias("e"))
    else:
        exits = written(_exits(batch, paths, nodes), "exits")
    fresh = paths.drop("n").join(exits.select("x", "n", "exit"), "x").filter(F.col("p") > F.col("exit"))
    fresh = written(fresh.select("x", "n", "exit", "p", *_AT, "b1", "b2"), "fresh")
    seen = fresh.groupBy("p", *_AT).agg(F.min("x").alias("x"), F.bool_or(F.col("p") == F.col("n")).alias("ends"), F.max("b1").alias("b1"), F.max("b2").alias("b2"))
    seen = written(seen, "seen")
    own = seen.select("p", *_AT, "x", "ends", F.lit(0).alias("below"))
    above = seen.select((F.col("p") - 1).alias("p"), F.col("b1").alias("h1"), F.col("b2").alias("h2"), F.lit(None).cast("long").alias("x"), F.lit(False).alias("ends"), F.lit(1).alias("below"))
    marks = own.unionByName(above).groupBy("p", *_AT).agg(F.min("x").alias("first"), F.bool_or("ends").alias("ends"), F.sum("below").alias("below"))
    marks = marks.filter("first is not null and (ends or below > 1)").select("p", *_AT, "first")
    w = Window.partitionBy("x").orderBy("p")
    on_path = fresh.select("x", "exit", "p", *_AT).join(marks, ["p", *_AT]).withColumn("s", F.coalesce(F.lag("p").over(w), "exit"))
    edges = on_path.filter("x = first").select("x", "s", F.col("p").alias("e"))
    if nodes is None:
        return written(_keyed(edges, paths), "nodes")

    cuts = exits.filter("edge_x is not null and exit < e").select(F.col("edge_x").alias("x"), "s", "e", F.col("exit").alias("cut")).distinct()
    cuts = written(cuts, "cuts")
    split = cuts.select("x", "e").distinct()
    ends = cuts.unionByName(cuts.select("x", "s", "e", F.col("e").alias("cut")).distinct())
    order = Window.partitionBy("x", "e").orderBy("cut")
    pieces = ends.withColumn("s", F.coalesce(F.lag("cut").over(order), "s")).select("x", "s", F.col("cut").alias("e"))
    side, _ = small_side(split)
    new = _keyed(edges.unionByName(pieces), paths)
    return written(nodes.join(side, ["x", "e"], "left_anti").unionByName(new.select(*nodes.columns)), "nodes")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each run of equal (n, h1, h2), in a stream: no group is ever held."""
    key, digest = None, None
    schema = pa.schema([("p", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        out = []
        columns = [batch.column(x).to_pylist() for x in ("n", "h1", "h2", "c")]
        for n, h1, h2, c in zip(*columns, strict=True):
            if key != (n, h1, h2):
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (n, h1, h2), hashlib.sha256(str(c).encode())
            else:
                digest.update(f",{c}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], schema.types[i]) for i in range(4)], schema=schema)
    if key is not None:
        last = (*key, digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(last, schema.types, strict=True)], schema=schema)


def prefix_trie(table: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations of ``table`` (conv_id, turn, role, text, any others).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): smallest member,
    length, the parent's smallest member (root: null), members, children, childless nodes in the subtree (with
    itself), the sum over the subtree of (members - 1) times the code points of the last text, and the SHA-256
    of the ids that end here, ascending, with commas between. Conversations are rebuilt as ``rebuilt`` says.

    * Null role or text is empty; a null turn comes first; rows with a null conv_id are left out.
    * Turns of a conversation with the same number are ordered by role, then by a hash of role and text;
      repeated rows are turns of their own.
    * Conversations without a turn after rebuilding are members of the root alone.
    * An empty table gives an empty result. Other columns are ignored, whatever their names.

    Ids that end at one node are hashed in one stream, since SHA-256 has an order; nothing of it is held in memory.
    """
    convs, turns = rebuilt(numbered(table))
    every = written(prefixes(turns), "prefixes")
    zero = F.lit(0).cast("long")
    ends = every.filter("p = n").select("c", "n", *_AT).unionByName(convs.filter("n = 0").select("c", "n", zero.alias("h1"), zero.alias("h2")))
    distinct = written(ends.groupBy("n", *_AT).agg(F.min("c").alias("x"), F.count("*").alias("copies")), "distinct")
    if distinct.isEmpty():
        schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return table.sparkSession.createDataFrame([], schema)
    side, _ = small_side(distinct.select(F.col("x").alias("c"), "copies"))
    paths = written(every.join(side, "c").withColumnRenamed("c", "x"), "paths")

    level = F.lit(batches - 1)
    for i in range(batches - 2, -1, -1):
        level = F.when(F.pmod(F.xxhash64("x"), F.lit(GROWTH ** (batches - 1 - i))) == 0, F.lit(i)).otherwise(level)
    dealt = distinct.filter("n > 0").select("x", "n", level.alias("level"))
    nodes = None
    for i in range(batches):
        batch = dealt.filter(F.col("level") == i).select("x", "n")
        nodes = nodes if batch.isEmpty() else insert(nodes, batch, paths)
    return _expanded(nodes, paths, distinct, ends)


def _expanded(nodes: DataFrame | None, paths: DataFrame, distinct: DataFrame, ends: DataFrame) -> DataFrame:
    """Sums of the subtrees of compacted nodes, then a row for every depth of their edges."""
    zero = F.lit(0).cast("long")
    digests = ends.repartition("n", *_AT).sortWithinPartitions("n", *_AT, "c").mapInArrow(_digests, "p long, h1 long, h2 long, ends_sha256 string")
    root = {"s": F.lit(-1).cast("long"), "e": zero, "e1": zero, "e2": zero}
    on_path = distinct.select("x", "copies", *[root[k].alias(k) for k in ("e", "e1", "e2")])
    if nodes is not None:
        known, _ = small_side(nodes.select(F.col("e").alias("p"), F.col("e1").alias("h1"), F.col("e2").alias("h2")))
        deeper = paths.select("x", "copies", "p", *_AT).join(known, ["p", *_AT]).select("x", "copies", F.col("p").alias("e"), F.col("h1").alias("e1"), F.col("h2").alias("e2"))
        on_path = written(on_path.unionByName(deeper), "on_path")

    own = on_path.select("e", "e1", "e2", "copies", "x", F.lit(0).alias("child"))
    tops = distinct.limit(1).select(F.lit(None).cast("long").alias("x"), root["s"].alias("s"), root["e"].alias("e"), *[zero.alias(c) for c in ("e1", "e2", "p1", "p2", "from_size", "upto")])
    if nodes is not None:
        children = nodes.select(F.col("s").alias("e"), F.col("p1").alias("e1"), F.col("p2").alias("e2"), zero.alias("copies"), F.lit(None).cast("long").alias("x"), F.lit(1).alias("child"))
        own = own.unionByName(children)
        tops = tops.unionByName(nodes.select(*tops.columns))
    counts = own.groupBy("e", "e1", "e2").agg(F.sum("copies").alias("n_convs"), F.min("x").alias("conv_id"), F.sum("child").cast("long").alias("kids"))
    counts = written(counts, "counts")
    weighed = tops.join(counts, ["e", "e1", "e2"]).withColumn("weight", (F.col("n_convs") - 1) * (F.col("upto") - F.col("from_size")))
    weighed = written(weighed, "weighed")

    # Each node's weight is put on the path of its smallest member and summed upwards there.
    carried, _ = small_side(weighed.select("e", "e1", "e2", "conv_id", "weight", (F.col("kids") == 0).cast("long").alias("leaf")))
    upwards = Window.partitionBy("x").orderBy(F.desc("e")).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("x") == F.col("conv_id")
    placed = on_path.select("x", "e", "e1", "e2").join(carried, ["e", "e1", "e2"])
    placed = placed.select("x", "e", "e1", "e2", *[F.when(mine, F.col(c)).otherwise(zero).alias(c) for c in ("weight", "leaf")])
    placed = placed.select("e", "e1", "e2", F.sum("weight").over(upwards).alias("saved"), F.sum("leaf").over(upwards).alias("leaves"))
    sums = placed.groupBy("e", "e1", "e2").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))

    parents, _ = small_side(counts.select(F.col("e").alias("s"), F.col("e1").alias("p1"), F.col("e2").alias("p2"), F.col("conv_id").alias("parent")))
    edges = weighed.join(sums, ["e", "e1", "e2"]).join(parents, ["s", "p1", "p2"], "left")
    edges = edges.join(digests.select(F.col("p").alias("e"), F.col("h1").alias("e1"), F.col("h2").alias("e2"), "ends_sha256"), ["e", "e1", "e2"], "left")
    edges = written(edges, "compacted")

    nothing = F.sha2(F.encode(F.lit(""), "utf-8"), 256)
    named = lambda: F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    top = edges.filter("e = 0").select("conv_id", F.col("e").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), named())
    # Long edges are dealt out in chunks before single depths are listed.
    chunked = edges.filter("e > 0").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("s") / CHUNK), F.floor((F.col("e") - 1) / CHUNK))))
    depths = F.sequence(F.greatest(F.col("s"), F.col("chunk") * CHUNK) + 1, F.least(F.col("e"), (F.col("chunk") + 1) * CHUNK))
    single = chunked.withColumn("p", F.explode(depths)).join(paths.select("x", "p", F.col("upto").alias("at"), "size"), ["x", "p"])
    last = F.col("p") == F.col("e")
    return top.unionByName(
        single.select(
            "conv_id",
            F.col("p").alias("depth"),
            F.when(F.col("p") == F.col("s") + 1, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            "n_convs",
            F.when(last, F.col("kids")).otherwise(F.lit(1)).alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (F.col("saved") - (F.col("n_convs") - 1) * (F.col("at") - F.col("size") - F.col("from_size"))).alias("saved_tokens"),
            F.when(last, F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
        )
    )
