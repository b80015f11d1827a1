"""Operators that hold for hot keys, long stretches, hubs and wide ranges, against plain versions."""

import random
import time
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from hypograph.operators import evaluation as ev
from hypograph.operators import graph as gr
from hypograph.operators import pairs as pr
from hypograph.operators import relevance as rl
from hypograph.operators import sizing
from hypograph.operators import timeline as tl
from hypograph.sources import tables as sb

PAIRS = "article_id string, code int, l string, r string, uber_dist int, l_pos int, r_pos int, doc_dist int, para_dist int, sent_dist int"


@pytest.fixture
def shuffled(monkeypatch):
    """No broadcast of measured sides, and keys heavy from 50 rows on."""
    monkeypatch.setattr(sizing, "small_side", lambda df, *a: (df, False))
    monkeypatch.setattr(sizing, "GROUP_ROWS", 50)


def test_heavy_keys_are_split_and_only_those(spark, shuffled):
    left = spark.range(1000).select(F.when(F.col("id") < 700, F.lit("hot")).when(F.col("id") < 760, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    heavy = sizing.heavy_keys(left, ["k"]).collect()
    assert sorted(r["_salts"] for r in heavy) == [2, 14]  # the null key is heavy too
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("800", 3), (None, 4), ("absent", 5)], "k string, v int")
    for how, plain in (("inner", "inner"), ("left", "left"), ("left_semi", "left_semi"), ("left_anti", "left_anti")):
        got, want = sizing.keyed_join(left, right, ["k"], how), left.join(right, ["k"], plain)
        assert got.columns == want.columns and rows(got.na.fill(-1).na.fill("-"), *got.columns) == rows(want.na.fill(-1).na.fill("-"), *got.columns)
    # Copies are made for the heavy key only: two rows of it, fourteen times each, and the three others once.
    repeated = right.withColumn("_key", F.xxhash64("k")).join(sizing.heavy_keys(left, ["k"]), "_key", "left").agg(F.sum(F.coalesce("_salts", F.lit(1)))).first()[0]
    assert repeated == 2 * 14 + 1 + 2 + 1


def test_keys_of_different_types_meet(spark, shuffled):
    left = spark.range(300).select((F.col("id") % 3).cast("int").alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    assert sizing.keyed_join(left, right, ["k"]).count() == 200


def _greedy(items):
    left, right, out = set(), set(), []
    for d, lp, rp in sorted(items):
        if lp not in left and rp not in right:
            left.add(lp)
            right.add(rp)
            out.append((d, lp, rp))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_matching_in_rounds_equals_the_greedy_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(pr, "FEW_PAIRS", 0)
    r, data = random.Random(seed), {}
    for a in range(12):
        spread, step = r.choice([(30, 1), (200, 1), (400, 10), (3000, 5)])
        ls, rs = ({r.randrange(spread) * step for _ in range(r.randrange(1, 40))} for _ in range(2))
        reach = r.choice([5, 60, 800])
        data[f"d{a}"] = {(abs(x - y), x, y) for x in ls for y in rs if abs(x - y) < reach}
    found = [(a, 1, "x", "y", d, lp, rp, d, 0, 0) for a, items in data.items() for d, lp, rp in items]
    found += found[:5]  # the same pair twice
    out = pr.match_one_to_one(spark.createDataFrame(found, PAIRS).repartition(5))
    got = {a: [] for a in data}
    for x in out.collect():
        got[x["article_id"]].append((x["doc_dist"], x["l_pos"], x["r_pos"]))
    assert {a: sorted(x) for a, x in got.items()} == {a: _greedy(x) for a, x in data.items()}


def test_matching_inside_rows_and_in_rounds_together(spark, monkeypatch):
    monkeypatch.setattr(pr, "FEW_PAIRS", 6)
    r = random.Random(1)
    spots = [(1000 * k + r.randrange(300), 1000 * k + r.randrange(300)) for k in range(6) for _ in range(1 + 3 * (k % 3))]
    items = {(abs(x - y), x, y) for x, _ in spots for _, y in spots if abs(x - y) < 300}
    out = pr.match_one_to_one(spark.createDataFrame([("d", 1, "x", "y", d, a, b, d, 0, 0) for d, a, b in items], PAIRS))
    assert rows(out, "doc_dist", "l_pos", "r_pos") == _greedy(items)


@pytest.mark.parametrize("rows_in_batch", [7, 10_000])
def test_matching_of_middling_stretches_takes_no_round(spark, monkeypatch, rows_in_batch):
    """Each distance of many is a round otherwise; stretches and keys end inside batches, one key is null."""
    monkeypatch.setattr(pr, "_match_in_rounds", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_in_batch))
    r, data = random.Random(8), {}
    for a in (None, "d", "e"):
        for word in ("x", "y"):
            ls, rs = ([base + r.randrange(700) for base in (0, 5000) for _ in range(25)] for _ in range(2))
            data[a, word] = {(abs(x - y), x, y) for x in ls for y in rs if abs(x - y) < 800}
    found = [(a, 1, "w", word, d, lp, rp, d, 0, 0) for (a, word), items in data.items() for d, lp, rp in items]
    out = pr.match_one_to_one(spark.createDataFrame([*found, *found[:5]], PAIRS).repartition(5)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {k: sorted((x["doc_dist"], x["l_pos"], x["r_pos"]) for x in out if (x["article_id"], x["r"]) == k) for k in data}
    assert got == {k: _greedy(x) for k, x in data.items()}


def test_rounds_give_what_the_other_ways_give(spark, monkeypatch):
    r = random.Random(9)
    items = {(abs(x - y), x, y) for x in {r.randrange(900) for _ in range(25)} for y in {r.randrange(900) for _ in range(25)} if abs(x - y) < 300}
    monkeypatch.setattr(pr, "FEW_PAIRS", 0)
    monkeypatch.setattr(pr, "STREAM_PAIRS", 0)
    out = pr.match_one_to_one(spark.createDataFrame([("d", 1, "x", "y", d, a, b, d, 0, 0) for d, a, b in items], PAIRS))
    assert rows(out, "doc_dist", "l_pos", "r_pos") == _greedy(items)


def test_a_dense_stretch_takes_few_rounds(spark):
    """A hundred thousand pairs of one stretch, neighbours at equal distances: no list of them is made."""
    n = 50_000
    pairs = spark.range(n).selectExpr(
        "'x' article_id", "1 code", "'a' l", "'b' r", "explode(array(named_struct('a', id * 20, 'b', id * 20 + 10), named_struct('a', id * 20 + 20, 'b', id * 20 + 10))) p"
    ).selectExpr("article_id", "code", "l", "r", "10 uber_dist", "cast(p.a as int) l_pos", "cast(p.b as int) r_pos", "10 doc_dist", "0 para_dist", "0 sent_dist")
    out = pr.match_one_to_one(pairs)
    assert out.count() == n and out.filter("r_pos <> l_pos + 10").isEmpty()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_special_interest_of_a_table_of_targets(spark, shuffled):
    pairs = spark.createDataFrame([("a", "b", 1), ("c", "d", 2), ("e", None, 3), (None, None, 4)], "l string, r string, n int")
    targets = spark.createDataFrame([("b",), ("b",), ("e",), (None,)], "term string")
    out = ev.mark_special_interest(pairs, targets)
    assert rows(out, "n", "special") == [(1, True), (2, False), (3, True), (4, False)] and out.columns == ["l", "r", "n", "special"]


def test_rank_join_gives_the_first_of_all_chains(spark):
    r = random.Random(2)
    for n, levels in ((1, 3), (7, 3), (40, 1000), (10_000, 5)):
        ab = [(f"a{i}", f"b{r.randrange(6)}", r.randrange(levels + 1) / levels) for i in range(150)]
        bc = [(f"b{r.randrange(6)}", f"c{i}", r.randrange(levels + 1) / levels) for i in range(90)]
        ab, bc = list({x[:2]: x for x in ab}.values()), list({x[:2]: x for x in bc}.values())
        every = sorted((-p * q, -p, -q, a, b, c) for a, b, p in ab for b2, c, q in bc if b == b2)[:n]
        frames = [spark.createDataFrame(x, "l string, r string, p double").repartition(3) for x in (ab, bc)]
        got = [(x["a"], x["b"], x["c"], x["score"]) for x in rl.best_hypotheses(*frames, n=n).collect()]
        assert got == [(a, b, c, -s) for s, _, _, a, b, c in every]
    assert rl.best_hypotheses(frames[0].limit(0), frames[1], 5).collect() == []


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(4000).withColumn("x", F.lit("v"))
    train, test = rl.split_80_20(df)
    assert rows(train, "id") == rows(rl.split_80_20(df.repartition(9))[0], "id")
    assert 3000 < train.count() < 3400 and train.count() + test.count() == 4000 and rows(rl.split_80_20(df, seed=1)[0], "id") != rows(train, "id")


@pytest.mark.parametrize("parts", [2, 7, 1024])
def test_quantiles_by_selection(spark, monkeypatch, parts):
    monkeypatch.setattr(tl, "SELECTION_PARTS", parts)
    rng = np.random.default_rng(parts)
    groups = {"hot": rng.integers(-(10**4 if parts < 1024 else 10**12), 10**4, 500), "ties": np.array([3] * 50 + [4]), "one": np.array([-7]), None: rng.integers(0, 9, 33)}
    data = [(k, int(v)) for k, values in groups.items() for v in values] + [("hot", None), ("empty", None)]
    cuts = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    out = tl.exact_quantiles(spark.createDataFrame(data, "k string, value long").repartition(6), ["k"], cuts)
    got = {(r["k"], r["cut"]): r["quantile"] for r in out.collect()}
    assert set(got) == {(k, c) for k in groups for c in cuts}
    assert all(np.isclose(got[k, c], np.quantile(v, c), rtol=1e-12, atol=1e-6) for k, v in groups.items() for c in cuts)


def test_walks_and_triangles(spark, shuffled):
    r = random.Random(4)
    edges = [(f"v{r.randrange(12)}", f"v{r.randrange(12)}") for _ in range(60)] + [("hub", f"v{i}") for i in range(12)] + [("hub", "hub"), ("x", "hub")]
    df = spark.createDataFrame([(a, b, "e") for a, b in edges], "src string, dst string, relationship string")
    want = {}
    for a, b in edges:
        for c, d in edges:
            if b == c:
                want[a] = want.get(a, 0) + 1
    assert dict(rows(gr.walk_counts(df), "id", "n_paths")) == want
    three = {}
    for a, b in edges:
        if b in want:
            three[a] = three.get(a, 0) + want[b]
    assert dict(rows(gr.walk_counts(df, 3), "id", "n_paths")) == three
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    tri = {}
    for a in near:
        n = sum(1 for b in near[a] for c in near[a] if b < c and c in near[b])
        if n:
            tri[a] = n
    assert dict(rows(gr.triangle_counts(df), "id", "n_triangles")) == tri


def test_triangles_are_sought_at_the_end_with_fewer_neighbours(spark, shuffled):
    """Both ways of closing a triangle, and no more rows than the smaller of the two lists of each edge."""
    fans = [(f"p{i:02d}", f"s{j:02d}") for i in range(20) for j in range(30)] + [(f"s{j:02d}", f"n{j % 3}") for j in range(30)]
    fans += [(f"p{i:02d}", f"n{i % 3}") for i in range(20)] + [(f"t{i}", f"m{i}_{j}") for i in range(3) for j in range(2)]
    fans += [(f"m{i}_0", f"m{i}_1") for i in range(3)] + [(f"m{i}_{j}", f"z{i}{j}{k}") for i in range(3) for j in range(2) for k in range(9)]
    near = {}
    for a, b in fans:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {a: sum(1 for b in near[a] for c in near[a] if b < c and c in near[b]) for a in near}
    df = spark.createDataFrame([(a, b, "e") for a, b in fans], "src string, dst string, relationship string")
    assert dict(rows(gr.triangle_counts(df), "id", "n_triangles")) == {a: n for a, n in want.items() if n}
    lists = {1: [4, 5, 6, 7, 8], 2: [4, 9], 4: [9], 5: [6, 7, 8, 9, 10, 11]}
    found = gr._third_vertices(spark.createDataFrame(list(lists.items()), "u long, vs array<long>")).collect()
    assert sorted((r.u, r.v, r.w or 0) for r in found) == [(1, 4, 9), (1, 5, 0), (2, 4, 9)]


def test_a_store_knows_its_input(spark, tmp_path):
    one, two = (spark.range(n).withColumn("x", F.lit("v")) for n in (5, 6))
    built = []

    def ask(df, params=()):
        return sb.read_or_build(spark, str(tmp_path / "t"), lambda: built.append(1) or df, [df], params).count()

    assert [ask(one), ask(two), ask(one.repartition(3)), ask(two), ask(one, ("p",))] == [5, 6, 5, 6, 5]
    assert len(built) == 3
    assert sb.fingerprint([one]) != sb.fingerprint([one.union(one)]) != sb.fingerprint([one.union(one).union(one)])


def test_of_two_writers_one_counts_and_drafts_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    sb._publish(spark, spark.range(3), path)
    sb._publish(spark, spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    spark.range(4).write.parquet(f"{path}/_draft-t-late")  # a move that ended inside
    assert spark.read.parquet(path).count() == 3 and [x.name for x in tmp_path.iterdir()] == ["t"]


def test_distinct_terms_of_windows(spark):
    """Exact below the sketch's size, near beyond it; null terms and undated rows count nowhere."""
    r = random.Random(3)
    data = [(f"2011-{1 + r.randrange(6):02d}-05", f"t{r.randrange(300)}") for _ in range(900)] + [(None, "undated"), ("2011-03-01", None)]
    df = spark.createDataFrame(data, "day string, term string").select(F.to_date("day").alias("pub_date"), "term").repartition(5)
    for lg, error in ((12, 0.0), (6, 0.5)):
        out = tl.window_distinct(df, "term", depths={"month": 1, "quarter": 3}, lg_entries=lg)
        got = {(x["window"], x["window_end"].month): x["n_terms"] for x in out.collect()}
        assert len(got) == 18
        for (window, end), n in got.items():
            first = {"month": end, "quarter": end - 2, "cumulative": 1}[window]
            want = len({t for day, t in data if day and t and first <= int(day[5:7]) <= end})
            assert abs(n - want) <= error * want


def test_distinct_terms_are_exact_at_any_number(spark):
    """More terms than a sketch of usual size holds, of which every third comes again two months later."""
    term, month = F.col("id").cast("string").alias("term"), F.lit("2011-01-05").cast("date")
    df = spark.range(40_000).select(term, F.explode(F.array(month, F.when(F.col("id") % 3 == 0, F.add_months(month, 2)))).alias("pub_date"))
    out = tl.window_distinct(df, "term", depths={"month": 1, "quarter": 3})
    got = {(x["window"], x["window_end"].month): x["n_terms"] for x in out.collect()}
    again = 13_334
    want = {("month", 1): 40_000, ("month", 3): again} | {(w, m): 40_000 for w in ("quarter", "cumulative") for m in (1, 2, 3)}
    assert got == want


def test_sketch_vectors_of_windows(spark, tmp_path):
    """Vectors of a window are those of its text: a plain count of contexts times signs."""
    import hashlib

    from hypograph.operators import embeddings as em

    r = random.Random(6)
    rows_ = [(f"2011-{1 + i % 5:02d}", mode, [f"w{r.randrange(9)}" for _ in range(r.randrange(0, 9))]) for i in range(60) for mode in ("word", "bigram")]
    stored = spark.createDataFrame([(t, mode, m) for m, mode, t in rows_], "tokens array<string>, mode string, month string").repartition(4)
    grid = tl.model_grid(spark.createDataFrame([(f"2011-{m:02d}-01",) for m in range(1, 6)], "m string").select(F.to_date("m").alias("month")))
    store = str(tmp_path / "vectors")
    keys = em.sketch_grid(stored, grid, store, min_size=8, min_count=2, size=40, radius=2)
    depth, got = {**tl.WINDOW_MONTHS, "cumulative": 99}, {}
    for x in spark.read.schema("word string, vector array<double>, n long, window string, until string, mode string").parquet(store).collect():
        got.setdefault((x["window"], x["until"], x["mode"]), {})[x["word"]] = (x["n"], x["vector"])
    assert {tuple(x) for x in keys.collect()} == set(got)
    signs = lambda w: [1 if (hashlib.md5(w.encode()).hexdigest() + hashlib.md5(f"{w}#1".encode()).hexdigest())[d] >= "8" else -1 for d in range(40)]
    for x in grid.collect():
        key = (x["window"], x["until"], x["mode"])
        end = 12 if x["window"] == "cumulative" else int(x["until"][5:])
        texts = [t for m, mode, t in rows_ if mode == x["mode"] and end - depth[x["window"]] < int(m[5:]) <= end and t]
        uses, vectors = {}, {}
        for t in texts:
            for i, w in enumerate(t):
                uses[w] = uses.get(w, 0) + 1
                v = vectors.setdefault(w, [0] * 40)
                for j in range(max(0, i - 2), min(len(t), i + 3)):
                    if j != i:
                        vectors[w] = v = [a + b for a, b in zip(v, signs(t[j]), strict=True)]
        want = {w: (n, [float(y) for y in vectors[w]]) for w, n in uses.items() if n >= 2}
        assert got.get(key, {}) == (want if len(texts) >= 8 else {}), key
    assert em.sketch_grid(stored, grid, store, min_size=8, min_count=2, size=40, radius=2).isEmpty()


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x.name for f in manager.localDirsString() for x in Path(f).rglob("shuffle_*") if x.name.endswith(".data")}


def test_a_stored_table_leaves_no_shuffle_files_and_can_be_dropped(spark):
    before = _shuffle_files(spark)
    table = sizing.written(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n")), "counts")
    again = sizing.written(table.join(table.groupBy("k").agg(F.max("n").alias("most")), "k").repartition(3), "again")
    for _ in range(50):  # files are removed a moment later
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    folder = Path(urlparse(table.inputFiles()[0]).path).parent
    assert folder.is_dir() and again.count() == 97
    sizing.dropped(table, spark.range(3))
    assert not folder.exists() and again.agg(F.sum("n")).first()[0] == 10_000


def test_phrase_scores_keep_no_counts(spark):
    """Of all that is stored on the way only the phrases are left."""
    from hypograph.operators.mentions import phrase_scores

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    old = set(shared.iterdir())
    toks = spark.createDataFrame([(["a", "b", f"x{i}"],) for i in range(80)] + [([f"y{i}"],) for i in range(900)], "tokens array<string>")
    assert [tuple(x)[:3] for x in phrase_scores(toks).collect()] == [("a", "b", 80)]
    assert {x.name.rsplit("-", 1)[0] for x in set(shared.iterdir()) - old} == {"phrases"}
