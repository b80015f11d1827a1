"""Near-duplicates against all pairs."""

import random

import llm_corpus as c
import numpy as np
import pytest
from hypograph.llm import _stages, neardup


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def mutated(words, times, seed):
    r, out = random.Random(seed), list(words)
    for _ in range(times):
        out[r.randrange(len(out))] = f"m{r.randrange(10**6)}"
    return " ".join(out)


def corpus():
    """Copies, near copies around the threshold, chains, short, blank and unrelated texts."""
    texts = [c.text(i, 30 + 7 * i) for i in range(12)]
    base = c.words(99, 120)
    texts += [mutated(base, k % 6, 1000 + k) for k in range(40)]
    chain = c.words(98, 100)
    for k in range(8):
        chain = mutated(chain, 1, 2000 + k).split(" ")
        texts.append(" ".join(chain))
    texts += ["a b", "A  b", "a b c", "", "  \n ", None, "one", "One\ttwo three four", "one two three four", c.text(3, 51).upper()]
    return list(enumerate(texts))


def test_equals_all_pairs(spark):
    pairs = corpus()
    want = c.components(pairs, 4)
    assert found(neardup.near_duplicates(c.docs(spark, pairs))) == want
    assert len({x for _, x in want.values()}) < len(pairs) - 30


def test_five_words(spark):
    pairs = corpus()
    assert found(neardup.near_duplicates(c.docs(spark, pairs), size=5)) == c.components(pairs, 5)


def test_a_large_group_and_members_off_its_centre(spark):
    """The least id is far from some members, which are linked through others."""
    base = c.words(5, 80)
    near = mutated(base, 2, 1)
    texts = [near, " ".join(base), *[mutated(base, 2 + k % 3, 10 + k) for k in range(150)]]
    pairs = list(enumerate(texts))
    assert found(neardup.near_duplicates(c.docs(spark, pairs))) == c.components(pairs, 4)


def test_nulls_repeats_and_other_columns(spark):
    same = c.text(7, 60)
    rows = [(1, same), (1, same), (2, same), (None, same), (None, "alone " + c.text(8, 50)), (3, None), (3, None)]
    out = neardup.near_duplicates(c.docs(spark, rows, extra=c.CLASHING)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None) == [
        (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)
    ]
    assert sorted((r["component_id"] is None, r["kept"]) for r in out if r["doc_id"] is None) == [(False, False), (True, True)]


def test_firsts_of_groups_keeps_columns_and_one_row_of_each(spark):
    same = c.text(7, 60)
    docs = c.docs(spark, [(4, same), (4, same), (9, same + " end"), (5, None), (6, ""), (None, c.text(1, 20))], extra=c.CLASHING)
    kept = neardup.firsts_of_groups(docs, neardup.near_duplicates(docs, size=5))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "6", "None"]


def test_empty_table(spark):
    assert neardup.near_duplicates(c.docs(spark, [])).count() == 0


def test_a_very_long_text(spark):
    long = c.text(1, 120_000, 50_000)
    out = found(neardup.near_duplicates(c.docs(spark, [long, long + " more", c.text(2, 50)])))
    assert out[1][1] == 0 and out[2][1] == 2 and out[0][0] == len(c.shingle_set(long, 4))


def test_estimate_is_near_the_similarity(spark):
    base = c.words(1, 600, 10**6)
    a, b = " ".join(base), mutated(base, 30, 3)
    sets = c.shingle_set(a, 4), c.shingle_set(b, 4)
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    rows = {r["doc_id"]: r for r in neardup.signatures(c.docs(spark, [a, b])).collect()}
    pair = spark.createDataFrame([(rows[0]["sig"], rows[1]["sig"])], "a array<long>, b array<long>")
    assert abs(pair.select(neardup.estimate(pair["a"], pair["b"])).first()[0] - true) < 0.15


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    r = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (40, 2))] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 201 + i) for i in range(20)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    out = {x["node"]: x["component"] for x in _stages.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_thresholds_that_bands_and_floor_are_not_made_for():
    with pytest.raises(ValueError, match="80 percent"):
        neardup.near_duplicates(None, percent=60)
