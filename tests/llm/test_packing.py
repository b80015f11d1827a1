"""Packing: token ids, places, and the number of sequences."""

import random
import zlib

import llm_corpus as c
import numpy as np
import public_tokenizers
import pytest
from hypograph.llm import packing
from hypothesis import given, settings
from hypothesis import strategies as st

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def places(plan):
    """Bins of a plan: {bin: sorted (offset, length)}."""
    bins, counts = {}, {}
    for length, rank, n, first, each, offset in plan.placements:
        assert rank == counts.get(length, 0)
        counts[length] = rank + n * each
        for k in range(n * each):
            bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
    return {b: sorted(x) for b, x in bins.items()}, counts


def check(histogram, capacity):
    plan = packing.Plan(dict(histogram), capacity)
    bins, counts = places(plan)
    assert counts == {k: n for k, n in histogram.items() if n}
    assert sorted(bins) == list(range(plan.bins))
    for own in bins.values():
        end = 0
        for offset, length in own:
            assert offset == end
            end += length
        assert end <= capacity
    return plan


def fewest(items, capacity):
    """The least number of bins, by trying all."""
    items, best = sorted(items, reverse=True), len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in rooms[:k]:
                place(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_never_costs_a_sequence(items):
    """What is fixed is part of an optimal packing: fixed bins and the fewest for the rest are the fewest."""
    plan = packing.Plan.__new__(packing.Plan)
    histogram = {x: items.count(x) for x in items}
    plan.capacity, plan.left, plan.taken, plan.placements, plan.bins, plan.fixed = 20, dict(histogram), dict.fromkeys(histogram, 0), [], 0, 0
    plan._reduce()
    rest = [x for x, n in plan.left.items() for _ in range(n)]
    assert plan.fixed + (fewest(rest, 20) if rest else 0) == fewest(items, 20)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_plans_are_whole(histogram):
    plan = check(histogram, 64)
    total = sum(k * n for k, n in histogram.items())
    # No packing has fewer: k pieces of more than a (k + 1)-th of the capacity fill a sequence at most.
    fewest_ = max([-(-total // 64), *(-(-sum(n for x, n in histogram.items() if (k + 1) * x > 64) // k) for k in range(1, 64))])
    assert fewest_ <= plan.bins <= max(1, 11 / 9 * fewest_ + 1 + sum(n for k, n in histogram.items() if k > 32)) or not histogram


def test_classes_of_millions_are_planned_at_once():
    r = random.Random(1)
    plan = check({k: r.randrange(1, 30) for k in range(1, 300)}, 300)
    assert plan.bins
    big = packing.Plan({k: r.randrange(10**6) for k in range(1, 2049)}, 2048)
    assert len(big.placements) < 200_000
    assert big.bins <= sum(k * n for k, n in [(p[0], p[2] * p[4]) for p in big.placements]) / 2048 * 1.01


TEXTS = ["Hello  World", "it's\tfine\nNOW", "", None, "naïve café — 12,345.67!", "a" * 500, "x y z\x1fq", "end <|endoftext|> of", "日本語 のテキスト", "ΣΑΣ é ́x", "tab\rreturn", "Größe, İstanbul ŉ ǅ ſ; (x)., \"so.\" don't! ok?! é, ½, a², 3.", "ÉTÉ Çà\u0300 naı\u0308ve."]


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(TOKENIZER), packing.WordTokenizer(TOKENIZER)
    texts = [t or "" for t in TEXTS] + [c.text(i, 50) for i in range(5)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = [*TEXTS, c.text(1, 4000), *[c.text(i % 5, 40) for i in range(60)]]
    pairs = [*enumerate(texts), (3, "same id"), (3, "same id"), (None, "no id")]
    out = packing.packed_documents(c.docs(spark, pairs, extra=c.CLASHING), TOKENIZER, with_ids=True)
    rows = out.collect()
    want = []
    for doc, text in pairs:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in used.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
    assert len(used) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(out).collect()}
    assert all(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] for r in rows)


@pytest.mark.parametrize("group_rows", [3, 1000])
def test_a_hot_length_is_split_with_the_same_use(spark, group_rows):
    pieces = spark.createDataFrame([(i, 0, 5 if i % 3 else 7) for i in range(100)], "doc_id long, piece int, length long")
    rows = packing.pack(pieces, 12, group_rows).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 100
    assert len({r["sequence_id"] for r in rows}) == 50


def test_empty_table(spark):
    assert packing.packed_documents(c.docs(spark, []), TOKENIZER).count() == 0
