"""Fingerprints and their components against plain Python."""

import random
import re

import xxhash
from llm_corpus import CLASHING, docs, lower, text, words

from hypograph.llm import simhash
from hypograph.llm._stages import components


def plain_fingerprint(t, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return 0
    parts = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{value: least value reachable} over all pairs."""
    label = {x: x for x in prints}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if bin(a ^ b).count("1") <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_hash_is_that_of_spark(spark):
    """``xxhash64`` is XXH64 with seed 42."""
    r = spark.sql("select xxhash64('drei kurze wörter') h").first()
    assert r["h"] & (1 << 64) - 1 == xxhash.xxh64("drei kurze wörter".encode(), seed=42).intdigest()


def test_documents(spark):
    base = words(1, 60)
    texts = [" ".join(base), " ".join(base).upper(), " ".join([*base[:-1], "other"]), None, "", " \t\n", "one", "ONE", "one two", "one  two three", "Ünï ÄÖ x y z"]
    texts += [text(100 + i, n) for i, n in enumerate([3, 4, 5, 200, 9000, 70_000])] + ["w" * 300_000, "a " * 20_000]
    for i in range(40):  # near copies: one word changed
        w = words(7, 300)
        w[i * 7] = f"new{i}"
        texts.append(" ".join(w))
    rows = [*enumerate(texts, 10), (11, "a second text of id eleven"), (10, texts[0]), (None, "one"), (None, "never seen before")]
    got = simhash.near_duplicates(docs(spark, rows, extra=[*CLASHING, "fp", "least", "component"]).repartition(4))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    label = plain_components({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    want = sorted(((i, f"{p:016x}", least.get(label[p])) for i, p in prints), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_links_of_large_buckets(spark):
    """Families of fingerprints around random centres, many to a bucket, and some exactly three bits away."""
    r = random.Random(3)
    prints = {0, 1, 3, 7, (1 << 64) - 1}
    for _ in range(4):
        centre = r.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 4]))) for _ in range(60)}
        prints |= {centre ^ sum(1 << b for b in r.sample(range(20), 5)) for _ in range(60)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    links = simhash.links(nodes)
    assert links.filter("bit_count(a ^ b) > 2").isEmpty() and not links.groupBy("a", "b").count().filter("count > 1").count()
    found = {r["node"]: r["component"] for r in components(links).collect()}
    groups, want = {}, {}
    for x, y in plain_components(prints).items():
        want.setdefault(y, set()).add(signed(x))
        groups.setdefault(found.get(signed(x), signed(x)), set()).add(signed(x))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_every_close_pair_shares_a_key():
    masks = [m & (1 << 64) - 1 for m, _ in simhash.KEYS]
    assert len(masks) == 10 and all(m.bit_count() >= 38 for m in masks)
    assert all(any(not m & (1 << i | 1 << j) for m in masks) for i in range(64) for j in range(64))


def test_empty(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_query(spark, tmp_path):
    from hypograph.llm import queries

    docs(spark, ["one two three", "ONE two three", "four"]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_simhash(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 0), (2, 2)]
