"""Benchmark leaks against a plain search."""

import hashlib
import re

import llm_corpus as c
import pytest
from hypograph.llm import decontam, queries

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ITEM = c.words(500, 26)
ITEMS = [(1, " ".join(ITEM)), (2, " ".join(ITEM[:12])), (10, "Six short words é ß 日本"), (3, None), (4, ""), (5, "!!! ..."), (None, " ".join(c.words(501, 15))), (2, " ".join(ITEM[:12]))]


def texts():
    body = c.words(1, 300)
    put = lambda at, w: " ".join(body[:at] + w + body[at:])
    return [
        " ".join(body), put(20, ITEM), put(0, ITEM[:10]), put(300, ITEM[-10:]), put(9, ITEM[:9]), put(5, ITEM[3:14]).upper(), "six, SHORT words! é ß 日本",
        put(7, ["six", "short", "words", "é", "ß", "日本"]), "six short words é ß", put(3, c.words(501, 15)), None, "", "... !", " ".join(ITEM[:10] + ITEM[:10]),
        (",\n".join(ITEM[2:13])), *[put(50, ITEM)] * 3, put(1, ITEM[:6] + ["x"] + ITEM[6:]), " ".join(body * 40 + ITEM + body * 40),
    ]


def plain(pairs):
    windows = {}
    for i, t in ITEMS:
        w = re.findall(WORD, c.lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in pairs:
        w, hit, items = re.findall(WORD, c.lower(t)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    items |= {str(x) for x in found if x is not None}
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(items), digest, bool(hit)))
    return sorted(out, key=str)


def bench(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")


def test_query_equals_plain_search(spark, tmp_path):
    pairs = [*enumerate(texts()), (None, " ".join(ITEM)), (1, texts()[1])]
    c.docs(spark, pairs, extra=c.CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((tuple(r) for r in queries.op10_benchmark_leaks(spark, str(tmp_path)).collect()), key=str) == plain(pairs)


@pytest.mark.parametrize("block_bytes", [40, 1 << 24])
def test_blocks_change_nothing(spark, block_bytes):
    rows = decontam.scan(c.docs(spark, texts()), bench(spark), carry=["doc_id"], block_bytes=block_bytes).collect()
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"])) for r in rows}
    assert got == {d: (n, h, i) for d, n, h, i, *_ in plain(list(enumerate(texts())))}


def test_removed_and_clean(spark):
    docs = c.docs(spark, texts(), extra=c.CLASHING)
    scanned = decontam.scan(docs, bench(spark))
    hit = {r[0] for r in plain(list(enumerate(texts()))) if r[5]}
    clean = decontam.clean(scanned)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(len(texts()))) - hit
    cut = decontam.removed(scanned)
    assert cut.columns == docs.columns
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert all(after[i] == t for i, t in enumerate(texts()) if i not in hit)
    assert decontam.scan(cut, bench(spark)).filter("n_hit > 0").count() == 0
    assert c.words(1, 300)[:20] == after[1].split()[:20] and c.words(1, 300)[20:] == after[1].split()[20:]


def test_empty_tables(spark):
    assert decontam.scan(c.docs(spark, []), bench(spark)).count() == 0
    assert decontam.scan(c.docs(spark, ["a b"]), bench(spark, [])).first()["n_hit"] == 0


def test_windows_are_as_small_as_their_arrays():
    """What is sent and held grows with the text and 24 bytes a window at most, not with words times windows."""
    import pickle

    items = [(str(i), c.text(i, 400, 10**6)) for i in range(200)]
    windows = decontam.Windows(items, 10)
    text = sum(len(t) for _, t in items)
    assert windows.nbytes() <= text + 200 + 24 * 200 * 391
    assert len(pickle.dumps(windows)) <= windows.nbytes() + 20_000


def test_items_with_the_same_window(spark):
    """A window that several items have counts for each of them."""
    words = c.words(3, 10)
    bench = spark.createDataFrame([("a", " ".join(words)), ("b", " ".join(["x", *words])), (None, " ".join(words)), ("c", c.text(9, 12))], "item_id string, text string")
    row = decontam.scan(c.docs(spark, [" ".join([*c.words(4, 20), *words])]), bench).first()
    assert row["items"] == ["a", "b"] and row["n_hit"] == 10
