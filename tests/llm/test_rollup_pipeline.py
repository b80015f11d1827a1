"""Token totals by deltas, and the whole pipeline on a small corpus."""

from collections import Counter

import corpus_pipeline
import llm_corpus as c
import public_tokenizers
import pytest
from hypograph.llm import queries, rollup
from test_decontam import ITEM
from test_language_toxicity import prose

SIGNED = "doc_id long, source string, lang string, tokenizer string, n_tokens long, sign int"


def totals(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


def test_deltas_equal_a_recount(spark, tmp_path):
    store = str(tmp_path / "store")
    texts = [c.text(i, 10 + i) for i in range(40)] + [None, "", "a b"]
    docs = c.docs(spark, texts, extra=c.CLASHING)
    counts = rollup.token_counts(docs, "words")
    assert rollup.commit(rollup.inserts(counts), store, "one")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    pieces = rollup.token_counts(docs.filter("doc_id < 10"), "pieces", path, pattern)
    assert rollup.commit(rollup.revisions(counts.filter("doc_id < 10"), pieces), store, "two")
    assert rollup.commit(rollup.deletes(counts.filter("doc_id >= 20")), store, "three")
    assert not rollup.commit(rollup.inserts(counts), store, "three")
    names = ["one", "two", "three", "absent"]
    left = pieces.unionByName(counts.filter("doc_id >= 10 and doc_id < 20")).collect()
    want = Counter()
    docs_left = Counter()
    for r in left:
        want[r["source"], r["lang"], r["tokenizer"]] += r["n_tokens"]
        docs_left[r["source"], r["lang"], r["tokenizer"]] += 1
    got = totals(rollup.totals(spark, store, names))
    assert got == {k: (docs_left[k], want[k]) for k in docs_left}
    assert totals(rollup.totals(spark, store, [rollup.compact(spark, store, names, "all")])) == got


def test_token_counts(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  wörld\n!", None, "", "<|endoftext|>", c.text(1, 3000), "日本 x"]
    rows = rollup.token_counts(c.docs(spark, texts), "v", path, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(plain.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in rollup.token_counts(c.docs(spark, texts), "w").collect()} == {i: len((t or "").encode().split()) for i, t in enumerate(texts)}


def test_a_broken_batch_is_written_again_and_nulls_are_groups(spark, tmp_path):
    store = str(tmp_path)
    rows = spark.createDataFrame([(1, None, "en", "v", 5, 1), (2, None, "en", "v", 6, 1), (3, "s", None, "v", 7, 1), (3, "s", None, "v", 7, -1)], SIGNED)
    rows.limit(1).write.parquet(f"{store}/batch=a")  # files without the marker
    assert not rollup.committed(spark, store, "a") and totals(rollup.totals(spark, store, ["a"])) == {}
    assert rollup.commit(rows, store, "a")
    assert totals(rollup.totals(spark, store, ["a"])) == {(None, "en", "v"): (2, 11)}
    assert rollup.commit(rows.limit(0), store, "empty") and not rollup.commit(rows, store, "empty")


def _plain(name):
    import base64

    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_a_recount(spark, tmp_path):
    """What is left after all batches is every document that is not toxic, under the second vocabulary."""
    texts = [c.text(i, 20) + " Ünïcödé 日本\n" for i in range(30)] + [None, "", "w" * 20_000]
    docs = c.docs(spark, texts, extra=c.CLASHING)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(0, 30, 2)] + [(None, 1, 1), (77, 1, 1), (6, 1, 1), (8, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain, want = _plain("byte_bpe_multi_50k"), {}
    for r in docs.collect():
        if r["doc_id"] not in {0, 6, 12, 18, 24}:
            n, tokens = want.get((r["source"], r["lang"], "byte_bpe_multi_50k"), (0, 0))
            want[r["source"], r["lang"], "byte_bpe_multi_50k"] = n + 1, tokens + len(plain.encode_ordinary(r["text"] or ""))
    assert totals(queries.op8_token_totals(spark, str(tmp_path))) == want


def test_two_writers_of_one_batch(spark, tmp_path):
    """Both have seen the batch uncommitted; the second one's files are there, but do not count."""
    store = str(tmp_path)
    rows = spark.createDataFrame([("s", "en", "v", 1, 5)], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    assert rollup._publish(rows, store, "a") and not rollup._publish(rows, store, "a")
    assert totals(rollup.totals(spark, store, ["a"])) == {("s", "en", "v"): (1, 5)}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    passage = prose("en", 501, 60)
    clean = [prose(lang, 10 + i, 80) for i, lang in enumerate(["en", "de", "fr"] * 10)]
    texts = clean + [clean[3], clean[4] + " end", None, "12 !!", "", prose("en", 900, 80) + " " + " ".join(ITEM[:14])]
    texts += [prose("en", 600 + i, 40) + " " + passage + " " + prose("de", 700 + i, 40) for i in range(5)]
    c.docs(spark, texts, extra=c.CLASHING).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, passage


def test_stages(spark, corpus):
    path, texts, passage = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    language, near, repeats, leaks = left
    assert set(language) == set(range(len(texts))) - {32, 33, 34}
    assert set(near) == set(language) - {30, 31}
    assert set(repeats) == set(near) and [i for i, t in repeats.items() if passage in t] == [36]
    assert set(leaks) == set(repeats) - {35}
    assert all(leaks[i] == texts[i] for i in range(30))


def test_run(spark, corpus):
    path, texts, _ = corpus
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in rows} == set(range(30)) | set(range(36, 41))
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048


def test_run_on_nothing(spark, tmp_path):
    c.docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
