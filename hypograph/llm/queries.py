"""The queries of this subpackage over the sample tables, and their DuckDB statements where SQL can say it."""

from __future__ import annotations

from datetime import UTC, datetime

import public_tokenizers
from pyspark.sql import functions as F

from ..operators.sizing import scratch_dir, small_side, written
from . import clusters, decontam, langid, neardup, packing, passages, rollup, sharding, simhash, topk, toxicity, trie, warc

SHARDS = 24


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _id_hash(modulus):
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % modulus


def op1_warc(spark, d):
    folder = scratch_dir(spark, "warc")
    warc.write_archives(_table(spark, d, "pages"), f"{folder}/raw", datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    written(warc.normalise(spark, f"{folder}/raw", f"{folder}/records"), "archives")
    records = warc.read_records(warc.read_index(spark, f"{folder}/records"), with_payload=False)
    return records.select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to")
    )


def op2_histogram_shards(spark, d):
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, d, "documents").select(
        F.col("doc_id").alias("key"),
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    found = sharding.shard(written(rows, "sizes"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark, d):
    return packing.packed_documents(_table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_top_inner_products(spark, d):
    vectors = topk.integer_vectors(_table(spark, d, "embeddings"))
    return topk.top_inner_products(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_near_duplicates(spark, d):
    return neardup.near_duplicates(_table(spark, d, "documents"))


def op6_language(spark, d):
    docs = _table(spark, d, "documents")
    profiles = langid.fit_profiles(langid.training_rows(docs, _id_hash(4) != 2))
    found = langid.identify(docs, profiles, ["doc_id"])
    held_out = F.coalesce(_id_hash(4) == 2, F.lit(False))
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_repeated_passages(spark, d):
    return passages.repeated_passages(_table(spark, d, "documents"))


def op8_token_totals(spark, d):
    """All documents come in under one vocabulary, all are counted anew with another, the toxic ones go."""
    docs, store = _table(spark, d, "documents"), scratch_dir(spark, "totals")
    old, new = (
        written(rollup.token_counts(docs, name, public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN), "counts")
        for name in ("byte_bpe_50k", "byte_bpe_multi_50k")
    )
    toxic = _table(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct()
    toxic, _ = small_side(written(toxic, "toxic"))
    batches = {
        "1-inserts": rollup.inserts(old),
        "2-revisions": rollup.revisions(old, new),
        "3-deletes": rollup.deletes(new.join(toxic, "doc_id", "left_semi")),
    }
    for name, changes in batches.items():
        rollup.commit(changes, store, name)
    rollup.commit(batches["2-revisions"], store, "2-revisions")  # a retry adds nothing
    return rollup.totals(spark, store, list(batches))


def op9_toxicity(spark, d):
    docs = _table(spark, d, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, _table(spark, d, "labels"), _id_hash(5) != 0))
    found = toxicity.score(docs, model, ["doc_id"]).select("row.doc_id", "score")
    held_out = F.coalesce(_id_hash(5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_benchmark_leaks(spark, d):
    found = decontam.scan(_table(spark, d, "documents"), _table(spark, d, "benchmark"), carry=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", "items"), "utf-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_prefix_trie(spark, d):
    return trie.prefix_trie(_table(spark, d, "conversations"))


def op12_simhash(spark, d):
    return simhash.near_duplicates(_table(spark, d, "documents"))


def op13_clusters(spark, d):
    return clusters.clusters(_table(spark, d, "embeddings"))


QUERIES = {
    x.__name__: x
    for x in (
        op1_warc,
        op2_histogram_shards,
        op3_packing,
        op4_top_inner_products,
        op5_near_duplicates,
        op6_language,
        op7_repeated_passages,
        op8_token_totals,
        op9_toxicity,
        op10_benchmark_leaks,
        op11_prefix_trie,
        op12_simhash,
        op13_clusters,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _clusters_sql(k=40, rounds=5):
    """Rounds as one common table expression each; components are summed place by place."""
    assign = """a{i} AS MATERIALIZED (
  SELECT vec_id, v, cluster, distance FROM (
    SELECT v.vec_id, v.v, c.cluster, list_sum(list_transform(generate_series(1, 64), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j])))::BIGINT AS distance
    FROM v, c{i} c
  ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1
)"""
    update = """s{i} AS (
  SELECT cluster, j, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(generate_series(1, 64)) AS j, unnest(v) AS x FROM a{i}) GROUP BY 1, 2
),
c{n} AS MATERIALIZED (
  SELECT c.cluster, coalesce(u.v, c.v) AS v
  FROM c{i} c LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY 1) u ON u.cluster = c.cluster
)"""
    steps = [part for i in range(rounds) for part in (assign.format(i=i), update.format(i=i, n=i + 1))]
    return """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INTEGER AS cluster, v FROM v WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= %d
),
%s,
%s
SELECT a.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a%d a JOIN c%d c ON c.cluster = a.cluster
""" % (k, ",\n".join(steps), assign.format(i=rounds), rounds, rounds)


ORACLE = {
    "op1_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM r
""",
    "op4_top_inner_products": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q, v c
  WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score
FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
""",
    "op5_near_duplicates": rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
    END AS s
  FROM t
),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * n >= 80 * (na.n_shingles + nb.n_shingles - n)
),
reach AS (
  SELECT doc_id, doc_id AS node FROM n
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.node
)
SELECT n.doc_id, n.n_shingles, min(node) AS component_id, n.doc_id = min(node) AS kept
FROM n JOIN reach r ON r.doc_id = n.doc_id
GROUP BY n.doc_id, n.n_shingles
""",
    "op10_benchmark_leaks": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT item_id, least(len(w), 10) AS size, unnest(list_transform(generate_series(1, greatest(len(w) - 9, 1)), lambda k: array_to_string(w[k:k + 9], ' '))) AS x
  FROM i WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT size FROM g),
dw AS (
  SELECT doc_id, size, unnest(generate_series(1, len(w) - size + 1)) AS k, w FROM d, sizes WHERE len(w) >= size
),
h AS (
  SELECT dw.doc_id, dw.k, dw.size, g.item_id
  FROM (SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS x FROM dw) dw JOIN g ON g.x = dw.x AND g.size = dw.size
),
words AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS p FROM h) GROUP BY 1),
items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
),
h AS (
  SELECT a.conv_id AS c, a.w, coalesce(b.w, []) AS base,
         (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(a.conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))) AS inverse
  FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 100
),
k AS (SELECT c, w, base, ((4294967295 - inverse) % 6)::INTEGER AS h FROM h),
r AS (SELECT c, base[1:h] || w[h + 1:] AS w FROM k),
p AS (SELECT c, len(w) AS n, unnest(generate_series(0, len(w))) AS d, w FROM r),
q AS (SELECT c, n, d, sha256(to_json(w[1:d])::VARCHAR) AS id, CASE WHEN d > 0 THEN sha256(to_json(w[1:d - 1])::VARCHAR) END AS up, CASE WHEN d > 0 THEN length(w[d].t) ELSE 0 END AS size FROM p),
g AS (
  SELECT d, id, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM q GROUP BY 1, 2
),
kids AS (SELECT up AS id, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY 1),
m AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN kids USING (id)),
s AS (
  SELECT q.id, sum((m.n_convs - 1) * m.size)::BIGINT AS saved_tokens, (count(*) FILTER (m.n_children = 0))::BIGINT AS n_leaves
  FROM m JOIN q ON q.c = m.conv_id AND q.d <= m.d GROUP BY 1
)
SELECT m.conv_id, m.d::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s ON s.id = m.id LEFT JOIN m u ON u.id = m.up
""",
    "op13_clusters": _clusters_sql(),
}
