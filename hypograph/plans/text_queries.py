"""Queries on text: cleaning, sentences, tokens, mentions, vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dates import month_tag, tagged_month
from ..operators import mentions as mt
from ..operators import sentences as st
from ..operators import vocab as vc
from ..operators.sizing import written
from ..sources import articles as sa
from . import fixtures as fx
from .fixtures import with_cte


def clean_ascii(spark, d):
    docs = fx.table(spark, d, "documents")
    text = tx.clean_ascii(F.col("text"))
    return docs.select("doc_id", text.alias("clean"), F.length(text).alias("n_ascii"))


def sentence_split(spark, d):
    return fx.article_sentences(spark, d).select("article_id", "para_pos", "sent_pos", "text")


def sentence_offsets(spark, d):
    s = fx.article_sentences(spark, d)
    return s.select("article_id", "para_pos", "sent_pos", F.col("offset").alias("start"), F.length("text").alias("width"))


def dialogue_sentences(spark, d):
    turns = fx.table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("article_id"), F.split("text", "\n").alias("paragraphs")
    )
    return st.sentences(turns).groupBy("article_id").agg(
        F.count("*").alias("n_sentences"), F.max(F.col("offset") + F.length("text")).alias("n_chars")
    )


def tokens(spark, d):
    t = mt.tokens(fx.article_sentences(spark, d))
    return t.groupBy("article_id", "sent_pos").agg(
        F.count("*").alias("n_tokens"), F.sum(F.length("token")).alias("n_chars"), F.max("token").alias("last_token")
    )


def mentions_single(spark, d):
    return fx.found(spark, d)


def mentions_multi(spark, d):
    return mt.multi_word_mentions(fx.wrapped_sentences(spark, d), fx.multi_vocab(spark, d))


def mentions_padded(spark, d):
    both = fx.vocab(spark, d).unionByName(fx.multi_vocab(spark, d))
    return mt.padded_mentions(fx.wrapped_sentences(spark, d), both)


def mentions_by_category(spark, d):
    both = fx.vocab(spark, d).unionByName(fx.multi_vocab(spark, d))
    found = mt.mentions(fx.wrapped_sentences(spark, d), both)
    return found.groupBy("article_id", "cat").agg(F.count("*").alias("n"), F.min("doc_pos").alias("first_pos"))


def word_counts(spark, d):
    return mt.word_counts(fx.found(spark, d))


def kinase_like_words(spark, d):
    return mt.words_containing(fx.found(spark, d), "tion", "B")


def noise_filter(spark, d):
    """Whole mentions, and numbering and statistics residue made of them, as if a tagger had proposed them."""
    found = fx.found(spark, d).select("article_id", "doc_pos", "sent_pos", "word")
    number = F.col("sent_pos").cast("string")
    forms = [
        F.col("word"),
        F.concat(F.lit("= "), "word"),
        F.concat(F.lit("("), number, F.lit(") "), "word"),
        F.concat(F.lit("("), number, F.lit(") "), "word", F.lit(" of")),
        F.concat(number, F.lit(".5 "), "word"),
        F.concat(F.lit("v"), number, F.lit(".5")),
        F.concat("word", F.lit(" doi: 10")),
        F.concat("word", F.lit(" = 4")),
        F.concat("word", F.lit(" = 42")),
    ]
    return mt.drop_noise(found.select("article_id", "doc_pos", F.explode(F.array(*forms)).alias("word")))


def _dictionary(spark, d):
    terms = fx.vocab(spark, d).filter("cat <> 'B'").select("term").distinct()
    return terms.select(
        tx.name_key(F.col("term")).alias("key"), F.concat(F.lit("ID:"), F.length("term").cast("string")).alias("concept_id")
    )


def concept_ids(spark, d):
    return mt.concept_ids(fx.found(spark, d), _dictionary(spark, d)).groupBy("article_id", "word", "concept_id").agg(
        F.count("*").alias("n")
    )


def canonical_tokens(spark, d):
    v = fx.vocab(spark, d)
    synonyms = v.filter("cat = 'A'").select(
        F.col("term").alias("synonym"), F.concat(F.lit("gene_"), F.substring("term", 1, 3)).alias("canonical")
    )
    english = v.filter("term like 'th%'").select(F.col("term").alias("word")).distinct()
    toks = mt.tokens(fx.article_sentences(spark, d)).withColumn("token", tx.strip_punctuation(F.col("token")))
    out = mt.canonical_tokens(toks.filter("token <> ''"), synonyms, english)
    return out.groupBy("article_id", "canonical").agg(F.count("*").alias("n"))


def bigram_phrases(spark, d):
    corpus = st.token_corpus(fx.article_sentences(spark, d))
    p = mt.phrase_scores(corpus)
    return p.select("w1", "w2", "n12", "n1", "n2", F.round("score", 6).alias("score"))


def bigram_corpus(spark, d):
    """Sentences with scored phrases merged into one token."""
    keys = ["article_id", "sent_pos"]
    corpus = st.token_corpus(fx.article_sentences(spark, d)).select(
        *keys, F.filter("tokens", lambda t: t != "").alias("tokens")
    )
    corpus = written(corpus, "corpus")  # read for the scores, for the phrases of each sentence and for the sentences
    phrases = written(mt.phrase_scores(corpus), "phrases")
    merged = mt.join_phrases(corpus, phrases, keys)
    return merged.groupBy("article_id").agg(
        F.sum(F.size("tokens")).alias("n_tokens"), F.count_if(F.size("tokens") > 0).alias("n_sentences")
    )


def _raw_terms(spark, d):
    words = fx.table(spark, d, "documents").select(F.explode(F.split("text", r"\s")).alias("term"))
    return words.filter(F.col("term").rlike("^[A-Za-z0-9-]+$"))


def vocab_clean(spark, d):
    return vc.clean_terms(_raw_terms(spark, d))


def _term_facts(spark, d):
    """Parts as curated rows: brand, name and type as the two terms, three codes."""
    return fx.table(spark, d, "part").select(
        (F.col("p_partkey") % 3 + 1).cast("int").alias("code"),
        F.concat(F.col("p_brand"), F.lit(" "), "p_name").alias("l"),
        F.concat(F.col("p_type"), F.lit("-"), F.col("p_size").cast("string")).alias("r"),
    )


def vocab_extended(spark, d):
    return vc.extend_vocabulary(fx.vocab(spark, d), _term_facts(spark, d))


def vocab_minus(spark, d):
    words = _raw_terms(spark, d).select(F.lower("term").alias("term"))
    both = words.select(F.explode(F.array(F.lit("B"), F.lit("C"))).alias("cat"), "term").filter(
        (F.col("cat") == "B") | (F.length("term") % 2 == 0)
    )
    return vc.subtract_category(both.distinct())


def _descriptors(spark, d):
    p = fx.table(spark, d, "part")
    size = F.col("p_size").cast("string")
    return p.select(
        F.concat(F.lit(" "), F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("name"),
        F.array(
            F.concat(F.when(F.col("p_type") == "SMALL", "E").when(F.col("p_type") == "LARGE", "C").otherwise("D"), size),
            F.concat(F.lit("D"), size, F.lit(".100")),
            F.concat(F.lit("C"), size),
        ).alias("trees"),
    )


def tree_classify(spark, d):
    return vc.classify_trees(_descriptors(spark, d))


def tree_classify_first(spark, d):
    return vc.classify_first_tree(_descriptors(spark, d))


def token_corpus(spark, d):
    c = st.token_corpus(fx.article_sentences(spark, d), min_sentences=2)
    return c.select("article_id", "sent_pos", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens"))


def article_text(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.split("text", "\n").alias("paragraphs"))
    return st.article_text(docs)


def month_tag_filter(spark, d):
    """Articles whose file name is tagged with a month from July 2011 to June 2013."""
    a = fx.articles(spark, d).select("article_id", "file_name", month_tag(F.col("pub_date")).alias("tag"))
    month = tagged_month(F.col("file_name"))
    kept = a.withColumn("month", month).filter(F.col("month").between("2011-07-01", "2013-06-01"))
    return kept.select("article_id", "tag", F.date_format("month", "yyyy-MM-dd").alias("month"))


def valid_articles(spark, d):
    a = fx.articles(spark, d)
    blank = a.withColumn("article_id", F.when(F.col("article_id") % 10 != 0, F.col("article_id")))
    return sa.valid_articles(blank).select("article_id", F.size("paragraphs").alias("n_paragraphs"))


def first_articles(spark, d):
    return fx.articles(spark, d).select("file_name", "article_id").orderBy("file_name").limit(25)


def corpus_slices(spark, d):
    """Articles of all batches, taken one batch after the other, as a batch job would."""
    a = fx.articles(spark, d).select("file_name", "article_id")
    slices = sa.slice_of(F.col("file_name"), 8)
    parts = [a.filter(slices == i) for i in range(8)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def page_paragraphs(spark, d):
    """Paragraph text of raw pages by expression only: attributes and tags removed, line ends kept."""
    p = fx.table(spark, d, "pages").select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))).alias("para_pos", "body")
    )
    return p.select("page_id", "para_pos", F.regexp_replace("body", "<[^>]*>", "").alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_ascii,
        sentence_split,
        sentence_offsets,
        dialogue_sentences,
        tokens,
        mentions_single,
        mentions_multi,
        mentions_padded,
        mentions_by_category,
        word_counts,
        kinase_like_words,
        noise_filter,
        concept_ids,
        canonical_tokens,
        bigram_phrases,
        bigram_corpus,
        vocab_clean,
        vocab_extended,
        vocab_minus,
        tree_classify,
        tree_classify_first,
        token_corpus,
        article_text,
        month_tag_filter,
        valid_articles,
        first_articles,
        corpus_slices,
        page_paragraphs,
    )
}

# A term of several words is met wherever the text has it (any white space counting as a blank) and only
# punctuation stands between there and the white space or sentence start before.
_MULTI_HITS = r"""flat AS (SELECT article_id, para_pos, sent_pos, start, regexp_replace(text, '\s', ' ', 'g') AS t FROM wsents),
multi_at AS (SELECT article_id, cat, term, para_pos, sent_pos, start, t, unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, length(term)) = term)) AS p
  FROM flat JOIN multi_vocab ON contains(t, term)),
multi_hits AS (SELECT article_id, cat, term AS word, start + p - 1 AS doc_pos, para_pos, sent_pos FROM multi_at
  WHERE regexp_matches(substr(t, 1, p - 1), '(^| )[[:punct:]]*$'))"""
_SINGLE_HITS = r"""single_hits AS (SELECT article_id, cat, term AS word, start + off AS doc_pos, para_pos, sent_pos FROM (
  SELECT *, i - 1 AS n, replace(replace(w[i], '.', ''), '/', '') AS token,
    CAST(coalesce(sum(length(w[i]) + 1) OVER (PARTITION BY article_id, sent_pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM (SELECT *, string_split(t, ' ') AS w FROM flat), unnest(range(1, len(w) + 1)) u(i)) JOIN vocab ON token = term)"""


def _extend(base: str, extra: str, body: str) -> str:
    return with_cte(base, f", {extra}\n{body}")


_CORPUS = """corpus AS (SELECT article_id, sent_pos, list_filter(string_split(replace(text, '.', ' '), ' '), lambda x: x <> '') AS w FROM sents),
uni AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM corpus) GROUP BY w),
bi AS (SELECT w1, w2, count(*) AS n12 FROM (SELECT w[i] AS w1, w[i + 1] AS w2 FROM corpus, unnest(range(1, len(w))) t(i)) GROUP BY w1, w2),
scored AS (SELECT w1, w2, n12, a.n AS n1, b.n AS n2, (n12 - 5) * (SELECT count(*) FROM uni) / (a.n * b.n) AS score
  FROM bi JOIN uni a ON a.w = w1 JOIN uni b ON b.w = w2 WHERE n12 >= 5)"""

_RAW_TERMS = """raw AS (SELECT term FROM (SELECT unnest(regexp_split_to_array(text, '\\s')) AS term FROM documents)
WHERE regexp_matches(term, '^[A-Za-z0-9-]+$'))"""

_PART_FACTS = """pf AS (SELECT p_partkey % 3 + 1 AS code, p_brand || ' ' || p_name AS l, p_type || '-' || p_size AS r FROM part),
terms AS (SELECT 'A' AS cat, l AS term FROM pf WHERE code = 1 UNION ALL SELECT 'B', r FROM pf WHERE code = 1
  UNION ALL SELECT 'B', l FROM pf WHERE code = 2 UNION ALL SELECT 'C', r FROM pf WHERE code IN (2, 3))"""

_TREES = """td AS (SELECT lower(p_name || ' ' || p_brand) AS term, unnest([
  (CASE p_type WHEN 'SMALL' THEN 'E' WHEN 'LARGE' THEN 'C' ELSE 'D' END) || p_size, 'D' || p_size || '.100', 'C' || p_size]) AS tree,
  unnest([1, 2, 3]) AS pos, p_partkey FROM part),
tc AS (SELECT *, CASE WHEN starts_with(tree, 'D12') THEN 'B' WHEN starts_with(tree, 'D') THEN 'A' WHEN starts_with(tree, 'C') THEN 'C' END AS cat FROM td)"""

ORACLE = {
    "clean_ascii": r"""SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS clean,
        length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS n_ascii FROM documents""",
    "sentence_split": with_cte("sents", "SELECT article_id, para_pos, sent_pos, text FROM sents"),
    "sentence_offsets": with_cte("sents", "SELECT article_id, para_pos, sent_pos, start, length(text) AS width FROM sents"),
    "dialogue_sentences": r"""SELECT article_id, CAST(sum(len(s)) AS BIGINT) AS n_sentences, CAST(sum(length(p)) AS BIGINT) AS n_chars FROM (
        SELECT article_id, p, list_filter(string_split(regexp_replace(p, '([.!?]+\s+)', '\1' || chr(8233), 'g'), chr(8233)), lambda x: x <> '') AS s
        FROM (SELECT conv_id || '-' || turn AS article_id, unnest(string_split(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), chr(10))) AS p
        FROM conversations)) GROUP BY article_id HAVING sum(len(s)) > 0""",
    "tokens": with_cte(
        "words",
        """SELECT article_id, sent_pos, count(*) AS n_tokens, CAST(sum(length(token)) AS BIGINT) AS n_chars, max(token) AS last_token
        FROM words WHERE token <> '' GROUP BY article_id, sent_pos""",
    ),
    "mentions_single": with_cte("found", "SELECT * FROM found"),
    "mentions_multi": _extend("wsents multi_vocab", _MULTI_HITS, "SELECT * FROM multi_hits"),
    "mentions_padded": _extend(
        "wsents vocab multi_vocab",
        _MULTI_HITS.replace("'\\s', ' ', 'g')", "'[\\s.]', ' ', 'g')"),
        """SELECT article_id, cat, word, min(doc_pos) AS doc_pos, para_pos, sent_pos FROM multi_hits WHERE length(word) >= 3
        GROUP BY article_id, cat, word, para_pos, sent_pos
        UNION ALL
        SELECT article_id, cat, term, start + instr(t, ' ' || term || ' ') - 1, para_pos, sent_pos
        FROM flat JOIN vocab ON contains(t, ' ' || term || ' ') WHERE length(term) >= 3""",
    ),
    "mentions_by_category": _extend(
        "wsents vocab multi_vocab",
        f"{_MULTI_HITS}, {_SINGLE_HITS}",
        """SELECT article_id, cat, count(*) AS n, min(doc_pos) AS first_pos
        FROM (SELECT * FROM single_hits UNION ALL SELECT * FROM multi_hits) GROUP BY article_id, cat""",
    ),
    "word_counts": with_cte("found", "SELECT article_id, cat, word, count(*) AS n FROM found GROUP BY ALL"),
    "kinase_like_words": with_cte("found", "SELECT * FROM found WHERE contains(word, 'tion') AND cat = 'B'"),
    "noise_filter": _extend(
        "found",
        """prop AS (SELECT article_id, doc_pos, unnest([word, word || ' = 42', '(' || sent_pos || ') ' || word || ' of', 'v' || sent_pos || '.5']) AS word FROM found)""",
        "SELECT * FROM prop",
    ),
    "concept_ids": with_cte(
        "found vocab",
        """SELECT article_id, word, coalesce('ID:' || length(t.term), '-1') AS concept_id, count(*) AS n
        FROM found LEFT JOIN (SELECT DISTINCT term FROM vocab WHERE cat <> 'B') t ON t.term = word GROUP BY ALL""",
    ),
    "canonical_tokens": _extend(
        "words vocab",
        """tk AS (SELECT article_id, regexp_replace(token, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS tok FROM words),
        syn AS (SELECT term, 'gene_' || substr(term, 1, 3) AS canon FROM vocab WHERE cat = 'A' AND term NOT LIKE 'th%')""",
        "SELECT article_id, coalesce(canon, tok) AS canonical, count(*) AS n FROM tk LEFT JOIN syn ON term = tok WHERE tok <> '' GROUP BY ALL",
    ),
    "bigram_phrases": _extend(
        "sents", _CORPUS, "SELECT w1, w2, n12, n1, n2, round(score, 6) AS score FROM scored WHERE score > 10"
    ),
    # In a run of k neighbouring phrases every other one is merged: (k + 1) // 2 merges.
    "bigram_corpus": _extend(
        "sents",
        _CORPUS,
        """, hit AS (SELECT article_id, sent_pos, i, i - row_number() OVER (PARTITION BY article_id, sent_pos ORDER BY i) AS island
          FROM (SELECT article_id, sent_pos, i, w[i] AS w1, w[i + 1] AS w2 FROM corpus, unnest(range(1, len(w))) t(i))
          SEMI JOIN (FROM scored WHERE score > 10) s USING (w1, w2)),
        merges AS (SELECT article_id, sum(m) AS m FROM (SELECT article_id, (count(*) + 1) // 2 AS m FROM hit GROUP BY article_id, sent_pos, island) GROUP BY article_id)
        SELECT article_id, CAST(sum(len(w)) - coalesce(any_value(m), 0) AS BIGINT) AS n_tokens, count(*) FILTER (len(w) > 0) AS n_sentences
        FROM corpus LEFT JOIN merges USING (article_id) GROUP BY article_id""",
    ),
    "vocab_clean": f"""WITH {_RAW_TERMS} SELECT DISTINCT lower(term) AS term FROM raw
        WHERE length(replace(term, '-', '')) > 2 AND NOT regexp_matches(replace(term, '-', ''), '^[0-9]+$')
        AND replace(term, '-', '') NOT IN ('was', 'for')""",
    "vocab_extended": _extend(
        "vocab",
        _PART_FACTS,
        """SELECT DISTINCT cat, term FROM (SELECT cat, term FROM vocab UNION ALL SELECT cat, lower(term) FROM terms
        WHERE length(replace(term, '-', '')) > 2) WHERE NOT (term IN ('was', 'for', 'large') OR (cat = 'A' AND term = 'apotosis'))""",
    ),
    "vocab_minus": f"""WITH {_RAW_TERMS}, w AS (SELECT DISTINCT lower(term) AS term FROM raw)
        SELECT 'B' AS cat, term FROM w WHERE length(term) % 2 = 1 UNION ALL SELECT 'C', term FROM w WHERE length(term) % 2 = 0""",
    "tree_classify": f"WITH {_TREES} SELECT DISTINCT cat, term FROM tc WHERE cat IS NOT NULL",
    "tree_classify_first": f"""WITH {_TREES} SELECT DISTINCT cat, term FROM (SELECT term, arg_min(cat, pos) AS cat FROM tc
        WHERE cat IS NOT NULL GROUP BY p_partkey, term)""",
    "token_corpus": with_cte(
        "sents",
        """SELECT article_id, sent_pos, len(string_split(replace(text, '.', ' '), ' ')) AS n_tokens,
        replace(replace(text, '.', ' '), ' ', '|') AS tokens FROM (SELECT *, count(*) OVER (PARTITION BY article_id, para_pos) AS n FROM sents)
        WHERE n > 2""",
    ),
    "article_text": "SELECT doc_id AS article_id, text AS raw FROM documents",
    "month_tag_filter": with_cte(
        "articles",
        """SELECT article_id, strftime(pub_date, '_%Y_%b_') AS tag, strftime(date_trunc('month', pub_date), '%Y-%m-%d') AS month
        FROM articles WHERE pub_date >= DATE '2011-07-01' AND pub_date < DATE '2013-07-01'""",
    ),
    "valid_articles": "SELECT doc_id AS article_id, len(string_split(text, chr(10))) AS n_paragraphs FROM documents WHERE doc_id % 10 <> 0",
    "first_articles": with_cte(
        "articles",
        """SELECT strftime(pub_date, 'doc_%Y_%b_') || article_id || '.fxml' AS file_name, article_id
        FROM articles ORDER BY file_name LIMIT 25""",
    ),
    "corpus_slices": with_cte("articles", "SELECT strftime(pub_date, 'doc_%Y_%b_') || article_id || '.fxml' AS file_name, article_id FROM articles"),
    "page_paragraphs": r"""SELECT page_id, i - 1 AS para_pos, regexp_replace(b[i], '<[^>]*>', '', 'g') AS text FROM (
        SELECT page_id, regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1) AS b FROM pages), unnest(range(1, len(b) + 1)) t(i)""",
}
