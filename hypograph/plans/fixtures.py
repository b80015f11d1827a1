"""The sample tables read as articles, vocabulary, facts, series, citations, interactions and graph.

Every function has a DuckDB counterpart in ``CTE``, which the oracle queries are built from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds
from ..functions.text import clean_ascii
from ..operators import mentions as mt
from ..operators import pairs as pr
from ..operators.interactions import TARGET, reference_id
from ..operators.sentences import sentences
from ..operators.sizing import written

WIDE = 1600
SERIES_KEYS = ["user_id", "event_type"]
# What stands between words in the wrapped paragraphs.
WRAPPING = [("d ", "d\n"), ("n t", "n\tt"), (" o", " (o")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pub_date(doc_id="doc_id"):
    return F.date_add(F.lit("2010-01-01").cast("date"), (F.col(doc_id) % 3650).cast("int"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: a line is a paragraph."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(
        F.col("doc_id").alias("article_id"),
        F.split("text", "\n").alias("paragraphs"),
        pub_date().alias("pub_date"),
        F.concat(F.lit("doc_"), F.date_format(pub_date(), "yyyy_MMM"), F.lit("_"), F.col("doc_id"), F.lit(".fxml")).alias(
            "file_name"
        ),
    )


def article_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(articles(spark, sf_dir).select("article_id", "paragraphs"))


def wrapped_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of paragraphs with line ends and tabs between words and brackets in front of words."""
    def wrap(p):
        for plain, odd in WRAPPING:
            p = F.replace(p, F.lit(plain), F.lit(odd))
        return p

    wrapped = articles(spark, sf_dir).select("article_id", F.transform("paragraphs", wrap).alias("paragraphs"))
    return sentences(wrapped)


def _category(term):
    n = F.length(term) % 3
    return F.when(n == 0, "A").when(n == 1, "B").otherwise("C")


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct long words of the benchmark texts; the category is the length modulo 3."""
    text = F.lower(clean_ascii(F.col("text")))
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))).alias("term")
    )
    return words.filter(F.length("term") >= 6).select(_category(F.col("term")).alias("cat"), "term").distinct()


def multi_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent long words of the benchmark texts as two-word terms."""
    words = F.split(F.lower(clean_ascii(F.col("text"))), " ")
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = (
        table(spark, sf_dir, "benchmark")
        .select(words.alias("w"))
        .select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), n).alias("a"), F.slice("w", F.lit(2), n).alias("b"))).alias("x"))
        .select(F.col("x.a").alias("a"), F.regexp_replace("x.b", "[^a-z]+$", "").alias("b"))
        .filter(F.col("a").rlike("^[a-z]{6,}$") & F.col("b").rlike("^[a-z]{6,}$"))
    )
    term = F.concat_ws(" ", "a", "b")
    return pairs.select(_category(term).alias("cat"), term.alias("term")).distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of one-word terms."""
    return mt.single_word_mentions(article_sentences(spark, sf_dir), vocab(spark, sf_dir))


def close_pairs(spark: SparkSession, sf_dir: str, combos=(pr.AB, pr.BC, pr.AC)) -> DataFrame:
    """Closest pair per article and terms, of the lists ``combos``."""
    return pr.shortest_pairs(pr.cooccurrences(found(spark, sf_dir), combos))


def wide_pairs(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """All pairs within the wide window, distance zero included, different words only.

    ``shared`` stores the mentions first, for plans that use the pairs more than once: the text is then
    read once, and only the far smaller mentions are read again.
    """
    hits = found(spark, sf_dir)
    if shared:
        hits = written(hits, "mentions")
    return pr.cooccurrences(hits, threshold=WIDE, include_zero=True, distinct_words=True)


def facts(spark: SparkSession, sf_dir: str, wide: DataFrame) -> DataFrame:
    """Pairs of good documents within the wide window; the document is the reference."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("article_id"))
    return (
        wide.join(good, "article_id", "left_semi")
        .select("code", "l", "r", F.array(F.col("article_id").cast("string")).alias("refs"))
        .distinct()
    )


def facts_of(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """``facts`` from stored mentions: pairs are made of good documents only."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("article_id"))
    wide = pr.cooccurrences(hits.join(good, "article_id", "left_semi"), threshold=WIDE, include_zero=True, distinct_words=True)
    return wide.select("code", "l", "r", F.array(F.col("article_id").cast("string")).alias("refs")).distinct()


def equivalence_guesses(wide: DataFrame) -> DataFrame:
    """One-to-one pairs closer than the pair threshold, keyed by article as pmid."""
    near = wide.filter(F.col("doc_dist") < pr.PAIR_THRESHOLD)
    return pr.match_one_to_one(near).withColumn("pmid", F.col("article_id").cast("string"))


def pmid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("pmid"), epoch_seconds(pub_date()).alias("pub_ts"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated mentions of (user_id, event_type); every thirteenth one has no date."""
    events = table(spark, sf_dir, "events")
    day = F.col("ts").cast("date")
    return events.select(
        *SERIES_KEYS,
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 13 != 0, epoch_seconds(day)).alias("ts"),
        (F.col("value") > 20).alias("fact"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stored table of citation records.

    Stored, as records would be: inlined, the building expressions would be repeated for every use.
    """
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("date")
    published = F.add_months(day, (cust % 5).cast("int") - 2)

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    first = F.struct(
        text("Cond-", key % 11).alias("name"),
        F.when(key % 4 == 0, "N").when(key % 4 == 1, "Y").otherwise("").alias("major"),
        text(F.when(key % 3 == 0, F.lit("D0")).otherwise(F.lit("D12")), key % 11).alias("ui"),
        F.array(
            F.struct(F.col("o_orderpriority").alias("text"), text("Q", F.substring("o_orderpriority", 1, 1)).alias("ui")),
            F.struct(F.col("o_orderstatus").alias("text"), text("C", cust % 3).alias("ui")),
        ).alias("qualifiers"),
    )
    second = F.struct(
        text("Prot-", cust % 9).alias("name"),
        F.lit("Y").alias("major"),
        text("D12.", cust % 9).alias("ui"),
        F.array(
            F.struct(text("Sub ", cust % 13).alias("text"), text("D12.", cust % 13).alias("ui")),
            F.struct(text("Z").alias("text"), text("Z1").alias("ui")),
        ).alias("qualifiers"),
    )
    records = o.select(
        key.cast("string").alias("pmid"),
        F.when(key % 10 != 0, F.date_format(day, "d-M-yyyy")).otherwise("31-2-1999").alias("created"),
        F.when(key % 7 == 0, F.lit("1-13-1999"))
        .when(key % 2 == 0, F.concat(F.lit("1-"), F.date_format(published, "MMM-yyyy")))
        .otherwise(F.concat(F.lit("1-"), F.date_format(published, "M-yyyy")))
        .alias("published"),
        F.array(text("Chem-", cust % 40), text("Chem-", key % 7)).alias("chemicals"),
        F.array(first, second).alias("headings"),
    )
    return written(records, "citations")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as known interactions of one target."""
    key = F.col("c_custkey")
    text = key.cast("string")
    return table(spark, sf_dir, "customer").select(
        F.when(key % 3 == 0, F.lit(TARGET)).otherwise(F.concat(F.lit("uniprotkb:P"), text)).alias("a"),
        F.when(key % 3 == 1, F.lit(TARGET)).otherwise(F.concat(F.lit("uniprotkb:Q"), text)).alias("b"),
        F.concat(F.lit("hgnc:GENE "), text, F.lit("(gene name)|mi:bad|psi:"), F.col("c_mktsegment"), F.lit(" K(alias)")).alias(
            "alt_a"
        ),
        F.concat(F.lit("psi-mi:Partner_"), text, F.lit("(display)|hgnc:gene "), text, F.lit("(gene name)")).alias("alt_b"),
        reference_id(F.concat(F.lit("mint:M-"), text, F.lit("|pubmed:"), text, F.lit("|doi:x"))).alias("pmid"),
    )


def triples_spo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as part-supplier statements and suppliers as supplier-nation statements."""

    def uri(kind, value):
        return F.concat(F.lit(f"<http://data.example.org/{kind}/"), value.cast("string"), F.lit(">"))

    name = (
        F.when(F.col("l_returnflag") == "A", "PDB_ID").when(F.col("l_returnflag") == "N", "Name").otherwise("openeye_smiles")
    )
    items = table(spark, sf_dir, "lineitem").select(
        uri("part", F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("s"),
        uri("resource", name).alias("p"),
        uri("supplier", F.col("l_suppkey")).alias("o"),
    )
    places = table(spark, sf_dir, "supplier").select(
        uri("supplier", F.col("s_suppkey")).alias("s"),
        uri("resource", F.lit("located_in")).alias("p"),
        uri("nation", F.col("s_nationkey")).alias("o"),
    )
    return items.unionByName(places)


_CLEAN = r"lower(regexp_replace({}, '[^\x00-\x7F]', '', 'g'))"
_CAT = "CASE length({0}) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END"

def _wrapped(column: str) -> str:
    for plain, odd in WRAPPING:
        text = "'" + odd.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
        column = f"replace({column}, '{plain}', {text})"
    return column


CTE: dict[str, tuple[list[str], str]] = {
    "articles": (
        [],
        """SELECT doc_id AS article_id, string_split(text, chr(10)) AS paragraphs, text,
        DATE '2010-01-01' + CAST(doc_id % 3650 AS INTEGER) AS pub_date FROM documents""",
    ),
    "paras": (
        ["articles"],
        f"""SELECT article_id, i - 1 AS para_pos, {_CLEAN.format('paragraphs[i]')} AS p
        FROM articles, unnest(range(1, len(paragraphs) + 1)) t(i)""",
    ),
    "sraw": (
        ["paras"],
        r"""SELECT article_id, para_pos, j, s[j] AS text FROM (
        SELECT article_id, para_pos, list_filter(string_split(
          regexp_replace(p, '([.!?]+\s+)', '\1' || chr(8233), 'g'), chr(8233)), lambda x: x <> '') AS s FROM paras),
        unnest(range(1, len(s) + 1)) t(j)""",
    ),
    "sents": (
        ["sraw"],
        """SELECT article_id, para_pos, row_number() OVER (PARTITION BY article_id ORDER BY para_pos, j) - 1 AS sent_pos,
        CAST(coalesce(sum(length(text)) OVER (PARTITION BY article_id ORDER BY para_pos, j
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, text FROM sraw""",
    ),
    "wparas": (["articles"], f"""SELECT article_id, i - 1 AS para_pos, {_CLEAN.format(_wrapped('paragraphs[i]'))} AS p
        FROM articles, unnest(range(1, len(paragraphs) + 1)) t(i)"""),
    "words": (
        ["sents"],
        """SELECT article_id, para_pos, sent_pos, start, text, i - 1 AS i, w[i] AS raw,
        replace(replace(trim(w[i], ' ' || chr(9) || chr(10) || chr(13) || chr(12)), '.', ''), '/', '') AS token,
        CAST(coalesce(sum(length(w[i]) + 1) OVER (PARTITION BY article_id, sent_pos ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
        FROM (SELECT *, string_split(text, ' ') AS w FROM sents), unnest(range(1, len(w) + 1)) t(i)""",
    ),
    "vocab": (
        [],
        f"""SELECT DISTINCT {_CAT.format('term')} AS cat, term FROM (SELECT unnest(regexp_extract_all(
        {_CLEAN.format('text')}, '[a-z]+')) AS term FROM benchmark) WHERE length(term) >= 6""",
    ),
    "multi_vocab": (
        [],
        f"""SELECT DISTINCT {_CAT.format('term')} AS cat, term FROM (SELECT a || ' ' || b AS term FROM (
        SELECT w[i] AS a, regexp_replace(w[i + 1], '[^a-z]+$', '') AS b
        FROM (SELECT string_split({_CLEAN.format('text')}, ' ') AS w FROM benchmark), unnest(range(1, len(w))) t(i))
        WHERE regexp_matches(a, '^[a-z]{{6,}}$') AND regexp_matches(b, '^[a-z]{{6,}}$'))""",
    ),
    "found": (
        ["words", "vocab"],
        """SELECT article_id, cat, term AS word, start + off AS doc_pos, para_pos, sent_pos
        FROM words JOIN vocab ON token = term""",
    ),
    "combos": ([], "SELECT * FROM (VALUES (1, 'A', 'B'), (2, 'B', 'C'), (3, 'A', 'C')) t(code, lc, rc)"),
    "raw_pairs": (
        ["found", "combos"],
        """SELECT a.article_id, code, a.word AS l, b.word AS r, a.doc_pos AS l_pos, b.doc_pos AS r_pos,
        abs(a.doc_pos - b.doc_pos) AS doc_dist, abs(a.para_pos - b.para_pos) AS para_dist,
        abs(a.sent_pos - b.sent_pos) AS sent_dist,
        1000000 * abs(a.para_pos - b.para_pos) + 100000 * abs(a.sent_pos - b.sent_pos) + abs(a.doc_pos - b.doc_pos) AS uber_dist
        FROM found a JOIN combos ON a.cat = lc JOIN found b ON b.article_id = a.article_id AND b.cat = rc
        AND abs(a.doc_pos - b.doc_pos) < 8000""",
    ),
    "near": (["raw_pairs"], "SELECT * FROM raw_pairs WHERE doc_dist > 0 AND doc_dist < 800"),
    "pairs": (
        ["near"],
        """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY article_id, code, l, r
        ORDER BY uber_dist, l_pos, r_pos) AS rn FROM near) WHERE rn = 1""",
    ),
    "wide": (["raw_pairs"], f"SELECT * FROM raw_pairs WHERE l <> r AND doc_dist < {WIDE}"),
    "facts": (
        ["wide"],
        """SELECT DISTINCT code, l, r, CAST(article_id AS VARCHAR) AS pmid FROM wide
        WHERE article_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    ),
    "ranked": (
        ["wide"],
        """SELECT *, row_number() OVER (PARTITION BY article_id, code, l, r ORDER BY doc_dist, l_pos, r_pos) AS rn
        FROM wide WHERE doc_dist < 800""",
    ),
    "matching": (
        ["ranked"],
        """SELECT *, [l_pos] AS ls, [r_pos] AS rs, TRUE AS kept FROM ranked WHERE rn = 1
        UNION ALL
        SELECT n.*, CASE WHEN list_contains(m.ls, n.l_pos) OR list_contains(m.rs, n.r_pos) THEN m.ls ELSE list_append(m.ls, n.l_pos) END,
        CASE WHEN list_contains(m.ls, n.l_pos) OR list_contains(m.rs, n.r_pos) THEN m.rs ELSE list_append(m.rs, n.r_pos) END,
        NOT (list_contains(m.ls, n.l_pos) OR list_contains(m.rs, n.r_pos))
        FROM matching m JOIN ranked n ON n.article_id = m.article_id AND n.code = m.code AND n.l = m.l AND n.r = m.r AND n.rn = m.rn + 1""",
    ),
    "guesses": (
        ["matching"],
        """SELECT article_id, code, l, r, l_pos, r_pos, doc_dist, para_dist, sent_dist, uber_dist,
        CAST(article_id AS VARCHAR) AS pmid FROM matching WHERE kept""",
    ),
    "relevant": (["facts"], "SELECT DISTINCT l, r, pmid FROM facts"),
    "series": (
        [],
        """SELECT user_id, event_type, event_id AS id, value > 20 AS fact,
        CASE WHEN event_id % 13 <> 0 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) END AS ts FROM events""",
    ),
    "numbered": (
        ["series"],
        """SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, id) - 1 AS seq
        FROM series WHERE ts IS NOT NULL""",
    ),
    "cites": (
        [],
        """SELECT CAST(o_orderkey AS VARCHAR) AS pmid, o_orderkey AS k, o_custkey AS c, o_orderpriority AS pri,
        o_orderstatus AS st, CAST(o_orderdate AS DATE) AS d FROM orders""",
    ),
    "heads": (
        ["cites"],
        """SELECT pmid, 'A' AS cat, 'chem-' || (c % 40) AS term FROM cites
        UNION ALL SELECT pmid, 'A', 'chem-' || (k % 7) FROM cites
        UNION ALL SELECT pmid, 'C', 'cond-' || (k % 11) FROM cites WHERE k % 3 = 0
        UNION ALL SELECT pmid, 'B', lower(pri) FROM cites WHERE k % 4 IN (0, 1)
        UNION ALL SELECT pmid, 'C', lower(st) FROM cites WHERE k % 4 IN (0, 1)
        UNION ALL SELECT pmid, 'B', 'sub ' || (c % 13) FROM cites""",
    ),
    "spo": (
        [],
        """SELECT 'part/' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS src, 'supplier/' || l_suppkey AS dst,
        'resource/' || CASE l_returnflag WHEN 'A' THEN 'PDB_ID' WHEN 'N' THEN 'Name' ELSE 'openeye_smiles' END AS relationship
        FROM lineitem UNION ALL
        SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'resource/located_in' FROM supplier""",
    ),
}


# The wrapped paragraphs are cut into sentences as the others are.
CTE["wsraw"] = (["wparas"], CTE["sraw"][1].replace("FROM paras", "FROM wparas"))
CTE["wsents"] = (["wsraw"], CTE["sents"][1].replace("FROM sraw", "FROM wsraw"))


def with_cte(names: str | list[str], body: str, recursive: bool | None = None) -> str:
    """A DuckDB query with the named fixtures and all they build on."""
    wanted = names.split() if isinstance(names, str) else list(names)
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTE[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in wanted:
        visit(name)
    head = "WITH RECURSIVE " if (recursive or "matching" in order) else "WITH "
    parts = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order)
    return f"{head}{parts}\n{body}" if order else body
