"""Queries on metrics, vectors, graphs, citations, interactions, stores and incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds
from ..functions.text import base_name
from ..operators import citations as ct
from ..operators import embeddings as em
from ..operators import evaluation as ev
from ..operators import facts as fc
from ..operators import graph as gr
from ..operators import interactions as ia
from ..operators import mentions as mt
from ..operators import pairs as pr
from ..operators import relevance as rl
from ..operators.sentences import sentences, token_corpus
from ..operators.sizing import dropped, scratch_dir, written
from ..operators.timeline import WINDOW_MONTHS, model_grid
from ..operators.vocab import classify_trees
from ..sources import articles as sa
from ..sources import records as sr
from ..sources import tables as sb
from ..streaming.incremental import done_articles, incremental_result, run_incremental
from . import fixtures as fx
from .fixtures import with_cte
from .text_queries import _CORPUS


def _scored(spark, d):
    """Labels with a length rule as prediction; the split is by id parity."""
    docs = fx.table(spark, d, "documents").select("doc_id", "n_chars")
    labels = fx.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    rule = (F.col("n_chars") > 900).cast("int")
    return labels.join(docs, "doc_id").select(
        "label", rule.alias("prediction"), ev.training_split(F.col("doc_id")).alias("split")
    )


def _rounded(df, *keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


def confusion_matrix(spark, d):
    return ev.confusion(_scored(spark, d))


def confusion_metrics(spark, d):
    m = ev.label_metrics(_scored(spark, d))
    return _rounded(m.select("label", "tp", "fp", "fn", "tn", "precision", "recall", "f_measure", "fpr"), "label", "tp", "fp", "fn", "tn")


def weighted_metrics(spark, d):
    return _rounded(ev.weighted_metrics(ev.label_metrics(_scored(spark, d))))


def regression_metrics(spark, d):
    return _rounded(ev.regression_metrics(_scored(spark, d)), "n")


def error_rates(spark, d):
    return _rounded(ev.error_rates(_scored(spark, d)), "split", "n")


def cosine_pairs(spark, d):
    e = fx.table(spark, d, "embeddings")
    vectors = e.select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))
    # Partners beyond the last id have no vector and are dropped.
    pairs = e.select(
        F.col("vec_id").alias("a"),
        F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") * 3 + 1, F.col("vec_id") + 100)).alias("b"),
    )
    return em.similarity(pairs, vectors).select("a", "b", F.round("similarity", 5).alias("similarity"))


def embedding_synonyms(spark, d):
    """Nearest words of the most frequent long word, from stored vectors of the whole corpus."""
    corpus = written(token_corpus(fx.article_sentences(spark, d)), "corpus")
    words = corpus.select(F.explode("tokens").alias("w")).filter(F.length("w") >= 6)
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(1)
    vectors = written(em.train_words(corpus, min_count=3, vector_size=16), "vectors")
    return em.nearest_rows(vectors, vectors.join(top, vectors["word"] == top["w"], "left_semi"), 10)


def embedding_store(spark, d):
    """Vectors stored per window, the vocabulary of each; a second training finds nothing to do."""
    months = fx.articles(spark, d).select("article_id", F.trunc("pub_date", "month").alias("month"))
    corpus = token_corpus(fx.article_sentences(spark, d)).join(months, "article_id")
    stored = em.training_corpus(corpus, ["article_id", "sent_pos"], with_bigrams=False)
    grid = model_grid(months.select("month").distinct()).filter("mode = 'word'")
    some = grid.filter("(window = 'cumulative' and until in ('2010', '2012')) or (window in ('year', '2month') and until = '2011-02')")
    store = scratch_dir(spark, "vectors")
    em.train_grid(stored, some, store, min_size=1, min_count=3, vector_size=4)
    again = em.train_grid(stored, some, store, min_size=1, min_count=3, vector_size=4)
    rows = em.stored_vectors(spark, store).groupBy("window", "until").agg(F.count("*").alias("n_words"))
    return rows.withColumn("n_again", F.lit(len(again)))


_GRID_SIZE = 8


def embedding_grid(spark, d):
    """Vectors of every trailing and cumulative window, of words and of bigrams: per window the vocabulary, its uses, and
    sums over all vectors; a second run finds nothing to do."""
    months = fx.articles(spark, d).select("article_id", F.trunc("pub_date", "month").alias("month"))
    corpus = written(token_corpus(fx.article_sentences(spark, d)).join(months, "article_id"), "sentences")  # read four times
    stored = em.training_corpus(corpus, ["article_id", "sent_pos"])
    dropped(corpus)
    grid, store = model_grid(months.select("month").distinct()), scratch_dir(spark, "vectors")
    em.sketch_grid(stored, grid, store, min_size=1, size=_GRID_SIZE)
    again = em.sketch_grid(stored, grid, store, min_size=1, size=_GRID_SIZE)
    rows = spark.read.parquet(store)
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    sums = rows.groupBy(*em.GRID).agg(
        F.count("*").alias("n_words"), F.sum("n").alias("n_uses"), F.sum(F.col("vector")[0]).cast("long").alias("first"), F.sum(squares).cast("long").alias("squares")
    )
    return sums.withColumn("n_again", F.lit(again.count()).cast("long")).withColumn("until", F.col("until").cast("string"))


def nearest_vectors(spark, d):
    """The five rows most similar to each vector whose id is divisible by 50."""
    e = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))
    out = em.nearest_rows(e, e.filter("word % 50 = 0"), 5)
    return out.select("query", "word", "rank", F.round("similarity", 5).alias("similarity"))


def graph_vertices(spark, d):
    v = gr.vertices(fx.triples_spo(spark, d))
    return v.groupBy("id", "attr").agg(F.count("*").alias("n"))


def graph_vertices_distinct(spark, d):
    return gr.vertices(fx.triples_spo(spark, d), distinct=True)


def graph_edges(spark, d):
    return gr.edges(fx.triples_spo(spark, d))


def _edges(spark, d):
    return gr.edges(fx.triples_spo(spark, d))


def in_degree_top(spark, d):
    return gr.top_in_degrees(_edges(spark, d), 3)


def in_degree_rank(spark, d):
    return gr.in_degrees(_edges(spark, d))


def edge_filter(spark, d):
    return gr.edges_like(_edges(spark, d), "%resource/PDB_ID%").agg(F.count("*").alias("n"))


def relation_graph_sql(spark, d):
    named = gr.named_subjects(_edges(spark, d), "%resource/Name%", "drug", "name")
    smiles = gr.named_subjects(_edges(spark, d), "%open%_smiles%", "drug", "name")
    return named.withColumn("kind", F.lit("name")).unionByName(smiles.withColumn("kind", F.lit("smiles")))


def relationship_counts(spark, d):
    return gr.relationship_counts(_edges(spark, d))


def edge_motif(spark, d):
    return gr.edge_motif(_edges(spark, d), "%/PDB_ID")


def motif_two_hop(spark, d):
    """Paths of two edges from the subjects that carry a name."""
    edges = _edges(spark, d)
    named = gr.edges_like(edges, "%resource/Name").select(F.col("src").alias("id"))
    return gr.two_hop_counts(edges, named)


def _wide_edges(spark, d):
    """The graph with parts placed in nations as well, so that it has triangles, and nations as hubs."""
    parts = fx.table(spark, d, "part").select(
        F.concat(F.lit("part/"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("src"),
        F.concat(F.lit("nation/"), (F.col("p_partkey") % 25).cast("string")).alias("dst"),
        F.lit("resource/made_in").alias("relationship"),
    )
    return _edges(spark, d).unionByName(parts)


def walk_counts(spark, d):
    """Paths of two edges from every vertex."""
    return gr.walk_counts(_wide_edges(spark, d))


def triangle_counts(spark, d):
    return gr.triangle_counts(_wide_edges(spark, d))


def uri_trim(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", "url")
    wrapped = F.concat(F.lit("<"), "url", F.lit(">"))
    return p.select("page_id", gr.trim_uri(wrapped).alias("short"), gr.trim_uri(F.col("url")).alias("same"), base_name(F.col("url")).alias("base"))


def heading_classes(spark, d):
    return ct.heading_terms(fx.citations(spark, d))


def citation_triples(spark, d):
    return ct.citation_triples(fx.citations(spark, d))


def citation_dates(spark, d):
    out = ct.citation_dates(fx.citations(spark, d))
    return out.select("pmid", F.coalesce("pub_ts", F.lit(-1)).alias("pub_ts"))


def interaction_partners(spark, d):
    i = fx.interactions(spark, d)
    a = ia.partner_names(i, side="a").withColumn("side", F.lit("a"))
    return a.unionByName(ia.partner_names(i, side="b").withColumn("side", F.lit("b")))


def kinase_vocabulary(spark, d):
    c = fx.table(spark, d, "customer")
    gene_protein = c.select(F.concat(F.lit("K"), F.col("c_nationkey")).alias("key"), F.col("c_mktsegment").alias("synonym"))
    names = c.select(F.when(F.col("c_custkey") % 2 == 0, F.lit("KIT")).otherwise(F.concat(F.lit("Kin "), "c_nationkey")).alias("term"))
    thesaurus = fx.table(spark, d, "part").select(F.col("p_name").alias("term"))
    return ia.kinase_vocabulary(fx.interactions(spark, d), gene_protein, names, thesaurus)


def _found_interactions(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("gene "), F.col("o_custkey").cast("string")).alias("l"),
        F.lit("p53").alias("r"),
        F.col("o_orderkey").cast("string").alias("pmid"),
        F.when(F.col("o_orderkey") % 8 != 0, epoch_seconds(F.col("o_orderdate").cast("date"))).alias("pub_ts"),
    )


def interaction_facts(spark, d):
    return ia.interaction_facts(_found_interactions(spark, d), fx.interactions(spark, d)).select("l", "pmid", "ref_pmid")


def found_before(spark, d):
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 1500).cast("int"))
    dates = fx.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("pmid"), epoch_seconds(day).alias("pub_ts")
    )
    return ia.found_before(_found_interactions(spark, d), fx.interactions(spark, d), dates)


def roundtrip_csv(spark, d):
    """Closest pairs written as annotated CSV and read back."""
    p = fx.close_pairs(spark, d).withColumn("pmid", F.col("article_id").cast("string"))
    p = (
        p.withColumn("pub_ts", F.when(F.col("code") != 3, F.lit(1281744000).cast("bigint")))
        .withColumn("fact", F.col("code") == 1)
        .withColumn("l", F.concat("l", F.lit(', "x" #')))
        .withColumn("time_until_verified", F.lit(None).cast("bigint"))
        .withColumn("freq_sec_deriv", F.lit(None).cast("double"))
    )
    path = scratch_dir(spark, "pairs-csv")
    sb.write_pair_csv(p, path)
    back = sb.read_pair_csv(spark, path)
    none = F.lit(-1)
    return back.select(
        "pmid",
        F.coalesce("pub_ts", none).alias("pub_ts"),
        F.coalesce("date_text", F.lit("")).alias("date_text"),
        "l",
        "r",
        "para_dist",
        "sent_dist",
        "doc_dist",
        "fact",
    )


def roundtrip_facts(spark, d):
    """Parts written as a curated table with comment lines, read as facts, one row per reference."""
    p = fx.table(spark, d, "part")
    refs = F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(
        F.concat_ws("|", F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1).cast("string"))
    )
    blank = F.lit("")
    row = p.select(
        F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand")).alias("c0"),
        *[blank.alias(f"c{i}") for i in (1, 2)],
        F.col("p_type").alias("c3"),
        *[blank.alias(f"c{i}") for i in range(4, 10)],
        refs.alias("c10"),
    )
    comment = p.select(F.concat(F.lit("# "), "p_name").alias("c0"), *[blank.alias(f"c{i}") for i in range(1, 11)])
    path = scratch_dir(spark, "facts-csv")
    row.unionByName(comment).write.option("emptyValue", "").option("escape", '"').csv(path)
    return fc.fact_refs(sb.read_facts(spark, path, "chemical_gene")).select("l", "r", "pmid")


def roundtrip_interactions(spark, d):
    """Customers written as a tab-separated interaction export and read back."""
    c = fx.table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    cols = [F.concat(F.lit("uniprotkb:"), key), F.col("c_mktsegment"), key, key, F.col("c_name"), key, key, key]
    refs = F.concat(F.lit("mint:1|pubmed:"), key, F.lit("|pubmed:0"))
    path = scratch_dir(spark, "interactions")
    c.select(*[x.alias(f"c{i}") for i, x in enumerate([*cols, refs])]).write.option("sep", "\t").csv(path)
    return sb.read_interactions(spark, path)


def roundtrip_features(spark, d):
    """Feature vectors written in parts, read by glob, with the similarity of the two entities appended."""
    e = fx.table(spark, d, "embeddings")
    path = scratch_dir(spark, "features")
    e.select(
        F.col("label").cast("string").alias("c0"),
        F.concat(F.lit("V"), F.col("vec_id")).alias("c1"),
        F.concat(F.lit("V"), F.col("vec_id") + 1).alias("c2"),
    ).write.csv(path)
    vectors = e.select(F.concat(F.lit("v"), F.col("vec_id")).alias("word"), F.col("embedding").alias("vector"))
    rows = em.similarity(sb.read_feature_vectors(spark, f"{path}/part-*", 3), vectors)
    out = scratch_dir(spark, "features-ext")
    sb.write_feature_vectors(rows.withColumn("similarity", F.round("similarity", 5)), out)
    back = sb.read_delimited(spark, out, 4, comment=None)
    return back.select("c0", "c1", "c2", F.col("c3").cast("double").alias("similarity"))


def roundtrip_synonyms(spark, d):
    """Three synonym files written from parts and customers, read back to (source, term)."""
    p, c = fx.table(spark, d, "part"), fx.table(spark, d, "customer")
    genes, kinases = scratch_dir(spark, "genes"), scratch_dir(spark, "kinases")
    p.select(F.col("p_brand").alias("c0"), F.concat_ws(", ", "p_name", "p_type").alias("c1")).distinct().write.csv(genes)
    c.select(
        F.lit("x").alias("c0"),
        F.concat(F.lit("K"), F.col("c_nationkey")).alias("c1"),
        F.col("c_mktsegment").alias("c2"),
        F.concat(F.lit("A"), F.col("c_nationkey"), F.lit(";B"), F.col("c_nationkey")).alias("c3"),
    ).distinct().write.option("sep", " ").csv(kinases)
    a = sb.read_gene_synonyms(spark, genes).select(F.lit("gene").alias("source"), F.concat_ws(">", "synonym", "canonical").alias("term"))
    b = sb.read_kinase_synonyms(spark, kinases).select(F.lit("kinase").alias("source"), "term")
    return a.unionByName(b).distinct()


def roundtrip_json(spark, d):
    """Article digests written as JSON by file name, read back to flat mentions."""
    arts = fx.articles(spark, d)
    sents = fx.article_sentences(spark, d)
    found = written(mt.single_word_mentions(sents, fx.vocab(spark, d)), "mentions")
    pairs = written(pr.shortest_pairs(pr.cooccurrences(found)), "pairs")
    tagged = pairs.withColumn("fact", F.col("code") == 1).withColumn("refs", F.array(F.col("article_id").cast("string")))
    rows = sa.digests(arts, found, tagged, pr.triples(pairs))
    path = scratch_dir(spark, "digests")
    sa.write_digests(rows, path, by_name=True, compression="gzip")
    dropped(found, pairs)
    lists = ["A", "B", "C", "AB", "BC", "AC", "BB", "ABC"]
    n_sentences = F.size(F.flatten("paragraphs.sentences"))
    # The JSON is parsed once, not for each kind; of the text its numbers are kept.
    back = written(sa.read_digests(spark, path).select("id", *lists, n_sentences.alias("n"), F.length("raw").alias("last_pos")), "read-back")
    m = sa.digest_mentions(back).groupBy("article_id").agg(F.count("*").alias("n"), F.max("doc_pos").alias("last_pos"))
    p = sa.digest_pairs(back).groupBy("article_id").agg(F.count("*").alias("n"), F.sum("docDist").cast("bigint").alias("last_pos"))
    g = sa.digest_guesses(back).groupBy("article_id").agg(F.count("*").alias("n"), F.max("uberDist").alias("last_pos"))
    t = back.filter(F.size("ABC") > 0).select(F.col("id").alias("article_id"), F.size("ABC").alias("n"), F.lit(0).alias("last_pos"))
    s = back.select(F.col("id").alias("article_id"), "n", "last_pos")
    parts = {"mentions": m, "pairs": p, "guesses": g, "triples": t, "text": s}
    out = None
    for kind, part in parts.items():
        part = part.select(F.lit(kind).alias("kind"), "article_id", F.col("n").cast("bigint").alias("n"), F.col("last_pos").cast("bigint").alias("last_pos"))
        out = part if out is None else out.unionByName(part)
    return out


def roundtrip_names_json(spark, d):
    """Customers as gene/protein synonym objects and a plain term list, read back."""
    c = fx.table(spark, d, "customer")
    key = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    objects = c.select(
        F.when(F.col("c_custkey") % 2 == 0, F.create_map(key, F.array("c_name", "c_mktsegment"))).alias("Genes"),
        F.when(F.col("c_custkey") % 3 == 0, F.create_map(key, F.array("c_name"))).alias("Proteins"),
    )
    path = scratch_dir(spark, "names")
    objects.write.json(path)
    names = sb.read_gene_protein(spark, path, multi_line=False)
    terms = scratch_dir(spark, "terms")
    c.select(F.to_json(F.array("c_name", "c_mktsegment")).alias("value")).write.text(terms)
    listed = sb.read_term_list_lines(spark, terms).select(F.lit("list").alias("kind"), F.lit("").alias("key"), F.col("term").alias("synonym"))
    return names.unionByName(listed)


def roundtrip_split(spark, d):
    """Outcomes as JSON in train and test folders, read back."""
    from .pair_queries import evaluation_set

    out = evaluation_set(spark, d).withColumn("split", ev.training_split(F.col("pmid")))
    path = scratch_dir(spark, "split")
    sb.write_split(out, path)
    back = spark.read.schema(out.schema).json(path)
    return back.groupBy("split", "outcome", "code").agg(F.count("*").alias("n"))


def roundtrip_triples_json(spark, d):
    rows = ct.citation_triples(fx.citations(spark, d))
    path = scratch_dir(spark, "triples")
    sb.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


def roundtrip_xml(spark, d):
    """Documents as article XML with inline tags, parsed back to sentences."""
    docs = fx.table(spark, d, "documents")
    text = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    marked = F.regexp_replace(F.regexp_replace(text, "the", "<i>the</i>"), "é", "&eacute;")
    paras = F.array_join(F.transform(F.split(marked, "\n"), lambda p: F.concat(F.lit("<sec><p>"), p, F.lit("</p></sec>"))), "")
    day = fx.pub_date()
    xml = F.concat(
        F.lit("<!DOCTYPE article SYSTEM 'x.dtd'>\n<article><front><article-id pub-id-type='pmid'>"),
        F.col("doc_id").cast("string"),
        F.lit("</article-id><pub-date pub-type='epub'><day>"),
        F.dayofmonth(day).cast("string"),
        F.lit("</day><month>"),
        F.month(day).cast("string"),
        F.lit("</month><year>"),
        F.year(day).cast("string"),
        F.lit("</year></pub-date></front><body>"),
        paras,
        F.lit("</body></article>"),
    )
    source = docs.select(F.concat(F.lit("/corpus/"), "doc_id", F.lit(".fxml")).alias("path"), xml.alias("xml"))
    arts = sa.parse_articles(source)
    s = sentences(arts.select("article_id", "paragraphs"))
    n = s.groupBy("article_id").agg(F.count("*").alias("n_sentences"), F.max(F.col("offset") + F.length("text")).alias("n_chars"))
    return arts.join(n, "article_id").select(
        "article_id", "file_name", F.date_format("pub_date", "yyyy-MM-dd").alias("day"), "n_sentences", "n_chars"
    )


#: Records of a written XML file: a file is read by one task.
XML_RECORDS = 20_000


def _write_xml(rows, path, row_tag, root_tag):
    """Rows as XML records, in compressed files of at most ``XML_RECORDS``, whatever the number of tasks that write.

    Nearly all of such a file is its tags, so as plain text it takes tens of times what it holds.
    """
    options = {"rowTag": row_tag, "rootTag": root_tag, "maxRecordsPerFile": XML_RECORDS, "compression": "gzip"}
    rows.write.format("xml").options(**options).save(path)


def roundtrip_citations_xml(spark, d):
    """Orders as citation records in XML, read back with headings and dates."""
    c = fx.citations(spark, d)
    created = F.split("created", "-")
    published = F.split("published", "-")
    raw = c.select(
        F.struct(F.col("pmid").alias("_VALUE"), F.lit("1").alias("_Version")).alias("PMID"),
        F.struct(created[2].alias("Year"), created[1].alias("Month"), created[0].alias("Day")).alias("DateCreated"),
        F.struct(
            F.struct(
                F.struct(F.struct(published[2].alias("Year"), published[1].alias("Month")).alias("PubDate")).alias("JournalIssue")
            ).alias("Journal")
        ).alias("Article"),
        F.struct(
            F.transform(
                "chemicals",
                lambda x: F.struct(F.lit("0").alias("RegistryNumber"), F.struct(x.alias("_VALUE"), F.lit("D1").alias("_UI")).alias("NameOfSubstance")),
            ).alias("Chemical")
        ).alias("ChemicalList"),
        F.struct(
            F.transform(
                "headings",
                lambda h: F.struct(
                    F.struct(h["name"].alias("_VALUE"), h["ui"].alias("_UI"), h["major"].alias("_MajorTopicYN")).alias("DescriptorName"),
                    F.transform(
                        h["qualifiers"],
                        lambda q: F.struct(q["text"].alias("_VALUE"), q["ui"].alias("_UI"), F.lit("N").alias("_MajorTopicYN")),
                    ).alias("QualifierName"),
                ),
            ).alias("MeshHeading")
        ).alias("MeshHeadingList"),
    )
    path = scratch_dir(spark, "citations")
    _write_xml(raw, path, "MedlineCitation", "MedlineCitationSet")
    dropped(c)
    back = written(sr.read_citations(spark, path), "read")  # parsed once for headings and dates
    terms = ct.heading_terms(back).groupBy("pmid").agg(F.count("*").alias("n_terms"), F.max("term").alias("last_term"))
    dates = ct.citation_dates(back)
    return dates.join(terms, "pmid").select("pmid", F.coalesce("pub_ts", F.lit(-1)).alias("pub_ts"), "n_terms", "last_term")


def roundtrip_thesaurus_xml(spark, d):
    """Parts as descriptor records in XML, read and classified."""
    p = fx.table(spark, d, "part")
    size = F.col("p_size").cast("string")
    raw = p.select(
        F.concat(F.lit("D"), F.col("p_partkey")).alias("DescriptorUI"),
        F.struct(F.concat("p_name", F.lit(" "), "p_brand").alias("String")).alias("DescriptorName"),
        F.struct(F.array(F.concat(F.lit("D"), size), F.concat(F.lit("E"), size)).alias("TreeNumber")).alias("TreeNumberList"),
    )
    path = scratch_dir(spark, "thesaurus")
    _write_xml(raw, path, "DescriptorRecord", "DescriptorRecordSet")
    return classify_trees(sr.read_thesaurus(spark, path))


def roundtrip_parquet(spark, d):
    """Vocabulary, publication dates and series as stored tables, built once and then read."""
    path = scratch_dir(spark, "store")
    vocab = sb.read_or_build(spark, f"{path}/vocab", lambda: fx.vocab(spark, d))
    dates = sb.read_or_build(spark, f"{path}/dates", lambda: fx.pmid_dates(spark, d))
    v = vocab.select(F.concat_ws(":", "cat", "term").alias("key"), F.lit(0).cast("bigint").alias("value"))
    return v.unionByName(dates.select(F.col("pmid").alias("key"), F.col("pub_ts").alias("value")))


def graph_store(spark, d):
    """Vertices and edges written and read back, then the edge count per relationship."""
    spo = fx.triples_spo(spark, d)
    path = scratch_dir(spark, "graph")
    sb.save_graph(gr.vertices(spo), gr.edges(spo), path)
    vertices, edges = sb.load_graph(spark, path)
    v = vertices.groupBy(F.col("attr").alias("kind")).agg(F.count("*").alias("n"))
    return v.unionByName(edges.groupBy(F.col("relationship").alias("kind")).agg(F.count("*").alias("n")))


#: Lines of a compressed text file.
TEXT_LINES = 1_000_000


def ntriples(spark, d):
    """Statements written as lines with comments and tagged or typed literals in between, parsed back."""
    spo = fx.triples_spo(spark, d)
    label = F.lit(" <http://x/label> ")
    lines = spo.select(
        F.explode(
            F.array(
                F.concat_ws(" ", "s", "p", "o", F.lit(".")),
                F.concat(F.lit("# "), "s"),
                F.concat(F.col("s"), label, F.lit('"a . b" .')),
                F.concat(F.col("s"), label, F.lit('"say \\"a\\""@en-GB .')),
                F.concat(F.col("s"), label, F.lit('"1"^^<http://x/int> .')),
                F.concat(F.col("s"), label, F.lit('"open .')),
            )
        ).alias("value")
    )
    path = scratch_dir(spark, "triples")
    # Lines of one table repeat much; a compressed file is read by one task, so its lines are bounded.
    lines.write.options(compression="gzip", maxRecordsPerFile=TEXT_LINES).text(path)
    return gr.edges(sb.read_triples(spark, path)).groupBy("src", "dst", "relationship").agg(F.count("*").alias("n"))


def roundtrip_pathways(spark, d):
    """Suppliers as gene-gene facts in the pathway layout, read back."""
    s = fx.table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    refs = F.when(F.col("s_suppkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("7|"), key, F.lit(";9")))
    fields = {left: F.concat(F.lit("gene "), key) for left in sb.PATHWAY_COLUMNS[:1]}
    fields |= {sb.PATHWAY_COLUMNS[1]: F.concat(F.lit("partner "), F.col("s_nationkey").cast("string")), sb.PATHWAY_COLUMNS[2]: refs}
    path = scratch_dir(spark, "pathways")
    line = F.concat_ws("\t", *[fields.get(i, F.lit("x")) for i in range(5)])
    s.select(line.alias("value")).write.text(path)
    return sb.read_pathways(spark, path).select("code", "l", "r", F.array_join("refs", ",").alias("refs"))


def corpus_listing(spark, d):
    """Documents written in per-source folders, listed recursively by name."""
    docs = fx.table(spark, d, "documents")
    path = scratch_dir(spark, "corpus")
    docs.select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    files = sa.corpus_files(spark, path, "part-*.txt")
    return files.select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source")).distinct()


def model_store(spark, d):
    """A relevance model saved, loaded and applied. A fit with intercept has converged where, over its own
    training pairs, probabilities sum up to the facts, also when weighted by the distance."""
    from pyspark.ml import PipelineModel

    close = fx.close_pairs(spark, d)
    tagged = close.withColumn("fact", (F.col("article_id") + F.col("l_pos")) % 3 == 0)
    pairs = written(rl.labelled(tagged), "known")
    path = scratch_dir(spark, "model")
    rl.fit_relevance(pairs, ["doc_dist"], max_iter=500, tolerance=1e-12).write().overwrite().save(path)
    scored = rl.score(PipelineModel.load(path), pairs)
    return scored.agg(
        F.count("*").alias("n"),
        F.round(F.sum("p"), 1).alias("sum_p"),
        F.round(F.sum(F.col("p") * F.col("doc_dist")) / 1000, 1).alias("sum_p_dist"),
    )



#: Documents of a file that arrives, so that no task takes more, however many there are.
_ARRIVAL_ROWS = 20_000


def _arrive(part, source, least):
    """Adds the rows to a source in files of about ``_ARRIVAL_ROWS``, ``least`` at least; returns their number."""
    files = max(least, -(-part.count() // _ARRIVAL_ROWS))
    part.repartition(files).write.mode("append").parquet(source)
    return files


def incremental_mentions(spark, d):
    """Documents arriving as files, drained batch by batch; later runs add nothing, not even with a new checkpoint."""
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    source, target, state = (scratch_dir(spark, n) for n in ("arrivals", "mentions", "state"))
    files = _arrive(docs, source, 4)
    vocab = written(fx.vocab(spark, d), "vocab")

    def find(batch):
        arts = batch.select(F.col("doc_id").alias("article_id"), F.split("text", "\n").alias("paragraphs"))
        return mt.single_word_mentions(sentences(arts), vocab)

    for checkpoint in (state, state, scratch_dir(spark, "state")):  # the third run has lost its checkpoint
        run_incremental(spark, source, docs.schema, find, target, checkpoint, files_per_batch=-(-files // 2), key="article_id", source_key="doc_id")
    return incremental_result(spark, target)


def _arrivals(spark, d, n):
    """Documents in ``n`` folders of a source: each document comes twice in the first, and again in the others."""
    docs, source = fx.table(spark, d, "documents").select("doc_id", "text"), scratch_dir(spark, "arrivals")
    parts = [docs.filter("doc_id % 3 <> 2").unionByName(docs.filter("doc_id % 3 = 0")), docs.filter("doc_id % 3 <> 0"), docs]
    return docs.schema, source, parts[:n]


def incremental_repeats(spark, d):
    """Documents that come again in the same file, in later files, in later runs and after a lost checkpoint: each once."""
    schema, source, parts = _arrivals(spark, d, 3)
    target, state = scratch_dir(spark, "mentions"), scratch_dir(spark, "state")
    vocab = written(fx.vocab(spark, d), "vocab")

    def find(batch):
        arts = batch.select(F.col("doc_id").alias("article_id"), F.split("text", "\n").alias("paragraphs"))
        return mt.single_word_mentions(sentences(arts), vocab)

    for part, checkpoint in zip(parts, (state, state, scratch_dir(spark, "state")), strict=True):
        files = _arrive(part, source, 2)
        run_incremental(spark, source, schema, find, target, checkpoint, files_per_batch=files, key="article_id", source_key="doc_id")
    return incremental_result(spark, target)


def pending_after_run(spark, d):
    """Articles that a run over a part of the source has left to do; those without a hit count as done."""
    schema, source, parts = _arrivals(spark, d, 1)
    parts[0].write.parquet(source)
    target = scratch_dir(spark, "mentions")
    none = lambda batch: batch.filter("doc_id < 0")
    run_incremental(spark, source, schema, none, target, scratch_dir(spark, "state"), key="doc_id")
    return sa.pending(fx.table(spark, d, "documents").select("doc_id"), done_articles(spark, target, "doc_id"), "doc_id")


def pending_articles(spark, d):
    """Articles without an output yet, where the labelled documents count as done."""
    arts = fx.articles(spark, d).select("article_id")
    done = fx.table(spark, d, "labels").select(F.col("doc_id").alias("article_id"))
    return sa.pending(arts, done, "article_id")


_ALL = (
    confusion_matrix,
    confusion_metrics,
    weighted_metrics,
    regression_metrics,
    error_rates,
    cosine_pairs,
    embedding_synonyms,
    embedding_store,
    embedding_grid,
    nearest_vectors,
    graph_vertices,
    graph_vertices_distinct,
    graph_edges,
    in_degree_top,
    in_degree_rank,
    edge_filter,
    relation_graph_sql,
    relationship_counts,
    edge_motif,
    motif_two_hop,
    uri_trim,
    heading_classes,
    citation_triples,
    citation_dates,
    interaction_partners,
    kinase_vocabulary,
    interaction_facts,
    found_before,
    roundtrip_csv,
    roundtrip_facts,
    roundtrip_interactions,
    roundtrip_features,
    roundtrip_synonyms,
    roundtrip_json,
    roundtrip_names_json,
    roundtrip_split,
    roundtrip_triples_json,
    roundtrip_xml,
    roundtrip_citations_xml,
    roundtrip_thesaurus_xml,
    roundtrip_parquet,
    graph_store,
    ntriples,
    roundtrip_pathways,
    corpus_listing,
    model_store,
    incremental_mentions,
    incremental_repeats,
    pending_articles,
    pending_after_run,
    walk_counts,
    triangle_counts,
)
QUERIES = {f.__name__: f for f in _ALL}

_SCORED = """sc AS (SELECT quality AS label, CASE WHEN n_chars > 900 THEN 1 ELSE 0 END AS prediction,
CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM labels JOIN documents USING (doc_id))"""
_CELLS = f"""WITH {_SCORED}, cells AS (SELECT k AS label, count(*) AS n, count(*) FILTER (sc.label = k AND prediction = k) AS tp,
count(*) FILTER (sc.label <> k AND prediction = k) AS fp, count(*) FILTER (sc.label = k AND prediction <> k) AS fn,
count(*) FILTER (sc.label <> k AND prediction <> k) AS tn FROM sc, (VALUES (0), (1)) t(k) GROUP BY k),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r,
CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END AS f FROM cells),
fm AS (SELECT *, CASE WHEN 4 * p + r = 0 THEN 0 ELSE 5 * p * r / (4 * p + r) END AS fb, (tp + fn) / n AS w FROM pr)"""
_COSINE = """round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / (sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[]))
* sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[]))), 5) AS similarity"""
_TRIPLES = """SELECT pmid, a, b, unnest(cs) AS c FROM (SELECT pmid, a, unnest(bs) AS b, cs FROM (
SELECT pmid, unnest(['chem-' || (c % 40), 'chem-' || (k % 7)]) AS a,
CASE WHEN k % 4 IN (0, 1) THEN [lower(pri)] ELSE [] END || ['sub ' || (c % 13)] AS bs,
CASE WHEN k % 3 = 0 THEN ['cond-' || (k % 11)] ELSE [] END || CASE WHEN k % 4 IN (0, 1) THEN [lower(st)] ELSE [] END AS cs FROM cites))"""
_CITE_TS = """SELECT pmid, coalesce(CAST(epoch(least(created, published)) AS BIGINT), -1) AS pub_ts FROM (SELECT pmid,
CASE WHEN k % 10 <> 0 THEN d END AS created,
CASE WHEN k % 7 <> 0 THEN CAST(date_trunc('month', date_trunc('month', d) + to_months(CAST(c % 5 - 2 AS INTEGER))) AS DATE) END AS published FROM cites)"""
_FACE = """SELECT 'gene ' || o_custkey AS l, 'p53' AS r, CAST(o_orderkey AS VARCHAR) AS pmid,
CASE WHEN o_orderkey % 8 <> 0 THEN CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) END AS pub_ts, CAST(c_custkey AS VARCHAR) AS ref_pmid,
CAST(epoch(DATE '1996-01-01' + CAST(c_custkey % 1500 AS INTEGER)) AS BIGINT) AS ref_ts FROM orders JOIN customer ON o_custkey = c_custkey"""


def _grid_sql(radius: int = 5) -> str:
    """Monthly sums of signs, then of months in windows, with the merged words of the bigram mode."""
    signs = ", ".join(f"sum(CASE WHEN substr(md5(ctx), {i + 1}, 1) >= '8' THEN n ELSE -n END) AS v{i}" for i in range(_GRID_SIZE))
    total = ", ".join(f"sum(coalesce(v{i}, 0)) AS v{i}" for i in range(_GRID_SIZE))
    squares = " + ".join(f"v{i} * v{i}" for i in range(_GRID_SIZE))
    trailing = ", ".join(f"('{k}', {v})" for k, v in WINDOW_MONTHS.items())
    return with_cte(
        "articles sents",
        f""", {_CORPUS}, placed AS (SELECT article_id, sent_pos, i, w[i] AS t FROM corpus, unnest(range(1, len(w) + 1)) x(i)),
        hit AS (SELECT article_id, sent_pos, i, i - row_number() OVER (PARTITION BY article_id, sent_pos ORDER BY i) AS island
          FROM (SELECT article_id, sent_pos, i, w[i] AS w1, w[i + 1] AS w2 FROM corpus, unnest(range(1, len(w))) x(i))
          SEMI JOIN (FROM scored WHERE score > 10) s USING (w1, w2)),
        starts AS (SELECT article_id, sent_pos, i FROM (SELECT *, row_number() OVER (PARTITION BY article_id, sent_pos, island ORDER BY i) AS k FROM hit) WHERE k % 2 = 1),
        merged AS (SELECT p.article_id, p.sent_pos, p.i, CASE WHEN s.i IS NULL THEN p.t ELSE p.t || '_' || q.t END AS t FROM placed p
          LEFT JOIN starts s ON s.article_id = p.article_id AND s.sent_pos = p.sent_pos AND s.i = p.i
          LEFT JOIN placed q ON q.article_id = p.article_id AND q.sent_pos = p.sent_pos AND q.i = p.i + 1
          LEFT JOIN starts b ON b.article_id = p.article_id AND b.sent_pos = p.sent_pos AND b.i = p.i - 1 WHERE b.i IS NULL),
        tok AS (SELECT 'word' AS mode, * FROM placed UNION ALL SELECT 'bigram', article_id, sent_pos, row_number() OVER (PARTITION BY article_id, sent_pos ORDER BY i), t FROM merged),
        dated AS MATERIALIZED (SELECT tok.*, date_trunc('month', pub_date)::DATE AS m FROM tok JOIN articles USING (article_id)),
        used AS (SELECT mode, m, t AS w, count(*) AS n FROM dated GROUP BY ALL),
        pairs AS (SELECT a.mode, a.m, a.t AS w, b.t AS ctx, count(*) AS n FROM dated a JOIN dated b
          ON b.mode = a.mode AND b.article_id = a.article_id AND b.sent_pos = a.sent_pos AND b.i <> a.i AND abs(b.i - a.i) <= {radius} GROUP BY ALL),
        vec AS (SELECT mode, m, w, {signs} FROM pairs GROUP BY ALL),
        month_rows AS MATERIALIZED (SELECT u.*, vec.* EXCLUDE (mode, m, w) FROM used u LEFT JOIN vec ON vec.mode = u.mode AND vec.m = u.m AND vec.w = u.w),
        months AS (SELECT DISTINCT date_trunc('month', pub_date)::DATE AS m FROM articles),
        grid AS (SELECT k AS "window", strftime(m, '%Y-%m') AS until, (m - to_months(depth - 1))::DATE AS low, m AS high FROM months, (VALUES {trailing}) x(k, depth)
          UNION ALL SELECT DISTINCT 'cumulative', strftime(m, '%Y'), DATE '1900-01-01', strptime(strftime(m, '%Y') || '-12-01', '%Y-%m-%d')::DATE FROM months),
        totals AS (SELECT "window", until, mode, w, sum(n) AS n, {total} FROM month_rows JOIN grid ON m BETWEEN low AND high GROUP BY ALL HAVING sum(n) >= 3)
        SELECT "window", until, mode, count(*) AS n_words, sum(n)::BIGINT AS n_uses, sum(v0)::BIGINT AS "first", sum({squares})::BIGINT AS squares, 0::BIGINT AS n_again
        FROM totals GROUP BY ALL""",
    )


_WIDE = """, wide AS (SELECT * FROM spo UNION ALL
SELECT 'part/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 'nation/' || (p_partkey % 25), 'resource/made_in' FROM part)"""


def _extend(base: str, extra: str, body: str) -> str:
    return with_cte(base, f", {extra}\n{body}")


ORACLE = {
    "confusion_matrix": f"WITH {_SCORED} SELECT label, prediction, count(*) AS n FROM sc GROUP BY ALL",
    "confusion_metrics": f"""{_CELLS} SELECT label, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall,
        round(fb, 6) AS f_measure, round(f, 6) AS fpr FROM fm""",
    "weighted_metrics": f"""{_CELLS} SELECT round(sum(p * w), 6) AS weighted_precision, round(sum(r * w), 6) AS weighted_recall,
        round(sum(fb * w), 6) AS weighted_f_measure, round(sum(f * w), 6) AS weighted_fpr FROM fm""",
    "regression_metrics": f"""WITH {_SCORED}, m AS (SELECT avg(label) AS my FROM sc)
        SELECT count(*) AS n, round(avg((prediction - my) * (prediction - my)), 6) AS explained_variance, round(avg(abs(label - prediction)), 6) AS mae,
        round(avg((label - prediction) ** 2), 6) AS mse, round(sqrt(avg((label - prediction) ** 2)), 6) AS rmse,
        round(1 - sum((label - prediction) ** 2) / sum((label - my) ** 2), 6) AS r2 FROM sc, m""",
    "error_rates": f"""WITH {_SCORED} SELECT split, round(avg(CASE WHEN label <> prediction THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
        count(*) AS n FROM sc GROUP BY split""",
    "cosine_pairs": f"""SELECT x.vec_id AS a, y.vec_id AS b, {_COSINE} FROM (SELECT *, unnest([vec_id + 1, vec_id * 3 + 1, vec_id + 100]) AS b
        FROM embeddings) x JOIN embeddings y ON y.vec_id = x.b""",
    "graph_vertices": with_cte(
        "spo",
        """SELECT id, attr, count(*) AS n FROM (SELECT src AS id, 'attr0' AS attr FROM spo UNION ALL SELECT dst, 'attr1' FROM spo) GROUP BY ALL""",
    ),
    "graph_vertices_distinct": with_cte("spo", "SELECT src AS id, 'attr0' AS attr FROM spo UNION SELECT dst, 'attr1' FROM spo"),
    "graph_edges": with_cte("spo", "SELECT * FROM spo"),
    "in_degree_top": with_cte("spo", "SELECT dst AS id, count(*) AS in_degree FROM spo GROUP BY dst ORDER BY in_degree DESC, id LIMIT 3"),
    "in_degree_rank": with_cte("spo", "SELECT dst AS id, count(*) AS in_degree FROM spo GROUP BY dst"),
    "edge_filter": with_cte("spo", "SELECT count(*) AS n FROM spo WHERE relationship LIKE '%resource/PDB_ID%'"),
    "relation_graph_sql": with_cte(
        "spo",
        """SELECT substr(src, length(src) - 7, 6) AS drug, dst AS name, 'name' AS kind FROM spo WHERE relationship LIKE '%resource/Name%'
        UNION ALL SELECT substr(src, length(src) - 7, 6), dst, 'smiles' FROM spo WHERE relationship LIKE '%open%_smiles%'""",
    ),
    "relationship_counts": with_cte("spo", "SELECT relationship, count(*) AS n FROM spo GROUP BY relationship"),
    "edge_motif": with_cte("spo", "SELECT * FROM spo WHERE relationship LIKE '%/PDB_ID'"),
    "motif_two_hop": with_cte(
        "spo", """SELECT a.src, b.dst, count(*) AS n_paths FROM spo a JOIN spo b ON a.dst = b.src
        WHERE a.src IN (SELECT src FROM spo WHERE relationship LIKE '%resource/Name') GROUP BY a.src, b.dst"""
    ),
    "uri_trim": """SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN p[-2] || '/' || p[-1] ELSE '<' || url || '>' END AS short,
        url AS same, p[-1] AS base FROM (SELECT *, string_split(url, '/') AS p FROM pages)""",
    "heading_classes": with_cte("heads", "SELECT pmid, cat, term FROM heads"),
    "citation_triples": with_cte("cites", _TRIPLES),
    "roundtrip_triples_json": with_cte("cites", _TRIPLES),
    "citation_dates": with_cte("cites", _CITE_TS),
    "interaction_partners": """WITH p AS (SELECT c_custkey AS k, c_mktsegment AS m, CAST(c_custkey AS VARCHAR) AS pmid, s AS side,
          (s = 'a' AND c_custkey % 3 = 0) OR (s = 'b' AND c_custkey % 3 = 1) AS own FROM customer, (VALUES ('a'), ('b')) t(s))
        SELECT unnest(CASE WHEN own THEN ['partner_' || k, 'gene ' || k] ELSE ['gene ' || k, lower(m) || ' k'] END) AS name, pmid, side FROM p""",
    "kinase_vocabulary": """SELECT DISTINCT term FROM (
        SELECT unnest(CASE WHEN c_custkey % 3 = 0 THEN ['partner_' || c_custkey, 'gene ' || c_custkey] ELSE ['gene ' || c_custkey, lower(c_mktsegment) || ' k'] END) AS term FROM customer
        UNION ALL SELECT 'k' || c_nationkey FROM customer UNION ALL SELECT lower(c_mktsegment) FROM customer
        UNION ALL SELECT 'kin ' || c_nationkey FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT lower(p_name) FROM part)""",
    "interaction_facts": f"SELECT l, pmid, ref_pmid FROM ({_FACE})",
    "found_before": f"SELECT DISTINCT l, r, pmid, pub_ts, ref_ts FROM ({_FACE}) WHERE pub_ts < ref_ts",
    "roundtrip_csv": with_cte(
        "pairs",
        """SELECT CAST(article_id AS VARCHAR) AS pmid, CASE WHEN code <> 3 THEN 1281744000 ELSE -1 END AS pub_ts,
        CASE WHEN code <> 3 THEN '14-08-2010' ELSE '' END AS date_text, l || ', "x" #' AS l, r, para_dist, sent_dist, doc_dist, code = 1 AS fact FROM pairs""",
    ),
    "roundtrip_facts": """SELECT DISTINCT lower(p_name || ', ' || p_brand) AS l, lower(p_type) AS r, CAST(unnest([p_partkey, p_partkey + 1]) AS VARCHAR) AS pmid
        FROM part WHERE p_size % 5 <> 0""",
    "roundtrip_interactions": """SELECT 'uniprotkb:' || c_custkey AS a, c_mktsegment AS b, c_name AS alt_a, CAST(c_custkey AS VARCHAR) AS alt_b,
        CAST(c_custkey AS VARCHAR) AS pmid FROM customer""",
    "roundtrip_features": f"""SELECT CAST(x.label AS VARCHAR) AS c0, 'V' || x.vec_id AS c1, 'V' || y.vec_id AS c2, {_COSINE}
        FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""",
    "roundtrip_synonyms": """SELECT DISTINCT 'gene' AS source, lower(unnest([p_name, p_type])) || '>' || lower(p_brand) AS term FROM part
        UNION SELECT 'kinase', unnest(['K' || c_nationkey, c_mktsegment, 'a' || c_nationkey, 'b' || c_nationkey]) FROM customer""",
    "roundtrip_json": with_cte(
        "found pairs sents",
        """, tr AS (SELECT DISTINCT ab.article_id, ab.l, ab.r, bc.r AS c FROM pairs ab JOIN pairs bc
          ON bc.article_id = ab.article_id AND ab.code = 1 AND bc.code = 2 AND bc.l = ab.r)
        SELECT 'mentions' AS kind, CAST(article_id AS VARCHAR) AS article_id, count(*) AS n, max(doc_pos) AS last_pos FROM found GROUP BY article_id
        UNION ALL SELECT 'pairs', CAST(article_id AS VARCHAR), count(*), CAST(sum(doc_dist) AS BIGINT) FROM pairs GROUP BY article_id
        UNION ALL SELECT 'guesses', CAST(article_id AS VARCHAR), count(*), max(uber_dist) FROM pairs WHERE code <> 1 GROUP BY article_id
        UNION ALL SELECT 'triples', CAST(article_id AS VARCHAR), count(*), 0 FROM tr GROUP BY article_id
        UNION ALL SELECT 'text', CAST(doc_id AS VARCHAR), coalesce(n, 0), length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) FROM documents
          LEFT JOIN (SELECT article_id, count(*) AS n FROM sents GROUP BY article_id) s ON s.article_id = doc_id""",
    ),
    "roundtrip_names_json": """SELECT 'gene' AS kind, 'n' || c_nationkey AS key, unnest([c_name, c_mktsegment]) AS synonym FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT 'protein', 'n' || c_nationkey, c_name FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT 'list', '', unnest([c_name, c_mktsegment]) FROM customer""",
    "roundtrip_split": with_cte(
        "guesses relevant",
        """SELECT CASE WHEN CAST(coalesce(g.pmid, f.pmid) AS BIGINT) % 2 = 0 THEN 'train' ELSE 'test' END AS split,
        CASE WHEN g.pmid IS NULL THEN 'FN' WHEN f.pmid IS NULL THEN 'FP' ELSE 'TP' END AS outcome, coalesce(g.code, -1) AS code, count(*) AS n
        FROM guesses g FULL OUTER JOIN relevant f ON f.l = g.l AND f.r = g.r AND f.pmid = g.pmid GROUP BY ALL""",
    ),
    "roundtrip_xml": with_cte(
        "sents",
        """SELECT CAST(article_id AS VARCHAR) AS article_id, article_id || '.fxml' AS file_name,
        strftime(DATE '2010-01-01' + CAST(article_id % 3650 AS INTEGER), '%Y-%m-%d') AS day, count(*) AS n_sentences,
        max(start + length(text)) AS n_chars FROM sents GROUP BY article_id""",
    ),
    "roundtrip_citations_xml": with_cte(
        "heads",
        f"""SELECT pmid, pub_ts, count(*) AS n_terms, max(term) AS last_term FROM ({_CITE_TS}) JOIN heads USING (pmid) GROUP BY ALL""",
    ),
    "roundtrip_thesaurus_xml": """SELECT DISTINCT CASE WHEN starts_with('D' || p_size, 'D12') THEN 'B' ELSE 'A' END AS cat, lower(p_name || ' ' || p_brand) AS term FROM part""",
    "roundtrip_parquet": with_cte(
        "vocab articles",
        """SELECT cat || ':' || term AS key, 0 AS value FROM vocab UNION ALL SELECT CAST(article_id AS VARCHAR), CAST(epoch(pub_date) AS BIGINT) FROM articles""",
    ),
    "graph_store": with_cte(
        "spo",
        """SELECT unnest(['attr0', 'attr1']) AS kind, n FROM (SELECT count(*) AS n FROM spo)
        UNION ALL SELECT relationship, count(*) FROM spo GROUP BY relationship""",
    ),
    "embedding_store": with_cte(
        "articles sents",
        """, tok AS (SELECT date_trunc('month', pub_date) AS m, unnest(list_filter(string_split(replace(text, '.', ' '), ' '), lambda x: x <> '')) AS w
          FROM (SELECT s.text, a.pub_date FROM sents s JOIN articles a USING (article_id))),
        grid AS (SELECT * FROM (VALUES ('cumulative', '2010', DATE '1900-01-01', DATE '2010-12-01'), ('cumulative', '2012', DATE '1900-01-01', DATE '2012-12-01'),
          ('year', '2011-02', DATE '2010-03-01', DATE '2011-02-01'), ('2month', '2011-02', DATE '2011-01-01', DATE '2011-02-01')) t("window", until, low, high)),
        uses AS (SELECT "window", until, w, count(*) AS n FROM tok JOIN grid ON m BETWEEN low AND high GROUP BY ALL)
        SELECT "window", until, count(*) AS n_words, 0 AS n_again FROM uses
        WHERE n >= 3 AND until IN (SELECT strftime(m, '%Y') FROM tok UNION ALL SELECT strftime(m, '%Y-%m') FROM tok) GROUP BY ALL""",
    ),
    "embedding_grid": _grid_sql(),
    "nearest_vectors": f"""SELECT query, word, rank, similarity FROM (SELECT x.vec_id AS query, y.vec_id AS word, {_COSINE},
        row_number() OVER (PARTITION BY x.vec_id ORDER BY list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])) DESC, y.vec_id) AS rank
        FROM embeddings x JOIN embeddings y ON x.vec_id % 50 = 0 AND y.vec_id <> x.vec_id) WHERE rank <= 5""",
    "ntriples": with_cte(
        "spo",
        """SELECT src, dst, relationship, count(*) AS n FROM (SELECT src, dst, relationship FROM spo
        UNION ALL SELECT src, unnest(['"a . b"', '"say \\"a\\""@en-GB', '"1"^^<http://x/int>']), 'x/label' FROM spo) GROUP BY ALL""",
    ),
    "roundtrip_pathways": """SELECT 4 AS code, 'gene ' || s_suppkey AS l, 'partner ' || s_nationkey AS r,
        CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '7,' || s_suppkey || ',9' END AS refs FROM supplier""",
    "corpus_listing": "SELECT DISTINCT source FROM documents",
    "model_store": with_cte(
        "pairs",
        """SELECT count(*) AS n, round(CAST(count(*) FILTER (fact) AS DOUBLE), 1) AS sum_p, round(sum(doc_dist) FILTER (fact) / 1000, 1) AS sum_p_dist
        FROM (SELECT doc_dist, (article_id + l_pos) % 3 = 0 AS fact FROM pairs)""",
    ),
    "incremental_mentions": with_cte("found", "SELECT * FROM found"),
    "incremental_repeats": with_cte("found", "SELECT * FROM found"),
    "pending_after_run": "SELECT doc_id FROM documents WHERE doc_id % 3 = 2",
    "walk_counts": with_cte(
        "spo",
        f"""{_WIDE} SELECT a.src AS id, CAST(sum(n) AS BIGINT) AS n_paths FROM wide a
        JOIN (SELECT src AS mid, count(*) AS n FROM wide GROUP BY 1) b ON a.dst = b.mid GROUP BY 1""",
    ),
    "triangle_counts": with_cte(
        "spo",
        f"""{_WIDE}, ends AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM wide WHERE src <> dst),
        found AS (SELECT a.x, a.y, b.y AS z FROM ends a JOIN ends b ON a.x = b.x AND a.y < b.y JOIN ends c ON c.x = a.y AND c.y = b.y)
        SELECT id, count(*) AS n_triangles FROM (SELECT unnest([x, y, z]) AS id FROM found) GROUP BY 1""",
    ),
    "pending_articles": "SELECT doc_id AS article_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
