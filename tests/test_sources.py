"""Readers, writers, vocabulary, graph, citations, interactions and models on small files."""

import datetime
import json
from pathlib import Path

from conftest import rows
from pyspark.sql import functions as F

from hypograph.operators import citations as ct
from hypograph.operators import embeddings as em
from hypograph.operators import graph as gr
from hypograph.operators import interactions as ia
from hypograph.operators import relevance as rl
from hypograph.operators import vocab as vc
from hypograph.operators.sizing import fits_broadcast, scratch_dir
from hypograph.plans import jobs
from hypograph.sources import articles as sa
from hypograph.sources import records as sr
from hypograph.sources import tables as sb

CHEMICAL = "10,10-bis(4-pyridinylmethyl)-9(10H)-anthracenone"

ARTICLE = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE article PUBLIC "-//X//DTD" "x.dtd">
<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta>
<article-id pub-id-type="pmc">99</article-id><article-id pub-id-type="pmid">{pmid}</article-id>
<pub-date pub-type="collection"><month>12</month><year>2010</year></pub-date>
<pub-date pub-type="epub"><day>14</day><month>8</month><year>2010</year></pub-date></article-meta></front>
<body>{body}</body>
<back><ref><pub-id pub-id-type="pmid">1</pub-id></ref></back></article>"""


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def _corpus(tmp_path):
    first = (
        f"<p>In rat heart cells {CHEMICAL} blocks the channel <italic>KCNQ1</italic> which is a risk gene of osteoarthritis and"
        " Diabetes Mellitus, Type 2.</p><sec><p>Loss of 11-BETA-HSD3 leads to Hypokinesia.</p></sec>"
    )
    fourth = f"<p>The {CHEMICAL} and KCNQ1 here. Again {CHEMICAL} with KCNQ1 there.</p>"
    _write(tmp_path / "A/B/one.fxml", ARTICLE.format(pmid="18568022", body=first))
    _write(tmp_path / "A/four.fxml", ARTICLE.format(pmid="20805988", body=fourth))
    _write(tmp_path / "A/broken.fxml", "<article><p>no end")
    _write(tmp_path / "A/other.txt", "not an article")
    return str(tmp_path)


def _facts(spark, tmp_path):
    name = '"10,10-bis(4-pyridinylmethyl)-9(10H)-anthracenone"'
    row = name + ",C1,,{gene},1,protein,,,\"text, with comma\",x^y,{refs}\n"
    chem = "# Fields\n#\n" + row.format(gene="KCNQ1", refs="18568022|5") + "# comment in between\n" + row.format(gene="KCNQ3-TEST", refs="18568022")
    _write(tmp_path / "f/ab.csv", chem)
    _write(tmp_path / "f/bc.csv", "# Fields\n11-BETA-HSD3,1,Hypokinesia,D1,,,,,24394944\nKCNQ1,2,\"Diabetes Mellitus, Type 2\",D2,,,,,\n")
    _write(tmp_path / "f/ac.csv", f"{name},C1,,osteoarthritis,D3,,,,,77\n")
    return jobs.load_facts(
        spark,
        {
            "chemical_gene": str(tmp_path / "f/ab.csv"),
            "gene_disease": str(tmp_path / "f/bc.csv"),
            "chemical_disease": str(tmp_path / "f/ac.csv"),
        },
    )


def test_article_job_end_to_end(spark, tmp_path):
    arts = sa.read_articles(spark, _corpus(tmp_path / "c"))
    assert rows(arts, "article_id", "file_name", F.col("pub_date").cast("string")) == [
        ("18568022", "one.fxml", "2010-08-14"),
        ("20805988", "four.fxml", "2010-08-14"),
    ]
    facts = _facts(spark, tmp_path)
    assert rows(facts.groupBy("code").count(), "code", "count") == [(1, 2), (2, 2), (3, 1)]
    vocab = jobs.build_vocabulary(spark, None, facts)
    chemical = CHEMICAL.lower()
    vocab = vocab.unionByName(spark.createDataFrame([("A", chemical)], "cat string, term string")).distinct()
    out = jobs.analyse_articles(arts, vocab, facts)
    pairs = rows(out.pairs, "article_id", "l", "r", "fact")
    assert ("18568022", chemical, "kcnq1", True) in pairs
    assert ("18568022", "11-beta-hsd3", "hypokinesia", True) in pairs
    assert [p for p in pairs if p[0] == "20805988" and p[2] == "kcnq1"] == [("20805988", chemical, "kcnq1", True)]
    triples = rows(out.triples, "article_id", "a", "b", "c")
    assert ("18568022", chemical, "kcnq1", "diabetes mellitus, type 2") in triples

    from hypograph.operators import facts as fc

    refs = fc.fact_refs(facts)
    dates = spark.createDataFrame([("18568022", 1281744000), ("5", 1281744000 - 86400)], "pmid string, pub_ts bigint")
    path = str(tmp_path / "eval")
    result = jobs.evaluate_pairs(out.mentions, refs, out.articles, dates, path)
    hit = result.filter((F.col("outcome") == "TP") & (F.col("r") == "kcnq1")).first()
    assert (hit["l"], hit["pmid"], hit["pub_ts"], hit["fact"], hit["time_until_verified"]) == (chemical, "18568022", 1281744000, True, -86400)
    assert rows(result.filter("outcome = 'FN'"), "r") == [("kcnq3-test",)]
    back = sb.read_pair_csv(spark, f"{path}/annotated.csv")
    assert back.count() == result.count() and back.filter("l = ''").count() == 0
    assert spark.read.json(f"{path}/annotated").filter("split = 'train'").count() == result.filter("pmid % 2 = 0").count()
    assert jobs.augment_pairs(back).count() == back.count()

    digest = str(tmp_path / "digest")
    sa.write_digests(out.digests(), digest, by_name=True)
    assert (tmp_path / "digest/c1=o/c2=n").is_dir()
    again = sa.read_digests(spark, digest)
    cols = ["article_id", "cat", "word", "doc_pos", "para_pos", "sent_pos"]
    assert rows(sa.digest_mentions(again), *cols) == rows(out.mentions, *cols)
    assert sa.digest_pairs(again).count() == out.pairs.count()
    assert rows(sa.digest_pairs(again).filter("fact and R = 'hypokinesia'"), "fact", "refs") == [(True, ["24394944"])]
    assert jobs.summarise_digests(spark, digest, skip="four").filter("n > 1").count() == 0


def test_old_digest_defaults_and_broken_document(spark, tmp_path):
    doc = {"fileName": "x", "id": "1", "paragraphs": [], "A": [], "B": [], "C": [], "AC": [], "BC": [], "ABC": [],
           "AB": [{"id": 1, "L": "a", "R": "b", "docDist": 5.0, "paraDist": 0.0, "sentDist": 0.0, "code": 1}]}
    _write(tmp_path / "1.json", json.dumps(doc, indent=1))
    _write(tmp_path / "2.json", "{ not json")
    back = sa.read_digests(spark, str(tmp_path), multi_line=True)
    assert [tuple(r) for r in sa.digest_pairs(back).select("article_id", "L", "fact", F.size("refs")).collect()] == [("1", "a", False, 0)]


def test_vocabulary_rules(spark):
    terms = spark.createDataFrame([("ab",), ("a-b",), ("12-34",), ("Was",), ("was",), ("KCNQ1",), ("kcnq1",)], "term string")
    assert rows(vc.clean_terms(terms), "term") == [("kcnq1",), ("was",)]  # upper-case stop words pass the first filter
    d = spark.createDataFrame([("Insulin ", ["D12.1", "C1"]), ("Water", ["E1", "D01"]), ("Cold", ["C2", "C3"])], "name string, trees array<string>")
    assert rows(vc.classify_trees(d), "cat", "term") == [("A", "water"), ("B", "insulin"), ("C", "cold"), ("C", "insulin")]
    assert rows(vc.classify_first_tree(d), "cat", "term") == [("A", "water"), ("B", "insulin"), ("C", "cold")]
    assert rows(vc.subtract_category(vc.classify_trees(d)), "cat", "term") == [("A", "water"), ("C", "cold"), ("C", "insulin")]


def test_thesaurus_and_citations_xml(spark, tmp_path):
    _write(
        tmp_path / "mesh.xml",
        "<Set><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Calcimycin</String></DescriptorName>"
        "<PharmacologicalActionList><DescriptorName><String>Other</String></DescriptorName></PharmacologicalActionList>"
        "<TreeNumberList><TreeNumber>D03.1</TreeNumber></TreeNumberList></DescriptorRecord>"
        "<DescriptorRecord><DescriptorUI>D2</DescriptorUI><DescriptorName><String>Nothing</String></DescriptorName></DescriptorRecord></Set>",
    )
    t = sr.read_thesaurus(spark, str(tmp_path / "mesh.xml"))
    assert rows(vc.classify_trees(t), "cat", "term") == [("A", "calcimycin")]
    _write(
        tmp_path / "cit.xml",
        "<Set><MedlineCitation><PMID Version='1'>7</PMID><DateCreated><Year>2013</Year><Month>02</Month><Day>27</Day></DateCreated>"
        "<Article><Journal><JournalIssue><PubDate><Year>2012</Year><Month>Dec</Month></PubDate></JournalIssue></Journal></Article>"
        "<ChemicalList><Chemical><NameOfSubstance UI='D1'>Tea</NameOfSubstance></Chemical></ChemicalList>"
        "<MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN='Y' UI='D019453'>Calcium</DescriptorName>"
        "<QualifierName MajorTopicYN='N' UI='Q000187'>Drug Effects</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation>"
        "<MedlineCitation><PMID>8</PMID></MedlineCitation></Set>",
    )
    triples, dates = jobs.citation_job(spark, str(tmp_path / "cit.xml"), str(tmp_path / "out"))
    assert [tuple(r) for r in triples.collect()] == [("7", "tea", "drug effects", "calcium")]
    assert rows(dates.na.fill(-1), "pmid", "pub_ts") == [("7", 1354320000), ("8", -1)]
    assert ct.heading_terms(sr.read_citations(spark, str(tmp_path / "cit.xml"))).count() == 3


def test_interaction_files(spark, tmp_path):
    _write(
        tmp_path / "i.txt",
        "#ID\tB\n" + "\t".join(["uniprotkb:P04637", "uniprotkb:Q1", "x", "x", "psi-mi:p53(display)", "psi-mi:MDM2(display)|bad", "x", "x", "mint:1|pubmed:9|pubmed:8"])
        + "\n" + "\t".join(["uniprotkb:Q2", "uniprotkb:P04637", "x", "x", "hgnc:CDK 2(gene name)", "psi-mi:p53(display)", "x", "x", "mint:2"]) + "\n",
    )
    inter = sb.read_interactions(spark, str(tmp_path / "i.txt"))
    assert rows(inter.na.fill(""), "a", "pmid") == [("uniprotkb:P04637", "9"), ("uniprotkb:Q2", "")]
    assert rows(ia.partner_names(inter, side="a").na.fill(""), "name", "pmid") == [("cdk 2", ""), ("mdm2", "9")]
    assert rows(ia.partner_names(inter, side="b"), "name") == [("p53",), ("p53",)]
    _write(tmp_path / "k.txt", "0 ABL ABL1 abl;JTK7\n1 X Y\n")
    assert rows(sb.read_kinase_synonyms(spark, str(tmp_path / "k.txt")), "term") == [("ABL",), ("ABL1",), ("X",), ("Y",), ("abl",), ("jtk7",)]
    _write(tmp_path / "g.json", json.dumps([{"Genes": {"abl": ["ABL1", "Met"]}}, {"Proteins": {"src": ["c-src"]}}, {}], indent=2))
    both = sb.read_gene_protein(spark, str(tmp_path / "g.json"))
    assert rows(both, "kind", "key", "synonym") == [("gene", "abl", "ABL1"), ("gene", "abl", "Met"), ("protein", "src", "c-src")]
    _write(tmp_path / "n.json", json.dumps(["acetate kinase", "p53"], indent=1))
    names = sb.read_term_list(spark, str(tmp_path / "n.json"))
    vocab = ia.kinase_vocabulary(inter, both, sb.read_kinase_synonyms(spark, str(tmp_path / "k.txt")), names)
    got = {r.term for r in vocab.collect()}
    assert {"mdm2", "abl1", "acetate kinase", "jtk7"} <= got and not {"met", "p53"} & got
    _write(tmp_path / "s.csv", 'TP53,"P53, LFS1"\nX\n')
    assert rows(sb.read_gene_synonyms(spark, str(tmp_path / "s.csv")), "synonym", "canonical") == [("lfs1", "tp53"), ("p53", "tp53")]
    _write(tmp_path / "p.txt", "#h\nTP53\tx\tMDM2\ty\t1;2|3\n")
    assert [r.refs for r in sb.read_pathways(spark, str(tmp_path / "p.txt")).collect()] == [["1", "2", "3"]]


def test_crawl_finds_pairs_before_publication(spark):
    arts = spark.createDataFrame(
        [("1", "f1", "14-8-2010", ["we see mdm2 bind p53 here"]), ("2", "f2", "--2010", ["an mdm2 and p53 text"])],
        "article_id string, file_name string, date_text string, paragraphs array<string>",
    )
    inter = spark.createDataFrame(
        [("uniprotkb:P04637", "q", "", "x:MDM2(gene)", "9")], "a string, b string, alt_a string, alt_b string, pmid string"
    )
    dates = spark.createDataFrame([("9", 1281744000 + 86400)], "pmid string, pub_ts bigint")
    kin, tgt = spark.createDataFrame([("mdm2",)], "term string"), spark.createDataFrame([("p53",)], "term string")
    out = jobs.crawl_interactions(arts, kin, tgt, inter, dates)
    assert rows(out, "article_id", "l", "r", "ref_ts") == [("1", "mdm2", "p53", 1281744000 + 86400)]


def test_graph_store(spark, tmp_path):
    _write(
        tmp_path / "a.n3",
        "# c\n<http://x/r/drugbank/DB00001> <http://x/resource/PDB_ID> <http://x/pdb/1abc> .\n"
        '<http://x/r/drugbank/DB00001> <http://x/resource/Name> "Lepirudin" .\n',
    )
    v, e = jobs.relation_graph(spark, [str(tmp_path / "a.n3")], str(tmp_path / "g"))
    assert rows(e, "src", "dst", "relationship") == [
        ("drugbank/DB00001", '"Lepirudin"', "resource/Name"),
        ("drugbank/DB00001", "pdb/1abc", "resource/PDB_ID"),
    ]
    assert v.count() == 4 and v.distinct().count() == 3
    again = jobs.relation_graph(spark, ["/nowhere"], str(tmp_path / "g"))  # stored: the source is not read
    assert again[1].count() == 2
    assert gr.edge_motif(e, "%/PDB_ID").count() == 1


def test_relevance_and_hypotheses(spark, tmp_path):
    near = [("a", "b", 1, 0, 0, 20 + i, True) for i in range(30)] + [("a", "q", 1, 1, 3, 700 - i, False) for i in range(30)]
    far = [("b", "c", 2, 0, 0, 30 + i, True) for i in range(30)] + [("q", "d", 2, 1, 3, 650 - i, False) for i in range(30)]
    df = spark.createDataFrame(near + far, "l string, r string, code int, para_dist int, sent_dist int, doc_dist int, fact boolean")
    out = [tuple(r)[:3] for r in rl.ranked_hypotheses(df, df).collect()]
    assert out == [("a", "b", "c"), ("a", "q", "d")]
    report = jobs.train_relevance(df, str(tmp_path / "model"))
    assert report.errors.agg(F.max("error_rate")).first()[0] == 0.0 and report.labels.count() == 2
    assert (tmp_path / "model/metadata").is_dir()


def test_embeddings_and_similarity(spark):
    corpus = spark.createDataFrame([(["kinase", "binds", "p53", "x"],), (["kinase", "cuts", "p53"],)] * 40, "tokens array<string>")
    model = em.fit_words(corpus, min_count=1, vector_size=8, partitions=2)
    vectors = em.word_vectors(model)
    assert rows(vectors, "word") == [("binds",), ("cuts",), ("kinase",), ("p53",), ("x",)]
    terms = spark.createDataFrame([("kinase",), ("two words",)], "term string")
    nearest = {r["word"]: r["rank"] for r in jobs.crawl_neighbours(vectors, terms, 2).collect()}
    want = {r["word"] for r in model.findSynonyms("kinase", 2).collect()}
    assert set(nearest) == want and sorted(nearest.values()) == [1, 2]
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "word string, vector array<float>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "zz")], "a string, b string")
    assert [(r.a, r.b, round(r.similarity, 6)) for r in em.similarity(pairs, vec).collect()] == [("a", "b", 0.707107)]


def test_window_embeddings_are_stored_once(spark, tmp_path):
    from datetime import date

    from hypograph.operators.sentences import sentences

    text = "Alpha binds beta. Beta cuts gamma. Gamma likes alpha. Delta is gone."
    days = [date(2010, 1, 5), date(2010, 2, 5), date(2011, 1, 5), None]
    arts = spark.createDataFrame([(str(i), [text], day) for i, day in enumerate(days)], "article_id string, paragraphs array<string>, pub_date date")
    synonyms = spark.createDataFrame([("beta", "bet1"), ("is", "isx")], "synonym string, canonical string")
    english = spark.createDataFrame([("is",)], "word string")
    store = str(tmp_path / "store")
    params = spark.createDataFrame(
        [("month", "2010-02", "word"), ("year", "2010-12", "word"), ("cumulative", "2011", "bigram"), ("month", "2010-05", "word")],
        "window string, until string, mode string",
    )
    train = lambda: jobs.window_embeddings(sentences(arts), arts, store, synonyms, english, params, min_size=2, min_count=1, vector_size=4)
    assert train() == [("cumulative", "2011", "bigram"), ("month", "2010-02", "word"), ("year", "2010-12", "word")]
    assert train() == []
    rows_of = em.stored_vectors(spark, store).filter("mode = 'word'").groupBy("window").agg(F.sort_array(F.collect_set("word")).alias("w"))
    words = {r["window"]: r["w"] for r in rows_of.collect()}
    assert words["month"] == words["year"] == sorted(["alpha", "binds", "bet1", "cuts", "gamma", "likes", "delta", "is", "gone"])


def test_a_stored_table_is_not_built_again(spark, tmp_path):
    def trap():
        raise AssertionError("built again")

    path = str(tmp_path / "t")
    assert sb.read_or_build(spark, path, lambda: spark.range(3)).count() == 3
    assert sb.read_or_build(spark, path, trap).count() == 3
    series = spark.createDataFrame([("k", i, 86400 * (i % 3)) for i in range(6)] + [("one", 9, 0), ("k", 7, None)], "k string, id long, pub_ts long")
    out = jobs.stored_series(spark, str(tmp_path / "s"), series, ["k"], min_size=2)
    assert rows(out, "k", "seq", "id") == [("k", i, x) for i, x in enumerate([0, 3, 1, 4, 2, 5])]


def test_samples_are_stable_and_near_their_share(spark):
    df = spark.range(4000).withColumnRenamed("id", "article_id")
    one = rows(sa.sample_rows(df, 0.25), "article_id")
    assert one == rows(sa.sample_rows(df.repartition(7), 0.25), "article_id") and 800 < len(one) < 1200
    assert sa.sample_rows(df, 1.0).count() == 4000 and sa.sample_rows(df, 0.0).count() == 0


def test_entities_failed_files_and_typed_literals(spark, tmp_path):
    _write(tmp_path / "c/a.fxml", ARTICLE.format(pmid="1", body="<p>caf&eacute;&nbsp;&lt;x&gt; &amp;c</p>"))
    _write(tmp_path / "c/b.fxml", ARTICLE.format(pmid="2", body="<p>&unknown; text</p>"))
    xml = sa.article_xml(spark, str(tmp_path / "c"))
    assert [r["paragraphs"] for r in sa.parse_articles(xml).collect()] == [["caf\u00e9\u00a0<x> &c"]]
    failed = sa.failed_articles(xml).collect()
    assert len(failed) == 1 and failed[0]["path"].endswith("b.fxml") and "undefined entity" in failed[0]["reason"]
    _write(tmp_path / "d/1.json", '{"id": "1"}\n{ no\n')
    assert [r["text"] for r in sa.failed_digests(spark, str(tmp_path / "d")).collect()] == ["{ no"]
    assert sa.read_digests(spark, str(tmp_path / "d")).count() == 1
    lines = ['<a> <b> "x"@en .', '<a> <b> "1"^^<t> .', '<a> <b> "q \\" . " .', "<a> <b> \"open .", "# c", "_:n <b> _:m ."]
    got = rows(sb.parse_triples(spark.createDataFrame([(x,) for x in lines], "value string")), "o")
    assert got == [('"1"^^<t>',), ('"q \\" . "',), ('"x"@en',), ("_:m",)]


def test_all_references_of_a_tagged_pair(spark):
    from hypograph.operators import facts as fc

    facts = spark.createDataFrame([(1, "A", "b", ["1", "2"]), (1, "a", "B", ["3"]), (2, "a", "b", ["2", ""])], "code int, l string, r string, refs array<string>")
    pairs = spark.createDataFrame([(1, "a", "b"), (3, "a", "b"), (1, "a", "z")], "code int, l string, r string")
    out = {(r["code"], r["r"]): (r["fact"], r["refs"]) for r in fc.tag_facts(pairs, facts, with_refs=True).collect()}
    assert out == {(1, "b"): (True, ["1", "2", "3"]), (3, "b"): (False, []), (1, "z"): (False, [])}


def test_joins_on_hot_keys_give_the_same_without_broadcast(spark, monkeypatch):
    from hypograph.operators import sizing

    left = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c"), (9, "d")], "k long, v string")
    small = {how: rows(sizing.keyed_join(left, right, ["k"], how).na.fill("-"), *(["k", "id", "v"] if how in ("inner", "left") else ["k", "id"])) for how in ("inner", "left", "left_semi", "left_anti")}
    monkeypatch.setattr(sizing, "small_side", lambda df, *a: (df, False))
    for how, want in small.items():
        assert rows(sizing.keyed_join(left, right, ["k"], how).na.fill("-"), *(["k", "id", "v"] if how in ("inner", "left") else ["k", "id"])) == want


def test_measured_broadcast_and_scratch(spark):
    df = spark.range(100).withColumn("t", F.lit("x" * 10))
    assert fits_broadcast(df) and not fits_broadcast(df, max_rows=99) and not fits_broadcast(df, max_bytes=1000)
    assert scratch_dir(spark, "a").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_dir(spark, "a") != scratch_dir(spark, "a")


def test_slices_cover_the_corpus(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    parts = [df.filter(sa.slice_of(F.col("k"), 3) == i).count() for i in range(3)]
    assert sum(parts) == 1000 and min(parts) > 200


def test_feature_vectors(spark, tmp_path):
    _write(tmp_path / "model-split1.csv", "1,A,B,0.5\n2,A,ZZ,0.1\n")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "word string, vector array<float>")
    jobs.annotate_similarity(spark, str(tmp_path / "model*split*"), 4, vec, str(tmp_path / "ext"))
    assert [tuple(r) for r in sb.read_delimited(spark, str(tmp_path / "ext"), 5).collect()] == [("1", "A", "B", "0.5", "1.0")]


def test_written_xml_files_hold_a_bounded_number_of_records(spark, tmp_path, monkeypatch):
    """One writing task, several files: so no reading task gets all that one task has written."""
    from hypograph.plans import other_queries as oq
    from hypograph.sources import records as sr
    from pyspark.sql import functions as F

    monkeypatch.setattr(oq, "XML_RECORDS", 10)
    raw = spark.range(45).coalesce(1).select(F.concat(F.lit("D"), "id").alias("DescriptorUI"), F.struct(F.lit("N").alias("String")).alias("DescriptorName"))
    oq._write_xml(raw, str(tmp_path / "x"), "DescriptorRecord", "DescriptorRecordSet")
    assert len([x for x in (tmp_path / "x").iterdir() if x.name.startswith("part-")]) == 5
    assert {x["ui"] for x in sr.read_thesaurus(spark, str(tmp_path / "x")).collect()} == {f"D{i}" for i in range(45)}


def test_written_triples_are_compressed_in_bounded_files(spark, monkeypatch):
    from hypograph.plans import other_queries as oq

    monkeypatch.setattr(oq, "TEXT_LINES", 5_000)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    known = set(shared.glob("triples-*"))
    assert oq.ntriples(spark, "/root/testdata/sf0.001").agg(F.sum("n")).first()[0] > 20_000
    (path,) = set(shared.glob("triples-*")) - known
    files = [x for x in path.iterdir() if x.name.startswith("part-")]
    assert len(files) > 5 and all(x.name.endswith(".gz") for x in files)


def _size(folder):
    return sum(x.stat().st_size for x in folder.rglob("*") if x.is_file())


def test_written_records_and_digests_take_little_disk(spark, tmp_path):
    """Citations in XML and digests in JSON are compressed, and no text is kept beside what is read back."""
    from hypograph.plans import other_queries as oq

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    orders = [(i, i % 90, "O", "1-URGENT", datetime.datetime(1995, 1 + i % 12, 3)) for i in range(600)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp"
    spark.createDataFrame(orders, schema).write.parquet(str(tmp_path / "orders.parquet"))
    text = "Aspirin binds kinase one. The protein inhibits tumour growth in tissue.\nSecond paragraph follows. "
    spark.createDataFrame([(i, text * 5 + str(i)) for i in range(200)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "aspirin kinase protein tumour growth tissue")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    old = set(shared.iterdir())
    assert oq.roundtrip_citations_xml(spark, str(tmp_path)).count() == 600
    made = set(shared.iterdir()) - old
    xml = [x for x in made if list(x.glob("part-*.xml.gz"))]
    assert len(xml) == 1 and _size(xml[0]) < 600 * 200  # 1,500 bytes a record as plain text
    assert {x.name.rsplit("-", 1)[0] for x in made - set(xml)} == {"read"}

    old = set(shared.iterdir())
    out = {(x["kind"], x["article_id"]): (x["n"], x["last_pos"]) for x in oq.roundtrip_json(spark, str(tmp_path)).collect()}
    assert out["text", "7"] == (sum(1 for p in (text * 5 + "7").split("\n") for s in p.split(". ") if s), len(text * 5 + "7"))
    made = {x.name.rsplit("-", 1)[0]: x for x in set(shared.iterdir()) - old}
    assert set(made) == {"lists", "digests", "read-back"}
    assert list(made["digests"].rglob("part-*")) and all(x.name.endswith(".json.gz") for x in made["digests"].rglob("part-*"))
    assert not {"raw", "paragraphs"} & set(spark.read.parquet(str(made["read-back"])).columns)
