"""The drained incremental result equals the batch result, and a second run adds only new files."""

from conftest import rows

from hypograph.operators import mentions as mt
from hypograph.operators.sentences import sentences
from hypograph.streaming.incremental import done_articles, incremental_result, run_incremental


def test_incremental_equals_batch(spark, tmp_path):
    schema = "article_id string, paragraphs array<string>"
    docs = [(str(i), [f"alpha {i} beta. gamma alpha"]) for i in range(40)]
    df = spark.createDataFrame(docs, schema)
    vocab = spark.createDataFrame([("A", "alpha"), ("B", "beta")], "cat string, term string")
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def find(batch):
        return mt.single_word_mentions(sentences(batch), vocab)

    cols = ["article_id", "word", "doc_pos", "sent_pos"]
    df.filter("article_id % 2 = 0").repartition(4).write.parquet(source)
    run_incremental(spark, source, df.schema, find, target, state, files_per_batch=1)
    half = rows(find(df.filter("article_id % 2 = 0")), *cols)
    assert rows(incremental_result(spark, target), *cols) == half
    run_incremental(spark, source, df.schema, find, target, state)  # nothing new
    assert rows(incremental_result(spark, target), *cols) == half
    run_incremental(spark, source, df.schema, find, target, str(tmp_path / "lost"), key="article_id")  # a new checkpoint
    assert rows(incremental_result(spark, target), *cols) == half
    df.filter("article_id % 2 = 1").repartition(2).write.mode("append").parquet(source)
    run_incremental(spark, source, df.schema, find, target, state)
    assert rows(incremental_result(spark, target), *cols) == rows(find(df), *cols)


DOCS = "article_id string, paragraphs array<string>"


def _arrive(spark, source, ids, text="alpha {0} beta"):
    spark.createDataFrame([(str(i), [text.format(i)]) for i in ids], DOCS).coalesce(1).write.mode("append").parquet(source)


def _runs(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []

    def find(batch):
        seen.append([r[0] for r in batch.select("article_id").collect()])
        return batch.filter("article_id not like '9%'").select("article_id", "paragraphs")

    def run(checkpoint, **options):
        run_incremental(spark, source, spark.createDataFrame([], DOCS).schema, find, target, str(tmp_path / checkpoint), key="article_id", **options)
        return [r[0] for r in rows(incremental_result(spark, target), "article_id")]

    return source, target, seen, run


def test_every_article_once_however_often_it_comes(spark, tmp_path):
    """Again in the same file, a later file of the run, a later run, and under a new checkpoint."""
    source, target, seen, run = _runs(spark, tmp_path)
    _arrive(spark, source, [1, 2, 2, 90])
    _arrive(spark, source, [1, 3])
    assert run("state", files_per_batch=1) == ["1", "2", "3"]
    _arrive(spark, source, [1, 4, 90])
    assert run("state") == ["1", "2", "3", "4"]
    assert run("state") == ["1", "2", "3", "4"]
    assert sorted(x for batch in seen for x in batch) == ["1", "2", "3", "4", "90"]  # the one without a hit was done as well
    _arrive(spark, source, [5, 4])
    assert run("lost") == ["1", "2", "3", "4", "5"]
    _arrive(spark, source, [5, 6, 1])
    assert run("lost", files_per_batch=1) == ["1", "2", "3", "4", "5", "6"]
    assert rows(done_articles(spark, target, "article_id"), "article_id") == [(x,) for x in ["1", "2", "3", "4", "5", "6", "90"]]
    assert sorted(x for batch in seen for x in batch) == ["1", "2", "3", "4", "5", "6", "90"]


def test_a_batch_that_broke_off_does_not_count(spark, tmp_path):
    """Rows without their list of ids are passed over, and the articles are done again."""
    source, target, _, run = _runs(spark, tmp_path)
    _arrive(spark, source, [1, 2])
    spark.createDataFrame([("1", ["half"])], DOCS).write.parquet(f"{target}/rows/run=gone/batch=0")
    assert run("state") == ["1", "2"]


def test_rows_without_an_id_and_nothing_new(spark, tmp_path):
    source, target, _, run = _runs(spark, tmp_path)
    spark.createDataFrame([(None, ["alpha"]), ("7", None)], DOCS).write.parquet(source)
    assert run("state") == ["7"]
    assert done_articles(spark, str(tmp_path / "nowhere"), "article_id").count() == 0


def test_the_session_keeps_its_state_store(spark, tmp_path):
    source, _, _, run = _runs(spark, tmp_path)
    _arrive(spark, source, [1])
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    run("state")
    assert spark.conf.get(name, None) == before


def test_arrivals_come_in_more_files_as_they_grow(spark, tmp_path, monkeypatch):
    from hypograph.plans import other_queries as oq

    monkeypatch.setattr(oq, "_ARRIVAL_ROWS", 30)
    docs = spark.range(100).withColumnRenamed("id", "doc_id")
    assert oq._arrive(docs, str(tmp_path / "many"), 2) == 4
    assert oq._arrive(docs.limit(10), str(tmp_path / "few"), 2) == 2
    stored = spark.read.parquet(str(tmp_path / "many"))
    assert len(stored.inputFiles()) == 4 and stored.count() == 100
    sizes = [r["count"] for r in stored.groupBy("_metadata.file_name").count().collect()]
    assert max(sizes) <= 30
