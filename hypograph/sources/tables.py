"""Delimited, JSON, text and Parquet sources and sinks of curated data and results."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_of_epoch
from ..schemas import PAIR_CSV

# Fixed values: (code, left column, right column, reference column) of the curated tables, and widths.
FACT_COLUMNS = {"chemical_gene": (1, 0, 3, 10), "gene_disease": (2, 0, 2, 8), "chemical_disease": (3, 0, 3, 9)}
FACT_WIDTH = {"chemical_gene": 11, "gene_disease": 9, "chemical_disease": 10}
PATHWAY_COLUMNS = (0, 2, 4)
INTERACTION_COLUMNS = (0, 1, 4, 5, 8)


def read_delimited(spark: SparkSession, path: str, width: int, sep: str = ",", comment: str | None = "#") -> DataFrame:
    """Headerless delimited text as string columns c0, c1, ...; quotes may hold the separator."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    reader = spark.read.schema(schema).option("sep", sep).option("quote", '"').option("escape", '"')
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def read_facts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """facts(code, l, r, refs) of one curated table; an empty reference list gives an empty array."""
    code, left, right, refs = FACT_COLUMNS[kind]
    raw = read_delimited(spark, path, FACT_WIDTH[kind])
    return raw.select(
        F.lit(code).alias("code"),
        F.col(f"c{left}").alias("l"),
        F.col(f"c{right}").alias("r"),
        F.filter(F.split(F.coalesce(f"c{refs}", F.lit("")), r"\|"), lambda x: x != "").alias("refs"),
    )


def read_pathways(spark: SparkSession, path: str, width: int = 5, code: int = 4) -> DataFrame:
    """Gene-gene facts, tab separated; references split at bars or semicolons."""
    left, right, refs = PATHWAY_COLUMNS
    raw = read_delimited(spark, path, width, sep="\t")
    return raw.select(
        F.lit(code).alias("code"),
        F.col(f"c{left}").alias("l"),
        F.col(f"c{right}").alias("r"),
        F.filter(F.split(F.coalesce(f"c{refs}", F.lit("")), "[|;]"), lambda x: x != "").alias("refs"),
    )


def read_interactions(spark: SparkSession, path: str, width: int = 9) -> DataFrame:
    from ..operators.interactions import reference_id

    raw = read_delimited(spark, path, width, sep="\t")
    a, b, alt_a, alt_b, refs = [F.col(f"c{i}") for i in INTERACTION_COLUMNS]
    return raw.select(
        a.alias("a"), b.alias("b"), alt_a.alias("alt_a"), alt_b.alias("alt_b"), reference_id(refs).alias("pmid")
    )


def read_kinase_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated: columns 1 and 2 are names, column 3 a semicolon list -> (term)."""
    raw = read_delimited(spark, path, 4, sep=" ", comment=None)
    listed = F.transform(F.split(F.coalesce("c3", F.lit("")), ";"), lambda x: F.lower(x))
    return raw.select(F.explode(F.concat(F.array("c1", "c2"), listed)).alias("term")).filter(
        F.col("term").isNotNull() & (F.col("term") != "")
    )


def read_gene_protein(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Objects with optional ``Genes`` and ``Proteins`` maps -> (kind, key, synonym).

    One JSON array per file, or with ``multi_line=False`` one object per line, which can be split.
    """
    schema = "Genes map<string,array<string>>, Proteins map<string,array<string>>"
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    kinds = F.array(
        F.struct(F.lit("gene").alias("kind"), F.col("Genes").alias("names")),
        F.struct(F.lit("protein").alias("kind"), F.col("Proteins").alias("names")),
    )
    return (
        raw.select(F.explode(kinds).alias("k"))
        .select("k.kind", F.explode("k.names").alias("key", "synonyms"))
        .select("kind", "key", F.explode("synonyms").alias("synonym"))
    )


def read_term_list(spark: SparkSession, path: str) -> DataFrame:
    """A plain JSON array of strings -> (term)."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "array<string>")).alias("term"))


def read_term_list_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of strings per line -> (term): the form a large list is written in."""
    return spark.read.text(path).select(F.explode(F.from_json("value", "array<string>")).alias("term"))


def read_gene_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """Canonical name and a quoted comma list -> (synonym, canonical), lower-cased."""
    raw = read_delimited(spark, path, 2, comment=None).filter(F.col("c1").isNotNull())
    return raw.select(
        F.explode(F.transform(F.split("c1", ","), lambda s: F.lower(F.trim(s)))).alias("synonym"),
        F.lower("c0").alias("canonical"),
    )


def read_triples(spark: SparkSession, *paths: str) -> DataFrame:
    """Line-based RDF (``<s> <p> <o> .``) -> (s, p, o); literals keep their quotes, language tag or type.

    Comments and other lines are dropped.
    """
    return parse_triples(spark.read.text(list(paths)))


def parse_triples(lines: DataFrame, value: str = "value") -> DataFrame:
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*$'
    part = {name: F.regexp_extract(value, pattern, i) for i, name in enumerate(("s", "p", "o"), start=1)}
    return lines.select(*[c.alias(name) for name, c in part.items()]).filter(F.col("s") != "")


def save_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def pair_csv_rows(pairs: DataFrame) -> DataFrame:
    """Annotated pairs in the eleven-column layout with a readable date."""
    text = F.when(F.col("pub_ts").isNotNull(), F.date_format(date_of_epoch(F.col("pub_ts")), "dd-MM-yyyy"))
    return pairs.withColumn("date_text", text).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in PAIR_CSV.fields]
    )


def write_pair_csv(pairs: DataFrame, path: str, single_file: bool = False) -> None:
    """``single_file`` is meant for small results only; a corpus stays in many parts."""
    rows = pair_csv_rows(pairs)
    if single_file:
        rows = rows.coalesce(1)
    rows.write.mode("overwrite").option("header", True).option("nullValue", "None").option("escape", '"').csv(path)


def read_pair_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(PAIR_CSV)
        .option("header", True)
        .option("nullValue", "None")
        .option("comment", "#")
        .option("escape", '"')
        .csv(path)
    )


def write_split(pairs: DataFrame, path: str) -> None:
    """JSON lines in ``split=train`` and ``split=test``."""
    pairs.write.mode("overwrite").partitionBy("split").json(path)


def read_feature_vectors(spark: SparkSession, glob: str, width: int) -> DataFrame:
    """Feature CSV parts; the two entities are columns 1 and 2."""
    raw = read_delimited(spark, glob, width, comment=None)
    return raw.withColumns({"a": F.lower("c1"), "b": F.lower("c2")})


def write_feature_vectors(rows: DataFrame, path: str) -> None:
    rows.drop("a", "b").write.mode("overwrite").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str, *partition_by: str) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def fingerprint(inputs: list[DataFrame], params: tuple = ()) -> str:
    """A digest of the rows of all inputs (their order and files do not matter), their schemas and the parameters.

    One pass over each input; what reaches the driver is a count and a sum.
    """
    seen = []
    for df in inputs:
        rows = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
        again = F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
        seen.append((df.schema.simpleString(), *df.agg(F.count("*"), F.sum(rows), F.sum(again)).first()))
    return hashlib.sha256(repr((seen, params)).encode()).hexdigest()[:32]


def _publish(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Write a table so that it is there as a whole or not at all; of two writers at once the first one counts."""
    parent, _, name = path.rstrip("/").rpartition("/")
    draft = f"{parent}/_draft-{name}-{uuid.uuid4().hex}"
    write_table(rows, draft)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    source, target = hadoop_path(draft), hadoop_path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target) and not path_exists(spark, f"{path}/_SUCCESS"):
        files.delete(target, True)  # left by a writer that broke off
    # A rename onto a folder that another writer made meanwhile fails, or ends inside it under a name that readers pass over.
    if files.exists(target) or not files.rename(source, target):
        files.delete(source, True)


def read_or_build(spark: SparkSession, path: str, build, inputs: list[DataFrame] | None = None, params: tuple = ()) -> DataFrame:
    """A stored table if it is there, else the table that ``build()`` gives, written first.

    With ``inputs``, ``path`` holds one table for each content of the inputs and the parameters, in a folder named by
    their fingerprint: other rows are another table, and a stored one is never taken for them.
    """
    folder = path if inputs is None else f"{path.rstrip('/')}/{fingerprint(inputs, params)}"
    if not path_exists(spark, f"{folder}/_SUCCESS"):
        _publish(spark, build(), folder)
    return spark.read.parquet(folder)
