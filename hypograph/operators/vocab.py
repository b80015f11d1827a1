"""Vocabularies: ``vocab(cat, term)`` with categories A, B and C."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("A", "B", "C")

# Words excluded from term lists, per stage.
STOP_TERMS = {"A": ["was", "for", "large", "apotosis"], "B": ["was", "for", "large"], "C": ["was", "for", "large"]}
STOP_CLEAN = ["was", "for"]
STOP_EVALUATION = ["for", "was", "she", "long"]
STOP_EQUIVALENCE = ["for", "was", "long", "her"]
STOP_KINASES = [
    "for",
    "gene",
    "complete",
    "unsuitable",
    "unambiguous",
    "met",
    "kit",
    "name",
    "yes",
    "fast",
    "fused",
    "top",
    "cuts",
    "fragment",
    "kind",
    "factor",
    "p53",
]

# Tree number prefixes of proteins, chemicals and diseases.
PROTEIN_TREE, CHEMICAL_TREE, DISEASE_TREE = "D12", "D", "C"


def clean_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """Lower-cased distinct terms; without hyphens longer than 2 and not all digits."""
    bare = F.replace(F.col(term), F.lit("-"), F.lit(""))
    kept = terms.filter(
        (F.length(bare) > 2) & ~bare.rlike("^[0-9]+$") & ~bare.isin(STOP_CLEAN)
    )
    return kept.withColumn(term, F.lower(term)).distinct()


def drop_stop_terms(vocab: DataFrame) -> DataFrame:
    """Remove the stop terms of each category."""
    stopped = reduce(
        lambda a, b: a | b,
        [(F.col("cat") == cat) & F.col("term").isin(words) for cat, words in STOP_TERMS.items()],
    )
    return vocab.filter(~stopped)


def tree_category(tree: str = "tree"):
    """Category of one tree number; NULL outside the three branches."""
    return (
        F.when(F.col(tree).startswith(PROTEIN_TREE), "B")
        .when(F.col(tree).startswith(CHEMICAL_TREE), "A")
        .when(F.col(tree).startswith(DISEASE_TREE), "C")
    )


def classify_trees(descriptors: DataFrame) -> DataFrame:
    """(name, trees ARRAY) to vocab; a term may enter several lists."""
    flat = descriptors.select(F.lower(F.trim("name")).alias("term"), F.explode("trees").alias("tree"))
    return flat.select(tree_category().alias("cat"), "term").filter("cat is not null").distinct()


def classify_first_tree(descriptors: DataFrame) -> DataFrame:
    """One list per term: that of its first tree number inside the three branches.

    Decided inside the descriptor's row, since its tree numbers are an array there.
    """
    cats = F.filter(
        F.transform(
            F.col("trees"),
            lambda t: F.when(t.startswith(PROTEIN_TREE), "B")
            .when(t.startswith(CHEMICAL_TREE), "A")
            .when(t.startswith(DISEASE_TREE), "C"),
        ),
        lambda c: c.isNotNull(),
    )
    return (
        descriptors.select(F.get(cats, 0).alias("cat"), F.lower(F.trim("name")).alias("term"))
        .filter("cat is not null")
        .distinct()
    )


def subtract_category(vocab: DataFrame, cat: str = "B", other: str = "C") -> DataFrame:
    """Remove from ``cat`` every term that ``other`` has too, in one grouping by term."""
    lists = vocab.groupBy("term").agg(*[F.bool_or(F.col("cat") == c).alias(c) for c in CATEGORIES])
    stays = {c: F.col(c) & ~F.col(other) if c == cat else F.col(c) for c in CATEGORIES}
    cats = F.filter(F.array(*[F.when(keep, F.lit(c)) for c, keep in stays.items()]), lambda c: c.isNotNull())
    return lists.select(F.explode(cats).alias("cat"), "term")


def extend_vocabulary(vocab: DataFrame, facts: DataFrame) -> DataFrame:
    """Add the terms of curated facts: A + AB.l; B + AB.r + BC.l; C + AC.r + BC.r, without stop terms."""
    # Fixed values: (fact code, side, category).
    roles = [(1, "l", "A"), (1, "r", "B"), (2, "l", "B"), (2, "r", "C"), (3, "r", "C")]
    role_array = F.filter(
        F.array(
            *[
                F.when(F.col("code") == code, F.struct(F.lit(cat).alias("cat"), F.col(side).alias("term")))
                for code, side, cat in roles
            ]
        ),
        lambda x: x.isNotNull(),
    )
    from_facts = facts.select(F.explode(role_array).alias("x")).select("x.cat", "x.term")
    return drop_stop_terms(vocab.select("cat", "term").unionByName(clean_terms(from_facts))).distinct()


def union_terms(*sources: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Lower-cased distinct terms of several one-column sources without stop words and NULLs."""
    merged = reduce(DataFrame.unionByName, [s.select(F.lower(F.col(s.columns[0])).alias("term")) for s in sources])
    return merged.filter(F.col("term").isNotNull() & ~F.col("term").isin(stop or [])).distinct()
