"""Language by rank-order profiles: the most frequent n-grams of a text against those of each language.

A profile lists the ``PROFILE`` most frequent letter n-grams (one to three letters, words padded with one
blank) in order. The distance of a text to a language is the sum, over the n-grams of the text's own profile,
of how many places the n-gram is out of place in the language's; an n-gram that the language lacks counts
``PROFILE`` places. The nearest language wins, ties go to the first by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import pieces

PROFILE = 300
#: Documents of each language that a fit uses at most; all of them where there are fewer.
TRAIN_DOCS = 3000
UNDETERMINED = "und"

_PIECE = 1 << 20
_BLANK = 32


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _padded(text: str) -> np.ndarray:
    """Letters in lower case, every run of other characters one blank, a blank at both ends; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(_letters()[points], points, _BLANK)
    if not len(points) or not (points != _BLANK).any():
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate(([_BLANK], points, [_BLANK])).astype(np.uint64)
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != _BLANK) | (padded[:-1] != _BLANK)
    return padded[keep]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of all n-grams of the whole text, and their counts; long texts are counted in pieces."""
    c = _padded(text)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(c), _PIECE):
        one = c[at : at + _PIECE]
        two, three = c[at + 1 : at + 1 + len(one)], c[at + 2 : at + 2 + len(one)]
        pairs = one[: len(two)] | two << np.uint64(21)
        triples = (pairs[: len(three)] | three << np.uint64(42))[two[: len(three)] != _BLANK]
        found.append(np.unique(np.concatenate((one[one != _BLANK], pairs, triples)), return_counts=True))
    if not found:
        return c, np.zeros(0, dtype=np.int64)
    if len(found) == 1:
        return found[0]
    codes, place = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return codes, np.bincount(place, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def _top(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent codes in order; equal counts by code."""
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language, summed over pieces of each batch before they leave the task."""
    for batch in (x for whole in batches for x in pieces(whole, whole.column("text"), limit=_PIECE)):
        sums: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            sums.setdefault(lang, []).append(ngram_counts(text or ""))
        for lang, found in sums.items():
            codes, place = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64), pa.int64()), pa.array(counts, pa.int64())],
                names=["lang", "code", "n"],
            )


def _last_orders(rows: DataFrame, n: int) -> DataFrame:
    """(lang, last): the n-th least ``order`` of each language, or the greatest possible where there are fewer.

    Sixteen bits of the order a round: rows of each language are counted by the next bits, among those that have
    the bits found so far, until the n-th is one value. Counts are summed before they are shuffled, so a
    language with nearly all rows costs a task 65,536 numbers at most; the driver keeps two numbers a language.
    """
    place = F.col("order").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order of the signed number
    bits = lambda depth: F.shiftrightunsigned(place, 64 - 16 * depth)
    found: dict[str, tuple[int, int]] | None = None
    for depth in range(1, 5):
        counts = rows
        if found is not None:
            state = F.broadcast(rows.sparkSession.createDataFrame([(k, v) for k, (v, _) in found.items()], "lang string, prefix long"))
            counts = rows.join(state, "lang").filter(bits(depth - 1) == F.col("prefix"))
        counts = counts.groupBy("lang", bits(depth).alias("bits")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("lang").orderBy("bits"))
        below = F.lit(0)
        if found is not None:
            below = F.broadcast(rows.sparkSession.createDataFrame([(k, b) for k, (_, b) in found.items()], "lang string, below long"))
            counts, below = counts.join(below, "lang"), F.col("below")
        upto = counts.withColumn("upto", upto + below).filter((F.col("upto") >= n) & (F.col("upto") - F.col("n") < n))
        found = {r["lang"]: (r["bits"], r["upto"] - r["n"]) for r in upto.collect()}
        if not found:
            break
    signed = lambda x: (x ^ (1 << 63)) - (1 << 64) if (x ^ (1 << 63)) >> 63 else x ^ (1 << 63)
    last = [(k, signed(v & (1 << 64) - 1)) for k, (v, _) in (found or {}).items()]
    return rows.sparkSession.createDataFrame(last, "lang string, last long")


def training_rows(docs: DataFrame, eligible: Column, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(lang, text) of the ``train_docs`` rows of each language that come first by a hash of their id.

    Rows with the hash of the last one are all taken.
    """
    rows = docs.select(
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("doc_id").cast("string")).alias("order"),
        F.coalesce(eligible, F.lit(False)).alias("eligible"),
    ).filter("eligible and lang is not null")
    last = _last_orders(rows.select("lang", "order"), train_docs)
    return rows.join(F.broadcast(last), "lang", "left").filter(F.col("last").isNull() | (F.col("order") <= F.col("last"))).select("lang", "text")


def fit_profiles(training: DataFrame) -> dict[str, np.ndarray]:
    """The profile of each language, from (lang, text) rows. Its size is languages x PROFILE."""
    counts = training.mapInArrow(_count_batches, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("nth", nth).filter(F.col("nth") <= PROFILE).select("lang", "nth", "code").collect()
    profiles: dict[str, list] = {}
    for row in sorted(top):
        profiles.setdefault(row["lang"], []).append(row["code"])
    return {lang: np.array(codes, dtype=np.int64).view(np.uint64) for lang, codes in sorted(profiles.items())}


class Ranker:
    """Distances of texts to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.codes = np.unique(np.concatenate([profiles[x] for x in self.names])) if profiles else np.zeros(0, dtype=np.uint64)
        self.ranks = np.full((len(self.names), len(self.codes)), PROFILE, dtype=np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.codes, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngram_counts(text or "")
        if not len(codes) or not len(self.codes):
            return UNDETERMINED, 0.0
        top = _top(codes, counts)
        place = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        known = np.flatnonzero(self.codes[place] == top)
        far = np.abs(self.ranks[:, place[known]] - known)
        # Lacking n-grams have rank PROFILE here, which may be fewer than PROFILE places away.
        far[self.ranks[:, place[known]] == PROFILE] = PROFILE
        total = far.sum(axis=1) + PROFILE * (len(top) - len(known))
        best = int(np.argmin(total))
        return self.names[best], float(1.0 - total[best] / (PROFILE * len(top)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], carry: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score) per row of ``docs``: ``row`` holds the columns ``carry`` (all of them by default).

    Only ``text`` decides. ``lang_pred`` is ``und`` with score 0 for null texts, texts without a letter, and
    where nothing was learned. Carried columns may have any names. An empty table gives an empty result.
    """
    carry = carry or docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    # A text that is carried is sent once.
    inside = carry.index("text") if "text" in carry and isinstance(docs.schema["text"].dataType, T.StringType) else None
    rows = docs.select(row) if inside is not None else docs.select(row, F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast({name: codes.tolist() for name, codes in profiles.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker({name: np.array(codes, dtype=np.uint64) for name, codes in shared.value.items()})
        text_of = lambda batch: batch.column("text") if inside is None else batch.column("row").field(inside)
        for batch in (x for whole in batches for x in pieces(whole, text_of(whole))):
            found = [ranker.predict(x) for x in text_of(batch).to_pylist()]
            names, scores = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), names, scores], names=["row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)
