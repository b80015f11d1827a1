"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one or two words skipped, hashed into
``2 ** BITS`` coordinates; each counts once. The fit keeps a learning rate per coordinate and L1 sets most
weights to exactly zero, so what is left is small enough to broadcast whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sizing import written
from ._arrays import ALPHANUMERIC, mix, slices

BITS = 20
#: Labelled documents that a fit uses at most, the first by a hash of their id; all of them where there are fewer.
TRAIN_DOCS = 20_000
#: Pairs of words this far apart are features besides single words: neighbours, and skip-grams.
GAPS = (1, 2, 3)


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.1
    epochs: int = 5


@dataclass(frozen=True)
class Model:
    bias: float
    index: np.ndarray
    weight: np.ndarray


def features(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text number, coordinate) arrays of all features of a slice, repeats included."""
    hashes = texts.hashes()
    owner = np.repeat(np.arange(len(texts.words) - 1), np.diff(texts.words))
    mask = np.uint64((1 << BITS) - 1)
    out = [(owner, (mix(hashes) & mask).astype(np.int64))]
    for gap in GAPS:
        if len(hashes) > gap:
            same = owner[:-gap] == owner[gap:]
            pair = mix(hashes[:-gap] * np.uint64(0xD6E8FEB86659FD93) + hashes[gap:] + np.uint64(gap))
            out.append((owner[:-gap][same], (pair[same] & mask).astype(np.int64)))
    return out


def coordinates(column: pa.Array) -> list[np.ndarray]:
    """The distinct coordinates of every text of an Arrow column."""
    out = []
    for first, end, texts in slices(column, ALPHANUMERIC):
        parts = features(texts)
        owner, index = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        keys = np.unique(owner << BITS | index)
        cuts = np.searchsorted(keys, np.arange(end - first + 1) << BITS)
        out += [(keys[a:b] & ((1 << BITS) - 1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def train(examples: list[tuple[np.ndarray, int]], ftrl: Ftrl = Ftrl()) -> Model:
    """One pass per epoch in the order given. Without examples all weights are zero."""
    positive = sum(y for _, y in examples)
    bias = float(np.log((positive + 0.5) / (len(examples) - positive + 1.5)))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    start = bias
    for _ in range(ftrl.epochs):
        for index, y in examples:
            zi, ni = z[index], n[index]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= ftrl.l1, 0.0, (np.sign(zi) * ftrl.l1 - zi) / ((ftrl.beta + root) / ftrl.alpha + ftrl.l2))
            g = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            z[index] = zi + g - (np.sqrt(ni + g * g) - root) / ftrl.alpha * w
            n[index] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ftrl.alpha * (bias - start)
            bias_n += g * g
            bias = start - bias_z / ((ftrl.beta + np.sqrt(bias_n)) / ftrl.alpha)
    index = np.flatnonzero(np.abs(z) > ftrl.l1)
    weight = (np.sign(z[index]) * ftrl.l1 - z[index]) / ((ftrl.beta + np.sqrt(n[index])) / ftrl.alpha + ftrl.l2)
    return Model(bias, index, weight)


def training_rows(docs: DataFrame, labels: DataFrame, eligible: Column, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(order, text, label) of at most ``train_docs`` labelled documents.

    Of labels that disagree the higher counts; of texts that share an id the one with the least hash is taken.
    """
    known = labels.filter("toxic is not null").filter(F.coalesce(eligible, F.lit(False)))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("label")).filter("doc_id is not null")
    # Bounded by ``train_docs`` rows of three numbers.
    chosen = F.broadcast(known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(train_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Texts of one id are told apart by their hashes, so the same one is taken on every run.
    found = written(texts.join(chosen, "doc_id").withColumn("hash", F.struct(F.xxhash64("text"), F.sha1(F.encode(F.coalesce("text", F.lit("")), "utf-8")))), "training")
    least = F.broadcast(found.groupBy(F.col("doc_id").alias("id")).agg(F.min("hash").alias("least")))
    taken = found.join(least, (F.col("doc_id") == F.col("id")) & (F.col("hash") == F.col("least")))
    return taken.dropDuplicates(["doc_id"]).select("order", "text", "label")


def fit(training: DataFrame, ftrl: Ftrl = Ftrl()) -> Model:
    """Fit on (order, text, label) rows, in that order, in one task: the caller bounds their number.

    Features are made in all tasks; only coordinates go to the fitting one.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = coordinates(batch.column("text"))
            index = pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("order"), index, batch.column("label")], names=["order", "index", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            examples += [(x.values.to_numpy(), y) for x, y in zip(batch.column("index"), batch.column("label").to_pylist(), strict=True)]
        model = train(examples, ftrl)
        index = np.concatenate(([-1], model.index))
        weight = np.concatenate(([model.bias], model.weight))
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(weight, pa.float64())], names=["index", "weight"])

    rows = training.mapInArrow(hashed, "order long, index array<int>, label int").repartition(1).sortWithinPartitions("order")
    found = sorted(rows.mapInArrow(run, "index long, weight double").collect())  # at most 2 ** BITS + 1 numbers
    if not found:
        return train([], ftrl)
    return Model(found[0]["weight"], np.array([x["index"] for x in found[1:]], dtype=np.int64), np.array([x["weight"] for x in found[1:]]))


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """(row, score) per row of ``docs``: ``row`` holds the columns ``carry`` (all of them by default).

    Null and empty texts get the score of a text without features. An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("row"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.index, model.weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, index, weight = shared.value
        table = np.zeros(1 << BITS)
        table[index] = weight
        for batch in batches:
            out = []
            for first, end, texts in slices(batch.column("text"), ALPHANUMERIC):
                found = []
                for owner, at in features(texts):
                    used = np.flatnonzero(table[at])
                    found.append(owner[used] << BITS | at[used])
                keys = np.unique(np.concatenate(found))
                total = bias + np.bincount(keys >> BITS, weights=table[keys & ((1 << BITS) - 1)], minlength=end - first)
                out.append(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
