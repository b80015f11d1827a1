"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

A fingerprint has a bit for each of the 64 bits of the shingle hashes, set if more than half of the shingles set
it. Fingerprints that differ in at most ``DISTANCE`` bits are linked. Their 64 bits are split into ``BLOCKS``
blocks; a difference in two bits touches two blocks at most, so linked fingerprints agree in all blocks of one
choice of three. Each choice is a join key of 38 bits and more.

Equal fingerprints are one node, so copies cost nothing. Buckets of a key with few fingerprints are compared
pair by pair. In larger ones the bits outside the key decide: two fingerprints are linked if and only if each is
at most one bit from some value in the middle, so every member is listed under itself and under its neighbours at
one bit, and those listed under one value are all linked. That is at most 27 rows a member, whatever the size of
the bucket, and a group of such rows has at most 27 members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import keyed_join, written
from ._stages import components

BITS = 64
#: Bits in which linked fingerprints may differ.
DISTANCE = 2
BLOCKS = 5
#: Members of a bucket that are compared pair by pair.
FEW = 8
SEED = 42

_SPLIT_BYTES = 1 << 20
_CHUNK = 1 << 13


def _block_masks() -> list[int]:
    """The bits of each block as a mask; blocks are as long as each other, but for one bit."""
    cuts = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: For each key: the mask of its blocks, and the single bits outside.
KEYS = [(_signed(mask), [_signed(1 << i) for i in range(BITS) if not mask >> i & 1]) for mask in (sum(c) for c in combinations(_block_masks(), BLOCKS - DISTANCE))]


def fingerprint(text: bytes, size: int) -> int:
    """The fingerprint of a UTF-8 text; 0 without words. Only a part of a long text's hashes is held at once."""
    plain = b" ".join(text.lower().split())
    if not plain:
        return 0
    blanks = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 0x20)
    starts, ends = np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(plain)]))
    size = min(size, len(starts))
    starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        low, high = starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist()
        hashes = np.array([digest(plain[a:b], SEED) for a, b in zip(low, high, strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > len(starts)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", size) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) per row, fp as a long. Words are what white space separates, A-Z lower-cased."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(size), "doc_id long, fp long")


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` of ``nodes`` (distinct) that differ in at most two bits.

    Not every linked pair is listed, but a path of links joins the two of each. ``a`` is above ``b``.
    """
    fp = F.col("fp")
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("bits")) for i, (mask, _) in enumerate(KEYS)])
    placed = nodes.select("fp", F.explode(keys).alias("key")).select("fp", "key.*")
    sizes = placed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = written(keyed_join(placed, sizes, ["choice", "bits"]), "buckets")

    few = buckets.filter(F.col("n") <= FEW)
    left, right = (few.select("choice", "bits", F.col("fp").alias(x)) for x in ("a", "b"))
    pairs = left.join(right, ["choice", "bits"]).filter("a > b").select("a", "b")

    flips = F.lit(None)
    for i, (_, free) in enumerate(KEYS):
        flips = F.when(F.col("choice") == i, F.lit([0, *free]).cast("array<bigint>")).otherwise(flips)
    middle = buckets.filter(F.col("n") > FEW).select("choice", "fp", F.explode(F.transform(flips, lambda bit: fp.bitwiseXOR(bit))).alias("middle"))
    # The value in the middle has the bits of the bucket's key, so it names the bucket as well.
    first = middle.groupBy("choice", "middle").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
    stars = first.select(F.explode("members").alias("a"), "b").filter("a > b")
    return pairs.unionByName(stars).filter(_differing("a", "b") <= DISTANCE).distinct()


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs`` (doc_id, text, any others).

    ``fingerprint`` is in 16 lower-case hexadecimal digits; ``component_id`` the least doc_id reachable over links
    of fingerprints that differ in at most two bits, the own one included.

    * Null or blank text: fingerprint zero, linked like any other. Fewer than ``size`` words: one shingle of all.
    * Repeated rows, and rows that repeat an id, are labelled each by its own text.
    * Null doc_id: such a row has a fingerprint and links, but names no component; its own is null if no other
      row in it has an id.
    * An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    base = written(fingerprints(docs, size), "fingerprints")
    nodes = written(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp")))
    placed = nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    labels = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = written(keyed_join(placed.select("fp", "component"), labels, ["component"]).select("fp", "component_id"), "labels")
    rows = keyed_join(base, of_fp, ["fp"])
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
