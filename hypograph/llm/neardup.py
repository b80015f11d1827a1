"""Near-duplicate documents by b-bit MinHash.

One pass over the text gives each document its shingle count, a class key of its words, a packed signature of
the low bits of its minima, and band keys. Documents with the same words form a class; only one of each class
goes on. Members of a band bucket are paired with the bucket's first member, the packed signatures estimate
their similarity, and what may reach the threshold is confirmed on the full shingle sets. Where a bucket is not
in one component then, a second star is tried, and what is still outside is compared with the rest of its star
in blocks, so no link is lost to the stars; exact distances to the star's centre rule out many of those
comparisons by the triangle inequality of Jaccard distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import small_side, written
from ._arrays import SPACED, mix, shingles, slices
from ._stages import components

BANDS = 32
ROWS = 4
BITS = 4
#: Estimates under this are not confirmed. With 128 minima the estimate of a pair at 0.8 has a standard
#: deviation of 0.037, so a true link falls under it once in about 10**10 pairs.
ESTIMATE_FLOOR = 0.56
#: Links at less than this would be lost to the bands and to the floor.
LEAST_PERCENT = 80

#: Members of each side that a task compares at once.
BLOCK_ROWS = 128

_LANES = 64 // BITS
_WORDS = BANDS * ROWS // _LANES
_LANE_MASK = 0x1111111111111111

SIGNATURES = "doc_id long, n_shingles long, cls binary, sig array<long>, bands array<long>"


def _multipliers() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def minima(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of every permutation over the set, a few thousand shingles at a time."""
    low = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(small), 2048):
        np.minimum(low, (small[at : at + 2048, None] * factors).min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the (mixed) minima, sixteen of four bits to a long."""
    bits = (mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(_WORDS, _LANES)
    return (bits << (np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key per band, from the full minima; the band's number is part of it."""
    table = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + table[:, i])
    return key.view(np.int64)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _multipliers()
        for batch in batches:
            counts, keys, sigs, bands = [], [], [], []
            for first, end, texts in slices(batch.column("text"), SPACED):
                hashes = texts.hashes()
                for i in range(end - first):
                    low, high = texts.words[i], texts.words[i + 1]
                    raw = texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes()
                    keys.append(hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest())
                    own = np.unique(shingles(hashes[low:high], size))
                    counts.append(len(own))
                    if len(own):
                        least = minima(own, factors)
                        sigs.append(packed(least))
                        bands.append(band_keys(least))
                    else:
                        sigs.append(None)
                        bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(sigs, pa.list_(pa.int64())),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "cls", "sig", "bands"],
            )

    return run


def signatures(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, n_shingles, cls, sig, bands) per row; sig and bands are null where there are no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_signatures(size), SIGNATURES)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for lanes that agree by chance.

    Lanes that differ are counted as bits: xor, fold each lane onto its lowest bit, count.
    """
    differ = F.lit(0)
    for i in range(_WORDS):
        x = a[i].bitwiseXOR(b[i])
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(_LANE_MASK)))
    chance = 1.0 / (1 << BITS)
    return (1.0 - differ / F.lit(float(BANDS * ROWS)) - chance) / (1.0 - chance)


def _set_of(raw: bytes, size: int) -> set:
    words = raw.lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def _confirm(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kept_set = None, set()
        for batch in batches:
            both, sizes_a, sizes_b = [], [], []
            left, right = batch.column("text_a"), batch.column("text_b")
            for i in range(batch.num_rows):
                if (b := right[i].as_py()) != kept:
                    kept, kept_set = b, _set_of(b, size)
                own = _set_of(left[i].as_py(), size)
                both.append(len(own & kept_set))
                sizes_a.append(len(own))
                sizes_b.append(len(kept_set))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), *(pa.array(x, pa.int64()) for x in (both, sizes_a, sizes_b))],
                names=["a", "b", "both", "size_a", "size_b"],
            )

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, size: int = 4) -> DataFrame:
    """(a, b, both, size_a, size_b) of candidate pairs (a, b), counted on the full shingle sets.

    Only texts that a pair needs are shuffled. ``b`` is the side that many pairs share.
    """
    need, _ = small_side(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "utf-8").alias("text"))
    texts = texts.filter("text is not null").join(need, "doc_id", "left_semi").distinct()
    joined = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size), "a long, b long, both long, size_a long, size_b long")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text, any others).

    Words are what white space separates, A-Z lower-cased. A document's set holds its distinct shingles of
    ``size`` words, of fewer words the whole sequence. Sets that share at least ``percent`` of their union are
    linked; ``component_id`` is the least doc_id reachable over links. ``percent`` under 80 is an error.

    * Null or blank text: no shingles, no links, its own component, kept.
    * Rows that repeat an id are one node of the graph; each row is labelled by its own words.
    * Null doc_id: takes the component of documents with the same words, else null; kept if that is null.
    * An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"bands and estimate are made for links at {LEAST_PERCENT} percent and more")
    base = written(signatures(docs, size), "signatures")
    classes = base.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    members = base.join(classes, "cls", "left")
    firsts = written(
        members.filter("doc_id = rep").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "cls", "sig", "bands").dropDuplicates(["id", "cls"]), "firsts"
    )
    buckets = firsts.select("id", F.explode("bands").alias("key"))
    centres = buckets.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("members")).filter("members > 1").select("key", "centre")
    shared = written(buckets.join(centres, "key"), "buckets")

    sig = firsts.select("id", "n", "sig")
    star = shared.filter("id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    checked = written(confirmed(written(_estimated(star, sig, percent), "star"), docs, size), "confirmed")
    labels = written(components(checked.filter(_linked(percent)).select("a", "b")), "labels")

    # A second star around other members, where the first has left several components in a bucket.
    split = _placed(shared, labels).filter("apart")
    other = split.groupBy("key").agg(F.min_by("id", F.xxhash64("id")).alias("b"))
    again = split.join(other, "key").filter("id != b").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
    links = confirmed(written(_estimated(again, sig, percent), "star"), docs, size).filter(_linked(percent)).select("a", "b")
    labels = written(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "labels")

    rest = written(_outside(shared, sig, checked, labels, docs, size, percent), "rest")
    links = confirmed(rest, docs, size).filter(_linked(percent)).select("a", "b")
    merged = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    labelled = base.select("doc_id", "n_shingles", "cls").join(classes, "cls", "left").join(merged, F.col("rep") == F.col("node"), "left")
    out = labelled.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("size_a") + F.col("size_b") - F.col("both"))


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _estimated(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and packed signatures allow a link."""
    left = sig.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = sig.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.filter(_sizes_fit("n_a", "n_b", percent)).filter(estimate(F.col("sig_a"), F.col("sig_b")) >= ESTIMATE_FLOOR).select("a", "b")


def _placed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket members with their component ``own``, and ``apart``: it is not that of the bucket's centre."""
    of = lambda name, out: labels.select(F.col("node").alias(name), F.col("component").alias(out))
    placed = shared.join(of("id", "own"), "id", "left").join(of("centre", "hub"), "centre", "left")
    placed = placed.withColumns({"own": F.coalesce("own", "id"), "hub": F.coalesce("hub", "centre")})
    return placed.withColumn("apart", F.col("own") != F.col("hub"))


def _hash_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, end, texts in slices(batch.column("text"), SPACED):
                hashes = texts.hashes()
                out += [np.unique(shingles(hashes[texts.words[i] : texts.words[i + 1]], size)).tobytes() for i in range(end - first)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "set"])

    return run


def _compare_block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        rows = {name: table.column(name).to_pylist() for name in ("id", "own", "apart", "far", "n", "set")}
        sig = np.array(table.column("sig").to_pylist(), dtype=np.int64).view(np.uint64)
        side = np.array(table.column("left").to_pylist(), dtype=bool)
        own, n, ids, apart = (np.array(rows[x]) for x in ("own", "n", "id", "apart"))
        far = np.array([np.nan if x is None else x for x in rows["far"]])
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["set"]]
        right, found = np.flatnonzero(~side), []
        chance = 1.0 / (1 << BITS)
        for y in np.flatnonzero(side).tolist():
            x = sig[right] ^ sig[y]
            for shift in (1, 2):
                x |= x >> np.uint64(shift)
            differ = np.bitwise_count(x & np.uint64(_LANE_MASK)).sum(axis=1)
            likely = (1.0 - differ / (BANDS * ROWS) - chance) / (1.0 - chance) >= ESTIMATE_FLOOR
            likely &= (own[right] != own[y]) & (100 * np.minimum(n[right], n[y]) >= percent * np.maximum(n[right], n[y]))
            # Distances to the centre that differ by more than a link allows rule the link out.
            likely &= ~(np.abs(far[right] - far[y]) > 1 - percent / 100 + 1e-9)
            # Of two members outside the centre's component the pair is met twice.
            likely &= ~apart[right] | (ids[right] > ids[y])
            for z in right[likely].tolist():
                at = np.minimum(np.searchsorted(sets[z], sets[y]), len(sets[z]) - 1)
                both = int((sets[z][at] == sets[y]).sum())
                if 100 * both >= percent * (len(sets[y]) + len(sets[z]) - both):
                    found.append((max(rows["id"][y], rows["id"][z]), min(rows["id"][y], rows["id"][z])))
        return pa.table([pa.array([p[i] for p in found], pa.int64()) for i in range(2)], names=["a", "b"])

    return run


def _outside(shared: DataFrame, sig: DataFrame, checked: DataFrame, labels: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) by hashed sets between members of a centre's buckets that are still in different components.

    Members outside the centre's component are met with all others of the centre, in blocks of at most twice
    ``BLOCK_ROWS`` sets a task: no table of pairs is made, and no task holds a whole group.
    """
    known = checked.select(
        F.col("a").alias("id"), F.col("b").alias("centre"), (1 - F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))).alias("far")
    )
    placed = written(_placed(shared, labels).filter("id != centre").select("centre", "id", "own", "apart").distinct(), "placed")
    counts = placed.groupBy("centre").agg(F.count("*").alias("n_all"), F.count_if("apart").alias("n_apart")).filter("n_apart > 0 and n_all > 1")
    chunks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    sized = counts.select("centre", chunks("n_all").alias("rights"), chunks("n_apart").alias("lefts"))
    members = placed.join(sized, "centre").join(known, ["id", "centre"], "left").join(sig, "id")
    need, _ = small_side(members.select("id").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    sets = texts.join(need, "id", "left_semi").mapInArrow(_hash_sets(size), "id long, set binary")
    members = members.join(sets, "id")
    own_chunk = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    block = lambda l, r, left: F.struct(l.alias("l"), r.alias("r"), F.lit(left).alias("left"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda l: block(l, own_chunk("rights"), False))
    as_left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda r: block(own_chunk("lefts"), r, True))
    placed_rows = members.withColumn("block", F.explode(F.when(F.col("apart"), F.concat(as_right, as_left)).otherwise(as_right)))
    rows = placed_rows.select("centre", "block.*", "id", "own", "apart", "far", "n", "sig", "set")
    return rows.groupBy("centre", "l", "r").applyInArrow(_compare_block(percent), "a long, b long").distinct()


def firsts_of_groups(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near`` (of ``near_duplicates``) keeps; same columns, one row of each group.

    Of rows that repeat an id and a text one stays; an id is dropped only if none of its rows is kept. Rows
    without an id stay. Only the ids that go are joined, so the text is shuffled only if those are many.
    """
    ids = written(near.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "kept")
    gone, _ = small_side(ids.filter("not kept").select("doc_id"))
    twice, _ = small_side(ids.filter("kept and n > 1").select("doc_id"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"))
    once = rows.join(gone, "doc_id", "left_anti").join(twice, "doc_id", "left_anti")
    again = rows.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "hash"])
    return once.select("row.*").unionByName(again.select("row.*"))
