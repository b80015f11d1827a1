"""Benchmark decontamination by a broadcast hash set of test n-grams.

Each test item gives its windows of ``window`` consecutive normalised words (an item of fewer words is one
window). All windows of every document are looked up by hash; what is found is compared word by word. Hits are
word ranges, so a caller can report them, cut them out, or drop the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import ALPHANUMERIC, shingles, slices

WINDOW = 10
#: Benchmark text that one broadcast holds; a larger benchmark is scanned in blocks of about this size. With its
#: windows a block is about five times its text; a window of ten words has some sixty bytes.
BLOCK_BYTES = 8 * 1024 * 1024

_RANGES = T.ArrayType(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))


class Windows:
    """The windows of a block of test items as arrays: by length, their hashes in order, words and items.

    Words are kept once, in one run of bytes; a window is a range of it. So a window costs 24 bytes beside its
    share of the text, in the broadcast and in every worker.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.names = [name for name, _ in items]
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        plain, at = [], 0
        for row, end, texts in slices(pa.array([x for _, x in items], pa.string()), ALPHANUMERIC):
            words = texts.hashes()
            for i in range(row, end):
                low, high = texts.words[i - row], texts.words[i - row + 1]
                size = int(min(window, high - low))
                if not size:
                    continue
                lengths = texts.ends[low:high] - texts.starts[low:high]
                starts = at + np.cumsum(lengths + 1) - lengths - 1
                plain.append(texts.joined(low, high))
                at += len(plain[-1]) + 1
                own = shingles(words[low:high], size)
                parts.setdefault(size, []).append((own, starts[: len(own)], (starts + lengths)[size - 1 :], np.full(len(own), i)))
        self.text = b" ".join(plain)
        #: By length: hashes in order, where the words of each window begin and end, and its item's number.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, found in parts.items():
            hashes, first, last, item = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.by_length[size] = hashes[order], first[order].astype(np.int32), last[order].astype(np.int32), item[order].astype(np.int32)
        self._tables: dict[int, tuple[np.ndarray, np.uint64]] = {}

    def nbytes(self) -> int:
        """What a broadcast sends, but for the ids of the items."""
        return len(self.text) + sum(x.nbytes for arrays in self.by_length.values() for x in arrays)

    def tables(self) -> dict[int, tuple[np.ndarray, np.uint64]]:
        """A bit table per length that lets nearly all other windows pass at the cost of one look-up.

        Made once in each worker, which keeps the broadcast set for all its tasks.
        """
        if self._tables:
            return self._tables
        out = self._tables
        for size, (hashes, *_) in self.by_length.items():
            mask = np.uint64(min(1 << 24, max(1 << 16, 1 << int(len(hashes) * 32).bit_length())) - 1)
            table = np.zeros(int(mask) + 1, dtype=bool)
            table[(hashes & mask).astype(np.int64)] = True
            out[size] = table, mask
        return out

    def matches(self, size: int, low: int, high: int, words: bytes) -> set:
        """The ids of the items with this window, of those between two places in the order of hashes."""
        _, first, last, item = self.by_length[size]
        return {self.names[item[k]] for k in range(low, high) if self.text[first[k] : last[k]] == words}


def _hits(texts, windows: Windows, tables: dict) -> dict[int, tuple[list, set]]:
    """By text number: word ranges of the windows that occur, and their items."""
    found: dict[int, tuple[list, set]] = {}
    words = texts.hashes()
    for size, (sorted_hashes, *_) in windows.by_length.items():
        if len(words) < size:
            continue
        table, mask = tables[size]
        own = shingles(words, size)
        at = np.flatnonzero(table[(own & mask).astype(np.int64)])
        if not len(at):
            continue
        low, high = (np.searchsorted(sorted_hashes, own[at], side=x) for x in ("left", "right"))
        owner = np.searchsorted(texts.words, at, side="right") - 1
        whole = (low < high) & (at + size <= texts.words[owner + 1])
        for i, text, a, b in zip(*(x[whole].tolist() for x in (at, owner, low, high)), strict=True):
            if items := windows.matches(size, a, b, texts.joined(i, i + size)):
                ranges, names = found.setdefault(text, ([], set()))
                ranges.append((i - int(texts.words[text]), i - int(texts.words[text]) + size))
                names |= items
    return found


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def _scan_block(rows: DataFrame, items: list[tuple[str | None, str | None]], window: int, last: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Windows(items, window))
    ranges_type = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        tables = windows.tables()
        for batch in batches:
            n_words, n_hit, ranges, spans, names = [], [], [], [], []
            before, listed = batch.column("ranges").to_pylist(), batch.column("items").to_pylist()
            for first, end, texts in slices(batch.column("text"), ALPHANUMERIC):
                found = _hits(texts, windows, tables)
                for i in range(end - first):
                    own, items = found.get(i, ((), ()))
                    merged = _merged([(x["low"], x["high"]) for x in before[first + i]] + list(own))
                    base, start = int(texts.words[i]), int(texts.bounds[i])
                    n_words.append(int(texts.words[i + 1]) - base)
                    n_hit.append(sum(high - low for low, high in merged))
                    ranges.append([{"low": low, "high": high} for low, high in merged])
                    spans.append([{"low": int(texts.starts[base + a]) - start, "high": int(texts.ends[base + b - 1]) - start} for a, b in merged])
                    names.append(sorted({*listed[first + i], *(x for x in items if x is not None)}))
            columns = {"row": batch.column("row")} | ({} if last else {"text": batch.column("text")})
            columns |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64())}
            columns |= {"ranges": pa.array(ranges, ranges_type), "spans": pa.array(spans, ranges_type), "items": pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    text = [] if last else [T.StructField("text", T.StringType())]
    numbers = [T.StructField(x, T.LongType()) for x in ("n_words", "n_hit")]
    lists = [T.StructField("ranges", _RANGES), T.StructField("spans", _RANGES), T.StructField("items", T.ArrayType(T.StringType()))]
    return rows.select("row", "text", "ranges", "items").mapInArrow(run, T.StructType([rows.schema["row"], *text, *numbers, *lists]))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_words, n_hit, ranges, spans, items) per row of ``docs``.

    ``row`` holds the columns ``carry`` (all by default; any names). ``ranges`` are runs of hit words, ``spans``
    the same as byte offsets in the UTF-8 text, ``items`` the sorted ids (as strings) of items with a window in
    the text. The benchmark is measured: beyond ``block_bytes`` it is scanned in several blocks, each broadcast
    alone, with the same result.

    Null text has no words; null or blank items have no windows; an item without an id counts as a hit but is
    not listed. Repeated rows are judged each. Empty tables give empty results, or rows without hits.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("row"),
        F.col("text").cast("string").alias("text"),
        F.array().cast(_RANGES).alias("ranges"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = _scan_block(rows, [tuple(x) for x in own.collect()], window, block == blocks - 1)
    return rows


def removed(scanned: DataFrame) -> DataFrame:
    """The rows of ``scan`` with every hit cut out of ``row.text``: the columns of ``row``.

    A cut leaves a line end.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, at, parts = (text or "").encode(), 0, []
                for span in spans:
                    parts.append(raw[at : span["low"]])
                    at = span["high"]
                out.append(b"\n".join([*parts, raw[at:]]).decode() if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    fields = scanned.schema["row"].dataType
    rows = scanned.select("row", F.col("row.text").alias("text"), "spans").mapInArrow(
        cut, T.StructType([scanned.schema["row"], T.StructField("text", T.StringType())])
    )
    return rows.select(*[F.col("text") if f.name == "text" else F.col(f"row.`{f.name}`").alias(f.name) for f in fields])


def clean(scanned: DataFrame) -> DataFrame:
    """The rows of ``scan`` without a hit: the columns of ``row``."""
    return scanned.filter("n_hit = 0").select("row.*")
