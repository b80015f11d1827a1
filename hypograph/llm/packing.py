"""Packing of token pieces into sequences: Martello-Toth dominance reduction, then best fit decreasing.

Lengths are integers from 1 to the capacity, so an instance of any size is a histogram of at most ``capacity``
counts. The plan is made on that histogram, whole classes of equal pieces at a time; pieces then find their
place by their rank among those of their length, all in parallel.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sizing import written
from ._arrays import Texts, byte_class, mix, slices

CAPACITY = 2048
#: Pieces that one task ranks; a length with more of them is split over several groups.
GROUP_ROWS = 200_000
#: Words whose ids a worker keeps; memory for them is bounded, results do not depend on it.
CACHED_WORDS = 500_000
#: Text that a worker cuts into words at once.
TEXT_BYTES = 1 << 20

def _byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as: printable Latin-1 ones stay, the others, in
    order, are those from U+0100 on."""
    stays = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in stays]
    return {b: chr(b if b in stays else 0x100 + others.index(b)) for b in range(256)}


_BYTE_CHARACTERS = _byte_characters()


#: White space at which texts are cut; the tokenizer cuts at any other by itself.
_BLANKS = byte_class([(0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D)])
#: Marks behind an ASCII letter are words of their own to the tokenizer, so they are cut off, up to this many.
_MARKS, _MOST_MARKS = byte_class([(0, 0x20), (0x22, 0x2B), (0x2D, 0x2D), (0x2F, 0x39), (0x3C, 0x3E), (0x40, 0xFF)]), 4
#: Words of up to this many bytes are told apart by two 64-bit numbers that hold their bytes.
_SHORT = 16
#: The first k of eight bytes.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def _cut_marks(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, by text, numbers of the words, with the marks ``,.!?;:`` behind an ASCII letter apart."""
    starts, ends = texts.starts, texts.ends
    stem = ends.copy()
    for _ in range(_MOST_MARKS):
        stem -= (stem > starts) & _MARKS[texts.data[np.maximum(stem - 1, 0)]]
    letter = texts.data[np.maximum(stem - 1, 0)]
    cut = np.flatnonzero((stem < ends) & (stem > starts) & (letter >= ord("a")) & (letter <= ord("z")))
    more = np.zeros(len(starts) + 1, dtype=np.int64)
    more[cut + 1] = 1
    first = ends.copy()
    first[cut] = stem[cut]
    return np.insert(starts, cut + 1, stem[cut]), np.insert(first, cut + 1, ends[cut]), texts.words + np.cumsum(more)[texts.words]


class _Rows:
    """Rows of numbers that grow at the end, in a buffer that doubles."""

    def __init__(self, width: int, dtype: str):
        self.buffer, self.n = np.zeros((width, 1 << 12), dtype=dtype), 0

    def add(self, rows: np.ndarray) -> None:
        need = self.n + rows.shape[1]
        if need > self.buffer.shape[1]:
            grown = np.zeros((len(self.buffer), max(need, 2 * self.buffer.shape[1])), dtype=self.buffer.dtype)
            grown[:, : self.n] = self.buffer[:, : self.n]
            self.buffer = grown
        self.buffer[:, self.n : need] = rows
        self.n = need


class WordTokenizer:
    """Ids of whole texts, word by word, from a tokenizer that never merges across white space.

    Words repeat a lot, so each is encoded once and its ids are kept. The words of a slice of text are found and
    told apart by array operations on its bytes: up to 16 of them are two numbers, and these, not a hash of them,
    decide which word it is. Longer words, and words whose hash another one has, are looked up by their bytes.
    A-Z are lower-cased first, as the tokenizer does later. A text that spells out a special token is encoded as
    a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.of_hash: dict[int, int] = {}
        self.of_bytes: dict[bytes, int] = {}
        #: Per known word: its two numbers, its bytes' count, where its ids begin, how many they are.
        self.known = _Rows(5, "u8")
        self.ids = _Rows(1, "<u4")

    def _learn(self, words: list[bytes], numbers: np.ndarray) -> np.ndarray:
        """Encode new words (with their numbers and sizes) and return their places among the known ones."""
        tokenize, found, other = self.tokenizer.model.tokenize, [None] * len(words), []
        for i, raw in enumerate(words):
            word = raw.decode("utf-8", "surrogatepass")
            lower = word.lower()
            if word.isalpha() and lower.isalpha() and max(word) < "\u0250":
                # Latin letters are one word for the tokenizer and stay as they are but for their case.
                found[i] = [x.id for x in tokenize(lower.encode().decode("latin-1").translate(_BYTE_CHARACTERS))]
            else:
                other.append((i, word))
        for (i, _), encoded in zip(other, self.tokenizer.encode_batch_fast([w for _, w in other], add_special_tokens=False), strict=True):
            found[i] = encoded.ids
        sizes = np.array([len(x) for x in found], dtype=np.uint64)
        begins, first = np.uint64(self.ids.n) + np.cumsum(sizes) - sizes, self.known.n
        self.known.add(np.vstack((numbers, begins, sizes)))
        self.ids.add(np.array([[x for ids in found for x in ids]], dtype="<u4"))
        return np.arange(first, first + len(words))

    def _by_bytes(self, words: list[bytes], numbers: np.ndarray) -> list[int]:
        new = {raw: j for j, raw in enumerate(words) if raw not in self.of_bytes}
        if new:
            places = self._learn(list(new), numbers[:, list(new.values())])
            self.of_bytes.update(zip(new, places.tolist(), strict=True))
        return [self.of_bytes[raw] for raw in words]

    def encode_words(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a slice as little-endian unsigned 32-bit numbers, and where each text's ids begin and end."""
        if self.known.n > CACHED_WORDS:
            self._clear()
        starts, ends, bounds = _cut_marks(texts)
        n = ends - starts
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(bounds), dtype=np.int64)
        padded = np.concatenate((texts.data, np.zeros(_SHORT + 8, dtype=np.uint8)))
        eight = np.ndarray((len(texts.data) + _SHORT,), dtype="<u8", buffer=padded, strides=(1,))
        low = eight[starts] & _FIRST[np.minimum(n, 8)]
        high = eight[starts + 8] & _FIRST[np.clip(n - 8, 0, 8)]
        numbers = np.vstack((low, high, n.astype(np.uint64)))
        word = lambda j: texts.data[starts[j] : ends[j]].tobytes()
        coded = pa.array(mix(low * np.uint64(0x9E3779B97F4A7C15) + mix(high + numbers[2]))).dictionary_encode()
        hashes, place = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        first = np.zeros(len(hashes), dtype=np.int64)
        first[place[::-1]] = np.arange(len(place) - 1, -1, -1)
        rows = np.array([self.of_hash.get(h, -1) for h in hashes], dtype=np.int64)
        new = np.flatnonzero((rows < 0) & (n[first] <= _SHORT))
        if len(new):
            rows[new] = self._learn([word(j) for j in first[new].tolist()], numbers[:, first[new]])
            self.of_hash.update(zip((hashes[i] for i in new.tolist()), rows[new].tolist(), strict=True))
        rows = rows[place]
        odd = np.flatnonzero((n > _SHORT) | (rows < 0) | (self.known.buffer[:3, rows] != numbers).any(axis=0))
        if len(odd):
            rows[odd] = self._by_bytes([word(j) for j in odd.tolist()], numbers[:, odd])
        begin, size = (self.known.buffer[i, rows].astype(np.int64) for i in (3, 4))
        upto = np.cumsum(size)
        flat = self.ids.buffer[0, np.repeat(begin - (upto - size), size) + np.arange(upto[-1])]
        return flat, np.concatenate(([0], upto))[bounds]

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit numbers."""
        return list(self.documents(pa.array(texts, pa.string())))

    def documents(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of every text of a column, null being empty, a slice at a time."""
        for first, end, texts in slices(column, _BLANKS, TEXT_BYTES):
            spelled, raw = set(), texts.data.tobytes()
            # The slice is lower-cased: what has a special in it may have one in the text.
            if any(s.lower().encode() in raw for s in self.special):
                spelled = {i for i in range(first, end) if any(s in (column[i].as_py() or "") for s in self.special)}
            flat, bounds = self.encode_words(texts)
            for i in range(first, end):
                yield self.encode_whole(column[i].as_py()).tobytes() if i in spelled else flat[bounds[i - first] : bounds[i - first + 1]].tobytes()


@cache
def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process, which serves many tasks."""
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, ``end_id`` after them, cut at ``capacity``.

    ``tokenizer`` is the path of a tokenizers file on every executor. Null texts are empty: one piece of one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(tokenizer)
        step, tail = capacity * 4, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("doc", "piece", "start", "length", "crc", "ids")}
            for doc, raw in enumerate(words.documents(batch.column("text"))):
                raw += tail
                for piece, at in enumerate(range(0, len(raw), step)):
                    ids = raw[at : at + step]
                    for name, value in zip(out, (doc, piece, at // 4, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None), strict=True):
                        out[name].append(value)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(out["doc"], pa.int64())),
                "piece": pa.array(out["piece"], pa.int32()),
                "start": pa.array(out["start"], pa.int64()),
                "length": pa.array(out["length"], pa.int64()),
                "ids_crc32": pa.array(out["crc"], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in out["ids"]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)


class Plan:
    """Places for every length: classes of bins are runs of bin numbers that are filled alike.

    A placement (length, rank, bins, first, each, offset) says: of the pieces of ``length``, those ranked from
    ``rank`` on go to ``bins`` bins from ``first`` on, ``each`` to a bin, from ``offset`` there.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {length: n for length, n in histogram.items() if n}
        self.taken = dict.fromkeys(self.left, 0)
        self.placements: list[tuple[int, int, int, int, int, int]] = []
        self.bins = 0
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _place(self, length: int, bins: int, first: int, each: int, offset: int) -> None:
        self.placements.append((length, self.taken[length], bins, first, each, offset))
        self.taken[length] += bins * each
        self.left[length] -= bins * each
        if not self.left[length]:
            del self.left[length]

    def _fix(self, lengths: list[int], bins: int) -> None:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            self._place(length, bins, self.bins, each, offset)
            offset += length * each
        self.bins += bins
        self.fixed += bins

    def _reduce(self) -> None:
        """Fix sets that dominate every other feasible set with their largest piece, until none is found.

        A set dominates another if its pieces can each take the place of one or several of the other's: then
        some optimal packing has it. With r left beside a piece j:

        * nothing fits beside j: {j};
        * some piece is exactly r: {j, r}, since all others beside j sum to r at most;
        * no two pieces fit beside j: {j, the largest k that fits};
        * no three fit, and the largest k is at least as long as the best two together: {j, k}.
        """
        while True:
            before = self.fixed
            for j in sorted(self.left, reverse=True):
                while j in self.left and (found := self._dominant(j)):
                    # Fewer pieces leave fewer alternatives, so the rule holds until one of the two runs out.
                    self._fix(found, min(self.left[x] // found.count(x) for x in found))
            if self.fixed == before:
                return

    def _dominant(self, j: int) -> list[int] | None:
        room = self.capacity - j
        lengths = sorted(self.left)
        spare = lambda x: self.left[x] - (x == j)
        smallest: list[int] = []
        for x in lengths:
            smallest += [x] * min(3 - len(smallest), spare(x))
            if len(smallest) == 3:
                break
        if not smallest or smallest[0] > room:
            return [j]
        if room in self.left and spare(room) > 0:
            return [j, room]
        at = bisect_left(lengths, room + 1) - 1
        while spare(lengths[at]) <= 0:
            at -= 1
        largest = lengths[at]
        if len(smallest) < 2 or smallest[0] + smallest[1] > room:
            return [j, largest]
        if len(smallest) < 3 or sum(smallest) > room:
            best, low, high = 0, 0, at
            while low <= high:
                pair = lengths[low] + lengths[high]
                if pair > room or not spare(lengths[high]):
                    high -= 1
                else:
                    if spare(lengths[low]) >= 1 + (low == high):
                        best = max(best, pair)
                    low += 1
            if largest >= best:
                return [j, largest]
        return None

    def _best_fit(self) -> None:
        """Best fit decreasing of the rest, by classes: each piece goes where it leaves least room.

        After one piece a bin has less room than its class had, so the next piece of the same length best
        fits there again: bins are filled one after the other with as many as they hold.
        """
        rooms: dict[int, list[tuple[int, int]]] = {}
        free: list[int] = []

        def put(room: int, first: int, bins: int) -> None:
            if bins and room:
                if room not in rooms:
                    rooms[room] = []
                    free.insert(bisect_left(free, room), room)
                rooms[room].append((first, bins))

        for length in sorted(self.left, reverse=True):
            while length in self.left:
                at = bisect_left(free, length)
                if at == len(free):
                    each = self.capacity // length
                    room, first = self.capacity, self.bins
                    bins = max(1, self.left[length] // each)
                    self.bins += bins
                else:
                    room = free[at]
                    first, bins = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                        free.pop(at)
                    each = room // length
                full = min(bins, self.left[length] // each)
                if full:
                    self._place(length, full, first, each, self.capacity - room)
                    put(room - each * length, first, full)
                rest = self.left.get(length, 0)
                if full < bins and 0 < rest < each:
                    self._place(length, 1, first + full, rest, self.capacity - room)
                    put(room - rest * length, first + full, 1)
                    full += 1
                put(room, first + full, bins - full)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, any others) with ``sequence_id`` and ``offset``, in as few sequences as the plan finds.

    ``pieces`` is read three times, so it should be a written table. The driver sees the histogram of lengths
    (``capacity`` numbers); the plan's placements are bounded by lengths and rooms, not by pieces, and are
    broadcast. Ranks within a length are made in groups of about ``group_rows`` pieces, so a length that a
    third of all documents have is split. Every piece must be 1 to ``capacity`` long.

    Equal rows are interchangeable. An empty table gives an empty result. The columns ``sequence_id``,
    ``offset``, ``salt``, ``below`` and ``rank`` are taken.
    """
    histogram = {x["length"]: x["n"] for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(histogram, capacity)
    spark = pieces.sparkSession
    order = sorted(plan.placements)
    table = np.array(order, dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast((table[:, 0] << 44 | table[:, 1], table))

    groups = np.ones(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        groups[length] = -(-n // group_rows)
    split = [(int(x), int(groups[x])) for x in np.flatnonzero(groups > 1)]
    salts = F.lit(1)
    if split:
        salts = F.coalesce(F.create_map(*[F.lit(x) for pair in split for x in pair])[F.col("length").cast("int")], F.lit(1))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # A row per length and group: at most ``capacity`` + pieces / group_rows.
    below = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    bases = F.broadcast(counts.select("length", "salt", below.alias("below")))
    others = [c for c in pieces.columns if c not in ("length", "doc_id", "piece")]
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", *others))
    ranked = salted.withColumn("rank", rank).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("below")).drop("salt", "below")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            found = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            here = rank - found[:, 1]
            columns = {x: batch.column(x) for x in batch.schema.names if x != "rank"}
            columns["sequence_id"] = pa.array(found[:, 3] + here // found[:, 4], pa.int64())
            columns["offset"] = pa.array(found[:, 5] + here % found[:, 4] * length, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    places = [T.StructField(x, T.LongType()) for x in ("sequence_id", "offset")]
    return ranked.mapInArrow(run, T.StructType([*ranked.drop("rank").schema.fields, *places]))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text, any others), cut and pack: a row per piece with its place.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, the ids.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, with_ids=with_ids), "pieces")
    return pack(pieces, capacity).select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces with ids: a group holds at most ``capacity`` of them."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
