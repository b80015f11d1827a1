"""WARC archives: writing, normalising monolithic gzip files, reading by offset index.

Spark writes records into whole-file gzip streams, as many crawlers leave them. The normaliser inflates such a
stream once and rewrites every record as a gzip member of its own, with a sidecar index of offsets, so that
any record can be read alone and a large archive is read by many tasks.

Files are opened through ``pyarrow.fs``, so archives may lie wherever all executors reach them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import small_side

#: Fixed values of the format.
VERSION = "WARC/1.1"
GAP = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Compressed bytes of an archive that one task reads.
READ_BYTES = 64 * 1024 * 1024
_CHUNK = 1 << 20

INDEX = "offset long, length long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/") :]
    return pafs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame, threshold: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) as (page_id, url, payload, payload_bytes, payload_digest, refers_to).

    Of equal payloads of at least ``threshold`` bytes the one with the largest page_id is stored; the others
    refer to it. Payloads are told apart by SHA-1 and size, counted by partial aggregation, and never shuffled
    unless the revisits are too many to broadcast; then they meet by page_id, which no group shares.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.encode("payload", "utf-8"))})
    digests = rows.select("page_id", "payload_bytes", "payload_digest").filter(F.col("payload_bytes") >= threshold)
    groups = digests.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    again = digests.join(groups, ["payload_digest", "payload_bytes"]).filter("page_id < refers_to")
    again, _ = small_side(again.select("page_id", "payload_digest", "refers_to").distinct())
    return rows.join(again, ["page_id", "payload_digest"], "left")


def record(date: str):
    """A record as one text, from the columns of ``with_revisits``."""
    head = F.lit(HTTP_HEAD)
    stored = F.col("refers_to").isNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    body = F.when(stored, F.col("payload")).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(stored, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(stored, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(head) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
        head,
        body,
    )


def write_archives(pages: DataFrame, folder: str, date: str, threshold: int = REVISIT_BYTES) -> None:
    """Write a record per row of ``pages`` into gzip files of ``folder``, each one stream."""
    rows = with_revisits(pages, threshold).select(record(date).alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", GAP).text(folder)


class _Stream:
    """The inflated bytes of a gzip file of one or many members, a chunk at a time."""

    def __init__(self, file):
        self.file, self.buffer, self.inflate, self.done = file, b"", zlib.decompressobj(31), False

    def _more(self) -> bool:
        while not self.done:
            raw = self.inflate.unused_data if self.inflate.eof else b""
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            raw = raw or self.file.read(_CHUNK)
            if not raw:
                self.done = True
                return False
            if new := self.inflate.decompress(raw):
                self.buffer += new
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("archive ends inside a record")
                return None
        out, self.buffer = self.buffer[: at + len(mark)], self.buffer[at + len(mark) :]
        return out

    def parts(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in parts."""
        while n:
            if not self.buffer and not self._more():
                raise ValueError("archive ends inside a record")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").strip().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:80]!r}")
    return {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}


def _index_line(offset: int, length: int, fields: dict[str, str]) -> str:
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    values = (offset, length, fields.get("warc-record-id", ""), fields["warc-type"], fields.get("payload-length", ""), digest, fields.get("warc-refers-to", ""))
    return "\t".join(map(str, values)) + "\n"


def _archive_name(uri: str) -> str:
    """The name of a rewritten archive: the file's without its ending, and a hash of its whole path.

    Archives of the same name in different folders, or with the same name up to a dot, stay apart.
    """
    name = uri.rstrip("/").rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".warc")
    return f"{name}-{hashlib.sha256(uri.encode()).hexdigest()[:16]}"


def _normalise_file(uri: str, target: str, level: int) -> tuple[str, int]:
    """Rewrite one archive; returns the new one's path and its number of records.

    Both files are written under names of this attempt and moved at the end, so a repeated or parallel attempt
    leaves whole files only. A record's block is passed on in parts, however long.
    """
    source, path = _open(uri)
    out, folder = _open(target)
    name = _archive_name(uri)
    attempt = f"{folder}/.attempt-{uuid.uuid4().hex}"
    records = offset = 0
    with (
        source.open_input_stream(path, compression=None) as file,
        out.open_output_stream(f"{attempt}.warc", compression=None) as warc,
        out.open_output_stream(f"{attempt}.idx", compression=None) as index,
    ):
        stream = _Stream(file)
        while (head := stream.until(GAP.encode())) is not None:
            fields = _fields(head)
            member = zlib.compressobj(level, zlib.DEFLATED, 31)
            warc.write(member.compress(head.lstrip(b"\r\n")))
            for part in stream.parts(int(fields["content-length"])):
                warc.write(member.compress(part))
            for _ in stream.parts(len(GAP)):
                pass
            warc.write(member.compress(GAP.encode()))
            warc.write(member.flush())
            end = warc.tell()
            index.write(_index_line(offset, end - offset, fields).encode())
            offset, records = end, records + 1
    for kind, to in (("warc", "warc.gz"), ("idx", "idx")):
        out.move(f"{attempt}.{kind}", f"{folder}/{name}.{to}")
    return f"{target.rstrip('/')}/{name}.warc.gz", records


def normalise(spark: SparkSession, folder: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite all gzip archives of ``folder`` into ``target``: (archive, records) per file.

    One task per archive; a task holds one chunk of the stream. An empty folder gives an empty result.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")
    out, path = _open(target)
    out.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_normalise_file(x, target, level) for x in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], names=["archive", "records"]
            )

    files = max(1, found.count())
    return found.repartition(files).mapInArrow(run, "archive string, records long")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """The sidecar indexes of ``target``: a row per record, with the archive it is in."""
    lines = spark.read.option("sep", "\t").option("pathGlobFilter", "*.idx").option("quote", "").schema(INDEX).csv(target)
    archive = F.regexp_replace(F.col("_metadata.file_path"), r"\.idx$", ".warc.gz")
    return lines.select(archive.alias("archive"), *lines.columns)


def _read_range(uri: str, low: int, high: int) -> Iterator[tuple[dict[str, str], bytes]]:
    source, path = _open(uri)
    with source.open_input_file(path) as file:
        file.seek(low)
        raw, at = b"", low
        while at < high or raw:
            inflate, block = zlib.decompressobj(31), []
            while not inflate.eof:
                if not raw:
                    raw = file.read(min(_CHUNK, high - at))
                    at += len(raw)
                    if not raw:
                        raise ValueError(f"{uri} ends inside a member")
                block.append(inflate.decompress(raw))
                raw = inflate.unused_data
            head, _, rest = b"".join(block).partition(GAP.encode())
            fields = _fields(head)
            yield fields, rest[: int(fields["content-length"])]


def read_records(index: DataFrame, with_payload: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records that ``index`` names, read from their archives, member by member.

    (record_id, record_type, url, payload_bytes, payload_digest, refers_to[, payload]); size and digest are
    counted on the payload for records that hold one, else taken from the record's header. A task reads about
    ``read_bytes`` of consecutive members.
    """
    ranges = index.groupBy("archive", F.floor(F.col("offset") / read_bytes).alias("part"))
    ranges = ranges.agg(F.min("offset").alias("low"), F.max(F.col("offset") + F.col("length")).alias("high"))
    names = ["record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    if with_payload:
        names, types = [*names, "payload"], [*types, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, size = [], 0
                for fields, block in _read_range(row["archive"], row["low"], row["high"]):
                    payload = block.partition(GAP.encode())[2]
                    held = fields["warc-type"] != "revisit"
                    length = len(payload) if held else int(fields["payload-length"])
                    digest = hashlib.sha1(payload).hexdigest() if held else fields["warc-payload-digest"].removeprefix("sha1:")
                    head = (fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), length, digest, fields.get("warc-refers-to"))
                    rows.append((*head, payload) if with_payload else head)
                    size += len(payload) if with_payload else 0
                    if size > 8 * _CHUNK or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string"
    return ranges.select("archive", "low", "high").repartition("archive", "low").mapInArrow(run, schema + ", payload binary" * with_payload)


def page_of(urn: str):
    """The page id in a record id such as <urn:page:7>; null where there is none."""
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
