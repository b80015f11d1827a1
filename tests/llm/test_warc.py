"""Archives: round trips, revisits, and reading by index."""

import gzip
import hashlib
import zlib

import llm_corpus as c
import pytest
from hypograph.llm import queries, warc

SCHEMA = "page_id long, url string, html string, payload string, rank int"
DATE = "2024-01-01T00:00:00Z"


def table(spark, rows):
    return spark.createDataFrame([(i, f"http://h/{i}", h, "clash", 1) for i, h in rows], SCHEMA)


def want(rows):
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        same = [j for j, g in rows if (g or "") == (h or "") and j is not None]
        top = max(same) if len(raw) >= 1000 and same else None
        again = top is not None and i is not None and i < top
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


PAGES = [
    (1, "<p>é</p>" * 200), (2, "<p>é</p>" * 200), (3, "small"), (4, "small"), (5, None), (6, ""), (7, "a\r\n\r\nb WARC/1.1\r\n" * 100),
    (8, "a\r\n\r\nb WARC/1.1\r\n" * 100), (8, "a\r\n\r\nb WARC/1.1\r\n" * 100), (9, "x" * 1000), (10, "x" * 1000), (11, "y" * 999), (12, "y" * 999),
    (None, "x" * 1000), (13, "long " * 700_000),
]


def test_query_equals_plain_python(spark, tmp_path):
    rows = PAGES + [(100 + i, "<html>" + "hot page " * 200) for i in range(200)]
    table(spark, rows).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in queries.op1_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == want(rows)


def test_payloads_come_back(spark, tmp_path):
    warc.write_archives(table(spark, PAGES).repartition(2), f"{tmp_path}/raw", DATE)
    done = warc.normalise(spark, f"{tmp_path}/raw", f"{tmp_path}/out").collect()
    assert sum(r["records"] for r in done) == len(PAGES)
    for read_bytes in (1, 1 << 20):
        rows = warc.read_records(warc.read_index(spark, f"{tmp_path}/out"), read_bytes=read_bytes).collect()
        held = sorted(bytes(r["payload"]) for r in rows if r["record_type"] == "response")
        refers = {i for i, _, _, kind, _ in want(PAGES) if kind == "revisit"}
        assert held == sorted((h or "").encode() for i, h in PAGES if i not in refers)
        assert all(r["url"].startswith("http://h/") for r in rows)


def test_every_member_stands_alone_at_its_offset(spark, tmp_path):
    warc.write_archives(table(spark, PAGES).coalesce(1), f"{tmp_path}/raw", DATE)
    done = warc.normalise(spark, f"{tmp_path}/raw", f"{tmp_path}/out").collect()
    source = next((tmp_path / "raw").glob("*.gz"))
    raw = source.read_bytes()
    one = zlib.decompressobj(31)
    assert one.decompress(raw) and not one.unused_data  # a single stream
    whole = (tmp_path / "out" / done[0]["archive"].rsplit("/", 1)[1]).read_bytes()
    index = sorted(warc.read_index(spark, f"{tmp_path}/out").collect())
    assert gzip.decompress(whole) == gzip.decompress(raw)
    end = 0
    for r in sorted(index, key=lambda r: r["offset"]):
        assert r["offset"] == end
        end += r["length"]
        member = gzip.decompress(whole[r["offset"] : end])
        assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n") and r["record_id"].encode() in member
    assert end == len(whole)


def test_archives_of_many_members_and_broken_ones(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.warc.gz").write_bytes(gzip.compress(record) * 3)
    assert [r["records"] for r in warc.normalise(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/out").collect()] == [3]
    (tmp_path / "raw" / "a.warc.gz").write_bytes(gzip.compress(record + record[:-9]))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.normalise(spark, f"{tmp_path}/raw", f"{tmp_path}/out2").collect()


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op1_warc(spark, str(tmp_path)).count() == 0


def test_archives_of_one_stem_stay_apart(spark, tmp_path):
    """Names that are the same up to a dot, or in several folders, give an archive each."""
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{}>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for k, name in enumerate(["a/crawl.00001.warc.gz", "a/crawl.00002.warc.gz", "b/crawl.00001.warc.gz", "b/crawl"]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).with_name(name[2:] + ("" if name.endswith(".gz") else ".gz")).write_bytes(gzip.compress(record.format(k).encode()))
    done = []
    for folder in ("a", "b", "a"):  # once more: the same archive takes its own place
        done += [r["archive"] for r in warc.normalise(spark, f"{tmp_path}/{folder}", f"{tmp_path}/out").collect()]
    assert len(set(done)) == 4 and sum("crawl.00001" in x for x in set(done)) == 2
    ids = sorted(r["record_id"] for r in warc.read_index(spark, f"{tmp_path}/out").collect())
    assert ids == [f"<urn:x:{k}>" for k in range(4)]
