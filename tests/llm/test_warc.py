import hashlib
import io
import struct
from collections import defaultdict

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from aislemetrics.llm import warc as W
from aislemetrics.llm.common import table
from aislemetrics.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
LONG = "<p>" + "a page of words " * 20
ROWS = [
    (5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, None, LONG), (None, "http://a/3", LONG), (1, "http://b", None), (2, "http://b", ""),
    (4, "x y\r\nWARC-Type: revisit", "short"), (6, "http://c", "short"), (7, "http://d", "é" * 50), (8, "http://d", "é" * 49 + "e"),
    (10, "http://e", "é" * 50), (11, "http://f", "b" * 99), (12, "http://f", "b" * 99), (13, "http://g/%41?ü", "\r\n\r\nHTTP/1.1\r\nContent-Length: 3\r\n\r\n" * 5),
    (14, "u", "z" * 3_000_000), (15, "u", "z" * 3_000_000), (20, "r", LONG + "!"), (20, "r", LONG + "!"), (20, "q", LONG + "!"), (21, "q", LONG + "!"),
    (None, "n", LONG + "?"), (None, "n", LONG + "?"), *[(100 + i, f"http://many/{i}", LONG + "many") for i in range(300)],
]


def brute(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for payload, pages in groups.items():
        pages.sort(key=lambda p: (p is None, p))
        for i, p in enumerate(pages):
            again = len(payload) >= 100 and i > 0
            out.append((p, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", pages[0] if again else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "'x' as digest", "2 as kind", "3 as n")


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def got(df):
    ids = {c: df[c].cast("long") for c in ("page_id", "refers_to")}
    return sorted([tuple(r) for r in df.withColumns(ids).select(*NAMES).collect()], key=str)


@pytest.mark.parametrize("archive_bytes, buffer_bytes", [(W.ARCHIVE_BYTES, W.BUFFER_BYTES), (3_000, 1_000), (1, 1)])
def test_round_trip(spark, tmp_path, monkeypatch, archive_bytes, buffer_bytes):
    monkeypatch.setattr(W, "BUFFER_BYTES", buffer_bytes)
    manifest = W.write(frame(spark, ROWS).repartition(3), f"{tmp_path}/warc", archive_bytes=archive_bytes)
    assert got(W.read(manifest)) == brute(ROWS)
    back = W.read(manifest, payloads=True).filter("record_type = 'response'").collect()
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in back)
    assert {bytes(r.payload) for r in back} == {(h or "").encode() for _, _, h in ROWS}
    assert len({r.record_id for r in W.read(manifest).collect()}) == len(ROWS)
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS)


def test_archive_format(spark, tmp_path):
    """A dictionary in a skippable frame, then one frame for each record, readable on its own."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<html><body>{LONG} {i}</body>") for i in range(400)], "page_id long, url string, html string")
    row = W.write(pages.coalesce(1), f"{tmp_path}/warc").collect()
    assert len(row) == 1 and row[0].bytes * 4 < row[0].record_bytes
    data = open(row[0].path.removeprefix("file:"), "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and len(data) == row[0].bytes
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert dictionary.dict_id() != 0
    rest, seen = data[8 + size :], []
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        seen.append(W.parse_record(one.decompress(rest)))
        rest = one.unused_data
    assert [f["warc-type"] for f, _ in seen] == ["warcinfo"] + ["response"] * 400
    assert seen[1][1].startswith(b"HTTP/1.1 200 OK\r\n") and seen[1][0]["warc-target-uri"].startswith("http://x/")
    # any reader that skips skippable frames can read the records, given the dictionary
    plain = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 401


def test_fields_cannot_be_forged(spark, tmp_path):
    manifest = W.write(frame(spark, [(4, "x y\r\nWARC-Type: revisit", "short")]), f"{tmp_path}/warc")
    assert W.read(manifest).first().url == "x%20y%0D%0AWARC-Type:%20revisit"


def test_strays_do_not_count_and_damage_is_found(spark, tmp_path):
    manifest = W.write(frame(spark, ROWS).coalesce(1), f"{tmp_path}/warc")
    paths = [r.path for r in manifest.collect()]
    (tmp_path / "warc" / "stray.warc.zst").write_bytes(b"an attempt that was lost")
    assert W.read(manifest).count() == len(ROWS)
    name = paths[0].removeprefix("file:")
    data = bytearray(open(name, "rb").read())
    data[-20] ^= 255
    open(name, "wb").write(bytes(data))
    with pytest.raises(Exception, match="(?i)checksum|corrupt|damaged|error"):
        W.read(manifest).count()


@settings(deadline=None, max_examples=40)
@given(st.lists(st.binary(max_size=300), max_size=30))
def test_dictionary_of_any_records(records):
    dictionary = W.build_dictionary([*records, b"WARC"])
    press = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True)
    raw = dictionary.as_bytes()
    data = struct.pack("<II", W.DICTIONARY_FRAME, len(raw)) + raw + b"".join(press.compress(r) for r in records)
    assert list(W.records_of(io.BytesIO(data))) == records


def test_query_against_sql_and_brute_force(spark):
    from workload.compare import connect

    rows = [tuple(r) for r in table(spark, FOLDER, "pages").select("page_id", "url", "html").collect()]
    mine = got(QUERIES["op13_warc_archive"](spark, FOLDER))
    assert mine == brute(rows)
    sql = connect(FOLDER).execute(f"select {', '.join(NAMES)} from ({ORACLE_SQL['op13_warc_archive']})").fetchall()
    assert sorted(sql, key=str) == mine


def test_only_nulls_and_empty_table(spark, tmp_path):
    rows = [(None, None, None), (1, None, None), (2, "", "")]
    assert got(W.read(W.write(frame(spark, rows), f"{tmp_path}/a"))) == brute(rows)
    assert W.read(W.write(frame(spark, ROWS).limit(0), f"{tmp_path}/b")).count() == 0
