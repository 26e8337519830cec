"""WARC: round trips against the SQL, and salvage of damaged archives."""

import base64
import hashlib
import io

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from swipewatch.llm import queries, text, warc

FOLDER = "/root/testdata/sf0.01"


def test_query(spark):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    answer = connection.sql(queries.WARC_SQL)
    found = queries.op1_warc(spark, FOLDER).select(*answer.columns).collect()
    expected = answer.fetchall()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def parts_of(zipped, n=12):
    rng = np.random.default_rng(1)
    records = [warc.record_bytes({"WARC-Type": "response", "N": str(i)}, rng.bytes(int(rng.integers(0, 3000)))) for i in range(n)]
    return [warc.member(r) if zipped else r for r in records]


def read(data, name="x"):
    return list(warc.salvage(warc.Archive(io.BytesIO(data), len(data)), name))


def names(found):
    return [int(h["N"]) for _, _, h, _, gap in found if gap is None]


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("block", [7, 1 << 18])
def test_salvage(zipped, block, monkeypatch):
    monkeypatch.setattr(warc, "_BLOCK", max(block, 64))
    parts = parts_of(zipped)
    name, whole = "a.warc.gz" if zipped else "a.warc", b"".join(parts)
    assert names(read(whole, name)) == list(range(12)) and not [g for *_, g in read(whole, name) if g]
    borders = np.cumsum([0, *map(len, parts)]).tolist()

    def gaps(found):
        spans = [(s, e) for s, e, *_ in found]
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and (not spans or spans[0][0] == 0)
        return [(s, e) for s, e, _, _, gap in found if gap]

    flipped = bytearray(whole)
    for i in (borders[3] + len(parts[3]) // 2, borders[8] + 1):  # inside record 3, at the head of record 8
        flipped[i] ^= 0xFF
    found = read(bytes(flipped), name)
    assert names(found) == [0, 1, 2, 4, 5, 6, 7, 9, 10, 11]
    assert gaps(found) == [(borders[3], borders[4]), (borders[8], borders[9])]
    junk = b"\n" + b"\x1f\x8b\x08 WARC/ junk" * 50 + b"\n"
    found = read(junk + parts[0] + parts[1][:-20] + junk + parts[2] + parts[3][:30], name)
    assert names(found) == [0, 2] and len(gaps(found)) == 3
    assert found[-1][1] == len(junk) * 2 + len(parts[0]) + len(parts[1]) - 20 + len(parts[2]) + 30
    assert read(b"", name) == [] and names(read(b"nothing", name)) == [] and len(read(b"nothing", name)) == 1


def test_version_lines_inside_a_block():
    inner = warc.record_bytes({"N": "99"}, b"inner")
    data = warc.record_bytes({"N": "0"}, b"\r\n" + inner) + warc.record_bytes({"N": "1"}, b"x")
    assert names(read(data)) == [0, 1]
    assert names(read(data.replace(b"N: 0\r\n", b"N: 0\r\n\r\n"))) == [99, 1]


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("kind", ["md5", "sha1", "SHA-256", "sha512"])
@pytest.mark.parametrize("base32", [True, False])
def test_block_digests(zipped, kind, base32):
    block = b"some block " * 9
    raw = hashlib.new(kind.replace("-", "").lower(), block).digest()
    value = base64.b32encode(raw).decode() if base32 else raw.hex()
    wrap = warc.member if zipped else bytes
    record = lambda v, n: (f"WARC/1.0\r\nN: {n}\r\nWARC-Block-Digest: {kind}:{v}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    wrong = ("c" if value[0] in "bB" else "b") + value[1:]
    data = wrap(record(value, 0)) + wrap(record(wrong, 1)) + wrap(record(value, 2))
    found = read(data)
    assert names(found) == [0, 2] and [gap for *_, gap in found if gap] == ["block digest"]
    assert names(read(wrap(record("unknown", 0).replace(kind.encode(), b"crc99")))) == [0]  # a digest nobody knows is not checked


def test_members_of_several_records():
    parts = parts_of(False, 6)
    data = warc.member(parts[0]) + warc.member(b"".join(parts[1:4])) + warc.member(parts[4] + parts[5])
    found = read(data)
    assert names(found) == list(range(6)) and len({s for s, *_ in found}) == 3
    broken = warc.member(parts[0]) + warc.member(parts[1] + parts[2][:-3]) + warc.member(parts[3])
    found = read(broken)
    assert names(found) == [0, 3] and [gap for *_, gap in found if gap] == ["block length"]


@pytest.mark.parametrize("zipped", [True, False])
def test_long_headers(zipped):
    record = warc.record_bytes({"N": "0", "X": "y" * 3_000_000, "Z": "z"}, b"block")
    wrap = warc.member if zipped else bytes
    assert names(read(wrap(record) + wrap(warc.record_bytes({"N": "1"}, b"")))) == [0, 1]
    plain = warc.record_bytes({"N": "0"}, b"x").replace(b"N: 0", b"no header") + warc.record_bytes({"N": "1"}, b"")
    assert names(read(plain)) == [1] and read(plain)[0][4] == "header line"


def test_every_archive_is_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_BYTES", 1)
    pages = spark.range(16).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 200) AS html").repartition(3)
    archives = text.stored(warc.write_archives(warc.page_records(pages), f"file://{tmp_path}/w"), "archives")
    assert archives.count() == 16 and archives.agg({"n": "max"}).first()[0] == 1
    records = warc.read_archives(archives).withColumn("task", F.spark_partition_id())
    assert records.select("task").distinct().count() == records.select("path").distinct().count() == 16


def test_edge_rows(spark, tmp_path):
    long_text = "<p>" + "é" * 300_000
    pages = spark.createDataFrame(
        [(None, None, None, 1), (1, "u\r\nX: y", "", 2), (2, "u", long_text, 3), (3, "u", long_text, 4), (3, "u", long_text, 5),
         (None, "u", long_text, 6), (4, "u", "short", 7), (5, "u", "short", 8), (2, "u", long_text, 9)],
        "page_id long, url string, html string, headers long")
    archives = text.stored(warc.write_archives(warc.page_records(pages), f"file://{tmp_path}/w"), "archives")
    rows = warc.pages_of(warc.read_archives(archives)).collect()
    n = len(long_text.encode())
    assert sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in rows), key=repr) == sorted(
        [(0, 0, "response", None), (1, 0, "response", None), (2, n, "response", None), (2, n, "response", None), (3, n, "revisit", 2),
         (3, n, "revisit", 2), (0, n, "revisit", 2), (4, 5, "response", None), (5, 5, "response", None)], key=repr)
    empty = text.stored(warc.write_archives(warc.page_records(pages.limit(0)), f"file://{tmp_path}/e"), "archives")
    assert warc.pages_of(warc.read_archives(empty)).count() == 0
