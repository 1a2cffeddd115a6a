"""Archives round trip: types and targets by brute force, both ways of joining, frames, damage."""

from __future__ import annotations

import random
import struct
from pathlib import Path
from urllib.parse import quote

import pytest
import zstandard

from lumenry.llm import warc

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    held = [
        (k if k % 97 else None, None if k % 11 == 0 else f"http://x/é {k}\r\nWARC-Type: y", None if k % 13 == 0 else "" if k % 17 == 0 else "<p>" + "é x" * rng.randrange(80) if k % 3 else "same é page\r\n\r\n" * 20)
        for k in range(-20, 1500)
    ]
    rng.shuffle(held)
    return [*held, (9000, "u", "x" * 99), (9001, "u", "x" * 99), (9002, "u", "x" * 100), (9003, "u", "x" * 100), (9002, "u", "x" * 100), (None, "u", "only null ids " * 20), (None, "u", "only null ids " * 20), (9004, "u", "long " * 300_000)]


def brute(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, url, html in rows:
        html = html or ""
        to = first.get(html)
        to = to if to is not None and (i is None or i > to) else None
        url = None if url is None else quote(url, safe=":/?#[]@!$&()*+,;=%~-._'")
        out.append((i, url, "response" if to is None else "revisit", to, html if to is None else None, len(html.encode())))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize(("broadcast_rows", "archive_bytes"), [(1000, 1 << 28), (0, 50_000)])
def test_round_trip(spark, rows, broadcast_rows, archive_bytes):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS digest", "2 AS first", "3 AS payload").repartition(3)
    got = warc.archived(df, payloads=True, broadcast_rows=broadcast_rows, archive_bytes=archive_bytes)
    got = [(r.page_id, r.url, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode(), r.payload_bytes) for r in got.collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).collect() == []


def test_files_hold_a_dictionary_and_a_frame_a_record(spark, rows, tmp_path):
    marked = warc.marked(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    archives = warc.write_archives(marked, str(tmp_path / "a"), archive_bytes=60_000).collect()
    assert len(archives) > 2 and sum(a.n_records for a in archives) == len(rows)
    for a in archives:
        data = Path(a.path).read_bytes()
        assert len(data) == a.n_bytes
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        first = zstandard.ZstdDecompressor(dict_data=held).decompressobj().decompress(data[8 + size :])
        fields, block = warc.parsed(first)
        assert fields["warc-type"] in ("response", "revisit") and block.startswith(b"HTTP/1.1 200 OK") and first.endswith(b"\r\n\r\n")
        for step in (1, 7, 1 << 20):  # records don't depend on how the file is read
            pieces = iter([data[k : k + step] for k in range(0, len(data), step)]) if step > 1 else iter([data[:100], data[100:]])
            assert sum(1 for _ in warc.frames(pieces)) == a.n_records
    with pytest.raises(ValueError, match="ends within a frame"):
        list(warc.frames(iter([data[:-3]])))
    assert archives[-1].n_bytes < sum(len(r[2] or "") + 300 for r in rows)


def test_damage_is_found(spark, tmp_path):
    text = b"<p>a page of some words</p>"
    made = warc.record(1, "u", text.replace(b"some", b"more"), len(text), "0" * 64, None, "2024-01-01T00:00:00Z")
    store, top = warc.fs.FileSystem.from_uri(str(tmp_path))
    archive = warc._Archive(store, f"{top}/x.warc.zst")
    archive.add(made)
    table = spark.createDataFrame([archive.close()], warc.ARCHIVES)
    with pytest.raises(Exception, match="isn't the one that its digest names"):
        warc.read_archives(table, str(tmp_path)).collect()


def test_record_ids():
    for page in (0, 1, -5, 2**63 - 1, -(2**63), None):
        assert warc.page_id_of(warc.record_id(page)) == page
    assert len({warc.record_id(p) for p in (0, None, 1, -1)}) == 4
