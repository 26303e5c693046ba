import hashlib

import pytest

from fairground.llm import warc
from fairground.llm.common import workspace

TRAP = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nb WARC/1.0\r\nWARC/1.0\r\n"
ROWS = [
    (5, "http://a/é b\r\nX: y", "é" * 3000), (3, None, "é" * 3000), (9, "u", "é" * 3000), (1, "u", None), (2, "u", ""), (4, "u", "small"), (6, "u", "small"), (7, "u", TRAP), (8, "u", TRAP * 40), (10, "u", TRAP * 40), (11, "u", "\r\n\r\n"), (12, "u", "WARC/1.0\r\n" + "x" * 5000), (13, "u", "end\r\n\r\n" * 30), (14, "u", "日本語" * 20_000), (15, "u", "x" * 100), (16, "u", "x" * 99), (17, "u", "x" * 100), (18, "u", "x" * 99), (20, "u", "twice " * 50), (20, "u", "twice " * 50), (21, "u", "twice " * 50),
]


def brute(rows, least=100):
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= least and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        r = first.get(data)
        again = r is not None and r != i
        out.append((str(i) if i is not None else None, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(r) if again else None))
    return sorted(out, key=str)


def run(spark, rows, chunk_bytes=1 << 20):
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")
    path = workspace(spark, "warc-test")
    warc.write_archives(warc.to_chunks(pages, chunk_bytes=chunk_bytes), path)
    got = warc.read_archives(spark, path).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)


def test_round_trip(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_payloads_in_chunks(spark):
    assert run(spark, ROWS, 100) == brute(ROWS)


def test_null_key_and_empty_table(spark):
    rows = [(None, "u", "p" * 200), (2, "u", "p" * 200)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("size", [4, 7, 64, 1 << 20])
def test_cuts_are_whole_and_safe(size):
    for text in ("", "é日😀" * 50, TRAP * 3, "plain"):
        data = text.encode()
        parts = [bytes(p) for p in warc.cuts(memoryview(data), size)]
        assert b"".join(parts) == data and all(len(p) <= size for p in parts)
        for p in parts:
            p.decode()
            assert warc.MARK not in p


def test_records_carry_running_digests():
    rows = list(warc.chunk_rows(1, "u", memoryview(b"abcdefgh"), "d", None, "urn:r", "2024", 3))
    assert [n for _, n, _ in rows] == [1, 2, 3]
    for (_, _, text), part in zip(rows, (b"abc", b"abcdef", b"abcdefgh")):
        assert hashlib.sha256(part).hexdigest() in text
    assert "WARC-Type: response" in rows[0][2] and "WARC-Type: continuation" in rows[1][2] and "WARC-Segment-Total-Length" in rows[2][2]


def test_damage_is_found(spark):
    rows = list(warc.chunk_rows(1, "u", memoryview(b"abcdefgh"), "d", None, "urn:r", "2024", 3))
    path = workspace(spark, "warc-damaged")
    warc.write_archives(spark.createDataFrame([r for r in rows if r[1] != 2], warc.CHUNK_SCHEMA), path)
    with pytest.raises(Exception, match="out of order or damaged"):
        warc.read_archives(spark, path).collect()


def test_payload_over_the_default_chunk(spark):
    big = "".join(chr(97 + i % 26) + "é日"[i % 2] for i in range(900_000)) + TRAP
    rows = [(1, "u", big), (2, "u", big), (3, "u", big[:-1]), (4, "u", "x" * (1 << 20)), (5, "u", "x" * ((1 << 20) + 1))]
    assert run(spark, rows) == brute(rows)
