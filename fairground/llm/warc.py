"""WARC archives through a table of record chunks.

A payload becomes rows of record identifier and chunk number, each with the digest of the
payload so far. Each row is one WARC record: the first chunk a response, later ones
continuations (segments, as the standard has them), equal payloads revisits. Spark's text
writer and reader carry the archives, so any store that Spark reaches will do, and a reader
splits archives that are not compressed at record boundaries. No step holds more than one chunk of a payload beside what
the source's row itself is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of payload in a chunk, and payload bytes in an output batch.
CHUNK_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
END, VERSION = "\r\n\r\n", "WARC/1.0\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK_SCHEMA = "record_id string, chunk int, warc string"
MARK = VERSION.encode()


def cuts(payload: memoryview, size: int) -> Iterator[memoryview]:
    """``payload`` in chunks of at most ``size`` bytes that break no UTF-8 character.

    None holds the version line with which a record begins: a chunk ends within it.
    """
    n, at = len(payload), 0
    while True:
        end = min(n, at + size)
        while at < end < n and payload[end] & 0xC0 == 0x80:
            end -= 1
        found = bytes(payload[at : end]).find(MARK)
        if found >= 0:
            end = at + found + 2
        yield payload[at:end]
        at = end
        if at >= n:
            return


def _clean(value) -> str:
    """A header value: control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def _record(headers: dict[str, object], block: bytes) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"{VERSION}{lines}Content-Length: {len(block)}\r\n\r\n" + block.decode()


def chunk_rows(key, url: str | None, payload: memoryview, digest: str, refers_to, record_id: str, date: str, size: int) -> Iterator[tuple[str, int, str]]:
    """The rows of one payload, the digest carried from chunk to chunk."""
    common = {"WARC-Date": date, "WARC-Target-URI": _clean(url), "X-Page-Id": key}
    if refers_to is not None:
        head = {"WARC-Type": "revisit", "WARC-Record-ID": f"<{record_id}>", **common, "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": len(payload), "X-Refers-To-Page-Id": refers_to, "Content-Type": "application/http"}
        yield record_id, 1, _record(head, HTTP)
        return
    running, total, pieces = hashlib.sha256(), 0, cuts(payload, size)
    piece, number = next(pieces), 1
    while piece is not None:
        after = next(pieces, None)
        running.update(piece)
        total += len(piece)
        body = bytes(piece) if number > 1 else HTTP + bytes(piece)
        head = {"WARC-Type": "response" if number == 1 else "continuation", "WARC-Record-ID": f"<{record_id}>" if number == 1 else f"<{record_id}:{number}>", **common, "X-Running-Digest": f"sha256:{running.copy().hexdigest()}", "Content-Type": "application/http"}
        if number > 1 or after is not None:
            head |= {"WARC-Segment-Number": number, "WARC-Segment-Origin-ID": f"<{record_id}>"}
        if after is None:
            head |= {"WARC-Segment-Total-Length": total + len(HTTP), "WARC-Payload-Digest": f"sha256:{running.hexdigest()}"}
        yield record_id, number, _record(head, body)
        piece, number = after, number + 1


def to_chunks(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 100, date: str = "2024-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of ``pages``: record_id, chunk, warc (the record's text).

    Null payloads are empty. Of records with equal payloads of ``min_revisit`` bytes or more,
    those with the smallest key are responses and the others revisits of it; smaller ones are
    all responses. Rows that repeat the smallest key are all responses; rows with a null key
    are never referred to. Extra columns are not read; an empty table has no records.
    """
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # Only digests of large payloads that occur twice; most rows find no partner.
    shared = rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    marked = rows.join(shared, "digest", "left").select("key", "url", F.col("payload").cast("binary").alias("payload"), "digest", F.when(~F.col("first").eqNullSafe(F.col("key")), F.col("first")).alias("refers_to"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        out, held = ([], [], []), 0
        for batch in batches:
            for i in range(batch.num_rows):
                key, url, digest, refers_to = (batch.column(c)[i].as_py() for c in (0, 1, 3, 4))
                record_id = f"urn:record:{part}-{n}"
                n += 1
                for row in chunk_rows(key, url, memoryview(batch.column(2)[i].as_buffer() or b""), digest, refers_to, record_id, date, chunk_bytes):
                    for column, value in zip(out, row):
                        column.append(value)
                    held += len(row[2])
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["record_id", "chunk", "warc"])
                        out, held = ([], [], []), 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["record_id", "chunk", "warc"])

    return marked.mapInArrow(chunks, CHUNK_SCHEMA)


def write_archives(chunks: DataFrame, path: str) -> None:
    """Each partition's records as one gzipped archive under ``path``."""
    chunks.select("warc").write.option("lineSep", END).option("compression", "gzip").text(path)


def _parsed(text: str) -> tuple[dict[str, str], bytes]:
    head, _, block = text.partition("\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.split("\r\n") if ": " in line)
    data = block.encode()
    size = int(headers["Content-Length"])
    rest = data[size:]
    if len(data) < size or rest.strip(b"\r\n"):
        raise ValueError(f"record {headers.get('WARC-Record-ID')} has {len(data)} bytes, not {size}")
    return headers, data[:size]


PARSED = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("last", pa.bool_()), ("type", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("refers_to", pa.string()), ("piece", pa.binary())])
RECORDS = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
_ARROW = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.int64(): "long", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_ARROW[f.type]}" for f in schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to (ids as text).

    Lengths are checked record by record; a payload's digest is taken anew, over its chunks in
    order of their numbers, and compared with the digest each chunk carries. A missing or
    damaged chunk raises ValueError.
    """
    lines = spark.read.option("lineSep", END + VERSION).text(path)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                h, block = _parsed(value.as_py())
                origin = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])
                number = int(h.get("WARC-Segment-Number", 1))
                if h["WARC-Type"] == "revisit":
                    rows.append((origin, 1, True, "revisit", h.get("X-Page-Id"), h["WARC-Target-URI"], h["WARC-Payload-Digest"][7:], int(h["X-Payload-Length"]), h["X-Refers-To-Page-Id"], None))
                    continue
                piece = block if number > 1 else block[len(HTTP) :]
                last, digest = "WARC-Payload-Digest" in h, h["X-Running-Digest"][7:]
                alone = number == 1 and last
                if alone and hashlib.sha256(piece).hexdigest() != digest:
                    raise ValueError(f"record {origin}: wrong digest")
                rows.append((origin, number, last, "response", h.get("X-Page-Id"), h["WARC-Target-URI"], digest, len(piece), None, None if alone else piece))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PARSED)] if rows else [pa.array([], f.type) for f in PARSED], schema=PARSED)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks come record by record and in order; the digest goes on from one to the next."""
        origin, state, length, expected = None, None, 0, 1
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["number"] == 1 and r["last"]:
                    rows.append((r["page_id"], r["url"], r["length"], r["digest"], r["type"], r["refers_to"]))
                    continue
                if r["origin"] != origin:
                    if origin is not None:
                        raise ValueError(f"record {origin}: its last chunk is missing")
                    origin, state, length, expected = r["origin"], hashlib.sha256(), 0, 1
                state.update(r["piece"])
                length += r["length"]
                if r["number"] != expected or state.copy().hexdigest() != r["digest"]:
                    raise ValueError(f"record {origin}: chunk {r['number']} is out of order or damaged")
                expected += 1
                if r["last"]:
                    rows.append((r["page_id"], r["url"], length, r["digest"], r["type"], None))
                    origin = None
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORDS)] if rows else [pa.array([], f.type) for f in RECORDS], schema=RECORDS)
        if origin is not None:
            raise ValueError(f"record {origin}: its last chunk is missing")

    parsed = lines.mapInArrow(parse, _ddl(PARSED))
    ordered = parsed.repartition("origin").sortWithinPartitions("origin", "number")
    return ordered.mapInArrow(joined, _ddl(RECORDS))
