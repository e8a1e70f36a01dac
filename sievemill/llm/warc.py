"""WARC archives, index first: write records and their places, then read only what is asked for.

Each task writes one archive of gzip members, one per record, and returns offset, length, URL and digest of
each. A file that a failed or repeated attempt leaves is in no index, so nothing reads it. Reading sorts the
index by place and fetches neighbouring records in one request."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.shared import joined, own_columns, shared_dir, stored

#: Ranges at most this far apart are read together, up to so many bytes.
GAP, MOST = 64 << 10, 8 << 20
INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _line(value: str) -> str:
    """A header's value: control characters would end it."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refer: bool) -> bytes:
    """One record as a gzip member. A revisit holds no payload but its size and digest."""
    kind = "revisit" if refer else "response"
    body = b"" if refer else payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refer:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """A record's fields, from its gzip member; the payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    cut = raw.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in raw[:cut].decode().split("\r\n")[1:])
    size = int(head["Content-Length"])
    body = raw[cut + 4 : cut + 4 + size]
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"][5:]
    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't have its digest")
    number = lambda s: int(s[10:-1]) if s.startswith("<urn:page:") else None
    return {"page_id": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "refers_to": number(head["WARC-Refers-To"]) if kind == "revisit" else None, "payload": body if kind == "response" else None}


def write(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page to the shared folder; return the index.

    Of pages with equal payloads of at least least_bytes, those with the smallest id are responses, the others
    revisits of it. A null html is an empty payload. A null id is larger than any other, and no other id is taken for it; among null ids
    alone, all are responses. So each payload has a response. Rows that repeat an id and its payload have the same type, whatever their urls. Payloads of any
    length are written whole. Other columns are ignored, whatever their names. An empty table gives an empty index. Ids are integers."""
    p = own_columns(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    p = p.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload"))
    # copies are counted by digest before any row moves; rows of a digest that very many share don't move at all
    first = p.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first_id is not null")
    first = stored(first, "first")
    rows = joined(p, first, "sha1", "copies", p.count(), "left")
    rows = rows.select("page_id", "url", "payload", "sha1", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")), F.col("first_id")).alias("refers_to"))
    folder = shared_dir(pages.sparkSession, "warc")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        path = f"{root}/{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(path, compression=None)
            found = []
            for r in batch.to_pylist():
                digest = base32(r["sha1"])
                member = record(r["page_id"], r["url"], r["payload"], digest, r["refers_to"], r["refers_to"] is not None)
                out.write(member)
                found.append((r["page_id"], r["url"], path, offset, len(member), len(r["payload"]), digest, "revisit" if r["refers_to"] is not None else "response"))
                offset += len(member)
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["page_id", "url", "file", "offset", "length", "payload_bytes", "payload_digest", "record_type"])
        if out is not None:
            out.close()

    index = stored(rows.mapInArrow(put, INDEX), "warc-index")
    return index.withColumn("folder", F.lit(folder))


def ranges(places: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Start, end and members of each read that covers sorted (offset, length)."""
    group: list[tuple[int, int]] = []
    for offset, length in places:
        if group and (offset - sum(group[-1]) > gap or offset + length - group[0][0] > most):
            yield group[0][0], sum(group[-1]), group
            group = []
        group.append((offset, length))
    if group:
        yield group[0][0], sum(group[-1]), group


def read(index: DataFrame, gap: int = GAP, most: int = MOST) -> DataFrame:
    """The records of the index's rows; choose records by filtering the index first. payload is null for a revisit."""
    spark: SparkSession = index.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("folder", "file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            rows = batch.to_pylist()
            i = 0
            while i < len(rows):
                j = i
                while j < len(rows) and rows[j]["file"] == rows[i]["file"]:
                    j += 1
                folder = rows[i]["folder"]
                fs, _ = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                with fs.open_input_file(rows[i]["file"]) as f:
                    for start, end, members in ranges([(r["offset"], r["length"]) for r in rows[i:j]], gap, most):
                        block = f.read_at(end - start, start)
                        yield pa.RecordBatch.from_pylist([parse(block[o - start : o - start + n]) for o, n in members], schema=types)
                i = j

    return places.mapInArrow(get, RECORDS)
