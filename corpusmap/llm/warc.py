"""WARC archives with revisit resolution.

1. ``write_archives`` writes one gzip archive per task, a response record for each row,
   and returns the headers as rows ``(uri, offset, length, record_id, page_id, payload_bytes, digest, target)``.
2. ``resolve`` shuffles the headers by payload digest: of equal payloads the one with the
   largest page id is the original response, the others revisit it.
3. ``rewrite`` copies each archive, task by task, with fresh headers (record id and date):
   originals keep their block, revisits lose the payload and name the original's new record.
4. ``read_archives`` parses the records back and checks each payload against its digest.

Only headers shuffle; payloads go from archive to archive within one task.  An archive
gets its name when it is whole, so a task that runs again replaces it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.util import cut_lineage
from .common import new_folder, partitions, task_number

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value: white space and control characters percent-encoded."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _record(kind: str, headers: dict, block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None),
             f"Content-Length: {len(block)}", "", ""]
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packed.flush()


def _parse(stream) -> dict | None:
    """The next record of a decompressed stream: its headers, and its block as ``block``."""
    line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode().partition(": ")
        found[name] = value
    found["block"] = stream.read(int(found["Content-Length"]))
    stream.read(4)
    return found


class _Archive:
    """An archive under a temporary name until it is closed."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.at = self.fs.open_output_stream(self.temp, compression=None), 0

    def add(self, data: bytes) -> int:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def close(self):
        self.out.close()
        self.fs.move(self.temp, self.path)


def _page_headers(record_id, page_id, uri, date, digest, size):
    return {"WARC-Record-ID": record_id, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": f"sha1:{digest}",
            "X-Payload-Length": size, "X-Page-Id": page_id, "Content-Type": "application/http;msgtype=response"}


HEADERS = "uri string, offset long, length long, record_id string, page_id long, payload_bytes long, digest string, target string"


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One response record per row (null payload: empty; null url or id: no such header); returns the headers."""
    def write(batches):
        archive = None
        for b in batches:
            rows = []
            for page_id, url, text in zip(*(c.to_pylist() for c in b.columns)):
                archive = archive or _Archive(f"{folder}/raw-{task_number():06d}.warc.gz")
                payload = (text or "").encode()
                digest = payload_digest(payload)
                record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive.uri}#{archive.at}')}>"
                target = None if url is None else _clean(url)
                head = _page_headers(record_id, page_id, target, date, digest, len(payload))
                at = archive.add(_record("response", head, HTTP % len(payload) + payload))
                rows.append((archive.uri, at, archive.at - at, record_id, page_id, len(payload), digest, target))
            if rows:
                cols = list(zip(*rows))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ("uri", "offset", "length", "record_id", "page_id", "payload_bytes", "digest", "target")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))
        if archive:
            archive.close()

    picked = df.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("string"))
    return picked.mapInArrow(write, HEADERS)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``headers`` with ``original`` (its record id, null for a response), ``refers_to`` (its page id) and ``target`` (its URI).

    Payloads below ``min_bytes`` are responses without a search.  Where the largest page
    id is repeated, the record with the largest archive and offset is the original.
    """
    best = F.max(F.struct("page_id", "uri", "offset", "record_id", "target")).alias("best")
    groups = cut_lineage(headers.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes")
                         .agg(best, F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    joined = headers.join(groups, ["digest", "payload_bytes"], "left")
    other = F.col("best").isNotNull() & (F.col("best.record_id") != F.col("record_id"))
    return joined.select("uri", "offset", "length", F.when(other, F.col("best.record_id")).alias("original"),
                         F.when(other, F.col("best.page_id")).alias("refers_to"),
                         F.when(other, F.col("best.target")).alias("target"))


def _new_id(record_id: str) -> str:
    """The id in the new archives of a record of the old ones."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#pages')}>"


def rewrite(decided: DataFrame, date: str | None = None) -> DataFrame:
    """Copy the archives with fresh headers, all records dated ``date`` (default: now); ``(uri)`` of the new ones."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def copy(batches):
        archive, raw, last = None, None, None
        for b in batches:
            for uri, offset, length, original, refers_to, target in zip(*(c.to_pylist() for c in b.columns)):
                if uri != last:
                    if archive:
                        archive.close()
                        yield pa.RecordBatch.from_pydict({"uri": [archive.uri]})
                    fs, path = pafs.FileSystem.from_uri(uri)
                    raw, last = fs.open_input_file(path), uri
                    archive = _Archive(uri.replace("/raw-", "/pages-"))
                old = _parse(io.BytesIO(gzip.decompress(raw.read_at(length, offset))))
                kind, block = "response", old["block"]
                head = {k: v for k, v in old.items() if k not in ("block", "WARC-Type", "Content-Length")}
                head |= {"WARC-Record-ID": _new_id(old["WARC-Record-ID"]), "WARC-Date": date}
                if original is not None:
                    kind, block = "revisit", block[:block.index(b"\r\n\r\n") + 4]
                    head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _new_id(original), "WARC-Refers-To-Target-URI": target,
                             "WARC-Refers-To-Date": date, "X-Refers-To-Page-Id": refers_to}
                archive.add(_record(kind, head, block))
        if archive:
            archive.close()
            yield pa.RecordBatch.from_pydict({"uri": [archive.uri]})

    n = partitions(decided.sparkSession)
    rows = decided.repartition(n, "uri").sortWithinPartitions("uri", "offset")
    return rows.select("uri", "offset", "length", "original", "refers_to", "target").mapInArrow(copy, "uri string")


PAGES = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
         "payload string")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of ``archives(uri)``; payloads (null for revisits) only if asked for.  Raises on a wrong digest."""
    def read(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                rows = []
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    while True:
                        r = _parse(stream)
                        if r is not None:
                            digest, size, payload = r["WARC-Payload-Digest"][5:], int(r["X-Payload-Length"]), None
                            if r["WARC-Type"] == "response":
                                payload = r["block"][r["block"].index(b"\r\n\r\n") + 4:]
                                if payload_digest(payload) != digest or len(payload) != size:
                                    raise ValueError(f"{uri}: {r['WARC-Record-ID']} doesn't match its digest")
                            page, refers = r.get("X-Page-Id"), r.get("X-Refers-To-Page-Id")
                            rows.append((None if page is None else int(page), r.get("WARC-Target-URI"), size, digest, r["WARC-Type"],
                                         None if refers is None else int(refers),
                                         payload.decode() if payloads and payload is not None else None))
                        if rows and (r is None or len(rows) >= 1000):
                            cols = list(zip(*rows))
                            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                             names=[p.split()[0] for p in PAGES.split(", ")])
                            rows = []
                        if r is None:
                            break

    out = archives.select("uri").repartition(partitions(archives.sparkSession), "uri").mapInArrow(read, PAGES)
    return out if payloads else out.drop("payload")


def deduplicate_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                      min_bytes: int = 0, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write all rows as WARC archives, resolve revisits, write the final archives and read them back.

    Result: a row per input row, repeated rows included (each is a record); null ids stay
    null and count as smallest; extra columns are left out; an empty table gives an empty
    result.  The archives stay in ``folder`` (default: a new one in the checkpoint folder).
    """
    spark = df.sparkSession
    folder = new_folder(spark, "warc", folder)
    headers = cut_lineage(write_archives(df, folder, id_col, url_col, payload_col))
    final = cut_lineage(rewrite(resolve(headers, min_bytes)))
    return read_archives(final, payloads)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` as WARC archives with revisit records, read back."""
    out = deduplicate_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc_revisits": op8_warc_revisits}
SQL = {
    "op8_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS best,
                     list_transform(range(0, 8), lambda g: ('0x' || substr(h, 1 + 5 * g::INT, 5))::INT) AS fives FROM p)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
               array_to_string(list_transform(fives, lambda v:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 15), 1)
                   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1)
                   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1)
                   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
        FROM w""",
}
