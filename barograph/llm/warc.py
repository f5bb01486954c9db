"""Monolithic gzip normaliser: whole-file WARC streams become one gzip member a record, with an offset index.

A crawl archive that was compressed as one stream can only be read from its start. The normaliser inflates
such a file once, piece by piece, writes every record as a member of its own and a sidecar index line
(offset, length, digest) for each, after which any record can be read alone. Records whose payload another
record already holds are rewritten as revisits on the way: headers stay, the payload goes.

The steps of the query: (1) tasks write their pages as monolithic archives of bounded size and return a
manifest; (2) the manifest alone is grouped by payload digest to find each payload's first record; (3) one
task an archive normalises it; (4) one task an archive reads the records back through the index. Page texts
never enter a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import in_pandas, join_skewed, materialise, new_path, open_store, table, write_atomic

#: Archives are closed at this many payload bytes or records, which bounds a task's memory and a group's rows.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 16 << 20, 20_000
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def record(kind: str, page_id: str | None, uri: str | None, payload: bytes, size: int, sha: str, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP headers, the full payload's length among them, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(uri)}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, a chunk at a time; raises where it ends within a member or its trailer."""
    z = None
    while data := stream.read(CHUNK):
        while data:
            z = z or zlib.decompressobj(31)
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = None
    if z is not None:
        raise ValueError("truncated gzip stream")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an inflated stream; holds one record at a time."""
    buf = bytearray()

    def more() -> bool:
        for c in chunks:
            buf.extend(c)
            return True
        return False

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("the stream ends within a record's headers")
                return
        version, *lines = bytes(buf[:end]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        need = end + 4 + int(head["Content-Length"]) + 4
        while len(buf) < need:
            if not more():
                raise ValueError("the stream ends within a record")
        yield head, bytes(buf[end + 4 : need - 4])
        del buf[:need]


def page_of(urn: str) -> str | None:
    """The page's id as it was written, null for none."""
    return urn.removeprefix("<urn:page:").removesuffix(">") or None


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """pages(page_id, url, html) -> manifest(archive, record, page_id, payload_bytes, payload_digest)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k, size, rows = TaskContext.get().partitionId(), 0, 0, []
        z, out = zlib.compressobj(1, zlib.DEFLATED, 31), io.BytesIO()

        def flush() -> pd.DataFrame:
            out.write(z.flush())
            name = f"{part:06d}-{k:05d}"
            write_atomic(folder, f"{name}.mono.warc.gz", out.getvalue())
            return pd.DataFrame([(name, *r) for r in rows], columns=["archive", "record", "page_id", "payload_bytes", "payload_digest"], dtype=object)

        for b in batches:
            for page_id, url, html in zip(b["page_id"], b["url"], b["html"], strict=True):
                payload = (html or "").encode()
                sha = digest(payload)
                out.write(z.compress(record("response", page_id, url, payload, len(payload), sha)))
                rows.append((len(rows), page_id, len(payload), sha))
                size += len(payload)
                if size >= ARCHIVE_BYTES or len(rows) >= ARCHIVE_RECORDS:
                    yield flush()
                    k, size, rows = k + 1, 0, []
                    z, out = zlib.compressobj(1, zlib.DEFLATED, 31), io.BytesIO()
        if rows:
            yield flush()

    cols = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return materialise(in_pandas(cols, write, "archive string, record int, page_id long, payload_bytes long, payload_digest string", ["page_id"]), "manifest")


def _parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_revisits(manifest: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record_type and refers_to by payload digest; payloads under `least_bytes` are all responses."""
    large = manifest.where(F.col("payload_bytes") >= least_bytes)
    first = materialise(large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "first-pages")
    named = join_skewed(manifest, first.select("payload_digest", "first_id"), "payload_digest", first.select("payload_digest", "n"), "n", max(1, manifest.count()))
    again = F.coalesce((F.col("payload_bytes") >= least_bytes) & (F.col("page_id") > F.col("first_id")), F.lit(False))
    return named.select(*manifest.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def normalise(decided: DataFrame, folder: str) -> DataFrame:
    """One task an archive: inflate once, a member for each record, index beside it -> archive, members, bytes."""

    def rewrite(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["archive"].iloc[0]
        refers = {int(n): None if pd.isna(r) else r for n, r in zip(rows["record"], rows["refers_to"], strict=True)}
        store, base = open_store(folder)
        out, index, at = io.BytesIO(), [], 0
        with store.open_input_stream(f"{base}/{name}.mono.warc.gz", compression=None) as stream:
            for n, (head, block) in enumerate(records(inflated(stream))):
                page_id, sha = page_of(head["WARC-Record-ID"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                kind = "revisit" if refers[n] is not None else "response"
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(record(kind, page_id, head["WARC-Target-URI"], payload, len(payload), sha, refers[n])) + z.flush()
                out.write(member)
                index.append(json.dumps({"urn": head["WARC-Record-ID"], "offset": at, "length": len(member), "digest": sha, "type": kind}))
                at += len(member)
        write_atomic(folder, f"{name}.warc.gz", out.getvalue())
        write_atomic(folder, f"{name}.warc.idx", "\n".join(index).encode())
        return pd.DataFrame({"archive": [name], "members": [len(index)], "bytes": [at]})

    # the manifest is small and would meet in one task: archives are dealt over as many as a shuffle has
    dealt = decided.select("archive", "record", F.col("refers_to").cast("string").alias("refers_to")).repartition(_parts(decided.sparkSession), "archive")
    return materialise(dealt.groupBy("archive").applyInPandas(rewrite, "archive string, members long, bytes long"), "archives")


def read_member(stream, entry: dict) -> tuple[dict[str, str], bytes]:
    """One record by its index line alone."""
    stream.seek(entry["offset"])
    data = zlib.decompress(stream.read(entry["length"]), 31)
    return next(records(iter([data])))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every member, response payloads hashed anew."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(folder)
        for b in batches:
            for name in b["archive"]:
                rows = []
                with store.open_input_stream(f"{base}/{name}.warc.idx", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().decode().split("\n") if x]
                with store.open_input_file(f"{base}/{name}.warc.gz") as f:
                    for e in entries:
                        head, block = read_member(f, e)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        if head["WARC-Type"] == "response" and (digest(payload) != sha or len(payload) != size):
                            raise ValueError(f"{name}: payload of {e['urn']} does not match its digest")
                        rows.append((page_of(head["WARC-Record-ID"]), size, sha, head["WARC-Type"], page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)

    spread = archives.select("archive").repartition(_parts(archives.sparkSession), "archive")
    return in_pandas(spread, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", ["page_id", "refers_to"])


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null html is an empty payload; a null page_id stays null and is a response; rows that repeat page_id and html are all responses or all revisits."""
    folder = new_path(spark, "warc")
    decided = with_revisits(write_monolithic(table(spark, sf_dir, "pages"), folder))
    return read_archives(normalise(decided, folder), folder)


QUERIES = {"op4_warc_normaliser": op4_warc_normaliser}
ORACLES = {
    "op4_warc_normaliser": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * g + 1, 5) AS INTEGER) >> CAST(s AS INTEGER)) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f"""
}
