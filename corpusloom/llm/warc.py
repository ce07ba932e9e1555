"""WARC archives: one gzip member for each record, read back sequentially.

``write_archives`` deals pages to tasks; each task writes files of at most FILE_BYTES into the shared folder and returns
their names, which are written as the manifest.  Files of lost or repeated tasks are not in it and never read.  Pages
whose payload equals that of a page with a smaller page_id become revisit records without payload.
``read_archives`` streams each file in small reads, inflates member after member, frames blocks by Content-Length and
verifies block and payload digests, and that a file holds as many records as its manifest says.  Damage is an error of
the job with strict, else a row with ``error``, after which reading goes on at the next gzip member.  ``checked`` holds
revisits against their responses.

Defined cases: a null html is an empty payload; a null url leaves out the target; rows that repeat both page_id and
payload are response records all; a page without page_id revisits a page that has one and an equal payload, else it is a
response; further columns of pages are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, free, materialise, own, shared_dir, table

FILE_BYTES, READ, LEVEL = 64 << 20, 1 << 16, 6
MEMBER = b"\x1f\x8b\x08"
DATE, PAGE = "1970-01-01T00:00:00Z", "urn:corpus:page:"
RECORD = {
    "file": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
    "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "error": pa.string(),
}
SCHEMA = "file string, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = f"{PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}|{sha1(payload)}')}"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{PAGE}{refers_to}>")]
    head += [("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return member.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + member.flush()


def members(stream) -> Iterator[tuple[bytes, str | None]]:
    """The inflated bytes of each gzip member of a stream; after damage, nothing and what is wrong, once, and then the
    members from the next one on that can be inflated.  Holds the compressed bytes of one member."""
    rest, sound = b"", True
    while rest or (rest := stream.read(READ)):
        inflate, parts, raw = zlib.decompressobj(31), [], [rest]
        try:
            parts.append(inflate.decompress(rest))
            while not inflate.eof:
                raw.append(stream.read(READ))
                if not raw[-1]:
                    raise ValueError("the archive ends within a record")
                parts.append(inflate.decompress(raw[-1]))
        except (ValueError, zlib.error) as broken:
            if sound:
                yield b"", str(broken)
            held, sound = b"".join(raw), False
            while (at := held.find(MEMBER, 1)) < 0 and (more := stream.read(READ)):
                held = held[-len(MEMBER):] + more
            rest = held[at:] if at > 0 else b""
            continue
        rest, sound = inflate.unused_data, True
        yield b"".join(parts), None


def fields(data: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the one record in a member."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    version, named = fields(head)
    if not mark or not version.startswith("WARC/"):
        raise ValueError("no WARC header")
    size = int(named["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the block")
    if named.get("warc-block-digest", f"sha1:{sha1(block)}") != f"sha1:{sha1(block)}":
        raise ValueError("the block's digest differs")
    return named, block


def page_of(name: str | None) -> int | None:
    name = (name or "").strip("<>")
    return int(name.removeprefix(PAGE)) if name.startswith(PAGE) else None


def described(file: str, named: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(fields(head)[1].get("content-length", len(payload)))
    digest, kind = named.get("warc-payload-digest", "").removeprefix("sha1:"), named.get("warc-type")
    if kind == "response" and (size != len(payload) or digest != sha1(payload)):
        raise ValueError("the payload's digest differs")
    return {
        "file": file, "page_id": page_of(named.get("warc-record-id")), "url": named.get("warc-target-uri"), "record_type": kind,
        "refers_to": page_of(named.get("warc-refers-to")), "payload": payload, "payload_bytes": size, "payload_digest": digest, "error": None,
    }


def records(file: str, stream, expected: int | None = None) -> Iterator[dict]:
    """A row for each record, and for each damaged one, with its error; expected: how many there must be."""
    blank, good = dict.fromkeys(RECORD) | {"file": file}, 0
    for member, broken in members(stream):
        try:
            row = blank | {"error": broken} if broken else described(file, *parsed(member))
        except (ValueError, KeyError) as wrong:
            row = blank | {"error": f"{type(wrong).__name__}: {wrong}"}
        good += row["error"] is None
        yield row
    if expected is not None and good != expected:
        yield blank | {"error": f"{good} of {expected} records"}


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with ``_refers``: the smallest page_id of an equal payload, where that is another page."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    digest, same, first = free(pages, "_digest", "_same", "_first")
    digested = pages.withColumn(digest, F.sha2(payload, 256))
    often = digested.where(F.length(payload) >= min_bytes).groupBy(F.col(digest).alias(same)).agg(F.count("*").alias("n"), F.min("page_id").alias(first))
    often = materialise(often.where("n > 1").drop("n"), "warc-equal")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col(first))
    joined = digested.join(broadcast_if_small(often), F.col(digest) == F.col(same), "left")
    return joined.select(*own(pages, "_refers"), F.when(later, F.col(first)).alias("_refers"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html); the manifest: file and number of records."""
    bound_batches(pages.sparkSession)

    def write(batches):
        store, folder = pyarrow.fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        file, out, size, n = "", None, 0, 0
        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    file, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(file, compression=None)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n])], ["file", "records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n])], ["file", "records"])

    rows = with_revisits(pages.select("page_id", "url", "html"), min_bytes).select(F.col("page_id").cast("long"), "url", "html", F.col("_refers").cast("long"))
    return materialise(rows.mapInArrow(write, "file string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, path: str, payloads: bool = True, strict: bool = False, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row for each record of the files in the manifest, in the columns of SCHEMA; strict: the first damage is an error."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in RECORD.items()], list(RECORD))

    def read(batches):
        store, _ = pyarrow.fs.FileSystem.from_uri(path)
        rows, held = [], 0
        for files in batches:
            for file, expected in zip(files.column(0).to_pylist(), files.column(1).to_pylist()):
                with store.open_input_stream(file, compression=None) as stream:
                    for row in records(file, stream, expected):
                        if strict and row["error"]:
                            raise ValueError(f"{file}: {row['error']}")
                        rows.append(row if payloads else row | {"payload": None})
                        held += 200 + len(row["payload"] or b"") * payloads
                        if held >= batch_bytes:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    return manifest.select("file", "records").repartition(n, "file").mapInArrow(read, SCHEMA)


def unmatched(found: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, payload_bytes) of revisits to which no response of that page_id and payload belongs."""
    sides = (found.where(F.col("record_type") == kind).select(F.col(key).alias("refers_to"), "payload_digest", "payload_bytes").distinct() for kind, key in (("revisit", "refers_to"), ("response", "page_id")))
    revisits, responses = sides
    return revisits.join(responses, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def checked(found: DataFrame) -> DataFrame:
    """found, written; an error if a revisit has no response that it equals."""
    found = materialise(found, "warc-read")
    if wrong := unmatched(found).limit(3).collect():
        raise ValueError(f"revisits without their response: {wrong}")
    return found


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), path)
    return checked(read_archives(manifest, path, payloads=False, strict=True).drop("payload")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, payload, sha1(payload) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM d),
c AS (SELECT page_id, payload_bytes, first, unnest(range(8)) AS i, h FROM f),
v AS (SELECT page_id, payload_bytes, first, i, ('0x' || substr(h, 5 * i + 1, 5))::BIGINT AS v FROM c),
b AS (SELECT page_id, payload_bytes, first, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) ||
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) ||
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1), '' ORDER BY i) AS payload_digest FROM v GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM b
"""
