"""WARC archives: written one gzip member per record, read back sequentially.

Of pages with equal payloads the one with the largest id becomes a response record and the
others become revisits that refer to it and carry only the HTTP header.  The reader knows
nothing but the archive: it inflates members one after the other as bytes come in, frames each
record by its Content-Length and checks its digests; a damaged or cut archive raises.

Defined results: a null html is an empty payload; of rows alike in id and payload one is the
response; a null id is smaller than any other; every row gives one record; other columns are
ignored.  Archives go to the shared folder under names of their task attempt, and only names
that committed tasks report are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import _place, grouped, marked, partitions, saved, shared_dir, texts

#: Compressed bytes after which a task starts its next archive; bytes that the reader asks for at once.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 1 << 18
DATE = "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn != _urn(None) else None


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record as one gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    else:
        block += payload
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """Each gzip member of a stream, inflated as its bytes come in."""
    inflate, parts, left = None, [], b""
    while data := left or stream.read(READ_BYTES):
        inflate = inflate or zlib.decompressobj(31)
        parts.append(inflate.decompress(data))
        left = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts = None, []
    if inflate:
        raise ValueError("the archive ends within a record")


def _headers(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines.decode().split("\r\n")[1:])}


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, framed by Content-Length, its block digest checked."""
    for data in members(stream):
        head, found, rest = data.partition(b"\r\n\r\n")
        if not found or not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = _headers(head)
        n = int(headers["content-length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} isn't as long as it says")
        if (said := headers.get("warc-block-digest")) and said != f"sha1:{digest(rest[:n])}":
            raise ValueError(f"record {headers.get('warc-record-id')}: block digest differs")
        yield headers, rest[:n]


def parse(headers: dict[str, str], block: bytes) -> dict:
    """What an HTTP response or revisit record says of its page; the payload's digest is checked."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, said = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(_headers(head)["content-length"])
    if kind == "response" and (len(payload) != size or digest(payload) != said):
        raise ValueError(f"record {headers['warc-record-id']}: payload differs from its digest or length")
    refers = _page(headers["warc-refers-to"]) if kind == "revisit" else None
    return {"page_id": _page(headers["warc-record-id"]), "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": refers}


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write a record per page; returns (file), the archives' addresses.  Payloads shorter than
    ``least`` bytes are never revisited."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            data = list(texts(batch, "html"))
            columns = [pa.array(range(row, row + len(data)), pa.int64()), batch.column(0), batch.column(1), pa.array(data, pa.binary())]
            columns += [pa.array([digest(x) for x in data]), pa.array([hashlib.sha256(x).digest() for x in data]), pa.array([len(x) for x in data], pa.int64())]
            row += len(data)
            yield pa.RecordBatch.from_arrays(columns, ["row", "page_id", "url", "payload", "digest", "same", "bytes"])

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uris = None, []
        for batch in batches:
            for x in batch.to_pylist():
                if out is None or out.tell() >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    uris.append(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    store, path = _place(uris[-1])
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                out.write(record(x["page_id"], x["url"], x["payload"], x["digest"], x["refers_to"], x["revisit"]))
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string())], ["file"])

    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = saved(cut.mapInArrow(digests, "row long, page_id long, url string, payload binary, digest string, same binary, bytes long"), "warc-rows")
    # SHA-1 names payloads in the archive, but pages can be made to share one: SHA-256 tells them apart.
    first = rows.where(F.col("bytes") >= least).groupBy(F.col("same").alias("g_same"), F.col("bytes").alias("g_bytes"))
    first = first.agg(F.max(F.struct("page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Most payloads are alone; only those that may repeat are dealt out.
    told = marked(rows, F.xxhash64("same"), first, F.xxhash64("g_same"))
    met = told.where("maybe").join(first, (F.col("same") == F.col("g_same")) & (F.col("bytes") == F.col("g_bytes")), "left")
    revisit = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    common = ["page_id", "url", "payload", "digest"]
    written = met.select(*common, F.col("first.page_id").alias("refers_to"), revisit.alias("revisit"))
    written = told.where("not maybe").select(*common, F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit")).unionAll(written)
    return saved(written.mapInArrow(archive, "file string"), "warc-files")


def read(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    store, path = _place(uri)
                    # No compression: the reader itself inflates.
                    with store.open_input_stream(path, compression=None) as stream:
                        for headers, block in records(stream):
                            yield parse(headers, block)

        yield from grouped(rows(), pa.schema(fields), 4096)

    spread = files.select("file").repartition(max(partitions(files.sparkSession), 8), "file")
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages as archives, then tell what the archives say of every page."""
    return read(write(pages, least))
