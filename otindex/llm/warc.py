"""WARC archives: a deterministic sharded writer and a reader, with revisit records for equal payloads.

Pages are range-partitioned and sorted by page_id; each task writes its range to ``.warc.gz`` files of
one gzip member per record, beginning another file when the compressed size passes a limit, and
commits them through temporary names and a manifest (see :mod:`otindex.llm.files`). Names, order and
bytes depend on the pages only, so a retried task writes the same archive.

Of records with equal payloads the one with the largest page_id is a response and the others are
revisits. Which these are is found on (page_id, digest) alone: a grouped maximum, combined before
the shuffle, and a join back that adaptive execution splits where one payload holds very many
pages. The result travels as marker rows through the same range partitioning as the pages and
stands right before its page there, so page contents are shuffled once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otindex.llm.bytes_ import as_bytes
from otindex.llm.files import MANIFEST_SCHEMA, RollingWriter, commit, manifest, one_file_per_task

#: Compressed bytes after which a file is full.
FILE_BYTES = 256 << 20

#: The date of all records; archives are reproducible.
DATE = "2000-01-01T00:00:00Z"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{copy}')}>"


def _header_value(text: str) -> str:
    """A header value on one line; the reader undoes it."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace("\0", "%00")


def _plain_value(text: str) -> str:
    return text.replace("%00", "\0").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{name}: {value}" for name, value in headers.items() if value is not None]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, copy: int, refers_to: tuple | None) -> bytes:
    """The record of a page: a response, or a revisit of the page ``refers_to[0]``."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": record_id(page_id, digest, copy),
        "WARC-Target-URI": None if url is None else _header_value(url),
        "X-Page-ID": None if page_id is None else str(page_id),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is None:
        return record("response", headers, http + payload)
    headers["WARC-Profile"] = _PROFILE
    headers["WARC-Refers-To"] = record_id(refers_to[0], digest)
    headers["X-Refers-To-Page-ID"] = None if refers_to[0] is None else str(refers_to[0])
    return record("revisit", headers, http)


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, html) to archives in ``folder`` and return the manifest.

    Payloads are the html in UTF-8; null html is empty. Equal payloads of at least ``least_bytes``
    bytes become one response and revisits of it, smaller ones are all responses. Repeated rows are
    written too; of equal payloads under the largest page_id the first is the response. A null
    page_id counts as the smallest, a null url is left out. Other columns are ignored.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html")).withColumn("digest", F.sha1("html"))
    heads = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    shared = heads.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    earlier = (F.col("page_id") < F.col("refers_to")) | (F.col("page_id").isNull() & F.col("refers_to").isNotNull())
    marks = heads.join(shared.drop("n"), "digest").where(earlier).select("page_id", "digest", "refers_to").distinct()
    nothing = F.lit(None)
    both = rows.withColumn("refers_to", nothing.cast("long")).withColumn("page", F.lit(1)).unionByName(
        marks.select("page_id", nothing.cast("string").alias("url"), nothing.cast("binary").alias("html"), "digest", "refers_to", F.lit(0).alias("page"))
    )
    sorted_rows = (
        both.repartitionByRange("page_id", "digest")
        .sortWithinPartitions("page_id", "digest", "page", "url")
        .withColumn("task", F.spark_partition_id())
    )

    def write(batches):
        out, key, copy, mark = None, None, 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "digest", "page", "refers_to", "url")]
            for page_id, digest, page, refers_to, url, payload in zip(
                *columns, as_bytes(batch.column("html")).to_pylist(), strict=True
            ):
                if out is None:
                    task = batch.column("task")[0].as_py()
                    info = record("warcinfo", {"WARC-Record-ID": record_id(task, "warcinfo"), "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    out = RollingWriter(folder, task, "pages", ".warc.gz", file_bytes, info)
                if (page_id, digest) != key:
                    key, copy, mark = (page_id, digest), 0, None
                if not page:
                    mark = (refers_to,)
                    continue
                again = (page_id,) if copy and len(payload) >= least_bytes else None
                out.write(page_record(page_id, url, payload, copy, mark or again))
                copy += 1
        if out is not None:
            yield from out.manifest()

    return commit(sorted_rows.mapInArrow(write, MANIFEST_SCHEMA), folder)


def records(stream):
    """(headers, block) of every record of an open archive, checked against its block digest."""
    with gzip.GzipFile(fileobj=stream) as text:
        while first := text.readline():
            if not first.startswith(b"WARC/"):
                raise ValueError("not at the start of a WARC record")
            headers = {}
            while (line := text.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                headers[name] = value
            block = text.read(int(headers["Content-Length"]))
            if text.read(4) != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
                raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
            yield headers, block


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The pages of the committed archives in ``folder``.

    (page_id, url, payload_bytes, payload_digest, record_type, refers_to), and with ``payloads`` the
    payload (null for revisits). Size and digest of a response are those of the payload that was
    read; those of a revisit are the ones it states for the payload it refers to.
    """
    files = one_file_per_task(manifest(spark, folder).select("name"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    fields = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    width = len(names) if payloads else len(names) - 1

    def read(batches):
        store, path = pafs.FileSystem.from_uri(folder)

        def table(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types[:width])], names[:width])

        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        page_id, refers_to, url = (headers.get(k) for k in ("X-Page-ID", "X-Refers-To-Page-ID", "WARC-Target-URI"))
                        response = headers["WARC-Type"] == "response"
                        size = len(payload) if response else int(http.rpartition(b"Content-Length: ")[2])
                        digest = base32_sha1(payload) if response else headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        row = (
                            None if page_id is None else int(page_id),
                            None if url is None else _plain_value(url),
                            size,
                            digest,
                            headers["WARC-Type"],
                            None if refers_to is None else int(refers_to),
                            payload if response else None,
                        )
                        rows.append(row[:width])
                        held += len(payload) if payloads else 0
                        if len(rows) >= 4096 or held > 16 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    return files.mapInArrow(read, fields + (", payload binary" if payloads else ""))
