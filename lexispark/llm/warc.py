"""WARC archives: write records with an index, then read selected records by coalesced byte ranges.

Records are gzip members of their own (the usual ``.warc.gz`` form), so any record can be read
alone. Tasks write their archives into the shared folder and return one index row per record
(file, offset, length, URL, digest); the index is a Parquet table. A retried task writes a new
file, and only the files of successful tasks are in the index.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from lexispark.functions.lineage import materialize, shared_dir

LEAST_REVISIT_BYTES = 1000
#: Ranges of a file no further apart than GAP are read at once, up to READ bytes.
GAP, READ = 64 << 10, 8 << 20
#: A task starts a further archive beyond this size.
ARCHIVE_BYTES = 1 << 30

INDEX = "file string, offset long, length long, record_id string, url string, digest string, record_type string"
RECORDS = "record_id string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string, file string, offset long"


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Rows to write: ``id, url, payload, record_type, refers_to``.

    Of equal payloads of at least ``least`` bytes the largest id's is the response and the others
    revisit it. Equal means same length, SHA-1 and SHA-256. Rows that repeat the largest id are all
    responses; rows without id are responses, as nothing can refer to them.
    """
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    key = [F.octet_length("payload").alias("_n"), F.sha1("payload").alias("_sha1"), F.sha2("payload", 256).alias("_sha2")]
    first = rows.filter(F.octet_length("payload") >= least).select("id", *key).groupBy("_n", "_sha1", "_sha2").agg(F.max("id").alias("_first"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    salted = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")))
    rows = rows.select("*", *key, F.pmod(F.xxhash64("id", "url"), F.lit(8)).alias("_salt"))
    revisit = F.col("_first").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("_first"))
    return rows.join(salted, ["_n", "_sha1", "_sha2", "_salt"], "left").select("id", "url", "payload", F.col("_sha1").alias("digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def record(id_: str, url: str, digest: str, kind: str, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC/1.1 record; a revisit has the digest and size of the full payload but not the payload."""
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{id_}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{refers_to}>"]
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def text_id(x) -> str | None:
    return None if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x)


def clean_url(url: str | None) -> str:
    """Header values are one line: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")


def write_archives(rows: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of :func:`classify` and return the index, a written table.

    Null ids are written as empty ids. An empty table writes nothing and gives an empty index.
    """
    folder = folder or f"{shared_dir(rows.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base, out, at, name = None, "", None, 0, ""
        try:
            for b in batches:
                index = []
                for id_, url, payload, digest, kind, refers in zip(b["id"], b["url"], b["payload"], b["digest"], b["record_type"], b["refers_to"], strict=True):
                    if out is not None and at >= archive_bytes:
                        out.close()
                        out = None
                    if out is None:
                        if store is None:
                            store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
                            store.create_dir(base, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    key = text_id(id_) or ""
                    data = gzip.compress(record(key, clean_url(url), digest, kind, text_id(refers), bytes(payload)), 4, mtime=0)
                    out.write(data)
                    index.append((f"{folder}/{name}", at, len(data), key, url, digest, kind))
                    at += len(data)
                yield pd.DataFrame(index, columns=["file", "offset", "length", "record_id", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    # ids as text keep their digits in pandas, where a column with nulls would become double
    texts = rows.withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return materialize(texts.mapInPandas(write, INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(first, past, start, end): runs of the sorted ranges to read at once."""
    first = 0
    for k in range(1, len(ranges) + 1):
        if k == len(ranges) or ranges[k][0] - sum(ranges[k - 1]) > GAP or sum(ranges[k]) - ranges[first][0] > READ:
            yield first, k, ranges[first][0], sum(ranges[k - 1])
            first = k


def read_records(index: DataFrame) -> DataFrame:
    """The records of the index rows, whichever were selected, as ``RECORDS``.

    Index rows are range-partitioned and sorted by file and offset, so a task reads its stretch of an
    archive in few requests. ``payload`` is null for revisits; of responses the digest is computed
    anew from the payload that was read, and a mismatch with the record's header fails the job.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, part in b.groupby("file", sort=False):
                store, path = fs.FileSystem.from_uri(file if "://" in file or file.startswith("file:") else f"file://{file}")
                ranges = list(zip(part["offset"].tolist(), part["length"].tolist(), strict=True))
                urls = part["url"].tolist()
                with store.open_input_file(path) as f:
                    for first, past, start, end in coalesced(ranges):
                        data = f.read_at(end - start, start)
                        out = []
                        for k in range(first, past):
                            offset, length = ranges[k]
                            fields, body = parse(gzip.decompress(data[offset - start : offset - start + length]))
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            full = fields["WARC-Type"] == "response"
                            if full and hashlib.sha1(body).hexdigest() != digest:
                                raise ValueError(f"{file} at {offset}: payload does not match its digest")
                            name = lambda x: fields[x].removeprefix("<urn:record:").removesuffix(">") if x in fields else None  # noqa: B023, E731
                            out.append((name("WARC-Record-ID") or None, urls[k], fields["WARC-Type"], name("WARC-Refers-To"), body if full else None, int(fields["X-Payload-Length"]), digest, file, offset))
                        yield pd.DataFrame(out, columns=["record_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "file", "offset"])

    by_place = index.select("file", "offset", "length", "url").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return by_place.mapInPandas(read, RECORDS)


def archive_pages(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write every page and read all records back: ``id_col`` and the columns of ``RECORDS``."""
    index = write_archives(classify(pages, id_col, **options))
    kind = pages.schema[id_col].dataType
    return read_records(index).select(F.col("record_id").cast(kind).alias(id_col), "url", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "payload", "payload_bytes", "payload_digest", "file", "offset")
