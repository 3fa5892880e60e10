"""WARC archives with an index first, and coalesced byte-range reads of selected records.

Every task writes its pages as gzip members, one per record, and returns an index
row per record: file, offset, length, URL, digest. The index is a table. Reading
starts from index rows: they are sorted by file and offset, neighbouring ranges
are read in one request, and members are unpacked from it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import bounded_batches, partitions, written
from reviewlake.session import work_dir

#: Payloads of fewer bytes are always stored again.
MIN_REVISIT_BYTES = 0
#: Ranges closer than this are read together, up to READ_BYTES at once.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: A task starts another archive beyond this size.
FILE_BYTES = 1 << 30

#: Ids travel as text: a nullable number would lose digits in pandas.
INDEX = (
    "page_id string, url string, file string, offset bigint, length bigint, payload_digest string, "
    "payload_bytes bigint, record_type string, refers_to string"
)
RECORD = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record: headers, an HTTP response block (without its body in a revisit), two line ends."""
    body = payload if refers_to is None else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + body
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "urn:none", safe=";/?:@&=+$,#%-_.!~*'()[]"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        fields["X-Page-Id"] = page_id
    if refers_to is not None:
        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page": refers_to}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """What a record says; a response's digest and length come from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), sha1_base32(payload)
    else:
        size = int(http.rpartition(b"Content-Length: ")[2])
        digest, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
    return {
        "page_id": page,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": refers,
        "payload": payload,
    }


def decide(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with the page their record refers to (null: it is stored as a response).

    Only digests leave the pages for the grouping; the counts are combined before
    they are shuffled, and a digest of one page takes no part in the join, so a
    payload that a third of all pages share is one row there.
    """
    keyed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    first = (
        keyed.groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    again = (F.octet_length("html") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return keyed.join(first, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "html",
        F.when(again, F.col("first")).cast("string").alias("refers_to"),
    )


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("page_id", "refers_to")})


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page and return the index, a table in the work folder.

    Null html is an empty payload. Of pages of equal payload (of ``min_bytes`` or
    more) the smallest page_id is the response and the others revisit it; rows that
    repeat that page_id are responses too, and pages without an id are revisits, or
    all responses if no page of the payload has an id. Empty tables give an empty
    index; other columns are not read. A task names its files by its attempt, so a
    task run again leaves no half-written file in the index.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    base = (folder or work_dir(spark, "warc")).rstrip("/")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        part, offset, out, name = 0, 0, None, ""
        store, root = fs.FileSystem.from_uri(base)
        for frame in frames:
            if frame.empty:
                continue
            rows = []
            for page_id, url, html, refers in zip(frame["page_id"], frame["url"], frame["html"], frame["refers_to"]):
                if out is None or offset > FILE_BYTES:
                    if out is not None:
                        out.close()
                        part += 1
                    offset, name = 0, f"pages-{attempt:08d}-{part:04d}.warc.gz"
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                digest = sha1_base32(payload)
                member = gzip.compress(record(page_id, url, payload, digest, refers, date), 6, mtime=0)
                out.write(member)
                kind = "response" if refers is None else "revisit"
                rows.append((page_id, url, name, offset, len(member), digest, len(payload), kind, refers))
                offset += len(member)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")], dtype=object)
        if out is not None:
            out.close()

    index = written(decide(pages, min_bytes).mapInPandas(write, INDEX), "warc-index")
    return numbered(index).withColumn("file", F.concat(F.lit(f"{base}/"), F.col("file")))


def ranges(offsets: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Slices of the sorted records to read in one request each."""
    out, start = [], 0
    for i in range(1, len(offsets) + 1):
        if i < len(offsets):
            gap = offsets[i] - offsets[i - 1] - lengths[i - 1]
            if gap <= GAP_BYTES and offsets[i] + lengths[i] - offsets[start] <= READ_BYTES:
                continue
        out.append((start, i))
        start = i
    return out


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the index rows select, unpacked.

    Rows are dealt by file and offset, so that a large archive is read by many
    tasks, each by ascending ranges.
    """
    spark = index.sparkSession
    bounded_batches(spark)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, stream = "", None
        for frame in frames:
            if frame.empty:
                continue
            rows = []
            for file, group in frame.groupby("file", sort=False):
                if file != opened:
                    if stream is not None:
                        stream.close()
                    store, path = fs.FileSystem.from_uri(file)
                    opened, stream = file, store.open_input_file(path)
                offsets, lengths = group["offset"].to_numpy(), group["length"].to_numpy()
                for a, b in ranges(offsets, lengths):
                    begin = int(offsets[a])
                    data = stream.read_at(int(offsets[b - 1] + lengths[b - 1]) - begin, begin)
                    for o, n in zip(offsets[a:b] - begin, lengths[a:b]):
                        rows.append(parse_record(gzip.decompress(data[o : o + n])))
            found = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")], dtype=object)
            if not with_payload:
                found["payload"] = None
            yield found
        if stream is not None:
            stream.close()

    chosen = index.select("file", "offset", "length").repartitionByRange(partitions(spark), "file", "offset")
    records = numbered(chosen.sortWithinPartitions("file", "offset").mapInPandas(read, RECORD))
    return records if with_payload else records.drop("payload")
