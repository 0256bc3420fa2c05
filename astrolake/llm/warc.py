"""WARC archives: written by tasks, indexed, and read back by byte ranges.

Every task writes one archive of gzip members and returns one index row per record: file, offset,
length, URL and digest.  The index is a table.  A reader selects index rows, sorts them by file and
offset, and joins neighbouring records to one read each.

Files carry the task attempt in their name and the index lists only those of finished attempts, so
a lost or repeated task leaves an unused file and no wrong row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.session import work_folder, write_table

DATE = "1970-01-01T00:00:00Z"
# Records at most this far apart are read together, up to this much at once.
GAP = 64 << 10
RANGE = 8 << 20

INDEX = ("_id string, url string, file string, offset bigint, length bigint, digest string, "
         "record_type string, refers_to string")


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _line(value: str | None) -> str:
    """A header value; line ends, which no URL or id should have, are percent-encoded."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record(name: str | None, url: str | None, payload: bytes, digest: str, first: str | None,
           first_url: str | None) -> bytes:
    """One WARC record.  A revisit (`first` is given) has the response's HTTP header as its block,
    which states the length of the payload it leaves out."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if first is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_line(name)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{_line(first)}>",
            f"WARC-Refers-To-Target-URI: {_line(first_url)}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload of one record."""
    def headers(block: bytes) -> dict[str, str]:
        pairs = (line.split(": ", 1) for line in block.decode().split("\r\n")[1:])
        return {key.lower(): value for key, value in pairs}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = headers(head)
    block = rest[:int(warc["content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(head), payload


def with_first(df: DataFrame, id_column: str, url_column: str, text_column: str,
               least: int = 0) -> DataFrame:
    """(_id, _url, _text, _digest, _first, _first_url): of payloads that are equal and have at least
    `least` bytes, every row but those with the largest id refers to that id.

    Equality is that of SHA-1 and length.  The rows of a digest are folded before they move; the
    join back splits a digest that many rows share.
    """
    pages = df.select(
        F.col(id_column).alias("_id"), F.col(url_column).alias("_url"),
        F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
    ).withColumns({
        "_digest": F.sha1(F.encode("_text", "UTF-8")), "_bytes": F.octet_length("_text"),
    })
    first = pages.where(F.col("_bytes") >= least).groupBy("_digest", "_bytes").agg(
        F.max("_id").alias("_first"), F.max_by("_url", "_id").alias("_first_url"),
        F.count("*").alias("_rows"),
    ).where("_rows > 1").drop("_rows")
    joined = pages.join(first, ["_digest", "_bytes"], "left")
    other = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    return joined.select(
        "_id", "_url", "_text", "_digest", F.when(other, F.col("_first")).alias("_first"),
        F.when(other, F.col("_first_url")).alias("_first_url"),
    )


def write_archives(df: DataFrame, id_column: str, url_column: str, text_column: str,
                   folder: str | None = None, least: int = 0) -> DataFrame:
    """Write a record per row and give the index, as a table that has been written.

    `folder` is a URI that all executors reach; by default a new one in the folder of
    `spark.checkpoint.dir`.  A null text is an empty payload, a null URL an empty one; a row without
    id never is the one others refer to.  Rows with the same id and payload are alike.
    """
    folder = folder or f"{work_folder(df.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    rows = with_first(df, id_column, url_column, text_column, least).withColumns({
        "_id": F.col("_id").cast("string"), "_first": F.col("_first").cast("string"),
    })

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/{context.partitionId():06}-{context.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(name, compression=None)
            index = []
            for page, url, text, digest, first, first_url in zip(
                *(column.to_pylist() for column in batch.columns)
            ):
                digest = base32(digest)
                data = record(page, url, text.encode(), digest, first, first_url)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                out.write(member)
                index.append((page, url, name, at, len(member), digest,
                              "response" if first is None else "revisit", first))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*index), _INDEX.types)],
                schema=_INDEX,
            ) if index else pa.RecordBatch.from_pylist([], _INDEX)
        if out is not None:
            out.close()

    path = write_table(rows.mapInArrow(write, INDEX), "warc-index")
    return df.sparkSession.read.parquet(path).withColumn("folder", F.lit(folder))


_INDEX = pa.schema([
    ("_id", pa.string()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
    ("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.string()),
])


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int, int]]:
    """(file, first byte, byte after, first row, row after) of reads over sorted (file, offset,
    length) rows: near records of one file share a read."""
    begin = 0
    for i in range(1, len(rows) + 1):
        file, offset, _ = rows[begin]
        end = max(o + n for _, o, n in rows[i - 1:i])
        if i < len(rows) and rows[i][0] == file and rows[i][1] - end <= GAP \
                and rows[i][1] + rows[i][2] - offset <= RANGE:
            continue
        yield file, offset, end, begin, i
        begin = i


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the given index rows: (_id, url, record_type, payload_bytes, payload_digest,
    refers_to, payload).

    A response's digest is computed from the payload read and must equal the stored one.  A revisit
    states length and digest of the payload it refers to; its own payload is null.  With `payloads`
    off, no payload is returned.
    """
    slim = index.select("file", "offset", "length", "digest", "folder")
    ordered = slim.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    schema = pa.schema([
        ("_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
        ("payload", pa.binary()),
    ])

    def page(value: str | None) -> str | None:
        return value[len("<urn:page:"):-1] or None if value else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            digests = batch.column(3).to_pylist()
            if not rows:
                continue
            store, _ = fs.FileSystem.from_uri(batch.column(4)[0].as_py())
            name, source = None, None
            for file, lo, hi, first, last in ranges(rows):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(file)
                data = source.read_at(hi - lo, lo)
                out = []
                for at in range(first, last):
                    begin = rows[at][1] - lo
                    warc, http, payload = parse(
                        zlib.decompress(data[begin:begin + rows[at][2]], 31))
                    digest = warc["warc-payload-digest"].removeprefix("sha1:")
                    size = int(http["content-length"])
                    if digest != digests[at]:
                        raise ValueError(f"index and record differ in {file} at {rows[at][1]}")
                    if warc["warc-type"] == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != digest or len(payload) != size:
                            raise ValueError(f"damaged record in {file} at {rows[at][1]}")
                    out.append((
                        page(warc["warc-record-id"]), warc["warc-target-uri"],
                        warc["warc-type"], size, digest, page(warc.get("warc-refers-to")),
                        payload if payloads and warc["warc-type"] == "response" else None,
                    ))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            source.close()

    return ordered.mapInArrow(
        read, "_id string, url string, record_type string, payload_bytes bigint, "
              "payload_digest string, refers_to string, payload binary")
