"""WARC archives: written with an index of every record, read back by coalesced byte ranges.

Writing: each attempt of a task writes an archive of its own, of gzip members (one record each), and gives an index row per
record: file, offset, length, key, URL, digest, kind. The index holds the rows of committed attempts only, so a late or
repeated attempt's archive is never read. Of records with equal payloads of at least ``least`` bytes, the one with the smallest key
is a response and the others are revisit records, which hold no payload but name the digest, the length and the
response's key. Equal payloads meet by digest only; the payloads themselves are not sorted, and digests that occur once
leave the join early.

Reading: the index comes first. The selected index rows are range-partitioned and sorted by (file, offset), neighbouring
ranges become one read, and each record is parsed and checked against its digest.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, table
from .files import Reader, whole_file

DATE = "1970-01-01T00:00:00Z"
INDEX = "key long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
MAX_RUN, MAX_GAP = 8 << 20, 64 << 10


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. Control characters and blanks at the ends of a URL are percent-encoded (and stay so) to keep the header whole."""
    uri = None if url is None else re.sub(r"[\x00-\x1f\x7f]|^ +| +$", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), url)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"{key} {url} {digest}")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {uri}"] if uri is not None else []), f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        *([f"X-Record-Key: {key}"] if key is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        *([f"X-Refers-To-Key: {refers_to}"] if revisit and refers_to is not None else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the block's payload; a block cut short is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip(" ") for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("record cut short")
    return fields, block.partition(b"\r\n\r\n")[2]


def write(spark: SparkSession, pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, date: str = DATE, level: int = 4) -> DataFrame:
    """Write ``pages`` as WARC files in ``folder``; returns the index, a table in the shared folder.

    A null payload is empty; null keys and URLs have no header. Rows that share the smallest key of a payload are all
    responses. Extra columns are not stored, whatever their names. A payload of any length is one record. An empty table
    gives an empty index.
    """
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.length("payload"))
    firsts = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = materialize(spark, firsts.select("digest", "first"), "firsts")
    known = rows.join(firsts, "digest", "left")
    known = known.select("key", "url", "payload", "digest", "first", F.coalesce(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False)).alias("revisit"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, offset = TaskContext.get(), 0
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        with whole_file(folder, name) as out:
            for batch in batches:
                found = []
                for k, u, p, d, first, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(record(k, u, p, d, first, again, date)) + packer.flush()
                    out.write(member)
                    found.append((k, u, name, offset, len(member), len(p), d, "revisit" if again else "response", first if again else None))
                    offset += len(member)
                yield _batch(found, INDEX)

    return materialize(spark, known.mapInArrow(archive, INDEX), "warc-index")


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def read(spark: SparkSession, selected: DataFrame, folder: str, *, payloads: bool = True, most: int = MAX_RUN, gap: int = MAX_GAP) -> DataFrame:
    """The records of the ``selected`` index rows, from the archives. A revisit has a null payload."""
    schema = RECORD + ", payload binary" * payloads

    def one(span: tuple, raw: memoryview) -> tuple:
        fields, body = parse(zlib.decompress(raw, 31))
        kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
        if kind == "response":
            if hashlib.sha256(body).hexdigest() != digest:
                raise ValueError(f"{span[0]}, {span[1]}: the payload does not have its digest")
            size = len(body)
        number = lambda x: None if x is None else int(x)
        return (number(fields.get("x-record-key")), fields.get("warc-target-uri"), size, digest, kind, number(fields.get("x-refers-to-key")), *[body if kind == "response" else None] * payloads)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        spans = (span for batch in batches for span in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out, size = [], 0
        for r in reader.runs(spans, one, most, gap):
            out.append(r)
            size += r[2] if payloads else 100
            if size > most:
                yield _batch(out, schema)
                out, size = [], 0
        yield _batch(out, schema)
        reader.close()

    spans = selected.select("file", "offset", "length")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spans.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(records, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as the archives have it. Pages that repeat a payload's smallest page_id are all responses."""
    folder = scratch_path(spark, "warc")
    index = write(spark, table(spark, sf_dir, "pages"), folder)
    return read(spark, index, folder, payloads=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when f.first is not null and page_id is distinct from f.first then 'revisit' else 'response' end as record_type,
  case when f.first is not null and page_id is distinct from f.first then f.first end as refers_to
from p left join f using (payload_digest)
"""
