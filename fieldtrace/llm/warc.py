"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id; each task rolls to a new file when the compressed size is reached. A file is
written under a temporary name of its own attempt; the manifest rows of the attempts that Spark accepts are
cut, and a job over the manifest renames those files to their final names. Other attempts' files are never
named and are removed with the temporary folder, so lost executors and speculative tasks do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, text_or_empty

#: Compressed bytes after which a file is closed; payloads below this length are always stored; gzip level.
ROLL, LEAST, LEVEL = 8 << 20, 100, 3
#: Rows of a range partition, about.
ROWS = 4096
#: Fixed date of all records, so that the same rows give the same bytes.
DATE = "2000-01-01T00:00:00Z"


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"urn:uuid:{uuid5(NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, its headers and digests made anew; a revisit has no payload."""
    digest = sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    target = "".join(c for c in url or "" if c.isprintable()).strip() or "urn:none"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id(page_id, digest)}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower case) and block of one record. ValueError if lengths or digests don't fit."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != "sha256:" + sha256(block).hexdigest():
        raise ValueError("a broken block")
    return fields, block


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file."""
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data) + one.flush()
        data = one.unused_data


def revisits(pages: DataFrame) -> DataFrame:
    """(digest, first): the smallest id of payloads of LEAST bytes or more that more than one record has."""
    shown = pages.filter(F.octet_length("html") >= LEAST).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    return shown.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("_digest"), "first")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives below ``folder`` and returns the committed manifest: path, shard, part, records, bytes, sha256.

    ``pages`` has page_id, url, html. Null html is an empty payload, a null url a placeholder; a null
    page_id is written without an id, as a response. Of repeated rows with the same id, the later ones revisit the first.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    #: Written first, so that its size is known: it is broadcast only below Spark's threshold, and pages then aren't shuffled for it.
    revisits(rows).write.mode("overwrite").parquet(f"{folder}/_first")
    first = spark.read.parquet(f"{folder}/_first")
    shards = max(1, -(-rows.count() // ROWS))
    dupes = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).join(first, F.col("digest") == F.col("_digest"), "left")
    own = dupes.select("page_id", "url", "html", "first").repartitionByRange(shards, "page_id").sortWithinPartitions("page_id", "url", "html")
    temporary = f"{folder}/_temporary"
    schema = "name string, temporary string, shard int, part int, records long, bytes long, sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(temporary)
        system.create_dir(root, recursive=True)
        shard, part, out, held, n, last = TaskContext.get().partitionId(), 0, [], [], 0, None

        def close() -> None:
            nonlocal part, held, n
            if held:
                data, name = b"".join(held), f"{uuid4().hex}.warc.gz"
                with system.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write(data)
                out.append((f"pages-{shard:06d}-{part:05d}.warc.gz", name, shard, part, len(held), len(data), sha256(data).hexdigest()))
                part, held, n = part + 1, [], 0

        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                for page, url, html, first_ in zip(*(c.to_pylist() for c in batch.slice(i, 128).columns), strict=True):
                    refers = first_ if first_ is not None and page is not None and (page > first_ or last == (page, html)) else None
                    last = (page, html)
                    z = zlib.compressobj(LEVEL, wbits=31)
                    made = z.compress(record(page, url, html.encode(), refers)) + z.flush()
                    held.append(made)
                    n += len(made)
                    if n >= ROLL:
                        close()
        close()
        if out:
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    manifest = cut(own.mapInArrow(run, schema))
    return commit(manifest, folder)


def commit(manifest: DataFrame, folder: str) -> DataFrame:
    """Renames the manifest's files to their final names, then writes the manifest. A repeated task finds its work done."""
    temporary = f"{folder}/_temporary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, made in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, root = fs.FileSystem.from_uri(folder)
                here, there = f"{root}/_temporary/{made}", f"{root}/{name}"
                if system.get_file_info(here).type == fs.FileType.File:
                    system.move(here, there)
                elif system.get_file_info(there).type != fs.FileType.File:
                    raise FileNotFoundError(there)
            yield batch

    done = cut(manifest.mapInArrow(run, manifest.schema))
    rows = done.select(F.concat(F.lit(folder + "/"), "name").alias("path"), "shard", "part", "records", "bytes", "sha256")
    rows.write.mode("overwrite").parquet(f"{folder}/_manifest")
    spark = manifest.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(temporary)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return rows


def read(spark, folder: str) -> DataFrame:
    """One row per record of the archives below ``folder``: page_id, record_type, payload_bytes, payload_digest, refers_to, target, payload.

    Payload length and digest of a revisit are those of the full payload, from its headers.
    """
    schema = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, target string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for one in members(data.as_py()):
                    head, block = parse(one)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    kind = head["warc-type"]
                    if kind == "response" and (len(payload) != length or sha256(payload).hexdigest() != digest):
                        raise ValueError("a broken payload")
                    page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
                    rows.append((page and int(page), kind, length, digest, refers and int(refers), head["warc-target-uri"], payload))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(run, schema)


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: all pages written to archives in the
    shared folder and read back.

    A null html is the empty payload; null page_ids are kept and come last; repeated rows are records of their own;
    a payload of any length is one record; other columns aren't read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid4().hex}"
    if write(pages, folder).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
