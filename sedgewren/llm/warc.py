"""WARC archives compressed with an embedded Zstandard dictionary.

An archive is one file: a skippable frame that holds the dictionary, then one Zstandard frame a record, compressed with
it, so records can be read one by one. The dictionary is built from the archive's own first records. Pages with equal
payloads are stored once, by the largest id; the others become revisit records that point to it.

Archives are written by the tasks that hold the pages, under a name of the task's partition, first to a temporary name
and then moved, so that a task that is run again replaces its own work. They go to the folder all executors share, by
any file system that pyarrow opens.

Defined results: a null payload counts as empty; empty payloads equal each other. Payloads below `least` bytes are never
revisits. Rows that repeat a page id are each archived; null ids and addresses are written as such. No pages, no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sedgewren.llm.common import prepare, schema_of, tidy
from sedgewren.session import materialize, shared_path, table

#: The skippable frame of dictionaries, and the WARC version line.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Records and bytes that a dictionary is built from, at most, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 4 << 20, 32 << 10
LEVEL = 3


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str) -> bytes:
    """A response or revisit record. Revisits keep the payload's size and digest, not its bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    name = lambda i: record_id(f"page:{i}")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record."""
    if not raw.startswith(VERSION):
        raise ValueError("not a WARC record")
    head, _, rest = raw[len(VERSION) :].partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n"))
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of another length than it says")
    return fields, block


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; too few or too small ones serve as they are."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: Iterator[bytes], out) -> tuple[int, int]:
    """Writes the dictionary frame and a frame a record; gives the numbers of records and of bytes."""
    first, held = [], 0
    for r in records:
        first.append(r)
        held += len(r)
        if len(first) >= SAMPLE_RECORDS or held >= SAMPLE_BYTES:
            break
    dictionary = build_dictionary(first)
    raw = dictionary.as_bytes()
    out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    n, size = 0, 8 + len(raw)
    for some in (first, records):
        for r in some:
            frame = coder.compress(r)
            out.write(frame)
            n, size = n + 1, size + len(frame)
    return n, size


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one by one; holds one read's worth and one record."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    raw = stream.read(size)
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT))
    rest = b""
    while True:
        one, out = coder.decompressobj(), io.BytesIO()
        while not one.eof:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    if out.tell():
                        raise ValueError("archive ends within a record")
                    return
            out.write(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield out.getvalue()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def payload_of(html: Column) -> Column:
    """Hexadecimal SHA-1 of the payload; a page id that repeats with another payload has another role."""
    return F.sha1(F.encode(F.coalesce(html, F.lit("")), "UTF-8"))


def roles(pages: DataFrame, least: int) -> DataFrame:
    """page_id, payload, refers_to of the pages that are revisits: slim rows, grouped and joined by payload digest."""
    slim = pages.select("page_id", payload_of(F.col("html")).alias("payload"), F.length(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("size"))
    slim = slim.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    kept = slim.groupBy("payload").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return slim.join(kept, "payload").where("page_id <> refers_to").select("page_id", "payload", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archives all pages (page_id, url, html) under the folder; gives one row an archive: path, records, bytes."""
    prepare(pages.sparkSession)
    named = pages.select("page_id", "url", "html", payload_of(F.col("html")).alias("payload"))
    dealt = named.join(roles(pages, least), ["page_id", "payload"], "left").select("page_id", "url", "html", "refers_to")
    schema = schema_of("path string, records long, bytes long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    yield record(page_id, url, payload, digest_of(payload), refers_to, "response" if refers_to is None else "revisit")

        made = records()
        first = next(made, None)
        if first is None:
            return
        system, place = opened(folder)
        system.create_dir(place, recursive=True)
        name = f"{place}/pages-{TaskContext.get().partitionId():06d}.warc.zst"
        mine = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"

        def all_records() -> Iterator[bytes]:
            yield first
            yield from made

        with system.open_output_stream(mine, compression=None) as out:
            n, size = write_archive(all_records(), out)
        system.move(mine, name)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([n]), pa.array([size])], schema=arrow)

    return dealt.mapInArrow(tidy(run), schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record of the archives named in the path column. Payloads of responses are checked against their digest."""
    prepare(archives.sparkSession)
    schema = schema_of("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                system, place = opened(path)
                with system.open_input_stream(place, compression=None) as stream:
                    for raw in read_archive(stream):
                        fields, block = parse(raw)
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload, size = None, int(fields["X-Payload-Length"])
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if len(payload) != size or digest_of(payload) != digest:
                                raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                        number = lambda k: int(fields[k]) if fields.get(k) else None
                        rows.append((number("X-Page-Id"), fields["WARC-Target-URI"], kind, size, digest, number("X-Refers-To-Page"), payload))
                        held += len(raw)
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return archives.select("path").mapInArrow(tidy(run), schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = materialize(write_archives(pages, shared_path(spark, "warc")), "archives")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_archives(archives.repartition(n, "path")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
