"""WARC archives, each record a Zstandard frame of its own, with a shared dictionary.

Writing: a dictionary is trained on a bounded sample of the records that are to be archived, headers and
all, and stands at the head of every file in a skippable frame; then every record follows as one frame
that the dictionary decodes.  Of records with equal payloads the one with the smallest page id is a
response, the others are revisits that name it and hold the HTTP header only.  Tasks write their own
files, under names that no other attempt shares, straight to the shared folder; only files named in the
manifest exist for readers, so a lost executor's half-written file is never read.

A record's id is a name-based UUID of page id and payload; rows that repeat both have a number of their
own in it as well.  Page ids stand in the fields ``Page-ID`` and ``Refers-To-Page-ID``, which are no part of
the standard.  The pages have no time of their own: ``WARC-Date`` is a parameter.

Reading: files are dealt to tasks, which decode frame by frame and give one row for each record.
Digests and lengths of responses are taken from the payload read back.

Defined results: a null page counts as empty; payloads shorter than ``least_bytes`` are responses
all of them.  Repeated rows with the smallest id are responses all of them; null ids come after all
others, so a group of nulls only is all responses.  An empty table gives no file and no row.  Other
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

DICTIONARY_MAGIC = 0x184D2A5D  # skippable frame that holds the dictionary
CRLF = b"\r\n"


@dataclass(frozen=True)
class WarcConfig:
    dictionary_bytes: int = 64 << 10
    sample_records: int = 512  # bound of the sample that the dictionary is built from
    sample_bytes: int = 16 << 10  # of each sampled record, from its start
    level: int = 6
    least_bytes: int = 0  # shorter payloads are never revisits
    date: str = "2024-01-01T00:00:00Z"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples' own bytes; nothing for none."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def header_block(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def one_line(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


@dataclass(frozen=True)
class Page:
    """One row to archive.  ``number`` tells apart the rows that repeat id and payload; null if there is one only."""

    page_id: int | None
    url: str | None
    payload: bytes
    refers_to: int | None
    first_is_single: bool  # the response that a revisit refers to has the id of its page and payload
    number: int | None


NAMES = uuid.UUID("6f1c7f0a-52d5-5d0e-9c39-6b1a1f4a7c11")


def record_id(page_id: int | None, digest: str, number: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {digest} {number}')}>"


def make_record(page: Page, date: str) -> bytes:
    """One WARC/1.1 record."""
    http = header_block("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(page.payload)))])
    revisit = page.refers_to is not None
    block = http if revisit else http + page.payload
    digest = payload_digest(page.payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page.page_id, digest, page.number)),
        ("WARC-Target-URI", one_line(page.url or "")),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("Page-ID", "" if page.page_id is None else str(page.page_id)),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", str(page.refers_to))]
        if page.first_is_single:
            fields.append(("WARC-Refers-To", record_id(page.refers_to, digest, None)))
    return header_block("WARC/1.1", fields) + block + CRLF * 2


def parse_header(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(CRLF * 2)
    lines = head.decode().split("\r\n")[1:]
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines), rest


def write_file(pages: Iterator[Page], out, dictionary: bytes, cfg: WarcConfig) -> int:
    """Write the dictionary's frame and one frame for each row; returns the number of records."""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=cfg.level, dict_data=shared, write_checksum=True)
    if dictionary:
        held = zstandard.ZstdCompressor(level=cfg.level).compress(dictionary)
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held)
    n = 0
    for page in pages:
        out.write(packer.compress(make_record(page, cfg.date)))
        n += 1
    return n


def read_file(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, one frame after the other."""
    data = stream.read(step)
    shared = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size:
            data += stream.read(step)
        shared = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        data = data[8 + size :]
    unpacker = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
    while data or (data := stream.read(step)):
        frame, parts = unpacker.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(step)):
                raise EOFError("an archive ends inside a record")
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple[int | None, str, str, int | None, bytes, int, str]:
    """page_id, url, type, refers_to, payload, full payload's bytes, its digest."""
    head, block = parse_header(raw)
    http, body = parse_header(block[: int(head["Content-Length"])])
    number = lambda name: int(head[name]) if head.get(name) else None
    page_id, refers, kind = number("Page-ID"), number("Refers-To-Page-ID"), head["WARC-Type"]
    if kind == "response":
        return page_id, head["WARC-Target-URI"], kind, refers, body, len(body), payload_digest(body)
    return page_id, head["WARC-Target-URI"], kind, refers, body, int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")


def digest_of(html: str) -> Column:
    return F.sha1(F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8"))


def assign_roles(pages: DataFrame, cfg: WarcConfig, key: str, html: str) -> DataFrame:
    """(page_id, digest, refers_to, single, first_is_single): distinct pairs of id and payload.

    ``refers_to`` is null for responses; ``single`` pairs have one row.
    """
    size = F.octet_length(F.coalesce(F.col(html), F.lit("")))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), digest_of(html).alias("digest"), size.alias("bytes"))
    keyed = rows.groupBy("page_id", "digest").agg(F.min("bytes").alias("bytes"), (F.count("*") == 1).alias("single"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "single")))
    first = keyed.groupBy("digest").agg(least.alias("first"), F.count("*").alias("n")).filter("n > 1")
    own = (F.col("bytes") < cfg.least_bytes) | F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first.page_id"))
    known = keyed.join(first, "digest", "left")
    return known.select("page_id", "digest", F.when(~own, F.col("first.page_id")).alias("refers_to"), "single", F.coalesce("first.single", F.lit(False)).alias("first_is_single"))


#: Columns of the rows that tasks make records of.
RECORD = ["page_id", "url", "html", "refers_to", "first_is_single", "number"]


def pages_of(batch: pa.RecordBatch) -> Iterator[Page]:
    for page_id, url, html, refers_to, first_is_single, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield Page(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, first_is_single, number)


def sampled_records(full: DataFrame, roles: DataFrame, cfg: WarcConfig) -> list[bytes]:
    """The starts of at most ``sample_records`` of the records to come, responses and revisits in their proportion."""
    chosen = roles.orderBy(F.xxhash64("page_id", "digest"), "page_id", "digest").limit(cfg.sample_records).drop("page_id")
    rows = full.join(F.broadcast(chosen), ["name", "digest"]).dropDuplicates(["name", "digest"]).withColumn("number", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([make_record(p, cfg.date)[: cfg.sample_bytes] for p in pages_of(batch)], pa.binary())], ["record"])

    return sorted(bytes(r["record"]) for r in rows.select(RECORD).mapInArrow(run, "record binary").collect())


def write_archives(pages: DataFrame, folder: str | None = None, cfg: WarcConfig = WarcConfig(), key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` and return the manifest (path, records): one row for each finished archive."""
    spark = pages.sparkSession
    folder = folder or posixpath.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("name")  # a key that is never null
    roles = cut(assign_roles(pages, cfg, key, html).select("*", name))
    full = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).select("page_id", "url", "html", name, digest_of("html").alias("digest"))
    slim = roles.select("name", "digest", "refers_to", "single", "first_is_single")
    records = sampled_records(full, roles.drop("single"), cfg) if not roles.isEmpty() else []
    dictionary = spark.sparkContext.broadcast(train_dictionary(records, cfg.dictionary_bytes) if records else b"")
    # Joined by id and payload: a payload that very many pages share doesn't meet in one task.
    ready = full.join(slim, ["name", "digest"]).withColumn("number", F.when(~F.col("single"), F.monotonically_increasing_id())).select(RECORD)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (page for batch in batches for page in pages_of(batch))
        head = next(rows, None)
        if head is None:
            return
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"

        def again():
            yield head
            yield from rows

        with store.open_output_stream(posixpath.join(path, name), compression=None) as out:
            n = write_file(again(), out, dictionary.value, cfg)
        yield pa.RecordBatch.from_arrays([pa.array([posixpath.join(folder, name)]), pa.array([n], pa.int64())], ["path", "records"])

    return cut(ready.mapInArrow(write, "path string, records long"))


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row for each record of the archives that ``manifest`` (path) names."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for paths in batches:
            for path in paths.column(0).to_pylist():
                store, at = open_store(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for raw in read_file(stream):
                        page_id, url, kind, refers, body, size, digest = parse_record(raw)
                        rows.append((page_id, url, kind, refers, size, digest, *[body] * payloads))
                        held += len(body) * payloads
                        if len(rows) >= 10_000 or held > 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = manifest.select("path").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return files.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads)
