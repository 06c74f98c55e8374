"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import filesystem, new_dir, slices, stored, write_file

#: Magic number of the skippable frame that holds an archive's dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Records to train on: at most so many, of payloads of at most so many bytes, those of least hash.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 32_000, 96 << 10
#: An archive is closed beyond so many compressed bytes.
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
#: A payload is hot if this share of all rows has it; there are no more hot ones than its inverse.
HOT = 1 / 1_000
#: Bytes of payloads that a task holds at a time, unless one is longer.
PAYLOAD_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{urn(page_id)}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {target}"] if target else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"WARC-Refers-To: <{urn(refers_to)}>", f"WARC-Profile: {PROFILE}"] if revisit else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def urn(page_id: int | None) -> str:
    return f"urn:newsloom:page:{'' if page_id is None else page_id}"


def _id(header: str) -> int | None:
    text = header.strip("<>").rpartition(":")[2]
    return int(text) if text else None


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Archive:
    def __init__(self, uri: str, dictionary: bytes):
        self.uri, self.n = uri, 0
        target, path = filesystem(uri)
        self.out = target.open_output_stream(path)
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.bytes = 8 + len(packed)
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True).compress

    def add(self, data: bytes) -> None:
        frame = self.compress(data)
        self.out.write(frame)
        self.bytes += len(frame)
        self.n += 1

    def done(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.n, self.bytes


def read_archive(uri: str, piece: int = 1 << 16):
    """The records of an archive, one bytes object each, holding one record and one piece of the file at a time."""
    source, path = filesystem(uri)
    with source.open_input_stream(path) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{uri} does not begin with a dictionary")
        packed = f.read(size)
        own = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed)) if packed else None
        decompressor = zstandard.ZstdDecompressor(dict_data=own)
        rest = f.read(piece)
        while rest:
            frame, parts = decompressor.decompressobj(), []
            while not frame.eof:
                if not rest and not (rest := f.read(piece)):
                    raise ValueError(f"{uri} ends within a record")
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
            yield b"".join(parts)
            rest = rest or f.read(piece)


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not the one recorded")
    return {"page_id": _id(headers["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": _id(headers["WARC-Refers-To"]) if kind == "revisit" else None}


def train_dictionary(pages: DataFrame, date: str) -> bytes:
    """Made in one task from at most SAMPLE_RECORDS records; empty where there are too few to train on."""
    short = pages.where(F.octet_length("html") <= SAMPLE_BYTES)
    order = F.xxhash64("page_id", "url")
    share = min(1.0, 2.0 * SAMPLE_RECORDS / max(1, short.select("page_id").count()))
    chosen = short.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(order, "page_id").limit(SAMPLE_RECORDS)

    def train(batches):
        samples = []
        for batch in slices(batches, 2, PAYLOAD_BYTES):
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode("utf-8", "surrogatepass")
                samples.append(record(page_id, url, payload, sha1_base32(payload), None, False, date))
        total, dictionary = sum(map(len, samples)), b""
        if len(samples) >= 8 and total >= 16384:
            try:
                dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 4), samples).as_bytes()
            except zstandard.ZstdError:  # the samples have too little in common
                pass
        yield pa.RecordBatch.from_arrays([pa.array([dictionary], pa.binary())], names=["dictionary"])

    made = chosen.select("page_id", "url", "html").repartition(1).mapInArrow(train, "dictionary binary").first()
    return bytes(made.dictionary) if made else b""


def write_archives(pages: DataFrame, out: str | None = None, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the list of archives: path, n_records, bytes.

    Of records whose payloads (html in UTF-8, null: empty) are equal and of least_bytes at least, the one of smallest
    page_id is a response and the others are revisits of it; all smaller payloads are responses. Rows that repeat the
    smallest id are all responses; a null id is never smallest, and rows of a payload that only has null ids are all
    responses. Files count only if the list, a table in `out`, names them: an attempt of a task has names of its own.
    """
    spark = pages.sparkSession
    out = out or new_dir(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    dictionary = train_dictionary(rows, date)
    write_file(f"{out}/archives/.dictionary", dictionary)  # makes the folder
    keyed = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    equal = keyed.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    equal = stored(equal.select(F.col("digest").alias("d"), "first", "n"), "equal")
    hot = F.col("n") >= HOT * keyed.count()
    few = equal.where(hot).select(F.col("d").alias("hot"), F.col("first").alias("hot_first"))
    joined = keyed.join(F.broadcast(few), F.col("digest") == F.col("hot"), "left")  # at most 1 / HOT rows
    # What is settled goes through the second join under keys of its own, so that no task gets all rows of a payload.
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.xxhash64("page_id", "url").cast("string").cast("binary"))
    joined = joined.withColumn("key", key).join(equal.where(~hot).select("d", "first"), F.col("key") == F.col("d"), "left")
    joined = joined.select("page_id", "url", "html", F.coalesce("hot_first", "first").alias("first"))

    def write(batches):
        context, made, archive, listed = TaskContext.get(), 0, None, []
        for batch in slices(batches, 2, PAYLOAD_BYTES):
            for page_id, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4))):
                payload = html.encode("utf-8", "surrogatepass")
                revisit = first is not None and page_id != first
                if archive is None:
                    archive = Archive(f"{out}/archives/part-{context.partitionId():06d}-{made:04d}-{context.taskAttemptId()}.warc.zst", dictionary)
                archive.add(record(page_id, url, payload, sha1_base32(payload), first, revisit, date))
                if archive.bytes > ARCHIVE_BYTES:
                    listed.append(archive.done())
                    made, archive = made + 1, None
        if archive is not None:
            listed.append(archive.done())
        if listed:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*listed)], names=["path", "n_records", "bytes"])

    schema = "path string, n_records long, bytes long"
    joined.mapInArrow(write, schema).write.parquet(f"{out}/list")
    return spark.read.schema(schema).parquet(f"{out}/list")


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; payloads are held against their digests."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    fields = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for data in read_archive(path):
                    rows.append(parse(data))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=fields)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    n = archives.count()
    paths = archives.select("path")
    return (paths.repartition(n) if n else paths).mapInArrow(read, schema)  # an archive a task


ORACLE = """
with p as (select page_id, coalesce(html, '') as payload from pages),
k as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as hex from p),
d as (select *, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::int >> (15 - 5 * (i % 4)::int)) & 31), 1), '' order by i)
      from range(32) as t(i)) as payload_digest from k),
f as (select *, min(page_id) over (partition by hex, payload_bytes) as first from d)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id = first then null else first end as refers_to from f
"""
