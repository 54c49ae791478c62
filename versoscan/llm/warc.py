"""A dictionary-compressed WARC writer and reader.

A Zstandard dictionary is built from a bounded sample of the records to archive. Each archive starts with it, in a
skippable frame of magic 0x184D2A5D as the WARC-with-Zstandard convention asks, and every record is a frame of its own.
Archives are written by Spark's text sink: a row is one archive and the line separator is an empty skippable frame,
which readers pass over, so the files are valid Zstandard streams and the sink's commit protocol covers lost executors.
A task starts a new archive, with the dictionary, once the frames of the last one hold FILE_BYTES, so a file is never
larger than that and one more record, and reading one takes no more memory.

Defined results: a null html is an empty payload; a null url leaves the target header out; of rows with equal payloads
of at least 100 bytes the ones with the least page_id are responses (all of them, if rows are repeated), the others,
a null page_id among them, revisit it; with only null ids all are responses; an empty table gives no rows; pages of any
length are archived whole; other columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.llm.shared import shared_dir, table

DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # a skippable frame (0x184D2A50) of no bytes
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16_384, 65_536
FILE_BYTES = 32 << 20  # of compressed records, after which a new archive starts
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record, headers and block."""
    block = HTTP if revisit else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\n" in url or "\r" in url else f"WARC-Target-URI: {url}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def train(pages: DataFrame, records: int = SAMPLE_RECORDS, sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the records of at most ``records`` pages, those with the least hash of page_id and url.

    A long page gives its first ``sample_bytes`` bytes; only the ratio depends on that, all pages are archived whole.
    Where the sample is too small to train on, the records themselves are the dictionary; without any it is empty.

    The hashes are chosen first: only those below a bound that some 2 * ``records`` rows pass are gathered, however many
    tasks there are, and the bodies of the chosen ones, one each, alone reach the driver.
    """
    h = F.xxhash64("page_id", "url")
    share = min(1.0, 2 * records / max(1, pages.count()))
    below = min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1)
    least = pages.select(h.alias("h")).where(F.col("h") <= below).distinct().orderBy("h").limit(records)
    body = F.substring(F.coalesce("html", F.lit("")), 1, sample_bytes).alias("html")
    chosen = pages.select(h.alias("h"), "page_id", "url", body).join(F.broadcast(least), "h")
    rows = chosen.groupBy("h").agg(F.min(F.struct("html", "page_id", "url")).alias("r")).select("h", "r.*").orderBy("h").collect()
    samples = [record(r.page_id, r.url, body := r.html.encode()[:sample_bytes], hashlib.sha256(body).hexdigest(), None, False) for r in rows]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def plan_records(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with digest, refers_to (null for responses) and revisit.

    Only groups of several equal payloads are joined back, on the digest; the least page_id is a partially aggregated
    minimum, and a very large group is the side of the join that adaptive execution can split.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumn("digest", F.sha2("html", 256))
    groups = (
        keyed.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest")
        .agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").select("digest", "least")
    )
    joined = keyed.join(groups.hint("shuffle_hash"), "digest", "left")
    revisit = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("least")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(pages: DataFrame, path: str, dictionary: bytes, level: int = 6, file_bytes: int = FILE_BYTES) -> None:
    """Writes all pages as archives below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        head = dictionary_frame(dictionary)
        frames, held = [head], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], names=["archive"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")), strict=True):
                page_id, url, html, digest, refers_to, revisit = row
                frames.append(packer.compress(record(page_id, url, html.encode(), digest, refers_to, revisit)))
                held += len(frames[-1])
                if held >= file_bytes:
                    yield archive()
                    frames, held = [head], 0
        if held:
            yield archive()

    archives = plan_records(pages).mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def frames_of(content: memoryview) -> Iterator[bytes]:
    """The records of one archive, uncompressed, its dictionary taken from its leading frame."""
    unpacker, at = zstandard.ZstdDecompressor(), 0
    while at < len(content):
        (magic,) = struct.unpack_from("<I", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (size,) = struct.unpack_from("<I", content, at + 4)
            if magic == DICTIONARY_MAGIC and size:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(content[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        one, out = unpacker.decompressobj(), []
        while not one.eof:
            step = content[at : at + 16_384]
            if not len(step):
                raise ValueError("an archive ends inside a record")
            out.append(one.decompress(step))
            at += len(step) - len(one.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and its payload (the block behind the HTTP headers)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    A response's length and digest are taken from the payload that was read, a revisit's from its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for raw in frames_of(memoryview(content.as_buffer())):
                    h, payload = parse(raw)
                    response = h["WARC-Type"] == "response"
                    number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    rows.append((
                        number("X-Page-ID"), h.get("WARC-Target-URI"), len(payload) if response else number("X-Payload-Length"),
                        hashlib.sha256(payload).hexdigest() if response else h["WARC-Payload-Digest"].removeprefix("sha256:"),
                        h["WARC-Type"], number("X-Refers-To-Page-ID"), payload if response else None,
                    ))
                    held += len(payload)
                    if held > 8 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, train(pages))
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest from p),
g as (select payload_digest, min(page_id) as least, count(*) as n from q where payload_bytes >= 100 group by payload_digest)
select q.page_id, cast(q.payload_bytes as bigint) as payload_bytes, q.payload_digest,
  case when g.n > 1 and g.least is not null and q.page_id is distinct from g.least then 'revisit' else 'response' end as record_type,
  case when g.n > 1 and q.page_id is distinct from g.least then g.least end as refers_to
from q left join g using (payload_digest)
"""
