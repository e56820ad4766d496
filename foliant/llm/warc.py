"""WARC archives whose records are compressed one by one with a Zstandard dictionary that the archive itself carries."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, new_path, saved

#: Fixed by the format: the skippable frame that carries a dictionary, and the magic number of a frame.
DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
#: Bytes of records in an archive (one value in a table), of records a dictionary is built from, and of a dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 2 << 20, 64 << 10
LEVEL = 3
#: Fewer records than FEW are samples in pieces; and bytes of a dictionary that isn't trained.
FEW, PIECE_BYTES, PLAIN_BYTES = 64, 512, 4 << 10
TRAINED = bytes.fromhex("37a430ec")
#: Records are named by page_id.
PAGE_URI = "urn:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has no block; it names the response and the length of the payload."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{PAGE_URI}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE_URI}{refers_to}>"]
        block = b""
    else:
        block = payload
    lines += ["Content-Type: text/html", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:size]


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of records: trained, or, of too few records to train one, what the first ones begin with.

    The latter is a dictionary of plain content; readers tell the two by the first four bytes.
    """
    pieces = [x[i : i + PIECE_BYTES] for x in samples for i in range(0, len(x), PIECE_BYTES)] if len(samples) < FEW else samples
    total = sum(map(len, pieces))
    while size >= 1024 and total >= 8 * size:
        try:
            return zstandard.train_dictionary(size, pieces, k=256, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            size //= 4
    return b"".join(x[: PLAIN_BYTES // len(samples[:8])] for x in samples[:8])


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if content[:4] == TRAINED else zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Archives of up to `archive_bytes` of records: the dictionary's skippable frame, then a frame for each record."""

    def __init__(self, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES):
        self.most, self.head = archive_bytes, struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
        known = _dictionary(dictionary)
        known.precompute_compress(level=LEVEL)
        self.zstd, self.parts, self.size = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True), [], 0

    def add(self, raw: bytes) -> Iterator[bytes]:
        self.parts.append(self.zstd.compress(raw))
        self.size += len(self.parts[-1])
        if self.size >= self.most:
            yield from self.close()

    def close(self) -> Iterator[bytes]:
        if self.parts:
            yield self.head + b"".join(self.parts)
            self.parts, self.size = [], 0


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive's bytes; frames are found as they are decompressed."""
    known, at = None, 0
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        known, at = _dictionary(bytes(content[8 : 8 + size])), 8 + size
    zstd, view = zstandard.ZstdDecompressor(dict_data=known), memoryview(content)
    while at < len(content):
        frame = zstd.decompressobj()
        # A record is mostly far smaller than what is left; the window grows until the frame ends.
        raw, size, start = [], 1 << 12, at
        while not frame.eof and start < len(content):
            piece = view[start : start + size]
            raw.append(frame.decompress(piece))
            start, size = start + len(piece), size * 2
        if not frame.eof:
            raise ValueError("the archive ends within a record")
        at = start - len(frame.unused_data)
        yield parse(b"".join(raw))


def write_archives(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 0, scope: str = "") -> str:
    """Writes a record for each row and returns the path of the archives: a table with one archive's bytes in each row.

    Of rows with equal payloads of at least min_revisit bytes, those with the smallest page_id are responses, the others
    revisit it; null page_ids come last, and where all are null, all are responses. Smaller payloads are all responses.
    Null html is an empty payload, a null url no URI. Records are named by page_id, so that repeated ones share a name.
    A task builds its dictionary from the first records it is to write, up to SAMPLE_BYTES, and every archive begins
    with it. A task holds one archive, and a long record, at a time. An empty table gives none.
    The table is written by Spark, so that a lost task leaves nothing half-written; export() makes files of it.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    keyed = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload")).withColumn("key", F.unhex(F.sha1("payload")))
    first = F.min("page_id").alias("first")
    large = keyed.where(F.octet_length("payload") >= min_revisit)
    firsts = saved(large.groupBy("key").agg(first, F.count("*").alias("n")).where("n > 1 and first is not null").select("key", "first"), "warc-firsts", scope)
    rows = keyed.join(lookup(firsts), "key", "left").select("page_id", "url", "payload", "key", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                columns = [batch.column(i) for i in range(5)]
                for i in range(batch.num_rows):
                    page, link, payload, key, first = (c[i].as_py() for c in columns)
                    again = first is not None and page != first and len(payload) >= min_revisit
                    yield record("revisit" if again else "response", page, link, payload, base64.b32encode(key).decode(), first if again else None)

        waiting, size, every = [], 0, records()
        for raw in every:
            waiting.append(raw)
            size += len(raw)
            if size >= SAMPLE_BYTES:
                break
        if not waiting:
            return
        writer = Writer(build_dictionary(waiting))
        for raw in waiting:
            yield from map(_row, writer.add(raw))
        waiting.clear()
        for raw in every:
            yield from map(_row, writer.add(raw))
        yield from map(_row, writer.close())

    path = new_path(spark, "warc", scope)
    rows.mapInArrow(write, "content binary").write.parquet(path)
    return path


def _row(content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"content": pa.array([content], pa.binary())})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits).

    Lengths and digests of responses are computed from the payload that was read; a digest that differs from the
    record's own is an error. Those of revisits are the record's.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                for fields, block in read_archive(content.as_py()):
                    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if kind == "response" and (base32_sha1(block), len(block)) != (digest, size):
                        raise ValueError("a payload differs from its digest")
                    page, first = fields["WARC-Record-ID"][1:-1].removeprefix(PAGE_URI), fields.get("WARC-Refers-To", "")[1:-1].removeprefix(PAGE_URI)
                    out.append((int(page) if page else None, fields.get("WARC-Target-URI"), kind, size, digest, int(first) if first else None, block if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return spark.read.schema("content binary").parquet(path).mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def export(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Copies the archives into files `<n>.warc.zst` of a folder that Spark can write to, one at a time through the driver."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = []
    for i, row in enumerate(spark.read.parquet(path).toLocalIterator()):
        names.append(f"{folder}/{i:05d}.warc.zst")
        out = fs.create(fs_path(names[-1]), True)
        out.write(bytearray(row["content"]))
        out.close()
    return names


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(spark, write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
