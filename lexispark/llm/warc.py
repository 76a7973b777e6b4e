"""WARC archives compressed with Zstandard, with a dictionary in the leading skippable frame.

write() deals pages to tasks, and each task writes archives of at most ARCHIVE_BYTES (payload bytes) into a
shared folder: first a skippable frame that holds the dictionary, then one Zstandard frame for each record.
Of records with equal payloads of at least LEAST_REVISIT bytes the one with the largest page_id is a
response and the others revisit it. An archive's dictionary is trained on the first records that it holds.

read() reads such files, also others' (with no dictionary, or one that is itself compressed), in parallel:
the dictionary is loaded, frames are decoded one by one, and the header lines, lengths and digests of each
record are checked. A record that fails is returned with what is wrong in the column error.

Files are written under a name of their own and renamed when whole; names and contents depend on the rows
of the partition alone, so a task that runs again writes the same files.

Defined cases: null html is an empty payload; a null url is written as urn:page:<id>; white space and control
characters of a url are percent-encoded; equal page_ids with equal payloads are all responses if theirs is
the largest; a null page_id is never revisited as long as there is another; a payload of any length is one record, in one
frame; repeated rows are records of their own; an empty table gives no archives and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import common
from lexispark.session import remove, scratch

#: Smallest payload that is revisited, payload bytes in an archive, dictionary size and bytes it is trained on.
LEAST_REVISIT, ARCHIVE_BYTES, DICT_BYTES, TRAIN_BYTES = 1000, 32 << 20, 16 << 10, 1 << 20
#: Magic numbers of skippable frame, dictionary and frame; WARC version and revisit profile.
SKIPPABLE, DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
VERSION, PROFILE = b"WARC/1.1", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2000-01-01T00:00:00Z"
_BAD_URL = re.compile(r"[\x00-\x20\x7f]")


def roles(pages: DataFrame) -> DataFrame:
    """The pages (page_id, url, html) with payload_digest, payload_bytes and refers_to (null for responses)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    own = own.withColumn("payload_digest", F.sha1(F.col("html").cast("binary"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    # Large payloads with a copy; the join is on a digest, of which AQE splits the frequent ones.
    again = own.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    again = common.cut(again.where("n > 1").drop("n"))
    columns = ("page_id", "url", "html", "payload_digest", "payload_bytes")
    # Only payloads that may have a copy are shuffled; the others are responses where they are.
    marked = common.filtered(own, again, ["payload_digest"], "again", again.count())
    out = marked.where("again").join(again, "payload_digest", "left")
    refers = F.when(F.col("payload_bytes") >= LEAST_REVISIT, F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")))
    return marked.where(~F.col("again")).select(*columns, F.lit(None).cast("long").alias("refers_to")).union(out.select(*columns, refers.alias("refers_to")))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; the block of a revisit is the HTTP header alone."""
    name = "none" if page_id is None else str(page_id)
    uri = _BAD_URL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{name}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    sha = base64.b32encode(bytes.fromhex(digest))
    block_sha = base64.b32encode(hashlib.sha1(block).digest())
    lines = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:" + name.encode() + b">", b"WARC-Date: " + DATE, b"WARC-Target-URI: " + uri.encode("utf-8", "replace"), b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: sha1:" + sha, b"WARC-Block-Digest: sha1:" + block_sha]
    if refers_to is not None:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A whole file: the dictionary frame (if there is enough to train one on) and a frame for each record."""
    held, samples = 0, []
    for r in records:
        samples.append(r[:8192])
        held += len(samples[-1])
        if held >= TRAIN_BYTES:
            break
    trained = None
    if len(samples) >= 16 and held >= 8 * DICT_BYTES:
        try:
            trained = zstd.train_dictionary(DICT_BYTES, samples, k=256, d=8)
        except zstd.ZstdError:  # samples that have too little in common
            trained = None
    out = io.BytesIO()
    if trained is not None:
        raw = trained.as_bytes()
        out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        trained.precompute_compress(level=3)
    packer = zstd.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    for r in records:
        out.write(packer.compress(r))
    return out.getvalue()


def frames(data: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of each Zstandard frame, from block headers; skippable frames are passed over.

    Each step goes on by some bytes and is checked against the end, so any file is read to its end or to an error.
    """
    at = 0
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if at + 8 > len(data) or end > len(data):
                raise ValueError(f"the skippable frame at byte {at} is cut off")
            at = end
            continue
        if data[at : at + 4] != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        size = at + 4 < len(data) and zstd.frame_header_size(data[at : at + 18])
        end, last = at + (size or len(data)), False
        while not last:
            if end + 3 > len(data):
                raise ValueError(f"the frame at byte {at} is cut off")
            head = int.from_bytes(data[end : end + 3], "little")
            end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            last = bool(head & 1)
        end += 4 * bool(data[at + 4] & 4)
        if end > len(data):
            raise ValueError(f"the frame at byte {at} is cut off")
        yield at, end
        at = end


def dictionary(data: bytes) -> zstd.ZstdCompressionDict | None:
    """The dictionary of the leading skippable frame; it may be compressed itself."""
    if len(data) < 8 or int.from_bytes(data[:4], "little") != SKIPPABLE:
        return None
    size = int.from_bytes(data[4:8], "little")
    raw = data[8 : 8 + size]
    if len(raw) < size:
        raise ValueError("the dictionary is cut off")
    if raw[:4] == FRAME_MAGIC:
        raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
    if raw[:4] != DICT_MAGIC:
        raise ValueError("the leading frame holds no dictionary")
    return zstd.ZstdCompressionDict(raw)


@dataclass
class Record:
    """A decoded record; error says what is wrong with it."""

    page_id: int | None = None
    url: str | None = None
    record_type: str | None = None
    payload: bytes = b""
    payload_bytes: int | None = None
    payload_digest: str | None = None
    refers_to: int | None = None
    error: str | None = None


def headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("a header line without a name")
        out[name.strip().decode().lower()] = value.strip().decode("utf-8", "replace")
    return out


def page_number(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def parse(raw: bytes) -> Record:
    """Checks version, needed headers, lengths and digests."""
    r = Record()
    try:
        top, gap, rest = raw.partition(b"\r\n\r\n")
        version, _, lines = top.partition(b"\r\n")
        if not gap or not re.fullmatch(rb"WARC/1\.[01]", version):
            raise ValueError("no WARC version")
        h = headers(lines)
        if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in h]:
            raise ValueError(f"no {missing[0]}")
        r.record_type, r.page_id, r.url = h["warc-type"], page_number(h["warc-record-id"]), h.get("warc-target-uri")
        r.refers_to = page_number(h.get("warc-refers-to"))
        n = int(h["content-length"])
        block, tail = rest[:n], rest[n:]
        if len(block) != n or tail != b"\r\n\r\n":
            raise ValueError("content-length doesn't fit the record")
        if (d := h.get("warc-block-digest")) and d != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError("the block digest is another")
        http, gap, r.payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise ValueError("no HTTP header")
        r.payload_bytes = int(headers(http.partition(b"\r\n")[2])["content-length"])
        r.payload_digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
        if r.record_type == "response":
            if len(r.payload) != r.payload_bytes:
                raise ValueError("the payload has another length")
            if hashlib.sha1(r.payload).hexdigest() != r.payload_digest:
                raise ValueError("the payload digest is another")
    except (ValueError, KeyError) as e:
        r.error = str(e)
    return r


def records(data: bytes) -> Iterator[Record]:
    """The records of one file; a file that can't be read on ends with a record that has the error."""
    try:
        unpack = zstd.ZstdDecompressor(dict_data=dictionary(data))
        for a, b in frames(data):
            frame = data[a:b]
            known = zstd.get_frame_parameters(frame).content_size
            yield parse(unpack.decompress(frame) if known not in (2**64 - 1, 2**64 - 2) else unpack.decompressobj().decompress(frame))
    except (ValueError, zstd.ZstdError, struct.error) as e:
        yield Record(error=str(e))


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives now; returns (path, records)."""
    common.ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        done: list[tuple[str, int]] = []

        def put() -> None:
            name = f"{root}/pages-{part:06d}-{n:04d}.warc.zst"
            own = f"{root}/_{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(archive(held))
            store.move(own, name)
            done.append((name, len(held)))

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "payload_digest", "refers_to")), strict=True):
                page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                payload = html.encode("utf-8", "replace")
                held.append(record(page_id, url, payload, digest, refers_to))
                size += len(payload)
                if size >= archive_bytes:
                    put()
                    n, held, size = n + 1, [], 0
        if held:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    ordered = roles(pages).sortWithinPartitions("page_id", "url", "payload_digest")
    return common.cut(ordered.mapInArrow(run, "path string, records long"))


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all .warc.zst files in the folder: page_id, url, record_type, payload (if wanted), payload_bytes, payload_digest, refers_to, error."""
    common.ship(spark)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "error": pa.string()}
    names = [k for k in kinds if payloads or k != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                held: list[Record] = []
                for r in records(data.as_py()):
                    held.append(r)
                    if len(held) == 1000:
                        yield packed(held)
                        held = []
                if held:
                    yield packed(held)

    def packed(held: list[Record]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([getattr(r, k) for r in held], kinds[k]) for k in names], names=names)

    schema = ", ".join(f"{k} {'binary' if k == 'payload' else 'string' if kinds[k] == pa.string() else 'long'}" for k in names)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and returns what is read back: page_id, payload_bytes, payload_digest, record_type, refers_to, error. The archives are deleted."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    try:
        if write(pages, folder).isEmpty():
            return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string")
        return common.cut(read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"))
    finally:
        remove(spark, folder)
