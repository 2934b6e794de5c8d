"""WARC archives with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing stays one Spark stage after the look-up of repeated payloads: each task trains a dictionary on
the first payloads of its partition (a bounded part), and emits whole archives of a bounded size: the
dictionary frame and then a frame per record. Spark's own text sink commits them, a file for each, so
a retried task leaves no half archive. Its line separator is an empty skippable frame, which Zstandard
readers pass over; so every file is a plain .zst stream of records.

Reading takes archives of any size: files come through the binaryFile source, or, beyond CELL_BYTES, as
a path that the task opens by pyarrow's file systems and streams. Frames are decoded one at a time, by
their block headers, and never beyond RECORD_BYTES; headers and lengths are validated. A bad record or file, a
record of more bytes, and a long file on a store that only Spark can open become rows with `error` set
instead of failing the job or vanishing. Extra columns of pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derivia.llm.common import plain_keys

# Fixed values of the formats.
DICT_FRAME_MAGIC = 0x184D2A5D
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
ZSTD_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REQUIRED = ("warc-record-id", "content-length", "warc-date", "warc-type")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

DICT_BYTES = 32 << 10
TRAIN_BYTES = 1 << 20
LEVEL = 3
#: Payload bytes of an archive; one record more may go in.
ARCHIVE_BYTES = 64 << 20
#: Bytes of the largest file that comes to a task as one cell; larger ones the task streams itself.
CELL_BYTES = 256 << 20
#: Bytes of the largest record, as it is and as its frame, and of the largest dictionary.
RECORD_BYTES = 512 << 20
MOST_DICT_BYTES = 64 << 20
#: Shares of the pages of one payload, so that a payload of a third of all pages isn't one task's.
SALTS = 16
LONG_MAX = (1 << 63) - 1
DATE = re.compile(r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d(:\d\d(\.\d{1,9})?)?Z)?)?)?", re.ASCII)

FIELDS = [
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string()), ("archive", pa.string()), ("position", pa.int64()),
]
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string, archive string, position long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    """The page of one of our record ids; None for ids of others, which are no long."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", record or "")
    page = int(found[1]) if found else None
    return page if page is not None and -LONG_MAX - 1 <= page <= LONG_MAX else None


def length_of(text: str, name: str) -> int:
    """A length as a header states it; ValueError for what is no number or no long."""
    if not re.fullmatch(r"[0-9]{1,19}", text) or int(text) > LONG_MAX:
        raise ValueError("bad " + name)
    return int(text)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and the full payload's length and digest, not the payload."""
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(c for c in url if c >= " ") if url is not None else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to) if revisit else None),
    ]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head if v is not None)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples, or None where they are too few or too alike for one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=512, d=8) if len(samples) >= 8 else None
    except zstandard.ZstdError:
        return None


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """pages plus payload, digest, refers_to and revisit.

    The pages of a payload are found by its digest in one shuffle; the build side has SALTS rows per
    repeated payload, so that the pages of one that a third of all pages share are dealt to SALTS keys.
    Small payloads get keys of their own so that they spread.
    """
    base = plain_keys(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    base = base.withColumn("_key", F.when(F.octet_length("payload") >= least_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    base = base.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    lead = base.where(F.octet_length("payload") >= least_bytes).groupBy("_key").agg(F.max("page_id").alias("_lead"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _lead is not null").drop("_n")
    lead = lead.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = base.join(lead.hint("shuffle_hash"), ["_key", "_salt"], "left")
    revisit = F.col("_lead").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_lead")))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("_lead")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of pages (page_id, url, html; a null html is an empty payload) into archives under path.

    Of rows with equal payloads of at least least_bytes, those of the largest page_id are responses
    and the others revisit it (a null page_id counts as the smallest; equal ones are all responses).
    An empty table writes no record. An archive is closed once it has archive_bytes of payloads; a
    text of more than that makes an archive of its own size.
    """

    def archives(batches):
        pending: list[tuple] = []
        frames: list[bytes] = []
        size = held = 0
        packer, lead = None, b""

        def pack():
            nonlocal packer, lead
            if packer is None:
                trained = train([p[2][:16384] for p in pending if p[2]])
                given = {"level": LEVEL, "write_content_size": True, "write_checksum": True}
                if trained is not None:
                    raw = trained.as_bytes()
                    given["dict_data"], lead = trained, struct.pack("<II", DICT_FRAME_MAGIC, len(raw)) + raw
                packer = zstandard.ZstdCompressor(**given)
            frames.extend(packer.compress(record_bytes(*r, date)) for r in pending)
            pending.clear()

        def closed():
            out = pa.RecordBatch.from_arrays([pa.array([b"".join((lead, *frames))], pa.binary())], ["archive"])
            frames.clear()
            return out

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit")), strict=True):
                pending.append(row)
                size += len(row[2])
                held += len(row[2])
                if size >= TRAIN_BYTES or held >= archive_bytes:
                    pack()
                    size = 0
                if held >= archive_bytes:
                    yield closed()
                    held = 0
        if pending:
            pack()
        if frames:
            yield closed()

    made = with_revisits(pages, least_bytes).mapInArrow(archives, "archive binary")
    made.select(F.col("archive").cast("string")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def parse_record(raw: bytes) -> dict:
    """The fields of one record; ValueError tells what is wrong with its headers or lengths."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("the header has no end")
    lines = raw[:end].split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", VERSION):
        raise ValueError("unknown version line")
    head: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("a header line has no name")
        head[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if missing := [k for k in REQUIRED if not head.get(k)]:
        raise ValueError("missing header " + missing[0])
    if not DATE.fullmatch(head["warc-date"]):
        raise ValueError("bad warc-date")
    block, length = raw[end + 4 :], length_of(head["content-length"], "content-length")
    if len(block) != length + 4:
        raise ValueError(f"content-length {length}, block of {len(block) - 4}")
    if block[length:] != b"\r\n\r\n":
        raise ValueError("the record has no end mark")
    kind = head["warc-type"]
    out = {"page_id": page_of(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": kind}
    if kind not in ("response", "revisit"):
        return out | {"payload": block[:length], "payload_bytes": length}
    http_end = block.find(b"\r\n\r\n", 0, length)
    if http_end < 0:
        raise ValueError("the HTTP head has no end")
    payload = block[http_end + 4 : length]
    label, _, digest = head.get("warc-payload-digest", "").partition(":")
    if digest and label.lower() != "sha1":
        raise ValueError("unknown digest " + label)
    try:
        known = (base64.b32decode(digest) if len(digest) == 32 else bytes.fromhex(digest)).hex() if digest else None
    except ValueError:
        raise ValueError("bad payload digest") from None
    stated = length_of(head["warc-payload-length"], "payload length") if "warc-payload-length" in head else None
    if kind == "revisit":
        if not head.get("warc-profile"):
            raise ValueError("a revisit without a profile")
        return out | {"refers_to": page_of(head.get("warc-refers-to")), "payload_digest": known, "payload_bytes": stated}
    found = hashlib.sha1(payload).hexdigest()
    if known is not None and found != known:
        raise ValueError("the payload doesn't have its digest")
    if stated is not None and stated != len(payload):
        raise ValueError("the payload doesn't have its length")
    return out | {"payload": payload, "payload_digest": found, "payload_bytes": len(payload)}


class Source:
    """A file read forward, with a look ahead."""

    def __init__(self, stream):
        self.stream, self.ahead, self.at = stream, b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.ahead) < n and (more := self.stream.read(max(n, 1 << 16))):
            self.ahead += more
        return self.ahead[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.ahead = self.ahead[len(out) :]
        self.at += len(out)
        return out

    def skip(self, n: int) -> bool:
        """Whether there were n bytes."""
        while n and (part := self.take(min(n, 1 << 20))):
            n -= len(part)
        return not n


def frame(source: Source, most: int) -> bytes | None:
    """The bytes of the frame here, by its block headers; none if it is cut, and only its head if it has more than `most`."""
    head = source.peek(18)
    parts, size = [source.take(zstandard.frame_header_size(head))], 0
    last = False
    while not last:
        block = source.take(3)
        if len(block) < 3:
            return None
        told = int.from_bytes(block, "little")
        last = bool(told & 1)
        n = 1 if told >> 1 & 3 == 1 else told >> 3
        body = source.take(n)
        if len(body) < n:
            return None
        size += 3 + n
        if size <= most:
            parts += [block, body]
    mark = source.take(4 * zstandard.get_frame_parameters(head).has_checksum)
    if zstandard.get_frame_parameters(head).has_checksum and len(mark) < 4:
        return None
    return parts[0] if size > most else b"".join([*parts, mark])


def decoded(reader: zstandard.ZstdDecompressor, whole: bytes, most: int) -> bytes | None:
    """The content of a frame; none if it has more than `most` bytes, of which no more are held."""
    out, size = [], 0
    with reader.stream_reader(whole) as stream:
        while part := stream.read(1 << 20):
            size += len(part)
            if size > most:
                return None
            out.append(part)
    return b"".join(out)


def decode_frames(stream, most: int = RECORD_BYTES):
    """(position, record bytes or an error text) for each frame of an archive; a frame at a time is held."""
    source, first, reader = Source(stream), True, None
    while lead := source.peek(8):
        at = source.at
        if len(lead) < 8:
            yield at, "truncated frame"
            return
        magic, size = struct.unpack("<II", lead)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            source.take(8)
            wanted = magic == DICT_FRAME_MAGIC and first
            if wanted and size > MOST_DICT_BYTES:
                yield at, "bad dictionary: too long"
                return
            raw = source.take(size) if wanted else b""
            if len(raw) < size if wanted else not source.skip(size):
                yield at, "truncated skippable frame"
                return
            if magic == DICT_FRAME_MAGIC and not first:
                yield at, "a dictionary frame that doesn't lead"
            elif wanted:
                try:
                    if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
                        raw = decoded(zstandard.ZstdDecompressor(), raw, MOST_DICT_BYTES)
                        if raw is None:
                            raise zstandard.ZstdError("too long")
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT))
                except zstandard.ZstdError as e:
                    yield at, f"bad dictionary: {e}"
                    return
            first = False
            continue
        first = False
        if magic != ZSTD_MAGIC:
            yield at, "not a Zstandard frame"
            return
        try:
            whole = frame(source, most)
            if whole is None:
                yield at, "truncated frame"
                return
            raw = decoded(reader or zstandard.ZstdDecompressor(), whole, most) if source.at - at <= most else None
        except zstandard.ZstdError as e:
            yield at, f"bad frame: {e}"
            return
        yield at, f"a record of more than {most} bytes" if raw is None else raw


def opened(path: str):
    """A file of the task's own reading, by whatever file system pyarrow has for it."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return store.open_input_stream(place, compression=None)


def read_archives(spark: SparkSession, path: str, payload: bool = True, cell_bytes: int = CELL_BYTES, record_bytes: int = RECORD_BYTES) -> DataFrame:
    """The records of the archives under path, one row each, in no order.

    A record that breaks the format or has more than record_bytes, the rest of a file that can't be
    decoded further, and a file that can't be opened give a row with `error` set and what is known of it.
    Files of more than cell_bytes are streamed. Records of one id are all there. payload=False leaves the
    payload column null.
    """

    def records(name: str, stream):
        rows, size = [], 0
        for at, raw in decode_frames(stream, record_bytes):
            row = {"archive": name, "position": at}
            try:
                row |= {"error": raw} if isinstance(raw, str) else parse_record(raw)
            except ValueError as e:
                row["error"] = str(e)
            if not payload:
                row["payload"] = None
            rows.append(row)
            size += len(row.get("payload") or b"") + 500
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, pa.schema(FIELDS))
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema(FIELDS))

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from records(name, pa.BufferReader(content.as_buffer()))

    def parse_long(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                try:
                    stream = opened(name)
                except (OSError, ValueError, NotImplementedError) as e:
                    yield pa.RecordBatch.from_pylist([{"archive": name, "error": f"can't be opened: {e}"}], pa.schema(FIELDS))
                    continue
                with stream:
                    yield from records(name, stream)

    files = spark.read.format("binaryFile").load(path)
    short = files.where(F.col("length") <= cell_bytes).select("path", "content").mapInArrow(parse, READ_SCHEMA)
    return short.union(files.where(F.col("length") > cell_bytes).select("path").mapInArrow(parse_long, READ_SCHEMA))
