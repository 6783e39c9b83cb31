"""Zstandard WARC archives: a dictionary in the leading skippable frame, then one frame per record.

``store_archives`` writes records as ``.warc.zst`` files of bounded size, ``load_archives`` finds these as ``binaryFile``
rows, and ``read_archives`` reads their bytes frame by frame with the dictionary, and validates version, headers,
lengths, digests and the blank lines between records. Where Python workers cannot open files in the shared folder (it is
in an object store), ``write_archives`` gives the same archives as a table of names and bytes.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_path, materialize, new_folder, ship

#: Fixed values of the formats.
SKIPPABLE_DICT = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
#: Bytes of records in one archive, and of a trained dictionary.
ARCHIVE_BYTES, DICT_BYTES, LEVEL = 8 << 20, 16 << 10, 3
#: Records of an archive, evenly spread, that its dictionary is trained on.
TRAIN_RECORDS = 200
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response, or a revisit without payload if ``refers_to`` is given."""
    target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode()) or b"urn:none"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else str(page_id)
    head = [VERSION, b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"), b"WARC-Record-ID: <urn:page:%s>" % name.encode(), b"WARC-Date: " + DATE.encode(), b"WARC-Target-URI: " + target, b"WARC-Payload-Digest: sha1:" + digest.encode(), b"WARC-Block-Digest: sha1:" + digest32(block).encode()]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%s>" % str(refers_to).encode(), b"WARC-Profile: " + PROFILE.encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """An archive: the dictionary in a skippable frame (trained on some of these records, else their beginnings), one frame each."""
    try:
        d = zstandard.train_dictionary(DICT_BYTES, [r[:16384] for r in records[:: -(-len(records) // TRAIN_RECORDS)]])
    except zstandard.ZstdError:  # too few or too short records to train on
        d = zstandard.ZstdCompressionDict(b"".join(r[:1024] for r in records)[:DICT_BYTES].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = d.as_bytes()
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE_DICT, len(raw)), raw, *(c.compress(r) for r in records)])


def frame_end(buf: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its block headers."""
    if len(buf) < at + 6 or struct.unpack_from("<I", buf, at)[0] != FRAME_MAGIC:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = buf[at + 4]
    single = flags >> 5 & 1
    p = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        if p + 3 > len(buf):
            raise ValueError("the archive ends inside a frame")
        h = buf[p] | buf[p + 1] << 8 | buf[p + 2] << 16
        p += 3 + (1 if h >> 1 & 3 == 1 else h >> 3)
        if h & 1:
            p += 4 * (flags >> 2 & 1)
            if p > len(buf):
                raise ValueError("the archive ends inside a frame")
            return p


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one for each frame; other skippable frames are passed over."""
    buf, at, d = memoryview(content), 0, None
    while at < len(buf):
        magic, size = struct.unpack_from("<II", buf, at) if at + 8 <= len(buf) else (0, 0)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == SKIPPABLE_DICT and at == 0:
                raw = bytes(buf[8 : 8 + size])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                d = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
            if at > len(buf):
                raise ValueError("the archive ends inside a skippable frame")
            continue
        end = frame_end(buf, at)
        yield zstandard.ZstdDecompressor(dict_data=d).decompress(buf[at:end])
        at = end


def parse(rec: bytes) -> dict:
    """Headers and payload of one record; a ValueError says what is wrong with it."""
    head, sep, rest = rec.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.1", b"WARC/1.0"):
        raise ValueError("no WARC version line or end of headers")
    h = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon or not k.strip():
            raise ValueError("a header line without a colon")
        h[k.strip().lower()] = v.strip()
    if missing := [k for k in NEEDED if k not in h]:
        raise ValueError(f"headers missing: {missing}")
    if not h[b"content-length"].isdigit() or len(rest) != int(h[b"content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length is not that of its header")
    block = rest[:-4]
    if b"warc-block-digest" in h and h[b"warc-block-digest"] != b"sha1:" + digest32(block).encode():
        raise ValueError("block digest")
    http, sep, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: *(\d+)", http, re.I)
    if not sep or not length:
        raise ValueError("no HTTP headers")
    kind, digest = h[b"warc-type"].decode(), h.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
    if kind == "response" and (int(length[1]) != len(payload) or digest32(payload) != digest):
        raise ValueError("payload length or digest")
    if kind == "revisit" and (payload or b"warc-refers-to" not in h):
        raise ValueError("a revisit with a payload, or without the record that it refers to")
    return {"record_id": h[b"warc-record-id"].decode(), "url": h.get(b"warc-target-uri", b"").decode(), "record_type": kind, "payload_bytes": int(length[1]), "payload_digest": digest, "refers_to": h.get(b"warc-refers-to", b"").decode() or None, "payload": payload.decode("utf-8", "replace") if kind == "response" else None}


def _archives(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[bytes]:
    held, size = [], 0
    for b in batches:
        for x in zip(*(b.column(i) for i in range(4)), strict=True):
            page_id, url, payload, refers = (v.as_py() for v in x)
            payload = (payload or "").encode()
            held.append(record(page_id, url, payload, digest32(payload), refers))
            size += len(held[-1])
            if size >= most:
                yield archive(held)
                held, size = [], 0
    if held:
        yield archive(held)


def _write(most: int, folder: str | None = None):
    """Archives as rows (archive, content) or, with a folder, as files in it, and rows (archive, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        for n, content in enumerate(_archives(batches, most)):
            if folder is None:
                yield pa.RecordBatch.from_arrays([pa.array([f"{task.partitionId():06d}-{n:06d}.warc.zst"]), pa.array([content], pa.binary())], ["archive", "content"])
                continue
            name = f"{task.partitionId():06d}-{task.taskAttemptId():09d}-{n:06d}.warc.zst"  # of its own for each attempt
            at = os.path.join(folder, name)
            with open(at + ".part", "wb") as f:
                f.write(content)
            os.replace(at + ".part", at)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64())], ["archive", "size"])

    return run


def plan_revisits(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """``pages`` with the column ``refers_to``: of equal payloads of at least ``least`` bytes, the largest id is the one that the rest refer to.

    The group table is written first, so the join has plain shuffles on both sides and skewed digests are split.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    key = F.unhex(F.sha2(payload, 256)).alias("__key")
    size = F.octet_length(payload)
    held = materialize(
        pages.select(F.col(id_col).alias("__id"), key, size.alias("__size")).where(F.col("__size") >= least).groupBy("__key", "__size").agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__holder")).where("__n > 1").drop("__n"),
        "warc-holders",
    )
    rows = pages.select("*", key, size.alias("__size")).join(held, ["__key", "__size"], "left")
    refers = F.when(F.col("__holder").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__holder")), F.col("__holder"))
    return rows.withColumn("__refers", refers)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive, content) of a record per row, revisits for repeated payloads.

    Null payloads are empty, a null url becomes ``urn:none``, a null id is named ``null`` and never referred to; rows
    that repeat the holder's id are responses too. An empty table gives no archive. Other columns are ignored.
    """
    ship(pages.sparkSession)
    rows = plan_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col, least)
    return rows.select(id_col, url_col, payload_col, "__refers").mapInArrow(_write(archive_bytes), "archive string, content binary")


def store_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives as files into ``folder``, which every executor can open; a written table (archive, size).

    Each attempt of a task has names of its own, so the table names the whole files of the attempts that count. Cases as
    in ``write_archives``.
    """
    spark = pages.sparkSession
    ship(spark)
    at = file_path(folder)
    if at is None:
        raise ValueError(f"Python workers cannot open files in {folder}")
    os.makedirs(at, exist_ok=True)
    rows = plan_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col, least)
    rows = rows.select(id_col, url_col, payload_col, "__refers")
    return materialize(rows.mapInArrow(_write(archive_bytes, at), "archive string, size long"), "warc-names")


def load_archives(names: DataFrame, folder: str) -> DataFrame:
    """``binaryFile`` rows (path, content, length) of the files of ``folder`` that are in ``names`` (archive, size)."""
    files = names.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    name = F.regexp_extract("path", "[^/]+$", 0)
    return files.join(names, (name == F.col("archive")) & (F.col("length") == F.col("size")), "left_semi")


READ_SCHEMA = "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload string, error string"


def _read(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names])
        for b in batches:
            for content in b.column(0):
                rows = []
                try:
                    for rec in frames(content.as_py() or b""):
                        try:
                            rows.append(parse(rec))
                        except ValueError as e:
                            if strict:
                                raise
                            rows.append({"error": str(e)})
                except (ValueError, zstandard.ZstdError) as e:
                    if strict:
                        raise
                    rows.append({"error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(archives: DataFrame, content_col: str = "content", strict: bool = True) -> DataFrame:
    """A row per record of the archives in ``content_col`` (as written above or read with ``binaryFile``).

    Null or empty content has no records. A bad record fails the job, or, unless ``strict``, gives a row with ``error``.
    """
    ship(archives.sparkSession)
    return archives.select(content_col).mapInArrow(_read(strict), READ_SCHEMA)


def page_id(urn):
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(.*)>$", 1), F.lit("null"))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write every page, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Nulls, repeated rows and empty tables as in ``write_archives``; long payloads are records like any others.
    """
    folder = new_folder(pages.sparkSession, "warc")
    if file_path(folder):
        archives = load_archives(store_archives(pages, folder, least=least), folder)
    else:
        archives = materialize(write_archives(pages, least=least), "warc")
    kind = pages.schema["page_id"].dataType
    back = read_archives(archives)
    return back.select(page_id(F.col("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id(F.col("refers_to")).cast(kind).alias("refers_to"), "url")
