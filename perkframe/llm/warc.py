"""WARC archives with dictionary-compressed records (operator 4).

Pages become WARC/1.1 records.  Each file starts with a skippable frame that
holds a Zstandard dictionary built from that file's own records; every record
then follows as a Zstandard frame of its own, so a record can be read alone
given its offset and the dictionary.  Pages with equal payloads are stored
once, as the response of the largest page_id; the others are revisit records
that refer to it and carry no payload.

Tasks write files of bounded size into the shared folder under names that no
other attempt uses.  A file counts only when its row is in the manifest, a
table that Spark commits, so a lost executor or a repeated task leaves at most
unlisted files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, byte_list, id_key, id_out, new_folder, partitions, shared_fs, small_batches, stage_table

# Fixed values of the formats.
DICT_FRAME_MAGIC = 0x184D2A5D  # skippable frame that holds a dictionary
RAW_DICT_MAGIC = 0xEC30A437    # first bytes of a trained dictionary
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Record bytes looked at to build a file's dictionary, and its size.
SAMPLE_BYTES = 4 << 20
DICT_BYTES = 64 << 10
#: Uncompressed bytes of records after which a task starts a new file.
FILE_BYTES = 256 << 20
LEVEL = 3

MANIFEST = "path string, records long, dict_bytes long, file_bytes long"
RECORDS = ("id long, payload_bytes long, payload_digest string, record_type string, refers long, "
           "url string, path string, offset long")


def record_id(page: int) -> str:
    """A URN from which the page number can be read back."""
    return f"<urn:uuid:{uuid.UUID(int=page % (1 << 64))}>"


def page_of(urn: str) -> int:
    x = uuid.UUID(urn.strip("<>")[len("urn:uuid:"):]).int
    return x - (1 << 64) if x >= 1 << 63 else x


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page: int, url: str | None, payload: bytes, refers: int | None, date: str) -> bytes:
    """One WARC record.  The HTTP head's Content-Length is that of the full
    payload, which a revisit record leaves out."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:  # a header line can't hold white space or control characters
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}")
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers is not None:
        head += [f"WARC-Refers-To: {record_id(refers)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = http + (payload if refers is None else b"")
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; with too few of them to train on, their own
    bytes serve as a raw dictionary."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, records)
    except zstandard.ZstdError:
        raw = b"".join(records)[-DICT_BYTES:]
        if raw[:4] == struct.pack("<I", RAW_DICT_MAGIC):  # would read as a trained one
            raw = b"\n" + raw
        return zstandard.ZstdCompressionDict(raw.ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_files(records: Iterator[bytes], folder: str, file_bytes: int = FILE_BYTES) -> Iterator[tuple]:
    """Archive files of a task; yields (path, records, dict_bytes, file_bytes)."""
    fs, root = shared_fs(folder)
    fs.create_dir(root, recursive=True)
    while True:
        sample, size = [], 0
        for record in records:
            sample.append(record)
            size += len(record)
            if size >= SAMPLE_BYTES:
                break
        if not sample:
            return
        made = build_dictionary(sample)
        raw = made.as_bytes()
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=True).compress
        name = f"{uuid.uuid4().hex}.warc.zst"
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:  # frames are made here
            out.write(struct.pack("<II", DICT_FRAME_MAGIC, len(raw)) + raw)
            n, size, written = 0, 0, 8 + len(raw)
            for part in (sample, records):
                for record in part:
                    frame = compress(record)
                    out.write(frame)
                    n, size, written = n + 1, size + len(record), written + len(frame)
                    if size >= file_bytes and part is records:
                        break
        yield f"{folder}/{name}", n, len(raw), written


def read_dictionary(source) -> zstandard.ZstdCompressionDict:
    magic, length = struct.unpack("<II", source.read(8))
    if magic != DICT_FRAME_MAGIC:
        raise ValueError("the file doesn't begin with a dictionary frame")
    raw = source.read(length)
    trained = raw[:4] == struct.pack("<I", RAW_DICT_MAGIC)
    return zstandard.ZstdCompressionDict(
        raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def read_frames(source, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every frame after the dictionary frame."""
    reader = zstandard.ZstdDecompressor(dict_data=read_dictionary(source))
    at, held = source.tell(), b""
    while True:
        if not held:
            held = source.read(chunk)
            if not held:
                return
        one, parts, used = reader.decompressobj(), [], 0
        while True:
            parts.append(one.decompress(held))
            if one.eof:
                used += len(held) - len(one.unused_data)
                held = one.unused_data
                break
            used += len(held)
            held = source.read(chunk)
            if not held:
                raise ValueError("the last record of the file is cut off")
        yield at, b"".join(parts)
        at += used


def read_record(path: str, offset: int) -> bytes:
    """Random access: the record whose frame begins at ``offset``."""
    fs, name = shared_fs(path)
    with fs.open_input_file(name) as source:
        reader = zstandard.ZstdDecompressor(dict_data=read_dictionary(source))
        source.seek(offset)
        one, parts = reader.decompressobj(), []
        while not one.eof:
            held = source.read(1 << 16)
            if not held:
                raise ValueError("no whole record at this offset")
            parts.append(one.decompress(held))
    return b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP head, payload); checks the lengths that are stated."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is not as stated")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def describe(record: bytes) -> tuple:
    """What a record says of its page; a response's digest and length are
    recomputed from the payload and must agree with the headers."""
    fields, http, payload = parse_record(record)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload and headers disagree")
    refers = fields.get("WARC-Refers-To")
    return (page_of(fields["WARC-Record-ID"]), size, digest, kind,
            page_of(refers) if refers else None, fields.get("WARC-Target-URI"))


# ------------------------------------------------------------ the operator
def plan_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(id, url, html, refers): refers is the page whose response a page
    revisits, null for responses.

    The groups are aggregates over payload digests (combined before the
    shuffle).  Only groups of two and more are joined back to the pages, whose
    side adaptive execution splits where one payload fills a partition.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(id_key("page_id").alias("id"), F.col("url").cast("string").alias("url"),
                         html.alias("html"), F.sha2(html, 256).alias("key"))
    shared = (keyed.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("key")
              .agg(F.max("id").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    refers = F.when(F.col("kept") != F.col("id"), F.col("kept"))
    return (keyed.join(shared, "key", "left").select("id", "url", "html", refers.alias("refers")))


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0,
                   date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; returns the manifest."""
    planned = plan_revisits(pages, min_revisit_bytes)

    def run(batches):
        def records():
            for batch in batches:
                html = byte_list(batch.column(2))
                for page, url, body, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                   html, batch.column(3).to_pylist()):
                    yield make_record(page, url, body, refers, date)
        rows = list(write_files(records(), f"{folder}/task-{TaskContext.get().partitionId():06d}", file_bytes))
        if rows:  # one row per file of bounded size
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)],
                                             ["path", "records", "dict_bytes", "file_bytes"])

    return stage_table(planned.mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of every listed archive (see ``RECORDS``)."""
    def run(batches):
        names = ["id", "payload_bytes", "payload_digest", "record_type", "refers", "url", "path", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = shared_fs(path)
                rows = []
                with fs.open_input_file(name) as source:
                    for offset, record in read_frames(source):
                        rows.append((*describe(record), path, offset))
                        if len(rows) >= 4096:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return manifest.select("path").repartition(partitions(manifest.sparkSession)).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write archives of ``pages`` and read them back.

    Returns per page: page_id, payload_bytes, payload_digest (bare base32
    SHA-1 of the full payload), record_type, refers_to, url, path, offset.
    Null html is an empty payload, and equal to it; a null url leaves the
    header out; a null page_id is smaller than any other; rows that repeat a
    page_id are records of their own, and all responses where that page is the
    kept one; an empty table gives no rows; other columns are not read.
    """
    small_batches(pages.sparkSession)
    manifest = write_archives(pages, new_folder(pages.sparkSession, "warc"), min_revisit_bytes)
    return read_archives(manifest).select(
        id_out("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers") != NULL_ID, F.col("refers")).alias("refers_to"), "url", "path", "offset")
