"""WARC archives of Zstandard frames: writer and reader.

An archive begins with a skippable frame that holds the dictionary (trained
on a bounded sample of the archive's own first payloads); after it comes one
frame for each record. The reader loads the dictionary from that leading
frame, if there is one, decodes frame by frame, and validates the headers, the
block length and the digests of every record, of any type and of WARC 1.0 or
1.1. Archives are binary values of a table: the writer's in a Parquet table, so
that Spark's commit protocol covers them in any file system; export_archives
makes .warc.zst files of them, and read_files reads such files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.llm.common import settle
from quakespark.llm.exact_dedup import elect

#: Fixed values of the formats: magic numbers (little-endian) of the dictionary's skippable frame and of a frame, the marks of a record.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
VERSION, VERSIONS = b"WARC/1.1", (b"WARC/1.0", b"WARC/1.1")
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"

#: An archive is closed at about so many payload bytes.
ARCHIVE_BYTES = 16 << 20
#: The dictionary is trained on the archive's first payloads, up to SAMPLE_BYTES of them.
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20
RUNS, FAN = 64, 8

ARCHIVES = "archive string, content binary"
RECORDS = "archive string, record_id string, record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class BadArchive(ValueError):
    """An archive or record that isn't valid."""


def digest_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES, or none where the sample is too small to train on."""
    sample, size = [], 0
    for p in payloads:
        if size >= SAMPLE_BYTES:
            break
        sample.append(p[: 64 << 10])
        size += len(sample[-1])
    if len(sample) < 8 or size < 4 * DICTIONARY_BYTES:
        return b""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, sample, k=512, d=8).as_bytes()
    except zstd.ZstdError:
        return b""


def record_bytes(name: str, url: str | None, payload: bytes, record_type: str, refers: str | None) -> bytes:
    """One WARC record named ``name``. A revisit's block has the HTTP head alone, in which the payload's length stands."""
    block = HTTP_HEAD % len(payload) + (payload if record_type == "response" else b"")
    headers = {
        "WARC-Type": record_type,
        "WARC-Record-ID": f"<{name}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest_base32(payload)}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        headers["WARC-Target-URI"] = " ".join(url.split())
    if record_type == "revisit":
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["WARC-Refers-To"] = f"<{refers}>"
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n"
    return head + block + b"\r\n\r\n"


def archive_bytes(records: list[bytes], payloads: list[bytes]) -> bytes:
    words = train_dictionary(payloads)
    make = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(words) if words else None)
    lead = struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words
    return lead + b"".join(map(make.compress, records))


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each from a frame of its own; other skippable frames are passed over."""
    rest, words = memoryview(content), b""
    if len(rest) < 4:
        raise BadArchive("no leading frame")
    if len(rest) >= 8 and struct.unpack_from("<I", rest)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", rest, 4)[0]
        if len(rest) < 8 + size:
            raise BadArchive("the dictionary is cut short")
        words, rest = bytes(rest[8 : 8 + size]), rest[8 + size :]
        if size >= 4 and struct.unpack_from("<I", words)[0] == FRAME_MAGIC:
            words = zstd.ZstdDecompressor().decompressobj().decompress(words)
    given = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(words) if words else None)
    while len(rest):
        magic = struct.unpack_from("<I", rest)[0] if len(rest) >= 4 else 0
        if magic in SKIPPABLE and len(rest) >= 8:
            rest = rest[8 + struct.unpack_from("<I", rest, 4)[0] :]
            continue
        if magic != FRAME_MAGIC:
            raise BadArchive("not a frame")
        one, out, at = given.decompressobj(), [], 0
        while not one.eof:
            if at >= len(rest):
                raise BadArchive("a frame is cut short")
            out.append(one.decompress(rest[at : at + 65536]))
            at += 65536
        rest = rest[min(at, len(rest)) - len(one.unused_data) :]
        yield b"".join(out)


def fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last is not None:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadArchive(f"not a header field: {line[:40]!r}")
        last = name.strip().lower().decode("utf-8", "replace")
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def _verify(name: str, given: str | None, body: bytes) -> None:
    if given and given.lower().startswith("sha1:") and given[5:].upper() != digest_base32(body):
        raise BadArchive(f"{name}: it isn't what its digest says")


def parse_record(record: bytes) -> dict:
    """Fields of a record of any type; BadArchive where headers, length or digests don't hold.

    The payload is what follows the HTTP head in HTTP records, else the whole
    block. A revisit has none: its length is what the HTTP head says, or null.
    Payloads sent in chunks or cut short on purpose are not held against their
    digest, which is that of the whole.
    """
    head, gap, tail = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in VERSIONS:
        raise BadArchive("no WARC header")
    headers = fields(lines[1:])
    name, kind, length = (headers.get(x) for x in ("warc-record-id", "warc-type", "content-length"))
    if not name or not kind or not (length or "").isdecimal():
        raise BadArchive("no record id, type or length")
    block, end = tail[: int(length)], tail[int(length) :]
    if len(block) < int(length) or end != b"\r\n\r\n":
        raise BadArchive(f"{name}: its block length isn't right")
    _verify(name, headers.get("warc-block-digest"), block)
    payload, size, whole = block, len(block), "warc-truncated" not in headers
    if headers.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        sent = fields([x for x in http.split(b"\r\n")[1:] if b":" in x])
        whole = whole and "transfer-encoding" not in sent
        size = len(payload) if kind != "revisit" else int(sent["content-length"]) if sent.get("content-length", "").isdecimal() else None
    digest = headers.get("warc-payload-digest")
    if kind != "revisit" and whole:
        _verify(name, digest, payload)
    bare = lambda x: x.strip("<>") if x else None
    number = lambda x: int(x.split(":")[2]) if x and x.startswith("urn:page:") and x.split(":")[2] else None
    own, other = bare(name), bare(headers.get("warc-refers-to"))
    return {
        "record_id": own, "record_type": kind, "page_id": number(own), "target_uri": bare(headers.get("warc-target-uri")), "payload_bytes": size,
        "payload_digest": digest.split(":", 1)[-1] if digest else None if kind == "revisit" else digest_base32(payload), "refers_to": number(other), "payload": payload if kind != "revisit" else None,
    }


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import uuid

    records, payloads, size = [], [], 0
    for batch in batches:
        for name, url, html, kind, refers in zip(batch.name, batch.url, batch.html, batch.record_type, batch.refers, strict=True):
            payload = html.encode()
            records.append(record_bytes(name, url, payload, kind, refers))
            payloads.append(payload if size < SAMPLE_BYTES else b"")
            size += len(payload)
            if size >= ARCHIVE_BYTES:
                yield pd.DataFrame({"archive": [f"{uuid.uuid4().hex}.warc.zst"], "content": [archive_bytes(records, [p for p in payloads if p])]})
                records, payloads, size = [], [], 0
    if records:
        yield pd.DataFrame({"archive": [f"{uuid.uuid4().hex}.warc.zst"], "content": [archive_bytes(records, [p for p in payloads if p])]})


_WHOLE = {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"}


def _reader(with_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for archive, content in zip(batch.archive, batch.content, strict=True):
                rows = []
                for record in read_archive(content):
                    row = parse_record(record)
                    rows.append(row if with_payload else row | {"payload": None})
                    if len(rows) >= 2000:
                        yield pd.DataFrame(rows).assign(archive=archive)[columns].astype(_WHOLE)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows).assign(archive=archive)[columns].astype(_WHOLE)

    return read


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives given as (archive, content) rows; a bad one raises BadArchive."""
    one = archives.select("archive", "content")
    return one.mapInPandas(_reader(with_payload), RECORDS)


def read_files(spark: SparkSession, paths: str | list[str], with_payload: bool = True) -> DataFrame:
    """The records of .warc.zst files (of up to 2 GB each, Spark's bound on a binary value)."""
    files = spark.read.format("binaryFile").load(paths)
    return read_archives(files.select(F.regexp_extract("path", "[^/]+$", 0).alias("archive"), "content"), with_payload)


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes archives as files to a shared folder (a URI); (archive, bytes) of each, settled.

    A file is written under a name of its attempt and then renamed, so a task
    that runs twice leaves one whole file.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for archive, content in zip(batch.archive, batch.content, strict=True):
                attempt = f"{root}/.{archive}.{uuid.uuid4().hex}"
                with store.open_output_stream(attempt) as out:
                    out.write(content)
                store.move(attempt, f"{root}/{archive}")
            yield pd.DataFrame({"archive": batch.archive, "bytes": [len(x) for x in batch.content]})

    return settle(archives.select("archive", "content").mapInPandas(write, "archive string, bytes long"), "exported")


def record_types(pages: DataFrame) -> DataFrame:
    """``pages`` with record_type, the record's name, and refers (the name of the record it revisits).

    Of rows with equal payloads (null html counts as empty) that with the
    largest page_id is the response and the others revisit it; among rows that
    repeat that page_id one is. A null page_id comes after all others. A
    frequent payload's rows are spread over runs, as in exact dedup.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.monotonically_increasing_id().alias("rid")).withColumns({"sha": F.unhex(F.sha2("html", 256)), "bytes": F.octet_length("html")})
    keyed = keyed.withColumn("run", F.pmod(F.xxhash64("page_id", "rid"), F.lit(RUNS)).cast("int"))
    keyed = settle(keyed, "pages", "zstd")
    order = F.struct(F.col("page_id").isNull().alias("none"), (-F.col("page_id")).alias("last"), F.col("rid").alias("rid"))
    won = elect(keyed, ["sha", "bytes"], order, RUNS, FAN)
    own = F.col("first").isNull() | (F.col("first.rid") == F.col("rid"))
    name = lambda page, rid: F.concat_ws(":", F.lit("urn:page"), F.coalesce(page.cast("string"), F.lit("")), rid.cast("string"))
    return keyed.join(won, ["sha", "bytes", "run"], "left").select(name(F.col("page_id"), F.col("rid")).alias("name"), "url", "html", F.when(own, "response").otherwise("revisit").alias("record_type"), F.when(~own, name(-F.col("first.last"), F.col("first.rid"))).alias("refers"))


def write_archives(pages: DataFrame) -> DataFrame:
    """A WARC record for each row of pages (page_id, url, html), as a settled table (archive, content).

    Null html is an empty payload, null url leaves out the target's header;
    other columns are ignored. Very long payloads make archives of their own.
    Rows that repeat a page_id are records of their own, with names of their
    own; an empty table gives no archive.
    """
    return settle(record_types(pages).mapInPandas(_write, ARCHIVES), "archives")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives and reads them back: one row for each page."""
    read = read_archives(write_archives(pages), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
