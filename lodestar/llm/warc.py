"""Web archives of Zstandard frames: written with one record a frame, and read back with every check.

An archive starts with a skippable frame that holds its dictionary; each record after it is
one frame, which can be read without those before.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import settle

#: Fixed values of the formats: magic numbers of the dictionary's skippable frame, of the
#: sixteen skippable frames, of ordinary frames and of dictionaries; the profile of revisits.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
TRAINED = 0xEC30A437
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payloads that a dictionary is fitted on, from the first records of its archive, and its most bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 1 << 14
#: Compressed bytes after which an archive is closed; a longer record still stands whole.
ARCHIVE_BYTES = 8 << 20
LEVEL = 3
#: Bytes of rows that an Arrow batch holds about.
BATCH_BYTES = 16 << 20
#: Shares that the copies of one payload are dealt to.
SHARES = 64
#: The date that records get, for the table has none.
DATE = "2024-01-01T00:00:00Z"

RECORDS = "archive string, place long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, fault string"


def sha1(data: bytes) -> str:
    """SHA-1 in upper-case base 32, which needs no padding."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def uri(text: str | None) -> str:
    """``text`` as a header's value: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), text or "") or "about:blank"


class Page(NamedTuple):
    page_id: int | None
    url: str | None
    payload: bytes
    response: int | None  #: the page whose response has the same payload, if this is a revisit


def page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def headers(fields: Iterable[tuple[str, str]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{name}: {value}" for name, value in fields), "", ""]).encode()


def record(page: Page, date: str = DATE) -> bytes:
    """The WARC record of a page; a revisit has the HTTP headers of its payload, but not the payload."""
    http = headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(page.payload)))], "HTTP/1.1 200 OK")
    block = http if page.response is not None else http + page.payload
    fields = [
        ("WARC-Type", "response" if page.response is None else "revisit"),
        ("WARC-Record-ID", page_uri(page.page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri(page.url)),
        ("WARC-Payload-Digest", f"sha1:{sha1(page.payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page.response is not None:
        fields[2:2] = [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", page_uri(page.response)), ("WARC-Refers-To-Date", date)]
    return headers(fields, "WARC/1.1") + block + b"\r\n\r\n"


def fitted(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for records like ``samples``; their own bytes where they are too few to fit one."""
    size = sum(map(len, samples))
    if len(samples) >= 8 and size >= 8 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
        except zstandard.ZstdError:  # samples without anything in common
            pass
    raw = b"".join(samples)[-DICTIONARY_BYTES:]
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


class Archive:
    """Collects records until ``done``; the first of them are held back for the dictionary."""

    def __init__(self, sample_bytes: int = SAMPLE_BYTES):
        self.held: list[bytes] = []
        self.held_bytes, self.sample_bytes = 0, sample_bytes
        self.parts: list[bytes] = []
        self.size = self.records = 0
        self.writer: zstandard.ZstdCompressor | None = None

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.writer is None:
            self.held.append(raw)
            self.held_bytes += len(raw)
            if self.held_bytes >= self.sample_bytes:
                self.start()
        else:
            self.put(self.writer.compress(raw))

    def put(self, frame: bytes) -> None:
        self.parts.append(frame)
        self.size += len(frame)

    def start(self) -> None:
        budget, samples = self.sample_bytes, []
        for raw in self.held:
            samples.append(raw[:budget])
            budget -= len(samples[-1])
        words = fitted([s for s in samples if s])
        if words:
            packed = zstandard.ZstdCompressor(level=19).compress(words.as_bytes())
            self.put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True, write_content_size=True)
        for raw in self.held:
            self.put(self.writer.compress(raw))
        self.held = []

    def done(self) -> bytes:
        if self.writer is None:
            self.start()
        return b"".join(self.parts)


class Broken(ValueError):
    """An archive that cannot be read past some place."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, by its header and the sizes of its blocks."""
    try:
        end = at + zstandard.frame_header_size(data[at : at + 18])
        checked = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    except zstandard.ZstdError as error:
        raise Broken(f"frame header at {at}: {error}") from error
    last = False
    while not last:
        if end + 3 > len(data):
            raise Broken(f"frame at {at} is cut off")
        block = int.from_bytes(data[end : end + 3], "little")
        last = bool(block & 1)
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a run is one byte, whatever its length
    end += 4 * checked
    if end > len(data):
        raise Broken(f"frame at {at} is cut off")
    return end


def dictionary_of(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary in the leading skippable frame, itself compressed or not, and where the records start."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise Broken("the dictionary is cut off")
    words = bytes(data[8 : 8 + size])
    if words[:4] == struct.pack("<I", FRAME):
        words = zstandard.ZstdDecompressor().decompress(words)
    kind = zstandard.DICT_TYPE_FULLDICT if words[:4] == struct.pack("<I", TRAINED) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(words, dict_type=kind), 8 + size


def frames(content: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Each record's bytes, or why its frame or the rest of the archive cannot be read."""
    data = memoryview(content)
    try:
        words, at = dictionary_of(data)
    except (Broken, zstandard.ZstdError) as error:
        yield b"", str(error)
        return
    reader = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] in SKIPPABLE:
                at += 8 + struct.unpack_from("<I", data, at + 4)[0]
                if at > len(data):
                    raise Broken("a skippable frame is cut off")
                continue
            end = frame_end(data, at)
        except Broken as error:
            yield b"", str(error)
            return
        try:
            if zstandard.frame_content_size(data[at:end]) >= 0:
                yield reader.decompress(data[at:end]), None
            else:
                yield reader.decompressobj().decompress(data[at:end]), None
        except zstandard.ZstdError as error:
            yield b"", f"frame at {at}: {error}"
        at = end


def parsed_headers(raw: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and the fields by lower-cased name; lines that a blank continues are joined."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", raw).decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"no header: {line[:60]!r}")
        if name.lower() in fields and name.lower() != "warc-concurrent-to":
            raise ValueError(f"header twice: {name}")
        fields[name.lower()] = value.strip()
    return lines[0], fields


def length_of(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", value):
        raise ValueError("no length")
    return int(value)


class Record(NamedTuple):
    record_type: str | None = None
    record_id: str | None = None
    refers_to: str | None = None
    target_uri: str | None = None
    payload_digest: str | None = None
    payload_bytes: int | None = None  #: of the whole payload, also where a revisit leaves it out
    payload: bytes | None = None
    fault: str | None = None


def parse(raw: bytes) -> Record:
    """A record's fields; ``fault`` says what is wrong with its headers, lengths or digests."""
    known: dict = {}
    try:
        head, blank, body = raw.partition(b"\r\n\r\n")
        version, fields = parsed_headers(head)
        if not blank or not re.fullmatch(r"WARC/1\.[01]", version):
            raise ValueError("no WARC record")
        kind = fields.get("warc-type")
        known = {"record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri")}
        if missing := [n for n in ("warc-type", "warc-record-id", "warc-date") if not fields.get(n)]:
            raise ValueError(f"without {missing[0]}")
        size = length_of(fields)
        if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
            raise ValueError(f"length {size}, but {len(body) - 4} bytes")
        block = body[:size]
        if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1(block)}":
            raise ValueError("block digest")
        if kind not in ("response", "revisit"):  # warcinfo, metadata and the like have a block alone
            return Record(**known, payload=block, payload_bytes=size, payload_digest=sha1(block))
        if kind == "revisit" and not known["refers_to"]:
            raise ValueError("a revisit of nothing")
        http, blank, payload = block.partition(b"\r\n\r\n")
        status, http_fields = parsed_headers(http)
        if not blank or not status.startswith("HTTP/"):
            raise ValueError("no HTTP response")
        whole = length_of(http_fields)
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response" and whole != len(payload):
            raise ValueError(f"payload length {whole}, but {len(payload)} bytes")
        if kind == "response" and digest != sha1(payload):
            raise ValueError("payload digest")
        if kind == "revisit" and payload:
            raise ValueError("a revisit with a payload")
        if not re.fullmatch("[A-Z2-7]{32}", digest):
            raise ValueError("no payload digest")
        return Record(**known, payload_digest=digest, payload_bytes=whole, payload=None if kind == "revisit" else payload)
    except ValueError as error:
        return Record(**known, fault=str(error))


def with_responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, and ``response``: the largest page_id with the same payload, null where that is the row itself.

    Payloads are equal if their SHA-256 is. Copies of one payload are dealt to ``SHARES``
    shares; the shares' maxima are few rows, and each share meets its own once more, so a
    payload of a third of all rows is in no one task.
    """
    share = F.pmod(F.xxhash64("page_id", "url"), F.lit(SHARES)).alias("share_")
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("key_"), share)
    able = keyed.filter(F.octet_length(payload) >= least_bytes)
    shares = able.groupBy("key_", "share_").agg(F.max("page_id").alias("most"), F.count("*").alias("rows_"))
    groups = shares.groupBy("key_").agg(F.max("most").alias("head_"), F.sum("rows_").alias("rows_"), F.collect_set("share_").alias("shares_"))
    heads = groups.filter("rows_ > 1").select("key_", F.explode("shares_").alias("share_"), "head_")
    joined = keyed.join(heads, ["key_", "share_"], "left")
    large = F.octet_length(payload) >= least_bytes
    return joined.select("page_id", "url", "html", F.when(large & (F.col("page_id").isNull() | (F.col("page_id") < F.col("head_"))), F.col("head_")).alias("response"))


def bounded(frame: DataFrame) -> DataFrame:
    """``frame``, in a session whose Arrow batches hold about ``BATCH_BYTES`` bytes at most."""
    conf, setting = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not conf.get(setting).isdecimal() or int(conf.get(setting)) > BATCH_BYTES:  # Spark's own says "b" at the end
        conf.set(setting, str(BATCH_BYTES))
    return frame


def write_archives(pages: DataFrame, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """archive (a name), content, records: archives of ``pages`` (page_id, url, html, response).

    Every task writes its own archives, each of which has a dictionary fitted on its first
    records. A null html is the empty payload, a null url ``about:blank``.
    """

    def run(batches):
        task, n, archive = TaskContext.get().partitionId(), 0, Archive(sample_bytes)

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{n:06d}.warc.zst"]), pa.array([archive.done()], pa.binary()), pa.array([archive.records], pa.int64())], names=["archive", "content", "records"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "response")), strict=True):
                page_id, url, html, response = (x.as_py() for x in row)
                archive.add(record(Page(page_id, url, (html or "").encode(), response), date))
                if archive.size >= archive_bytes:
                    yield closed()
                    n, archive = n + 1, Archive(sample_bytes)
        if archive.records:
            yield closed()

    rows = bounded(pages).select("page_id", "url", "html", "response")
    return rows.mapInArrow(run, "archive string, content binary, records long")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of ``archives`` (archive, content), in their order, ``fault`` null where all is right.

    ``archives`` may as well come from ``binaryFile`` with its path as ``archive``. An empty
    archive has no record, a null content is a fault. A frame that cannot be read is one
    faulty row; after one that is cut off nothing more is read. Without ``payloads`` they
    are checked and left out.
    """

    def run(batches):
        schema = pa.schema([("archive", pa.string()), ("place", pa.int64()), *((c, pa.string()) for c in ("record_type", "record_id", "refers_to", "target_uri", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fault", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content"), strict=True):
                rows, held = [], 0
                found = frames(content.as_buffer()) if content.is_valid else [(b"", "no content")]
                for place, (raw, fault) in enumerate(found):
                    one = Record(fault=fault) if fault else parse(raw)
                    rows.append((name.as_py(), place, *(one if payloads else one._replace(payload=None))))
                    held += len(raw)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return bounded(archives).select("archive", "content").mapInArrow(run, RECORDS)


def unmet_revisits(records: DataFrame) -> DataFrame:
    """refers_to, payload_digest, payload_bytes of revisits without a response of that id, digest and length."""
    asked = records.filter("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    given = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes")
    return asked.join(given, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def archived_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from its archive record.

    The archives are written to the shared folder and read again; a record with a fault stops
    the query. Rows that share the largest page_id of their payload are all responses. A
    null page_id is smaller than others and null again. A null html is the empty payload; so
    are empty ones, which revisit each other. Payloads of any length are one record. No rows
    give none; other columns are not read.
    """
    archives = settle(write_archives(with_responses(pages)), "archives")
    records = read_archives(archives, payloads=False)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    right = F.when(F.col("fault").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat("archive", F.lit(": "), "fault")))
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", right.alias("record_type"), page("refers_to").alias("refers_to"))


#: SHA-1 in base 32: eight times 20 bits, each as four letters.
ARCHIVE_SQL = """
WITH given AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
placed AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS head FROM given)
SELECT page_id, strlen(payload) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST(('0x' || substr(sha1(payload), CAST(1 + i // 4 * 5 AS BIGINT), 5))::BIGINT >> CAST(15 - i % 4 * 5 AS BIGINT) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < head THEN head END AS refers_to
FROM placed
"""
