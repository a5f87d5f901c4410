"""WARC archives: one gzip member for each record, identical payloads as revisits, and a salvage reader.

The reader checks every record (gzip checksum, version line, length, record end, digests of block and payload).  After
a failed check it seeks the next place where a whole valid record begins, a gzip member or a version
line, goes on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, prepare, stored, whole_partition

END = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
PLACES = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
ID = "<urn:x-page:{}>"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of the largest file that is read as one value.
LARGEST_FILE = 1 << 30


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One uncompressed record: a response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    # A header value is one line; whatever would end it is percent-encoded.
    uri = re.sub(r"[\r\n\x00]", lambda m: f"%{ord(m.group()):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {ID.format('' if page_id is None else page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: {ID.format(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + END + block + END


def member(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member of its own; equal input gives equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


@dataclass
class Record:
    """A checked record.  ``payload`` is None for revisits; ``payload_bytes`` is that of the full payload."""

    offset: int
    length: int
    type: str
    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int
    digest: str

    @staticmethod
    def _page(value: str | None) -> int | None:
        m = re.fullmatch(r"<urn:x-page:(-?\d+)>", value or "")
        return int(m[1]) if m else None

    @property
    def page_id(self) -> int | None:
        return self._page(self.headers.get("warc-record-id"))

    @property
    def refers_to(self) -> int | None:
        return self._page(self.headers.get("warc-refers-to"))


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


class Damaged(ValueError):
    """A record that fails a check; the message says which."""


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record whose version line is at ``at``, and where it ends."""
    if not VERSION.match(data, at):
        raise Damaged("version line")
    stop = data.find(END, at)
    if stop < 0:
        raise Damaged("headers")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        size = int(headers["content-length"])
    except (KeyError, ValueError):
        raise Damaged("content length") from None
    begin = stop + len(END)
    end = begin + size
    if size < 0 or data[end : end + len(END)] != END:
        raise Damaged("record end")
    block = data[begin:end]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha256:") and stated[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest")
    kind, digest = headers.get("warc-type", ""), headers.get("warc-payload-digest", "")
    payload, full = block, size
    if headers.get("content-type", "").startswith("application/http"):
        head, mark, payload = block.partition(END)
        if not mark:
            raise Damaged("http headers")
        stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
        full = int(stated[1]) if stated else len(payload)
    if kind == "revisit":
        payload = None
    else:
        if full != len(payload):
            raise Damaged("payload length")
        if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(payload).hexdigest():
            raise Damaged("payload digest")
    return Record(at, end + len(END) - at, kind, headers, payload, full, digest.removeprefix("sha256:")), end + len(END)


def _before_damage(data: bytes, at: int) -> list[bytes]:
    """What a damaged member gives up to its damage: steps that fail are tried again as smaller ones."""
    z, out, step = zlib.decompressobj(31), [], 1 << 12
    while at < len(data) and step:
        ahead = z.copy()
        try:
            out.append(ahead.decompress(data[at : at + step]))
            z, at = ahead, at + step
        except zlib.error:
            step //= 16
    return out


def _inflate(data: bytes, at: int, step: int = 1 << 15) -> tuple[bytes, int, str]:
    """The gzip member at ``at``, where it ends, and what is wrong with it; fed in steps, so a member costs its own size.

    What comes before the damage of a member is given back too.
    """
    z = zlib.decompressobj(31)
    out, p, view, why = [], at, memoryview(data), ""
    try:
        while not z.eof:
            if p >= len(data):
                why = "member cut off"
                break
            out.append(z.decompress(view[p : p + step]))
            p += step
    except zlib.error as e:
        why = "member checksum" if "check" in str(e) else "member"
        out = _before_damage(data, at)
    return b"".join(out), min(p, len(data)) - len(z.unused_data), why


def _inside(data: bytes) -> tuple[list[Record], str]:
    """The records of an inflated member that pass their checks, and the first failed check."""
    found, at, why = [], 0, ""
    while at < len(data):
        try:
            record, at = _parse(data, at)
            found.append(record)
        except Damaged as e:
            why = why or str(e)
            later = VERSION.search(data, at + 1)
            at = later.start() if later else len(data)
    return found, why


def _take(data: bytes, at: int) -> tuple[list[Record], int, str]:
    """The records at ``at``, where they end, and what is wrong among them.

    A member that holds a single record stands or falls with it and with its own checksum.  Of a member with
    several the records that pass are kept; where the member itself is damaged, only those whose block has a
    digest, as nothing else vouches for them.
    """
    if not data.startswith(MEMBER, at):
        record, end = _parse(data, at)
        return [record], end, ""
    inside, end, why = _inflate(data, at)
    found, bad = _inside(inside)
    several = len(found) > 1 or (bool(found) and bool(bad))
    if (why or bad) and not several:
        raise Damaged(why or bad)
    if why:
        found = [r for r in found if r.headers.get("warc-block-digest", "").startswith("sha256:")]
        if not found:
            raise Damaged(why)
    for r in found:
        # Inside a gap a record has no bytes of its own.
        r.offset, r.length = at, 0 if why or bad else end - at
    return found, end, why or (f"inside a member: {bad}" if bad else "")


def salvage(data: bytes) -> Salvage:
    """All records of an archive that pass their checks, and the byte gaps that were quarantined.

    A member in which some records fail is a gap, too; the records that were recovered from it have length 0.
    After a member that is damaged itself the search goes on at the next place behind its beginning.
    """
    out, at, bad, why = Salvage(), 0, None, ""
    while at < len(data):
        try:
            found, end, wrong = _take(data, at)
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            later = PLACES.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if bad is not None:
            out.gaps.append((bad, at, why))
            bad = None
        out.records += found
        if wrong.startswith("member"):
            bad, why = at, wrong
            later = PLACES.search(data, at + 1)
            at = later.start() if later else len(data)
        else:
            if wrong:
                out.gaps.append((at, end, wrong))
            at = end
    if bad is not None:
        out.gaps.append((bad, len(data), why))
    return out


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: who is a response (null) and who revisits whom.

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response; rows that repeat
    that page_id are responses too, and rows without an id revisit the smallest one.  Only digests are
    aggregated, and only repeated ones are joined: those that many pages share, and all while they are few,
    are broadcast, so a payload stays where it was read.  Columns other than ``page_id, url, html`` are ignored,
    whatever their names; an empty table gives no rows.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    counted = (
        rows.filter(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("members"))
        .filter(F.col("members") > 1)
    )
    counted = stored(counted, "repeated-digests")
    total = counted.agg(F.sum("members")).first()[0] or 0
    joined = join_hot(rows, counted, ["digest"], total)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, least: int = 100, level: int = 6, segment_bytes: int = 4 << 20) -> DataFrame:
    """Archives of all pages as a stored table ``archive, segment, content``.

    A segment is a run of whole gzip members, so the segments of an archive put together in order are a
    .warc.gz file, and each can be read alone.  Null html is an empty payload, a null url an empty one; an
    empty table gives no archives; other columns are ignored, whatever their names.
    """
    prepare(pages.sparkSession)

    def work(batches):
        task = TaskContext.get().partitionId()
        held, size, segment = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    m = member(make_record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"]), level)
                    held.append(m)
                    size += len(m)
                    if size >= segment_bytes:
                        yield {"archive": [f"part-{task:05d}.warc.gz"], "segment": [segment], "content": [b"".join(held)]}
                        held, size, segment = [], 0, segment + 1
        if held:
            yield {"archive": [f"part-{task:05d}.warc.gz"], "segment": [segment], "content": [b"".join(held)]}

    table = whole_partition(with_revisits(pages, least), work, "archive string, segment int, content binary")
    return stored(table, "warc", "uncompressed")


RECORD = (
    "archive string, segment int, offset long, length long, page_id long, url string, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long, gap_reason string"
)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Salvage every segment of ``archive, segment, content``.

    One row for each record that passes its checks, and one with ``gap_reason`` (and no record columns)
    for each quarantined gap.  Null content reads as an empty archive.
    """
    prepare(archives.sparkSession)
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                found = salvage(r["content"] or b"")
                rows = [
                    (x.offset, x.length, x.page_id, x.headers.get("warc-target-uri"), x.payload_bytes, x.digest, x.type,
                     x.refers_to, None, x.payload)
                    for x in found.records
                ] + [(a, b - a, None, None, None, None, None, None, why, None) for a, b, why in found.gaps]
                rows = [(r["archive"], r["segment"], *x) for x in rows]
                yield {k: [x[j] for x in rows] for j, k in enumerate(names)}

    return whole_partition(archives.select("archive", "segment", "content"), work, schema)


def read_archive_files(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Salvage .warc and .warc.gz files under ``path``, in any store that Spark can read.

    A file is one value of one task, so its size is checked before it is read: a file of more than LARGEST_FILE
    bytes becomes one gap that names its size, and is not read.  Split such files at members first.
    """
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= LARGEST_FILE
    read = read_archives(files.filter(fits).select(F.col("path").alias("archive"), F.lit(0).alias("segment"), "content"), with_payload)
    large = files.filter(~fits).select(
        F.col("path").alias("archive"), F.lit(0).alias("segment"), F.lit(0).cast("long").alias("offset"), "length", F.lit("larger than one task reads").alias("gap_reason")
    )
    return read.unionByName(large, allowMissingColumns=True)
