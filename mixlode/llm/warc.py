"""Legacy archive converter: ARC version 1 and 2 files to WARC 1.1.

The converter reads an ARC file's version block, whose lines name the version and
the header fields, then each record's header line and as many bytes as it declares;
a version 2 record's offset, and its checksum where it is an MD5 digest, must hold.
From these it makes the WARC records: a warcinfo record of the version block, and for
each capture an identifier (URN of a UUID named by archive and place, so no two are
alike), the timestamp in WARC's form, the type and digests of block and payload.
Captures of HTTP are responses, or revisits where an equal payload is kept by another
record; others (dns, say) are resources of the type that the ARC line declares.

The reader measures payloads: lengths and digests of responses are of the bytes read
back and must equal the declared ones, those of revisits are of the response that has
the declared digest.

Defined cases: a null html is an empty payload, a null url is written as "-"; a
null page_id is kept as null and is a response only if all ids of its payload
are null; rows that repeat the smallest page_id of a payload are all responses;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlode.llm.common import key_bits, passing, selected, small_batches, stored

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: Bytes after which a new archive begins.
ARCHIVE_BYTES = 4 << 20
# Fixed values of the ARC format: field lines of the two versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


@dataclass(frozen=True)
class Capture:
    """One record of an ARC file."""

    url: str
    ip: str
    date: str
    block: bytes
    kind: str = "text/html"


@dataclass(frozen=True)
class Original:
    """The response that a revisit refers to."""

    page_id: int
    url: str
    date: str


def arc_file(name: str, version: int, captures: list[Capture]) -> bytes:
    """An ARC file of this version."""
    lines = f"{version} 0 Archive\n{FIELDS[version]}\n".encode()
    out = bytearray(_arc_record(version, Capture(f"filedesc://{name}", "0.0.0.0", "20000101000000", lines, "text/plain"), name, 0))
    for c in captures:
        out += b"\n"
        out += _arc_record(version, c, name, len(out))
    return bytes(out + b"\n")


def _arc_record(version: int, c: Capture, name: str, offset: int) -> bytes:
    rest = f"{len(c.block)}" if version == 1 else f"200 {hashlib.md5(c.block).hexdigest()} - {offset} {name} {len(c.block)}"
    return f"{c.url} {c.ip} {c.date} {c.kind} {rest}\n".encode() + c.block


def version_block(data: bytes) -> tuple[Capture, int]:
    """An ARC file's first record, and where it ends."""
    start = data.index(b"\n") + 1
    url, ip, date, kind, *_, size = data[: start - 1].decode("utf-8").split(" ")
    return Capture(url, ip, date, data[start : start + int(size)], kind), start + int(size)


def parse_arc(data: bytes) -> Iterator[Capture]:
    """The captures of an ARC file of either version."""
    first, at = version_block(data)
    described = first.block.decode("utf-8").split("\n")
    version = int(described[0].split(" ")[0])
    if version not in FIELDS:
        raise ValueError(f"ARC version {version} is unknown")
    fields = described[1].split(" ")
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        stop = data.index(b"\n", at)
        values = data[at:stop].decode("utf-8").split(" ")
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line has {len(values)} fields; the file declares {len(fields)}")
        head = dict(zip(fields, values, strict=True))
        length = int(head["Archive-length"])
        block = data[stop + 1 : stop + 1 + length]
        if len(block) != length:
            raise ValueError("an ARC record ends before its declared length")
        if head.get("Offset", "-").isdigit() and int(head["Offset"]) != at:
            raise ValueError(f"an ARC record at {at} declares the offset {head['Offset']}")
        if re.fullmatch("[0-9a-f]{32}", head.get("Checksum", "-")) and hashlib.md5(block).hexdigest() != head["Checksum"]:
            raise ValueError("an ARC record does not match its checksum")
        yield Capture(head["URL"], head["IP-address"], head["Archive-date"], block, head["Content-type"])
        at = stop + 1 + length


def http_block(page_id: int | None, payload: bytes) -> bytes:
    key = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def record_id(archive: str, place: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'archive:{archive}#{place}').urn}>"


def _timestamp(d: str) -> str:
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def payload_of(block: bytes) -> bytes:
    """What follows the head of an HTTP block (nothing where the head has no end); a whole block of another protocol."""
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _record(kind: str, name: str, date: str, content: str, block: bytes, more: list[str]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {_timestamp(date)}", *more, f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def warc_record(c: Capture, name: str, original: Original | None = None) -> bytes:
    """The WARC record of a capture; a revisit if an original is given."""
    payload = payload_of(c.block)
    about = [f"WARC-Target-URI: {c.url}", f"WARC-IP-Address: {c.ip}", f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}"]
    if not c.block.startswith(b"HTTP/"):
        return _record("resource", name, c.date, c.kind, c.block, about)
    http = "application/http; msgtype=response"
    if original is None:
        return _record("response", name, c.date, http, c.block, about)
    about += [
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {original.url}", f"WARC-Refers-To-Date: {_timestamp(original.date)}",
        f"WARC-X-Refers-To-Page: {original.page_id}",
    ]
    return _record("revisit", name, c.date, http, c.block[: len(c.block) - len(payload)], about)


def warcinfo(first: Capture, archive: str) -> bytes:
    """The warcinfo record of an ARC file's version block."""
    lines = [f"description: {line}" for line in first.block.decode("utf-8").split("\n") if line]
    block = "\r\n".join(["software: mixlode", "format: WARC File Format 1.1", *lines, ""]).encode()
    return _record("warcinfo", record_id(archive, 0), first.date, "application/warc-fields", block, [f"WARC-Filename: {archive}"])


@dataclass(frozen=True)
class Record:
    """One record of a WARC file."""

    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["WARC-Type"]


def parse_warc(data: bytes) -> Iterator[Record]:
    """The records of an uncompressed WARC file; block digests are verified."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) != size or hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"].partition(":")[2]:
            raise ValueError("a WARC block does not match its length or digest")
        yield Record(headers, block)
        at = stop + 4 + size + 4


def convert(data: bytes, originals: list[Original | None], archive: str) -> bytes:
    """The WARC file named `archive` from an ARC file; originals: for the i-th capture, what it is a revisit of."""
    first, _ = version_block(data)
    return b"".join([warcinfo(first, archive), *(warc_record(c, record_id(archive, i + 1), originals[i]) for i, c in enumerate(parse_arc(data)))])


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, d, refers_to, refers_url of the rows whose payload an earlier page has."""
    html = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", "url", F.octet_length(html).alias("n"), F.sha2(html.cast("binary"), 256).alias("d")).where(F.col("n") >= REVISIT_BYTES)
    first = narrow.groupBy("d").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    same = narrow.select("page_id", "d").join(first.select("d", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "d").where("refers_to is not null and not page_id <=> refers_to")
    # ids that repeat with other payloads stay apart by the digest
    return same.distinct()


def written_url(url: str | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "-"


def _archiver(collection: str, date: str, ip: str, bits: np.ndarray | None) -> Callable:
    """Streams (page_id, url, html, refers_to, refers_url, key); yields archives.  bits: rows that this filter lets through are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        held: list[Capture] = []
        originals: list[Original | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            version, name = 1 + number % 2, f"{collection}-{task:06d}-{number:06d}"
            data = convert(arc_file(f"{name}.arc", version, held), originals, f"{name}.warc")
            number, size = number + 1, 0
            held.clear()
            originals.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{name}.warc"]), pa.array([version], pa.int32()), pa.array([data], pa.binary())], ["name", "version", "warc"])

        for b in batches:
            if bits is not None:
                b = b.filter(pa.array(~passing(bits, b.column(5).to_numpy(zero_copy_only=False))))
            for page_id, url, html, ref, ref_url in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                block = http_block(page_id, (html or "").encode("utf-8"))
                held.append(Capture(written_url(url), ip, date, block))
                originals.append(None if ref is None else Original(ref, written_url(ref_url), date))
                size += len(block)
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


def archives(pages: DataFrame, collection: str = "pages", date: str = "20000101000000", ip: str = "0.0.0.0") -> DataFrame:
    """name, version, warc (binary): the pages' ARC files, versions in turn, converted to WARC.

    Only pages whose payload a filter of the revisits' digests lets through are shuffled.
    """
    small_batches(pages.sparkSession)
    links = stored(revisits(pages), "warc-revisits")
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    keyed = pages.select("page_id", "url", "html", digest.alias("digest")).withColumn("key", F.xxhash64("digest"))
    bits = key_bits(links.select(F.xxhash64("d")))
    to = links.select(F.col("page_id").alias("p"), "d", "refers_to", "refers_url")
    copies = selected(keyed, bits)
    joined = copies.join(to.hint("merge"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "refers_to", "refers_url", "key")
    alone = keyed.select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"), "key")
    schema = "name string, version int, warc binary"
    return joined.mapInArrow(_archiver(f"{collection}-copies", date, ip, None), schema).unionByName(alone.mapInArrow(_archiver(collection, date, ip, bits), schema))


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string"


def records(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url of every capture.

    Lengths and digests of payloads are measured, and an error is raised where a declared
    one differs; a revisit has no payload of its own, hence a null length, and the
    declared digest.
    """
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = [f.split()[0] for f in _RECORD.split(", ")]

    def row(r: Record) -> tuple:
        payload, declared = payload_of(r.block), r.headers["WARC-Payload-Digest"].partition(":")[2]
        if r.kind != "revisit" and hashlib.sha256(payload).hexdigest() != declared:
            raise ValueError("a WARC payload does not match its digest")
        head = r.block[: len(r.block) - len(payload)]
        page = next((line[11:] for line in head.split(b"\r\n") if line.startswith(b"X-Page-Id: ")), None)
        ref = r.headers.get("WARC-X-Refers-To-Page")
        return (int(page) if page else None, None if r.kind == "revisit" else len(payload), declared, r.kind, int(ref) if ref else None, r.headers["WARC-Record-ID"], r.headers["WARC-Target-URI"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = [row(r) for r in parse_warc(data.as_py()) if r.kind != "warcinfo"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("warc").mapInArrow(run, _RECORD)


def read_archives(files: DataFrame) -> DataFrame:
    """The records, revisits with the measured length of the response whose payload they refer to."""
    found = stored(records(files), "warc-records")
    kept = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("n"))
    again = found.where("record_type = 'revisit'").join(kept, "payload_digest", "left").withColumn("payload_bytes", F.col("n"))
    return found.where("record_type <> 'revisit'").unionByName(again.select(*found.columns))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: every page converted to a WARC record and read back."""
    files = stored(archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "warc-files")
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id <> kept THEN kept END AS refers_to FROM f"""
