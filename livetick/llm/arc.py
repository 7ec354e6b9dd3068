"""Legacy ARC archives to WARC.

An ARC file starts with a version block: a `filedesc:` header line, a version line and a line that names the fields of
every header that follows. Version 1 has five fields a header, version 2 has ten; the last is the declared length of
the bytes behind the line. `convert` parses both and synthesises WARC 1.1 records: a warcinfo per file; `response` for
blocks that start as HTTP does, `resource` for others, `revisit` for repeated payloads; record ids from file name and
place, so that a task that runs again writes the same ones; ISO times from archive dates; SHA-256 payload digests.

Files are gzipped text that Spark writes and commits, one archive of about `ARCHIVE_BYTES` a row and file. What repeats
is found from an index with one short row a record; payloads are not shuffled, but for the gzipped files themselves where
the list of repeats is too long to be sent to every task. Keys that many records share are salted in both joins.

Results for odd rows: a null or missing html is an empty payload; a null url is written as `-`, blanks and controls in
urls are percent-encoded; a null page_id is kept and counts as larger than any id; of rows with equal ids and payloads
one is the response and the others revisit it; payloads below `REVISIT_BYTES` never revisit; empty tables give empty
archives; other columns are ignored. A file that breaks its declared lengths stops the job.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from livetick.llm.common import stored, table, work_path

#: Bytes of an archive before it is gzipped (one record at least).
ARCHIVE_BYTES = 16 << 20
REVISIT_BYTES = 100
#: Tasks that share the records of one key.
SALTS = 32
#: Date of pages that have none of their own.
FETCHED = "20000101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Field names of the two versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Urls and content types of old files may hold blanks; what stands between them may not.
_HEADERS = {
    1: re.compile(rb"(?P<url>.+?) (?P<ip>\S+) (?P<date>\d{8,17}) (?P<type>.*) (?P<length>\d+)"),
    2: re.compile(rb"(?P<url>.+?) (?P<ip>\S+) (?P<date>\d{8,17}) (?P<type>.*) (?P<status>\d{3}|-) (?P<checksum>\S+) (?P<location>\S+) "
                  rb"(?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)"),
}
_PAGE_ID = re.compile(rb"^X-Page-Id: (-?\d+)\r?$", re.MULTILINE)


class ArcRecord(NamedTuple):
    """One document of an ARC file; `source` names the file and `at` is the header's place in it, unpacked."""

    source: str
    name: str
    at: int
    url: str
    date: str
    type: str
    block: bytes

    @property
    def record_id(self) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.source}#{self.at}')}>"

    @property
    def http(self) -> bool:
        return self.block.startswith(b"HTTP/")

    def split(self) -> tuple[bytes, bytes]:
        """Protocol headers with the empty line behind them, and payload; old servers part lines by \\n alone."""
        if self.http:
            for blank in (b"\r\n\r\n", b"\n\n"):
                head, found, payload = self.block.partition(blank)
                if found:
                    return head + found, payload
        return b"", self.block

    def page_id(self) -> int | None:
        found = _PAGE_ID.search(self.split()[0])
        return int(found[1]) if found else None


def opened(data: bytes) -> BinaryIO:
    """A stream over a file's bytes, unpacked where they are gzipped, in one or in several members."""
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 16) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def parse_arc(data: bytes, source: str) -> Iterator[ArcRecord]:
    """The documents of an ARC file of either version, without its version block; `source` tells files apart."""
    stream, at, version, name = opened(data), 0, None, ""
    while line := stream.readline():
        start, at = at, at + len(line)
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        if version is None:
            if not line.startswith(b"filedesc:"):
                raise ValueError("an ARC file starts with its file description")
            length = int(line.rpartition(b" ")[2])
            name = line.partition(b" ")[0].removeprefix(b"filedesc:").lstrip(b"/").decode("utf-8", "replace")
        else:
            found = _HEADERS[version].fullmatch(line)
            if found is None:
                raise ValueError(f"{name}, {start}: no header of version {version}")
            length = int(found["length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"{name}, {start}: {len(block)} of {length} declared bytes")
        at += length
        if version is None:
            number, _, rest = block.partition(b" ")
            version = int(number)
            if version not in FIELDS or rest.split(b"\n")[1].strip().decode() != FIELDS[version]:
                raise ValueError(f"{name}: unknown version or fields")
        else:
            yield ArcRecord(source, name, start, found["url"].decode("utf-8", "replace"), found["date"].decode(),
                            found["type"].decode("utf-8", "replace"), block)


def iso_time(date: str) -> str:
    """An archive date of 8 to 17 digits as WARC-Date; missing parts are the earliest, fractions are left out."""
    d = date[:14].ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


# --- writing ARC --------------------------------------------------------------------------------------------


def _quoted(url: str | None) -> str:
    return re.sub("[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


def arc_head(name: str, version: int, date: str = FETCHED) -> bytes:
    body = f"{version} 0 livetick\n{FIELDS[version]}\n".encode()
    middle = "text/plain" if version == 1 else f"text/plain 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} {middle} {len(body)}\n".encode() + body


def arc_document(url: str | None, block: bytes, name: str, at: int, version: int, date: str = FETCHED) -> bytes:
    middle = "text/html" if version == 1 else f"text/html 200 - - {at + 1} {name}"
    return f"\n{_quoted(url)} 0.0.0.0 {date} {middle} {len(block)}\n".encode() + block


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _write_archives(rows: DataFrame, path: str, end: str) -> None:
    """Every row of `archive` becomes a gzipped file of its own; `end` closes the last record."""
    rows.selectExpr("CAST(archive AS STRING) AS value").write.option("lineSep", end).option("compression", "gzip").option(
        "maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """All pages as ARC files, odd tasks in version 2 and even ones in version 1."""

    def of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version, held, size, number = 1 + task % 2, [], 0, 0

        def name() -> str:
            return f"pages-{task:06d}-{number:06d}.arc"

        for frame in frames:
            for page_id, url, html in zip(*frame.columns, strict=True):
                if not held:
                    held = [arc_head(name(), version)]
                    size = len(held[0])
                block = http_block(page_id.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"))
                held.append(arc_document(url.as_py(), block, name(), size, version))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield _binary(b"".join(held))
                    held, number = [], number + 1
        if held:
            yield _binary(b"".join(held))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    _write_archives(rows.mapInArrow(of, "archive binary"), path, "\n")


def _binary(data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"archive": pa.array([data], pa.binary())})


# --- converting ---------------------------------------------------------------------------------------------


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the archives in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def salted_join(rows: DataFrame, heads: DataFrame, key: str, spread_by: Column) -> DataFrame:
    """`rows` with the one row of `heads` of their key; a key's rows are shared by `SALTS` tasks."""
    wide = heads.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).join(wide, [key, "_salt"]).drop("_salt")


_INDEX = "path string, at long, page_id long, record_id string, payload_bytes long, digest binary"


def arc_index(files: DataFrame) -> DataFrame:
    """One short row for every document of ARC files."""

    def of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for path, content in zip(*frame.columns, strict=True):
                rows = []
                for r in parse_arc(content.as_py(), path.as_py()):
                    payload = r.split()[1]
                    rows.append((path.as_py(), r.at, r.page_id(), r.record_id, len(payload), hashlib.sha256(payload).digest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)],
                        ["path", "at", "page_id", "record_id", "payload_bytes", "digest"])

    return files.mapInArrow(of, _INDEX)


def repeats(index: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(path, at, refers_to) of documents whose payload another one has: the one with the smallest page id, then place."""
    long = index.where(F.col("payload_bytes") >= least_bytes)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "at", "record_id")
    heads = long.groupBy("digest").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    met = salted_join(long, heads, "digest", F.struct("path", "at"))
    return met.where("record_id <> head.record_id").select("path", "at", F.col("head.record_id").alias("refers_to"))


def _headers(fields: dict[str, str | int]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def warc_record(record: ArcRecord, refers_to: str | None) -> bytes:
    """The WARC record of an ARC document, without the empty lines that close it."""
    head, payload = record.split()
    kind = "revisit" if refers_to is not None else "response" if record.http else "resource"
    block = head if refers_to is not None else record.block
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": record.record_id, "WARC-Date": iso_time(record.date), "WARC-Target-URI": record.url,
        "Content-Type": "application/http; msgtype=response" if record.http else record.type,
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}", "X-Payload-Length": len(payload),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to}
    return _headers(fields | {"Content-Length": len(block)}) + block


def warc_info(name: str) -> bytes:
    body = b"software: livetick\r\nformat: WARC File Format 1.1\r\n"
    return _headers({
        "WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": iso_time(FETCHED),
        "WARC-Filename": name.removesuffix(".arc") + ".warc", "Content-Type": "application/warc-fields", "Content-Length": len(body),
    }) + body


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = REVISIT_BYTES) -> None:
    """Write a WARC file for every ARC file, repeated payloads as revisits."""

    def of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for path, content, known in zip(*frame.columns, strict=True):
                refers, out = {k["at"]: k["refers_to"] for k in known.as_py() or ()}, []
                for record in parse_arc(content.as_py(), path.as_py()):
                    out = out or [warc_info(record.name)]
                    out.append(warc_record(record, refers.get(record.at)))
                if out:
                    yield _binary(b"\r\n\r\n".join(out) + b"\r\n")

    files = files_of(spark, arc_path)
    known = repeats(stored(arc_index(files), "arc-index"), least_bytes).groupBy("path").agg(
        F.collect_list(F.struct("at", "refers_to")).alias("known"))
    _write_archives(files.join(known, "path", "left").select("path", "content", "known").mapInArrow(of, "archive binary"), warc_path, "\r\n")


# --- reading WARC -------------------------------------------------------------------------------------------


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of every record of a WARC file."""
    stream = opened(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.partition(b":")
            fields[key.decode().lower()] = value.strip().decode("utf-8", "replace")
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"{fields.get('warc-record-id')}: {len(block)} of {length} declared bytes")
        yield fields, block


_RECORDS = ("page_id long, record_id string, url string, time string, record_type string, payload_bytes long, payload_digest string, "
            "refers_to_id string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for every response, resource and revisit; payloads that are there are held against their digests."""

    def of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for (content,) in zip(*frame.columns, strict=True):
                rows = []
                for fields, block in parse_warc(content.as_py()):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    digest, length = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                    record = ArcRecord("", "", 0, fields["warc-target-uri"], "", "", block)
                    if kind != "revisit":
                        payload = record.split()[1]
                        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{fields['warc-record-id']}: payload and digest differ")
                    rows.append((record.page_id(), fields["warc-record-id"], record.url, fields["warc-date"], kind, length, digest,
                                 fields.get("warc-refers-to")))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                    names = [f.split()[0] for f in _RECORDS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)

    return files_of(spark, path).select("content").mapInArrow(of, _RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with `refers_to`, the page id of the response that a revisit names."""
    named = records.where("refers_to_id IS NOT NULL")
    heads = records.where("refers_to_id IS NULL").join(named.select(F.col("refers_to_id").alias("record_id")).distinct(), "record_id")
    heads = heads.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    met = salted_join(named, heads, "refers_to_id", F.col("record_id"))
    plain = records.where("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    return plain.unionByName(met)


def op11_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC files of both versions, converted to WARC and read back."""
    arc, warc = work_path(spark, "arc"), work_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return resolved(stored(read_warc(spark, warc), "warc-index")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same from the table itself; page ids are unique there.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT *, strlen(h) >= 100 AND page_id > min(page_id) OVER (PARTITION BY h) AS again, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, if(again, 'revisit', 'response') AS record_type,
  if(again, first, NULL) AS refers_to
FROM k"""
