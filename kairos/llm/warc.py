"""ARC to WARC conversion.

Pages are archived as ARC files of version 1 or 2; the converter parses each
file's version block, the header line that this version defines and the declared
length, and writes WARC/1.1 files with made-up but stable record ids, ISO
timestamps, record types and payload digests.  Records whose payload another
record carries become revisits of it.  Files are written and read by Spark's text
source with the format's own separators, so any Hadoop file system serves, and
Python sees one bounded batch at a time.  A first reading keeps keys and digests only; those
of repeated payloads are grouped, and the verdicts (which record is a revisit, of which) meet
the records of a second reading: broadcast while they are counted few, so that payloads
go from ARC to WARC within a task, else by an equi-join of deflated payloads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.llm.common import configure, materialize
from kairos.session import checkpoint_dir

# The field names of the two ARC versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"),
}
#: Verdicts (about 200 bytes each) that may be broadcast.
BROADCAST_VERDICTS = 100_000
ARC_END, WARC_END = "\n", "\r\n\r\n"
DATE = "20240101000000"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("arc string, ordinal long, version int, url string, ip string, date string, mime string, "
          "status string, head binary, payload binary, page_id long, payload_bytes long, digest string")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(url: str | None, page_id: int | None) -> str:
    """URL as one ARC field: white space and control characters percent-encoded, and never a filedesc URL."""
    said = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or f"urn:page:{page_id}").encode()).decode()
    return said.replace(":", "%3A", 1) if said.startswith("filedesc:") else said


def _arc_row(version: int, url: str, mime: str, name: str, offset: int, body: bytes, status: str = "200") -> bytes:
    fields = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": mime, "Result-code": status,
              "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name,
              "Archive-length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> None:
    """One ARC file per partition, version 1 and 2 in turn; a null html is an empty payload."""
    configure(pages.sparkSession)
    lean = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("u"),
                        F.col(html_col).cast("binary").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"pages-{part:06d}.arc"
        block = f"{version} 0 kairos\n{' '.join(ARC_FIELDS[version])}\n".encode()
        rows = [_arc_row(version, f"filedesc://{name}", "text/plain", name, 0, block)]
        offset = len(rows[0]) + 1
        for b in batches:
            for i, u, h in zip(*(c.to_pylist() for c in b.columns)):
                mark = "" if i is None else f"X-Page-Id: {i}\r\n"
                head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                        f"Content-Length: {len(h or b'')}\r\n{mark}\r\n").encode()
                rows.append(_arc_row(version, _clean(u, i), "text/html", name, offset, head + (h or b"")))
                offset += len(rows[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])
            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    _write(lean.mapInArrow(run, "value binary"), path, ARC_END)


def _write(values: DataFrame, path: str, end: str) -> None:
    (values.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").text(path))


def _pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """Separator-delimited pieces of the files under ``path``, in file order (gzip files are never split)."""
    return spark.read.option("lineSep", end).text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("value"))


class Arc:
    """ARC parser fed with the lines of one file."""

    def __init__(self):
        self.version, self.name, self.ordinal, self.need, self.fields, self.parts = 0, "", 0, -1, None, []

    def header(self, line: bytes) -> dict | None:
        values = line.decode("utf-8", "replace").split(" ")
        for version in ([self.version] if self.version else (1, 2)):
            names = ARC_FIELDS[version]
            if len(values) == len(names) and values[-1].isdigit() and values[0] and values[2].isdigit():
                return dict(zip(names, values)) | {"version": version}
        return None

    def feed(self, line: bytes) -> tuple | None:
        """A finished record, if this line ends one.  Text between records that is no header is skipped."""
        if self.need < 0:
            self.fields = self.header(line) if line else None
            if not self.fields:
                return None
            self.need, self.parts = int(self.fields["Archive-length"]), None
            return None
        if self.parts is None:
            self.parts, self.size = [line], len(line)
        else:
            self.parts.append(line)
            self.size += 1 + len(line)
        return self.end() if self.size >= self.need else None

    def end(self) -> tuple | None:
        """The record so far: what its declared length covers, or all there is of a truncated one."""
        if self.need < 0:
            return None
        body, f = b"\n".join(self.parts or [])[:self.need], self.fields
        self.need = -1
        if f["URL"].startswith("filedesc://"):
            self.name = f["URL"][len("filedesc://"):]
            first = body.split(b" ", 1)[0]
            self.version = int(first) if first in (b"1", b"2") else f["version"]
            return None
        self.ordinal += 1
        return self.name, self.ordinal, f["version"], f, body


def _split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; a body without HTTP head is all payload."""
    if body.startswith(b"HTTP/"):
        at = body.find(b"\r\n\r\n")
        return (body[:at + 4], body[at + 4:]) if at >= 0 else (body, b"")
    return b"", body


def _number(head: bytes, name: bytes) -> int | None:
    m = re.search(rb"(?im)^" + name + rb":[ \t]*(-?\d+)[ \t]*\r?$", head)
    return int(m[1]) if m else None


def read_arc(spark: SparkSession, path: str, packed: bool = False, payloads: bool = True) -> DataFrame:
    """One row (RECORD) per ARC record under ``path``; payloads deflated if ``packed``, to be shuffled, and
    null without ``payloads``."""
    configure(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arc, file = Arc(), None

        def row(got: tuple) -> tuple:
            name, ordinal, version, f, body = got
            head, payload = _split_http(body)
            return (name or file, ordinal, version, f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"],
                    f.get("Result-code", "-"), head, (zlib.compress(payload) if packed else payload) if payloads else None,
                    _number(head, b"X-Page-Id"), len(payload), sha1_base32(payload))

        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(),
                                 "binary": pa.binary()}[k]) for n, k in (x.split() for x in RECORD.split(", "))])
        for b in batches:
            out = []
            for f, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if f != file:
                    if got := arc.end():
                        out.append(row(got))
                    arc, file = Arc(), f
                if got := arc.feed(line or b""):
                    out.append(row(got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)],
                                                 schema=schema)
        if got := arc.end():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(got), schema.types)],
                                             schema=schema)

    return _pieces(spark, path, ARC_END).mapInArrow(run, RECORD)


def iso_date(arc_date: str) -> str:
    """WARC-Date of a 14-digit ARC date; shorter ones are filled up, others give the epoch."""
    d = arc_date if arc_date.isdigit() and 4 <= len(arc_date) <= 14 else "19700101000000"
    d += "00000101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(arc: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{arc}#{ordinal}')}>"


def _warc_row(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, revisit_from: int = 0) -> None:
    """Write the ARC records under ``arc_path`` as WARC files.

    Of records with equal payloads of at least ``revisit_from`` bytes the one with the
    largest page id is the response (ties: the last by file name and position), the
    others are revisits of it.  Records without a page id come before all others.
    """
    last = F.struct("page_id", "arc", "ordinal", "url", "date")
    keys = materialize(read_arc(spark, arc_path, payloads=False).where(F.col("payload_bytes") >= revisit_from).select(
        "arc", "ordinal", "page_id", "url", "date", "digest", "payload_bytes"))
    best = (keys.groupBy("digest", "payload_bytes").agg(F.max(last).alias("best"), F.count(F.lit(1)).alias("n"))
            .where("n > 1").drop("n"))
    verdicts = materialize(keys.join(best, ["digest", "payload_bytes"])
                           .where((F.col("best.arc") != F.col("arc")) | (F.col("best.ordinal") != F.col("ordinal")))
                           .select("arc", "ordinal", "best"))
    few = verdicts.count() <= BROADCAST_VERDICTS
    records = read_arc(spark, arc_path, packed=not few)
    told = records.join(F.broadcast(verdicts) if few else verdicts, ["arc", "ordinal"], "left").withColumn(
        "keep", F.col("best").isNotNull())
    payload = F.when(~F.col("keep"), F.col("payload"))
    told = told.select("arc", "ordinal", "url", "ip", "date", "mime", "head", payload.alias("payload"), "page_id",
                       "digest", F.col("keep").alias("revisit"), F.col("best.arc").alias("to_arc"),
                       F.col("best.ordinal").alias("to_ordinal"), F.col("best.url").alias("to_url"),
                       F.col("best.date").alias("to_date"), F.col("best.page_id").alias("to_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        info = b"software: kairos\r\nformat: WARC File Format 1.1\r\n"
        rows = [_warc_row([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", part)),
                           ("WARC-Date", iso_date(DATE)), ("WARC-Filename", f"pages-{part:06d}.warc.gz"),
                           ("Content-Type", "application/warc-fields")], info)]
        for b in batches:
            for r in b.to_pylist():
                again = r["revisit"]
                kind = "application/http; msgtype=response" if r["head"] else r["mime"]
                rows.append(_warc_row([
                    ("WARC-Type", "revisit" if again else "response" if r["head"] else "resource"),
                    ("WARC-Record-ID", record_id(r["arc"], r["ordinal"])), ("WARC-Date", iso_date(r["date"])),
                    ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
                    ("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("Content-Type", kind),
                    ("WARC-Profile", REVISIT if again else None),
                    ("WARC-Refers-To", record_id(r["to_arc"], r["to_ordinal"]) if again else None),
                    ("WARC-Refers-To-Target-URI", r["to_url"] if again else None),
                    ("WARC-Refers-To-Date", iso_date(r["to_date"]) if again else None),
                    ("X-Page-Id", r["page_id"]), ("X-Refers-To-Page-Id", r["to_page"] if again else None)],
                    r["head"] + ((r["payload"] if few else zlib.decompress(r["payload"])) if r["payload"] else b"")))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])
            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    _write(told.mapInArrow(run, "value binary"), warc_path, WARC_END)


WARC_RECORD = ("record_id string, record_type string, date string, url string, page_id long, payload_bytes long, "
               "payload_digest string, declared_digest string, refers_to long, refers_to_record string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row (WARC_RECORD) per captured page in the WARC files under ``path`` (no warcinfo).

    The digest of a record that carries its payload is computed from the bytes
    read; that of a revisit is the declared one."""
    configure(spark)
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in WARC_RECORD.split(", "))])

    def record(head: bytes, block: bytes) -> tuple | None:
        f = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        kind = f.get("WARC-Type", "")
        if kind == "warcinfo":
            return None
        http, payload = _split_http(block)
        told = f.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
        again = kind == "revisit"
        number = lambda k: int(f[k]) if k in f else None
        return (f.get("WARC-Record-ID"), kind, f.get("WARC-Date"), f.get("WARC-Target-URI"), number("X-Page-Id"),
                _number(http, b"Content-Length") if again else len(payload), told if again else sha1_base32(payload),
                told, number("X-Refers-To-Page-Id"), f.get("WARC-Refers-To"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pieces are put together again, as a block may end in part of the separator
        buf, at, need, file = bytearray(), -1, 0, None
        for b in batches:
            out = []
            for f, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if f != file:
                    buf, at, file = bytearray(), -1, f
                buf += (piece or b"") + WARC_END.encode()
                while True:
                    if at < 0:
                        buf = buf.lstrip(b"\r\n")
                        at = buf.find(b"\r\n\r\n") if buf.startswith(b"WARC/") else -1
                        if at < 0:
                            if buf and not b"WARC/".startswith(bytes(buf[:5])):
                                buf = bytearray()       # no record starts here: skip to the next separator
                            break
                        m = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", bytes(buf[:at]))
                        need = at + 4 + (int(m[1]) if m else 0)
                    if len(buf) < need + 4:
                        break
                    if got := record(bytes(buf[:at]), bytes(buf[at + 4:need])):
                        out.append(got)
                    buf, at = buf[need:], -1
            cols = list(zip(*out)) if out else [[]] * len(schema.types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return _pieces(spark, path, WARC_END).mapInArrow(run, WARC_RECORD)


def archive_round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """ARC files of ``pages``, converted to WARC, read back: one row (WARC_RECORD) per row of ``pages``.

    Null html is an empty payload, a null url becomes urn:page:<id>, a null id is
    carried as null; repeated rows are records of their own; an empty table gives none.
    """
    spark = pages.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    write_arc(pages, f"{root}/arc")
    convert(spark, f"{root}/arc", f"{root}/warc", revisit_from)
    return read_warc(spark, f"{root}/warc")
