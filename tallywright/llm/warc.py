"""Legacy ARC archives: written from pages, parsed by version, converted to WARC.

ARC 1 record line: URL, IP, 14-digit date, content type, length. ARC 2: URL, IP, date, content type, result code, checksum, location,
offset, file name, length. A file opens with a ``filedesc`` record whose body names the version. Bodies are taken by their declared
length, never by what stands in them.

Files are written by Spark as text with the formats' own separators (LF after an ARC record, two CRLF after a WARC record) and gzip,
about ``file_bytes`` of payload in each ARC file, below the shared folder, and are read as binary files, record by record.
"""
from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import only, shared_folder

FIELDS = {"1": 5, "2": 10}  # words of a record line by version
LINES = {"1": "URL IP-address Archive-date Content-type Archive-length",
         "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _word(value: str | None) -> str:
    """A header word: white space and control characters are percent-encoded, nothing stays "-"."""
    return re.sub(r"[\x00-\x20\x7f\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value or "") or "-"


def write_arc(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000", file_bytes: int = 24_000_000) -> None:
    """ARC files of pages: versions 1 and 2 by turns, file by file. A null page has an empty payload, a null URL is "-"."""
    rows = only(df, page_id=page_id, url=url, html=html)

    def archive(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, number, out, size = TaskContext.get().partitionId(), 0, [], 0

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(["\n".join(out)], pa.large_string()).cast(pa.string())], ["value"])

        for part in parts:
            for a in range(0, part.num_rows, 500):
                for r in part.slice(a, 500).to_pylist():
                    if not out:
                        version, name = str(1 + (part_id + number) % 2), f"pages-{part_id:06d}-{number:06d}.arc"
                        fill = " 200 - -" + f" 0 {name}" if version == "2" else ""
                        body = f"{version} 0 tallywright\n{LINES[version]}\n"
                        out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{fill} {len(body)}\n{body}"]
                    payload = r["html"] or ""
                    n = len(payload.encode())
                    own = f"X-Page-Id: {r['page_id']}\r\n" if r["page_id"] is not None else ""
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n{own}\r\n{payload}"
                    out.append(f"{_word(r['url'])} 0.0.0.0 {date} text/html{fill} {len(block.encode())}\n{block}")
                    size += n + 400
                    if size >= file_bytes:
                        yield whole()
                        number, out, size = number + 1, [], 0
        if out:
            yield whole()

    # A row is a whole archive and a file has one row, so pages are written where they are read, without a shuffle.
    rows.mapInArrow(archive, "value string").write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


class _Reader:
    """Bytes of a plain or gzipped file, taken piece by piece."""

    def __init__(self, raw: bytes):
        self.raw, self.zip = raw, raw[:2] == b"\x1f\x8b"
        self.gz = zlib.decompressobj(31) if self.zip else None
        self.at, self.buffer, self.place = 0, b"" if self.zip else raw, 0
        self.offset = 0

    def _more(self) -> bool:
        if not self.zip or (self.at >= len(self.raw) and not self.gz.unconsumed_tail):
            return False
        if self.gz.eof:
            self.at -= len(self.gz.unused_data)
            if self.at >= len(self.raw):
                return False
            self.gz = zlib.decompressobj(31)
        piece = self.gz.unconsumed_tail or self.raw[self.at:self.at + (1 << 18)]
        self.at += 0 if self.gz.unconsumed_tail else len(piece)
        self.buffer = self.buffer[self.place:] + self.gz.decompress(piece, 1 << 22)
        self.place = 0
        return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.place < n and self._more():
            pass
        out = self.buffer[self.place:self.place + n]
        self.place += len(out)
        self.offset += len(out)
        return out

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the file."""
        start = self.place
        while (k := self.buffer.find(mark, start)) < 0:
            back = self.place
            seen = max(len(self.buffer) - back - len(mark), 0)
            if not self._more():
                return None
            start = self.place + seen
        return self.take(k + len(mark) - self.place)

    def skip(self, chars: bytes) -> None:
        while (c := self.take(1)) and c in chars:
            pass
        if c:
            self.place -= 1
            self.offset -= 1


def arc_records(raw: bytes) -> Iterator[dict]:
    """Records of an ARC file. A record line with the wrong number of words, or a body shorter than declared, ends the file."""
    reader, version = _Reader(raw), "1"
    while True:
        reader.skip(b"\r\n")
        at = reader.offset
        line = reader.until(b"\n")
        if line is None:
            return
        words = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        opening = words[0].startswith("filedesc:")
        if not (len(words) in FIELDS.values() if opening else len(words) == FIELDS[version]) or not words[-1].isdigit():
            yield {"offset": at, "damaged": True}
            return
        body = reader.take(int(words[-1]))
        if len(body) < int(words[-1]):
            yield {"offset": at, "damaged": True}
            return
        if opening:
            version = body[:1].decode("ascii", "replace") if body[:1] in (b"1", b"2") else "1"
        yield {"offset": at, "damaged": False, "version": version, "url": words[0], "ip": words[1], "date": words[2], "mime": words[3], "body": body}


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _payload(record: dict) -> tuple[bytes, bytes]:
    """HTTP head and payload of a web record; no head for others."""
    if record["url"].startswith(("filedesc:", "dns:")) or not record["body"].startswith(b"HTTP/"):
        return b"", record["body"]
    head, gap, payload = record["body"].partition(b"\r\n\r\n")
    return head + gap, payload


def _kind(record: dict, head: bytes) -> str:
    return "warcinfo" if record["url"].startswith("filedesc:") else "response" if head else "resource"


def record_id(record: dict, digest: str) -> str:
    """The same for the same URL, date, place and payload, whenever it is converted."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((record['url'], record['date'], record['file'], str(record['offset']), digest)))}"


def iso_date(digits: str) -> str:
    d = (digits + "00000101000000"[len(digits):])[:14] if digits.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def whole_records(file: str, raw: bytes) -> Iterator[dict]:
    """``arc_records`` with head, payload, payload_digest, page_id (from the page's own header), kind and id; a damaged one is left as it is."""
    for r in arc_records(raw):
        if not r["damaged"]:
            r["file"] = file
            r["head"], r["payload"] = _payload(r)
            r["payload_digest"] = hashlib.sha256(r["payload"]).hexdigest()
            own = _headers(r["head"]).get("x-page-id", "")
            r["page_id"] = int(own) if re.fullmatch(r"-?\d{1,19}", own) else None
            r["id"], r["kind"] = record_id(r, r["payload_digest"]), _kind(r, r["head"])
        yield r


def read_arc(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Records: file, offset, id, kind, url, ip, date, page_id (from the page's own header), payload_bytes, payload_digest; with ``content`` also head and payload."""
    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for f in part.to_pylist():
                out, size = [], 0
                for r in whole_records(f["file"], f["content"]):
                    if r["damaged"]:
                        out.append((f["file"], r["offset"], None, "damaged", None, None, None, None, None, None, None, None))
                        continue
                    payload = r["payload"]
                    out.append((f["file"], r["offset"], r["id"], r["kind"], r["url"], r["ip"], iso_date(r["date"]), r["page_id"], len(payload), r["payload_digest"], r["head"] if content else None, payload if content else None))
                    size += len(payload)
                    if size > 4_000_000 and content or len(out) > 5000:
                        yield batch(out)
                        out, size = [], 0
                if out:
                    yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "offset", "id", "kind", "url", "ip", "date", "page_id", "payload_bytes", "payload_digest", "head", "payload"])

    return _files(spark, path).mapInArrow(parse, "file string, offset long, id string, kind string, url string, ip string, date string, page_id long, payload_bytes long, payload_digest string, head binary, payload binary")


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 100) -> None:
    """ARC files to WARC files.

    Identifiers are UUIDs of URL, date, place and digest, so a repeated conversion gives the same. Of web records with equal payloads
    of at least ``least_bytes``, the one with the least page_id (then place; null last) is a response and the others revisit it. Damaged
    records are left out. Decisions travel as one row for each file, which holds no more records than the file, and meet the file as it is, compressed.
    """
    light = read_arc(spark, arc_path).select("file", "offset", "id", "kind", "url", "date", "page_id", "payload_bytes", "payload_digest")
    web = light.filter((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "offset", F.col("id").alias("to"), F.col("url").alias("to_url"), F.col("date").alias("to_date"))
    first = web.groupBy("payload_digest").agg(F.min(order).alias("f"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "f.to", "f.to_url", "f.to_date")
    decided = web.select("file", "offset", "id", "payload_digest").join(first, "payload_digest").filter(F.col("id") != F.col("to"))
    of_file = decided.groupBy("file").agg(F.collect_list(F.struct("offset", "to", "to_url", "to_date")).alias("decisions"))

    def render(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                f = part.slice(k, 1).to_pylist()[0]
                decisions = {d["offset"]: d for d in f["decisions"] or []}
                out, size = [], 0
                for r in whole_records(f["file"], f["content"]):
                    if r["damaged"]:
                        continue
                    out.append(warc_record(r | {"date": iso_date(r["date"])} | decisions.get(r["offset"], {"to": None})))
                    size += len(out[-1])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    files = _files(spark, arc_path).join(of_file, "file", "left").select("file", "content", "decisions")
    files.mapInArrow(render, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path)


def warc_record(r: dict) -> str:
    """One record without its closing CRLFs. Payloads that are not UTF-8 keep their bytes one by one as Latin-1 and say so."""
    kind = "revisit" if r["to"] else r["kind"]
    block = r["head"] if kind == "revisit" else r["head"] + r["payload"]
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{r['id']}>", f"WARC-Date: {r['date']}"]
    if kind != "warcinfo":
        head += [f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha256:{r['payload_digest']}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{r['to']}>", f"WARC-Refers-To-Target-URI: {r['to_url']}", f"WARC-Refers-To-Date: {r['to_date']}"]
    try:
        text = block.decode()
    except UnicodeDecodeError:
        text = block.decode("latin-1")
        head.append("X-Encoded-From: latin-1")
    raw = text.encode()
    kinds = {"warcinfo": "application/warc-fields", "resource": "application/octet-stream"}
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(raw).hexdigest()}", f"Content-Type: {kinds.get(kind, 'application/http; msgtype=response')}", f"Content-Length: {len(raw)}"]
    return "\r\n".join(head) + "\r\n\r\n" + text


def warc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a WARC file."""
    reader = _Reader(raw)
    while True:
        reader.skip(b"\r\n")
        head = reader.until(b"\r\n\r\n")
        if head is None:
            return
        h = _headers(head)
        block = reader.take(int(h["content-length"]))
        yield h, block.decode().encode("latin-1") if "x-encoded-from" in h else block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Web records: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to (page_id of the response).

    A revisit has no payload of its own; its length stands in the HTTP head that it keeps, its digest in its WARC header. What a response
    declares is checked against its bytes.
    """
    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for f in part.to_pylist():
                out = []
                for h, block in warc_records(f["content"]):
                    kind = h["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = _headers(head)
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response":
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{f['file']}: digest of {h['warc-record-id']} does not fit its payload")
                        size = len(payload)
                    else:
                        size = int(http["content-length"])
                    out.append((int(http["x-page-id"]) if "x-page-id" in http else None, size, digest, kind, h["warc-record-id"], h.get("warc-refers-to")))
                if out:
                    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "id", "to"])

    rows = _files(spark, path).mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, id string, to string")
    named = rows.filter("record_type = 'response'").select(F.col("id").alias("to"), F.col("page_id").alias("refers_to"))
    return rows.join(named, "to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pages_through_archives(df: DataFrame, **columns: str) -> DataFrame:
    """Pages to ARC to WARC and back. One row per page; an empty table gives no rows."""
    spark = df.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(df, arc, **columns)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
