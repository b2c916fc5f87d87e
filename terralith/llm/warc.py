"""Legacy archive converter: ARC files of versions 1 and 2 to WARC 1.0.

An ARC file starts with a version block that names the fields of its record headers:
five in version 1 and ten in version 2. Each record is a header line, whose last field
declares the length, then so many bytes and a line break; every record is a gzip member of
its own. The converter reads records by declared length, derives digests, identifiers and
ISO timestamps, and writes one WARC file for each ARC file: a version block becomes a
``warcinfo`` record, a record with an HTTP response a ``response`` or ``revisit``, any other
a ``resource``.

ARC files may be packed, a member of gzip for each record, or plain. A header line or version block that cannot be
read, a corrupt member and a record that ends too soon are problems: each is listed with its place and the reason,
and reading goes on at the next header line, after corruption at the next member. A date that is
too short is filled up, one that is no date gives way to that of the version block.

Files are written to the shared folder through pyarrow's file systems, each under a name of
its own attempt; a task returns the paths of its complete files, and only those that a
finished task returned are ever read, so a lost executor costs a rerun and no more.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, new_path, small_batches, spread_join, stored

V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: A file is closed once it has so many bytes before compression.
FILE_BYTES, LEVEL = 16 << 20, 3


def file_system(uri: str):
    """The file system of a URI and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Writer:
    """A file of gzip members that appears under its name only when complete."""

    def __init__(self, folder: str, name: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}/{name}"
        self.fs, self.path = file_system(self.uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".open", compression=None)
        self.size = self.records = 0

    def add(self, data: bytes) -> None:
        self.out.write(member(data))
        self.size += len(data)
        self.records += 1

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.path + ".open", self.path)
        return self.uri


class Corrupt(ValueError):
    """Data that cannot be unpacked, or ends within a record."""


class Members:
    """Reads bytes and lines of a file, plain or across its gzip members, a block at a time."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.source, self.buffer, self.at = fs.open_input_stream(path, compression=None), bytearray(), 0
        self.packed = self.source.read(1 << 18)
        self.unpacker = zlib.decompressobj(31) if self.packed[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.unpacker is not None and self.unpacker.eof:
            self.packed, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
        if not self.packed:
            self.packed = self.source.read(1 << 18)
            if not self.packed:
                return False
        data, self.packed = self.packed, b""
        if self.unpacker is None:
            self.buffer += data
            return True
        try:
            self.buffer += self.unpacker.decompress(data)
        except zlib.error as e:
            self.packed = data
            raise Corrupt(f"a member cannot be unpacked: {e}") from None
        return True

    def resume(self) -> bool:
        """Goes on at the next member after corruption; False if there is none."""
        self.at += len(self.buffer)
        self.buffer.clear()
        if self.unpacker is None:
            return False
        data = self.packed[1:]
        while (start := data.find(b"\x1f\x8b\x08")) < 0:
            more = self.source.read(1 << 18)
            if not more:
                return False
            data = data[-2:] + more
        self.packed, self.unpacker = data[start:], zlib.decompressobj(31)
        return True

    def read(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            self.at += len(self.buffer)
            self.buffer.clear()
            raise Corrupt(f"a record declares {n} bytes and ends before")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.at += n
        return out

    def line(self) -> bytes | None:
        """The next line with its end, or None at the end of the file."""
        start = 0
        while (end := self.buffer.find(b"\n", start)) < 0:
            start = len(self.buffer)
            if not self._more():
                return self.read(len(self.buffer)) or None
        return self.read(end + 1)


def arc_date(page_id: int | None) -> str:
    """Fourteen digits; pages have no date, so the id counts seconds from 2004."""
    return (pd.Timestamp("2004-01-01") + pd.Timedelta(seconds=(page_id or 0) % (10**9))).strftime("%Y%m%d%H%M%S")


def http_response(page_id: int | None, payload: bytes) -> bytes:
    name = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_header(version: int, url: str, date: str, mime: str, length: int, offset: int, name: str) -> bytes:
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    fields = [url, "0.0.0.0", date, mime] + (["200", "-", "-", str(offset), name] if version == 2 else []) + [str(length)]
    return " ".join(fields).encode("utf-8", "replace") + b"\n"


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 Terralith\n{V1_FIELDS if version == 1 else V2_FIELDS}\n\n".encode()
    return arc_header(version, f"filedesc://{name}", "20040101000000", "text/plain", len(body), 0, name) + body + b"\n"


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, url, html) to ARC files, in version 1 and 2 by turns; returns (path)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, writer, paths = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                page_id = None if page_id is None or page_id != page_id else int(page_id)
                if writer is None:
                    version = 1 + (part + made) % 2
                    name = f"part-{part:06d}-{made:06d}.arc.gz"
                    writer, made = Writer(folder, name), made + 1
                    writer.add(version_block(version, name))
                body = http_response(page_id, html.encode("utf-8", "replace") if isinstance(html, str) else b"")
                url = url if isinstance(url, str) and url else f"urn:page:{page_id}"
                writer.add(arc_header(version, url, arc_date(page_id), "text/html", len(body), writer.size, name) + body + b"\n")
                if writer.size >= FILE_BYTES:
                    paths.append(writer.close())
                    writer = None
        if writer is not None:
            paths.append(writer.close())
        yield pd.DataFrame({"path": pd.Series(paths, dtype=str)})

    return stored(pages.mapInPandas(run, "path string"), "arc-files")


def _header(line: bytes, names: list[str]) -> dict | str:
    """The fields of a record's header line, or what is wrong with it."""
    values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    if not values[0].startswith("filedesc://") and len(values) != len(names):
        return f"a header has {len(values)} fields, the version block names {len(names)}"
    if not values[-1].isascii() or not values[-1].isdigit():
        return "a header declares no length"
    if values[0].startswith("filedesc://"):
        names = V1_FIELDS.lower().split() if len(values) == 5 else V2_FIELDS.lower().split()
    return dict(zip(names, values)) | {"archive-length": int(values[-1])}


def read_arc(path: str) -> Iterator[dict]:
    """The records of an ARC file, the version block first, with their offsets; and its problems, as {at, problem}.

    Lines after a header that cannot be read are passed over, one problem for all of them, up to one that can.
    """
    source, names, default, lost = Members(path), V1_FIELDS.lower().split(), None, False
    while True:
        at = source.at
        try:
            line = source.line()
            if line is None:
                return
            if not line.strip():
                continue
            record = _header(line, names)
            if isinstance(record, str):
                if not lost:
                    yield {"at": at, "problem": record}
                lost = True
                continue
            lost = False
            record |= {"at": at, "body": source.read(record["archive-length"])}
        except Corrupt as e:
            yield {"at": at, "problem": str(e)}
            if not source.resume():
                return
            continue
        if record["url"].startswith("filedesc://"):
            default = record["archive-date"]
            lines = record["body"].decode("utf-8", "replace").split("\n")
            if lines[0].split(" ")[0] in ("1", "2") and len(lines) > 1:
                names = lines[1].lower().split()
            else:
                yield {"at": at, "problem": f"unknown version {lines[0][:40]!r}"}
        yield record | {"archive-date": whole_date(record["archive-date"], default)}


def whole_date(date: str, default: str | None = None) -> str:
    """Fourteen digits that are a date: a short one is filled up; for one that is none the default, else the start of 1970."""
    filled = date + "00000101000000"[len(date) :] if date.isdigit() and 4 <= len(date) <= 14 else ""
    try:
        datetime.strptime(filled, "%Y%m%d%H%M%S")
    except ValueError:
        return whole_date(default) if default else "19700101000000"
    return filled


def payload_of(body: bytes) -> tuple[bytes, bytes] | None:
    """HTTP headers with their empty line, and the payload; None if it is no HTTP response."""
    if not body.startswith(b"HTTP/"):
        return None
    head, gap, payload = body.partition(b"\r\n\r\n")
    return head + gap, payload


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode() if found else None


def record_id(path: str, offset: int, payload_digest: str) -> str:
    """The same for the same place and content, whenever the file is converted."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{posixpath.basename(path)}|{offset}|{payload_digest}')}"


def index_arc(files: DataFrame) -> DataFrame:
    """(path, offset, record_id, page_id, url, date, payload_bytes, payload_digest, http, problem) of all records.

    A problem is a row with its path, offset and problem alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "offset", "record_id", "page_id", "url", "date", "payload_bytes", "payload_digest", "http", "problem"]
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for r in read_arc(path):
                    if "problem" in r:
                        rows.append((path, r["at"], *[None] * 7, r["problem"]))
                        continue
                    if r["url"].startswith("filedesc://"):
                        continue
                    parts = payload_of(r["body"])
                    head, payload = parts if parts else (b"", r["body"])
                    page_id = http_field(head, "X-Page-Id")
                    mark = digest(payload)
                    rows.append((path, r["at"], record_id(path, r["at"], mark), int(page_id) if page_id and page_id.isdigit() else None, r["url"], r["archive-date"], len(payload), mark, parts is not None, None))
                frame = pd.DataFrame(rows, columns=columns)
                yield frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "http": "boolean"})

    schema = "path string, offset long, record_id string, page_id long, url string, date string, payload_bytes long, payload_digest string, http boolean, problem string"
    return stored(files.mapInPandas(run, schema), "arc-index")


def iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def convert(index: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes one WARC file for each ARC file of the index; returns (path).

    Of HTTP records with equal payloads of at least min_bytes bytes the one with the largest
    page_id becomes a response, the others revisit it.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        path = group["path"].iloc[0]
        plan = {r.offset: r for r in group.itertuples()}
        name = re.sub(r"(\.arc)?(\.gz)?$", "", posixpath.basename(path)) + ".warc.gz"
        writer = Writer(folder, name)
        for r in read_arc(path):
            if "problem" in r or r["at"] not in plan and not r["url"].startswith("filedesc://"):
                continue
            date = ("WARC-Date", iso(r["archive-date"]))
            if r["url"].startswith("filedesc://"):
                info = f"converted-from: {posixpath.basename(path)}\r\n".encode() + r["body"]
                writer.add(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(path, r['at'], digest(info))}>"), date, ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
                continue
            row, parts = plan[r["at"]], payload_of(r["body"])
            fields = [("WARC-Record-ID", f"<{row.record_id}>"), date, ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip-address"]), ("WARC-Payload-Digest", f"sha1:{row.payload_digest}")]
            if parts is None:
                writer.add(warc_record([("WARC-Type", "resource"), *fields, ("Content-Type", r["content-type"])], r["body"]))
            elif row.response_id == row.record_id:
                writer.add(warc_record([("WARC-Type", "response"), *fields, ("Content-Type", "application/http; msgtype=response")], r["body"]))
            else:
                fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{row.response_id}>"), ("Content-Type", "application/http; msgtype=response")]
                writer.add(warc_record([("WARC-Type", "revisit"), *fields], parts[0]))
        return pd.DataFrame({"path": [writer.close()]})

    index = index.where("problem is null")
    same = (F.col("payload_bytes") >= min_bytes) & F.col("http")
    # Payloads that are there once need no look-up.
    first = index.where(same).groupBy("payload_digest").agg(F.max(F.struct("page_id", "record_id")).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first.select("payload_digest", F.col("r.record_id").alias("response"), "n"), "responses")
    planned = spread_join(index, first, "payload_digest", index.count(), "record_id")
    planned = planned.withColumn("response_id", F.when(same, F.coalesce("response", "record_id")).otherwise(F.col("record_id")))
    # One ARC file has FILE_BYTES bytes and one record more at most, so a group is bounded.
    planned = planned.select("path", "offset", "record_id", "payload_digest", "response_id")
    return stored(planned.groupBy("path").applyInPandas(run, "path string"), "warc-files")


def read_warc(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of the records of a WARC file."""
    source = Members(path)
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path} has no WARC record at {source.at}")
        fields = {}
        while (line := source.line()) and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, source.read(int(fields["content-length"]))


def read_back(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, record_id, refers_id of all HTTP records.

    Every block's digest is checked, and a response's payload digest is taken from its bytes.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for f, block in read_warc(path):
                    if f["warc-block-digest"] != f"sha1:{digest(block)}":
                        raise ValueError(f"a block of {path} does not have its digest")
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    head, payload = payload_of(block)
                    page_id = http_field(head, "X-Page-Id")
                    full = f["warc-type"] == "response"
                    mark = digest(payload) if full else f["warc-payload-digest"].removeprefix("sha1:")
                    size = len(payload) if full else int(http_field(head, "Content-Length"))
                    rows.append((int(page_id) if page_id else None, size, mark, f["warc-type"], f["warc-record-id"], f.get("warc-refers-to")))
                frame = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_id"])
                frame["page_id"] = frame["page_id"].astype("Int64")
                yield frame

    return files.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_id string")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to ARC files, converts them to WARC and reads the WARC files back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to (the page_id of
    the response that a revisit refers to).

    Defined cases: a null html is an empty payload; a null or empty url becomes
    urn:page:<page_id>; a row without page_id keeps a null one and comes before all others;
    of repeated rows with the largest page_id one is the response; blanks in a url are
    percent-encoded; an empty table gives an empty result; further columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    own = pages.select(col("page_id").cast("long").alias("page_id"), col("url").alias("url"), col("html").alias("html"))
    arcs = write_arc(own, new_path(spark, "arc"))
    spread = lambda files: files.repartition(max(1, min(files.count(), 10_000)))
    warcs = convert(index_arc(spread(arcs)), new_path(spark, "warc"), min_bytes)
    back = stored(read_back(spread(warcs)), "warc-index")
    revisits = back.where("record_type = 'revisit'")
    counts = revisits.groupBy("refers_id").agg(F.count(F.lit(1)).alias("n"))
    responses = back.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")).join(counts, "refers_id")
    met = spread_join(revisits, stored(responses, "responses"), "refers_id", revisits.count(), "record_id")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return back.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(met.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The records and their links as SQL; the digest in base32 is made from groups of five hex digits.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
e AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(i * 5 + 1 AS INT), 5) AS BIGINT)) AS g FROM d),
f AS (SELECT page_id, payload_bytes, array_to_string(list_transform(g, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest FROM e),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""
