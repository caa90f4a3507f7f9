"""WARC records in ZIP packages: write them, and read them back by range without extraction.

A package is a ZIP file of stored members: ``archive/*.warc.gz`` (one gzip member a record)
and ``indexes/index.cdxj`` (one line a record).  The reader parses the central directory,
ZIP64 fields included, finds where each stored member's bytes begin, takes the records'
places from the index, and reads only those ranges.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import as_scan, scratch_path, short_batches, written

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None, row: str | None = None) -> str:
    """A record's identifier: the page's id, and what tells the rows of one id apart."""
    return f"<{_ID}{'' if page_id is None else page_id}{'' if row is None else '#' + row}>"


def record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None, date: str = "2024-01-01T00:00:00Z", row: str | None = None, refers_to_row: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only, with the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {_name(page_id, row)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if revisits:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to, refers_to_row)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return {"headers": headers, "http": told, "payload": payload}


class PackageWriter:
    """Writes packages to a stream front to back; holds one WARC member at a time in memory."""

    def __init__(self, stream, member_bytes: int):
        self._zip, self._member_bytes = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True), member_bytes
        self._member, self._n, self._lines = io.BytesIO(), 0, []
        self.size = 0

    def add(self, page_id, url, payload: bytes, revisits: bool, refers_to, row=None, refers_to_row=None) -> None:
        gz = zlib.compressobj(4, zlib.DEFLATED, 31)
        raw = gz.compress(record(page_id, url, payload, revisits, refers_to, row=row, refers_to_row=refers_to_row)) + gz.flush()
        place = {"url": url, "page": page_id, "type": "revisit" if revisits else "response", "offset": self._member.tell(), "length": len(raw), "filename": f"data-{self._n:05d}.warc.gz"}
        self._lines.append(f"{url or '-'} 20240101000000 {json.dumps(place)}".replace("\n", " "))
        self._member.write(raw)
        self.size += len(raw)
        if self._member.tell() >= self._member_bytes:
            self._roll()

    def _roll(self) -> None:
        if self._member.tell():
            self._zip.writestr(zipfile.ZipInfo(f"archive/data-{self._n:05d}.warc.gz"), self._member.getvalue())
            self._member, self._n = io.BytesIO(), self._n + 1

    def close(self) -> None:
        self._roll()
        self._zip.writestr(zipfile.ZipInfo("indexes/index.cdxj"), "\n".join(self._lines).encode())
        self._zip.close()


def read_directory(f, size: int) -> list[dict]:
    """Members of a ZIP file from its central directory: name, method, size, where data begin.

    Sizes, offsets and counts that are all ones are taken from the ZIP64 records.
    """
    tail_at = max(0, size - 65_557 - 20)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # bytes of a comment: the record's own comment ends the file
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if (n == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF) and tail[end - 20 : end - 16] == b"PK\x06\x07":
        f.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        n, length, offset = struct.unpack_from("<QQQ", f.read(56), 32)
    f.seek(offset)
    directory, at, members = f.read(length), 0, []
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full = struct.unpack_from("<II", directory, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, at + 28)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                field = e + 4
                if full == 0xFFFFFFFF:
                    full, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                if packed == 0xFFFFFFFF:
                    packed, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", extra, field)[0]
            e += 4 + width
        f.seek(local)
        header = f.read(30)
        begin = local + 30 + sum(struct.unpack_from("<HH", header, 26))
        members.append({"name": name, "method": method, "size": packed, "begin": begin})
        at += 46 + n_name + n_extra + n_comment
    return members


def _walk_plain(f, begin: int, end: int):
    """(offset, length) of each record that isn't compressed, by the lengths that their headers tell."""
    while begin < end:
        f.seek(begin)
        head = b""
        while b"\r\n\r\n" not in head:
            block = f.read(min(4096, end - begin - len(head)))
            if not block:
                raise ValueError("a record ends in its header")
            head += block
        at = head.index(b"\r\n\r\n") + 4
        told = [line.partition(b":")[2] for line in head[:at].split(b"\r\n") if line.lower().startswith(b"content-length:")]
        if not head.startswith(b"WARC/") or not told:
            raise ValueError("not a WARC record")
        length = at + int(told[0]) + 4
        yield begin, min(length, end - begin)
        begin += length


def _walk(f, begin: int, end: int):
    """(offset, length) of each gzip member, or plain record, from begin to end of the file."""
    if begin < end:
        f.seek(begin)
        if f.read(2) != b"\x1f\x8b":
            yield from _walk_plain(f, begin, end)
            return
    while begin < end:
        gz, used = zlib.decompressobj(31), 0
        while not gz.eof and begin + used < end:
            f.seek(begin + used)
            block = f.read(min(1 << 20, end - begin - used))
            gz.decompress(block)
            used += len(block) - len(gz.unused_data)
        yield begin, used
        begin += used


def _lines(f, begin: int, end: int, block: int = 1 << 20):
    """Lines of a part of a file, read a block at a time."""
    left = b""
    while begin < end:
        f.seek(begin)
        got = f.read(min(block, end - begin))
        begin += len(got)
        *whole, left = (left + got).split(b"\n")
        yield from (x.decode() for x in whole)
    yield left.decode()


def places(f, size: int):
    """Yield (offset, length) in the file of every record of a package, once each.

    Places are taken from the index.  What no index line covers of a stored archive member,
    all of it at times, is walked through record by record.  Lines that name a member the
    package doesn't hold, or no place in it, are passed over.  An archive or index member
    that the package compresses can't be read by range, so it is an error.
    """
    archives, indexes = lambda n: n.startswith("archive/") and n.endswith((".warc.gz", ".warc")), lambda n: n.startswith("indexes/") and n.endswith((".cdxj", ".cdx"))
    members = {m["name"]: m for m in read_directory(f, size) if archives(m["name"]) or indexes(m["name"])}
    packed = sorted(n for n, m in members.items() if m["method"])
    if packed:
        raise ValueError(f"compressed members: {', '.join(packed)}")
    named: dict[str, set[tuple[int, int]]] = {name: set() for name in members if archives(name)}
    for name, m in members.items():
        if indexes(name):
            for line in _lines(f, m["begin"], m["begin"] + m["size"]):
                if "{" in line:
                    place = json.loads(line[line.index("{") :])
                    archive = f"archive/{place.get('filename')}"
                    if archive in named and "offset" in place and "length" in place:
                        named[archive].add((members[archive]["begin"] + int(place["offset"]), int(place["length"])))
    for name, found in named.items():
        at, end = members[name]["begin"], members[name]["begin"] + members[name]["size"]
        for begin, length in sorted(found):
            yield from _walk(f, at, begin)
            yield begin, length
            at = begin + length
        yield from _walk(f, at, end)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(__id, __url, __payload, __first, __type, __row, __first_row): which pages become responses, which revisits.

    Of pages with equal payloads of ``least_bytes`` or more, the one with the largest id is
    the response and the others revisit it; null ids rank lowest.  Of repeated rows of one
    id the largest URL goes first, and of rows that agree in that too the last in the files:
    rows are told by file and row number, which no change of executors alters.
    """
    pages = as_scan(pages, "warc-pages")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), payload.alias("__payload"), F.sha2(payload, 256).alias("__sha"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("__row"))
    rank = F.struct(F.col("__id").isNotNull().alias("has"), F.col("__id").alias("id"), F.coalesce("__url", F.lit("")).alias("url"), F.col("__row").alias("row"))
    long = rows.where(F.octet_length("__payload") >= least_bytes)
    groups = written(long.groupBy("__sha").agg(F.max(rank).alias("__top"), F.count(F.lit(1)).alias("__n")).where("__n > 1"), "warc-groups")
    out = rows.join(groups, "__sha", "left")
    top = F.col("__top.row").isNull() | (F.col("__top.row") == F.col("__row"))
    told = lambda r: F.concat_ws("-", F.hex(F.xxhash64(r["file"])), r["row"].cast("string"))
    return out.select("__id", "__url", "__payload", F.when(~top, F.col("__top.id")).alias("__first"), F.when(top, "response").otherwise("revisit").alias("__type"), told(F.col("__row")).alias("__row"), F.when(~top, told(F.col("__top.row"))).alias("__first_row"))


def write_packages(planned: DataFrame, folder: str, package_bytes: int = 256 << 20, member_bytes: int = 16 << 20) -> DataFrame:
    """Write packages of the planned records in ``folder`` and return (path, bytes, records).

    ``folder`` is a URI that pyarrow opens on every executor.  Each task writes under names
    of its own, so a repeated task never touches another's file, and only files of tasks
    whose rows are in the result count.
    """
    short_batches(planned.sparkSession)

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        stream, package, path, n = None, None, "", 0

        def close():
            package.close()
            stream.close()
            info = store.get_file_info(path)
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [info.size], "records": [n]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for b in batches:
            for page_id, url, payload, first, kind, row, first_row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if package is None:
                    path = f"{root}/{uuid.uuid4().hex}.wacz"
                    stream = store.open_output_stream(path)
                    package, n = PackageWriter(stream, member_bytes), 0
                package.add(page_id, url, payload, kind == "revisit", first, row, first_row)
                n += 1
                if package.size >= package_bytes:
                    yield close()
                    package = None
        if package is not None:
            yield close()

    rows = planned.select("__id", "__url", "__payload", "__first", "__type", "__row", "__first_row")
    return written(rows.mapInArrow(write, "path string, bytes long, records long"), "warc-packages")


def read_packages(packages: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records of the packages (path, bytes): one row each, read by range.

    First each package's directory and index give the places of its records; the places,
    not the packages, are then dealt in blocks of up to 512 neighbours to tasks of 1 MB,
    or 128 MB each where that leaves no slot idle.
    """

    def locate(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    found = sorted(places(f, size))
                for at in range(0, len(found), 512):
                    part = found[at : at + 512]
                    yield pa.RecordBatch.from_pydict({"path": [path], "offsets": [[p[0] for p in part]], "lengths": [[p[1] for p in part]]}, schema=pa.schema([("path", pa.string()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]))

    blocks = packages.select("path", "bytes").repartition("path").mapInArrow(locate, "path string, offsets array<long>, lengths array<long>")
    blocks = written(blocks, "warc-places")
    size, slots = packages.agg(F.sum("bytes")).first()[0] or 0, packages.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-size // (128 << 20)), min(2 * slots, -(-size // (1 << 20))))
    blocks = blocks.repartition(tasks, "path", F.col("offsets")[0])
    names = ["record_id", "record_type", "refers_to_id", "target_uri", "digest_header", "http_length", "payload_bytes", "payload_digest", "payload"]
    schema = pa.schema([(k, pa.int64() if k in ("http_length", "payload_bytes") else pa.binary() if k == "payload" else pa.string()) for k in names])

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with store.open_input_file(path) as f:
                    rows, held = [], 0
                    for at, n in zip(offsets, lengths, strict=True):
                        f.seek(at)
                        raw = f.read(n)
                        r = parse_record(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                        h, payload = r["headers"], r["payload"]
                        rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), int(r["http"].get("content-length", len(payload))), len(payload), digest32(payload), payload if keep_payload else None))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    types = ", ".join(f"{k} {'long' if k in ('http_length', 'payload_bytes') else 'binary' if k == 'payload' else 'string'}" for k in names)
    return blocks.select("path", "offsets", "lengths").mapInArrow(read, types)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write every page as a WARC record, read the archives back, and tell what they hold.

    (id, payload_bytes, payload_digest, record_type, refers_to): both payload columns are of
    the full payload, which a revisit tells in its headers.  Null html is an empty payload;
    null ids and repeated rows get a record each; an empty table gives an empty result;
    other columns are not read.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    planned = plan_records(pages, id_col, url_col, html_col, least_bytes)
    read = read_packages(write_packages(planned, folder), folder, keep_payload=False)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<{_ID}(-?[0-9]+)(?:#[^>]*)?>$', 1) as long)")
    revisit = F.col("record_type") == "revisit"
    return read.select(
        number("record_id").alias(id_col),
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("digest_header", "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, number("refers_to_id")).alias("refers_to"),
    )
