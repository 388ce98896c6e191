"""Operator 12: WARC archives of pages, and a reader that salvages what damage leaves."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.llm.common import hits, in_parts, mark_cell, marks, materialize, scratch_path

GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
END = b"\r\n\r\n"
MARK = re.compile(re.escape(GZIP) + b"[\x00-\x1f]|" + re.escape(VERSION))
TOKEN = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
#: Most bytes of the head of a record, and bytes that are read from a file at a time.
HEAD_BYTES, CHUNK = 1 << 16, 1 << 20
#: Most bytes that a gzip member may unpack to.
MOST_BYTES = 1 << 31
#: An archive is closed after so many bytes.
FILE_BYTES = 1 << 26
#: Values with more rows than this, or than a thousandth of all, are joined by broadcast: a thousand at most.
HOT_ROWS = 10_000
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


class Damaged(Exception):
    """What starts at a place isn't a whole record; the message says why."""


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- writing


def record(kind: str, record_id: str, page_id: str | None, url: str | None, payload_digest: str, length: int, payload: bytes, refers: tuple[str, str | None, str | None] | None, date: str) -> bytes:
    """One WARC record: HTTP headers, and the payload unless it refers to the record of an equal one."""
    block = HTTP.format(length).encode() + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}"]
    if page_id is not None:
        head.append(f"Page-Id: {quote(page_id, safe='')}")
    if refers:
        other, other_id, other_url = refers
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{other}>", f"WARC-Refers-To-Target-URI: {_uri(other_url)}", f"WARC-Refers-To-Date: {date}"]
        if other_id is not None:
            head.append(f"Refers-To-Page-Id: {quote(other_id, safe='')}")
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return b"".join((b"WARC/1.1\r\n", "\r\n".join(head).encode(), END, block, END))


def _uri(url: str | None) -> str:
    """The address with all that isn't visible ASCII as percent codes; none is ``urn:none``."""
    return quote(url, safe=PRINTABLE) if url else "urn:none"


class Archive:
    """Archives that one task writes: one gzip member a record, a new file after so many bytes, each under a name of its own.

    A file appears under its name when it is whole, so an attempt that is lost or repeated leaves nothing that a manifest names.
    """

    def __init__(self, folder: str, compress: bool, file_bytes: int):
        self.folder, self.compress, self.file_bytes = folder, compress, file_bytes
        self.out, self.closed = None, []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.uri = f"{self.folder}/pages-{uuid.uuid4().hex}.warc" + ".gz" * self.compress
            self.system, self.path = pafs.FileSystem.from_uri(self.uri)
            self.out, self.records, self.bytes = self.system.open_output_stream(self.path + ".part", compression=None), 0, 0
        if self.compress:
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress(data) + packer.flush()
        self.out.write(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)
        if self.bytes >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.system.move(self.path + ".part", self.path)
            self.closed.append((self.uri, self.records, self.bytes))
            self.out = None


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


MANIFEST = "uri string, records long, bytes long"
HELD_BACK = "id string, url string, sum binary, html binary"


def _manifest(closed: list[tuple[str, int, int]], held: list[tuple] = ()) -> pa.RecordBatch:
    files = list(zip(*closed, strict=True)) or [(), (), ()]
    back = list(zip(*held, strict=True)) or [()] * 4
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
    columns = [[*f, *[None] * len(held)] for f in files] + [[*[None] * len(closed), *b] for b in back]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["uri", "records", "bytes", "id", "url", "sum", "html"])


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_revisit_bytes: int = 0,
    compress: bool = True,
    file_bytes: int = FILE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record for each page under ``folder`` (a URI all executors share); returns the manifest: uri, records, bytes.

    Of pages with equal payloads (SHA-256) of ``least_revisit_bytes`` or more, the one of least id, then address, is a
    ``response`` with its payload and the others are ``revisit`` records that refer to it. Only digests are shuffled to find them; a bitmap of the
    revisited rows (16 MB at most) tells in the pass over the pages which are surely responses, and the few it can't tell are
    held back for a join. Revisits are written from digests alone.

    Defined cases: null html is an empty payload; a null id has no Page-Id and comes last in its group; a null or empty address is
    ``urn:none``; of equal rows one is the response; an empty table writes no files; further columns are ignored.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("order"), F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    keyed = materialize(
        rows.select("order", "id", "url", F.unhex(F.sha2("html", 256)).alias("sum"), F.unhex(F.sha1("html")).alias("sha1"), F.octet_length("html").cast("long").alias("length")).withColumn("row", F.monotonically_increasing_id()),
        "warc-digests",
    )
    first = F.min(F.struct(F.isnull("order").alias("last"), "order", F.isnull("url").alias("blank"), "url", "row", "id"))
    groups = materialize(keyed.where(F.col("length") >= least_revisit_bytes).groupBy("sum").agg(first.alias("first"), F.count("*").alias("rows")).where("rows > 1"), "warc-groups")
    limit = max(HOT_ROWS, keyed.count() // 1000)
    many, few = (groups.where(c).select("sum", "first") for c in (F.col("rows") > limit, F.col("rows") <= limit))
    # values of very many rows are a thousand at most; the rest meet in groups of a limited size
    twins = keyed.join(F.broadcast(many), "sum").unionByName(keyed.join(F.broadcast(many.select("sum")), "sum", "leftanti").join(few, "sum"))
    revisits = materialize(twins.where("row <> first.row").select("id", "url", "sum", "sha1", "length", "row", F.col("first.id").alias("other_id"), F.col("first.url").alias("other_url")), "warc-revisits")

    _make_folder(spark, folder)
    key = F.concat_ws("\x1f", F.coalesce("id", F.lit("\x1e")), F.coalesce("url", F.lit("\x1e")), F.hex("sum"))
    shared, bits = marks(revisits.select(key.alias("key")).distinct(), "key")

    def name(*parts: object) -> str:
        return str(uuid.UUID(hashlib.md5(repr(parts).encode()).hexdigest()))

    def response(page_id: str | None, url: str | None, digest: bytes, html: bytes) -> bytes:
        # small ones may be equal, and none refers to them
        own = name(page_id, url, digest) if len(html) >= least_revisit_bytes else str(uuid.uuid4())
        return record("response", own, page_id, url, _sha1(html), len(html), html, None, date)

    def write_responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, compress, file_bytes)
        for batch in in_parts(batches):
            unsure = hits(shared, batch.column(4))
            for k in np.flatnonzero(~unsure).tolist():
                archive.write(response(*(batch.column(c)[k].as_py() for c in range(4))))
            held = [tuple(batch.column(c)[k].as_py() for c in range(4)) for k in np.flatnonzero(unsure & hits(shared_seen, batch.column(5))).tolist()]
            if held:
                yield _manifest([], held)
        archive.close()
        yield _manifest(archive.closed)

    # the responses that the bitmap takes for revisits: the first of equal rows, and chance
    firsts = keyed.select("id", "url", "sum", "row").join(revisits.select("row"), "row", "leftanti").select("id", "url", "sum", key.alias("key"))
    # (rows of one key below the least size are all responses, so they are counted)
    seen = materialize(_hit(firsts.withColumn("cell", mark_cell("key", bits)), shared), "warc-unsure")
    shared_seen, seen_bits = marks(seen.select("key"), "key")

    cells = rows.withColumn("sum", F.unhex(F.sha2("html", 256))).withColumn("key", key).select("id", "url", "sum", "html", mark_cell("key", bits).alias("cell"), mark_cell("key", seen_bits).alias("seen"))
    direct = materialize(cells.mapInArrow(write_responses, f"{MANIFEST}, {HELD_BACK}"), "warc-responses")

    def write_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, compress, file_bytes)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive.write(response(*row))
        archive.close()
        yield _only_files(archive.closed)

    def write_revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, compress, file_bytes)
        for batch in batches:
            for page_id, url, digest, sha1, length, row, other_id, other_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers = (name(other_id, other_url, digest), other_id, other_url)
                archive.write(record("revisit", name(page_id, url, digest, row), page_id, url, base64.b32encode(sha1).decode(), length, b"", refers, date))
        archive.close()
        yield _only_files(archive.closed)

    back = direct.where("uri is null").select("id", "url", "sum", "html").withColumn("key", key)
    times = seen.groupBy("key").agg(F.count("*").alias("times"))
    held = (
        back.groupBy("key").agg(*(F.first(c).alias(c) for c in ("id", "url", "sum", "html"))).join(times, "key")
        .select("id", "url", "sum", "html", F.explode(F.expr("sequence(1, times)")).alias("_")).drop("_")
    )
    rest = materialize(held.mapInArrow(write_held, MANIFEST).unionAll(revisits.mapInArrow(write_revisits, MANIFEST)), "warc-rest")
    return direct.where("uri is not null").select("uri", "records", "bytes").unionAll(rest)


def _only_files(closed: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return _manifest(closed).select(["uri", "records", "bytes"])


def _hit(rows: DataFrame, shared) -> DataFrame:
    """The rows (id, url, sum, key, cell) whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(shared, batch.column(4))))

    return rows.mapInArrow(run, rows.schema)


# ---------------------------------------------------------------- reading


class Window:
    """Bytes of a file by place, read a chunk at a time."""

    def __init__(self, file):
        self.file, self.size, self.base, self.data = file, file.size(), 0, b""

    def get(self, at: int, count: int) -> bytes:
        if at < self.base or at + count > self.base + len(self.data):
            self.base, self.data = at, self.file.read_at(min(max(count, CHUNK), max(0, self.size - at)), at)
        return self.data[at - self.base : at - self.base + count]


class Whole:
    """Bytes in memory, by place."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def get(self, at: int, count: int) -> bytes:
        return self.data[at : at + count]


def plain_record(source: Window | Whole, at: int) -> tuple[dict[str, str], bytes, int]:
    """Head fields (lower-case names), block and end of the record at a place, or Damaged."""
    head = source.get(at, 4096)
    if not head.startswith(VERSION):
        raise Damaged("no version line")
    stop = head.find(END)
    if stop < 0:
        head = source.get(at, HEAD_BYTES)
        stop = head.find(END)
    if stop < 0:
        raise Damaged("head without end")
    version, *lines = head[:stop].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d", version):
        raise Damaged("no version line")
    fields: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:  # a folded line goes on
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon or not TOKEN.fullmatch(key):
            raise Damaged("head line without a name")
        last = key.lower().decode()
        if last in fields and last != "warc-concurrent-to":  # the only one that may be repeated: heads of two records have run together
            raise Damaged("field given twice")
        fields[last] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise Damaged("no content length")
    start = at + stop + len(END)
    end = start + int(length)
    if end + len(END) > source.size:
        raise Damaged("cut off")
    if source.get(end, len(END)) != END:
        raise Damaged("no end after the content length")
    block = source.get(start, int(length))
    digest = fields.get("warc-block-digest", "")
    if digest.lower().startswith("sha1:") and digest[5:].upper() != _sha1(block):
        raise Damaged("block digest differs")
    return fields, block, end + len(END)


def gzip_member(source: Window, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at a place, or Damaged; it must start with a version line and not unpack to more than a row holds."""
    unpack, parts, size, place = zlib.decompressobj(31), [], 0, at
    try:
        if not unpack.decompress(source.get(place, 4096), 64).startswith(VERSION):
            raise Damaged("member without a version line")
        unpack, step = zlib.decompressobj(31), 4096
        while not unpack.eof:
            data = source.get(place, step)
            if not data:
                raise Damaged("cut off")
            piece = unpack.decompress(data, MOST_BYTES - size + 1)
            place, size = place + len(data), size + len(piece)
            if size > MOST_BYTES:
                raise Damaged("member too large")
            parts.append(piece)
            step = min(CHUNK, 4 * step)
        return b"".join(parts), place - len(unpack.unused_data)
    except zlib.error as why:
        raise Damaged(f"gzip: {str(why).split(': ')[-1]}") from None


def salvage(file) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """Of a file: (start, end, fields, block) of each record, and (start, end, {"reason": ...} alone, b"") of each quarantined gap, in order.

    Records and gaps together cover the file. What starts at a place is checked whole (gzip checksum, head, length, closing
    lines, block digest). If a check fails, the next gzip member or version line is looked for, and the bytes up to the first that
    stands its own checks are one gap with the first reason. So a damaged length can't lead the reader astray, and each byte
    is searched once; a candidate costs its own length at most. Members and plain records may be mixed.
    """
    source, at, bad = Window(file), 0, None
    while at < source.size:
        try:
            if source.get(at, 3) == GZIP:
                data, end = gzip_member(source, at)
                inner = list(_inside(data))
                if not any(f for _, f, _ in inner):
                    raise Damaged(inner[0][2].decode() if inner else "empty member")
            else:
                fields, block, end = plain_record(source, at)
                inner = [("record", fields, block)]
        except Damaged as why:
            bad = bad or (at, str(why))
            at = _next_mark(source, at + 1)
            continue
        if bad:
            yield bad[0], at, {"reason": bad[1]}, b""
            bad = None
        for kind, fields, block in inner:
            yield at, end, fields if kind == "record" else {"reason": block.decode()}, block if kind == "record" else b""
        at = end
    if bad:
        yield bad[0], source.size, {"reason": bad[1]}, b""


def _inside(data: bytes) -> Iterator[tuple[str, dict[str, str] | None, bytes]]:
    """Records and gaps of a member's content."""
    source, at, bad = Whole(data), 0, ""
    while at < len(data):
        try:
            fields, block, end = plain_record(source, at)
        except Damaged as why:
            bad = bad or str(why)
            at = data.find(VERSION, at + 1)
            at = len(data) if at < 0 else at
            continue
        if bad:
            yield "gap", None, bad.encode()
            bad = ""
        yield "record", fields, block
        at = end
    if bad:
        yield "gap", None, bad.encode()


def _next_mark(source: Window, at: int) -> int:
    """The next place that a gzip member or a version line may start at, or the end."""
    step = 1 << 12
    while at < source.size:
        found = MARK.search(source.get(at, step))
        if found:
            return at + found.start()
        at += step if at + step >= source.size else step - len(VERSION) + 1
        step = min(CHUNK, 4 * step)
    return source.size


RECORDS = "uri string, start long, end long, reason string, record_type string, page_id string, url string, payload_bytes long, payload_digest string, refers_to string"


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read archives (``uri``) and salvage what is whole: a row for each record, and one with a ``reason`` for each quarantined gap of bytes.

    uri, start and end say where; record_type, page_id, url, payload_bytes, payload_digest (bare base32 SHA-1), refers_to (page id of the
    response) what. A response's length and digest are taken from the payload as read and have to agree with its head, else the record is
    a gap (``payload digest differs``); a revisit's come from its heads. Other records have their whole block as payload. Each file is one task's
    work in bounded memory: a chunk and one record.
    """
    spark = manifest.sparkSession
    schema = RECORDS + (", payload binary" if with_payload else "")
    files = manifest.select("uri")

    def rows(uri: str) -> Iterator[tuple]:
        system, path = pafs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            for start, end, fields, block in salvage(file):
                if "warc-type" not in fields:
                    yield (uri, start, end, fields.get("reason", "no record type"), *[None] * 7)
                    continue
                kind, head, payload = fields["warc-type"], b"", block
                if fields.get("content-type", "").lower().startswith("application/http"):
                    head, _, payload = block.partition(END)
                said = fields.get("warc-payload-digest", "")
                said = said[5:].upper() if said.lower().startswith("sha1:") else None
                if kind == "revisit":
                    told = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})", head)
                    length, digest = int(told[1]) if told else None, said
                else:
                    length, digest = len(payload), _sha1(payload)
                    if said and said != digest:
                        yield (uri, start, end, "payload digest differs", *[None] * 7)
                        continue
                ids = [unquote(fields[f]) if f in fields else None for f in ("page-id", "refers-to-page-id")]
                yield (uri, start, end, None, kind, ids[0], fields.get("warc-target-uri"), length, digest, ids[1], payload)

    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def together(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))[: len(names)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for row in rows(uri):
                    held.append(row if with_payload else row[:-1])
                    size += len(row[-1] or b"") if with_payload else 0
                    if len(held) >= 4096 or size > 1 << 23:
                        yield together(held)
                        held, size = [], 0
        if held:
            yield together(held)

    return files.repartition(max(1, files.count())).mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and read them back: page id, payload_bytes, payload_digest, record_type, refers_to, url."""
    kind = pages.schema[id_col].dataType
    manifest = write_archives(pages, scratch_path(pages.sparkSession, "warc"), id_col, url_col, html_col, least_revisit_bytes)
    return read_archives(manifest).where("reason is null").select(
        F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), F.col("url").alias("target_uri")
    )
