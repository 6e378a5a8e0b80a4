"""WARC archives as a Spark data source.

Writing: each task writes record-per-member gzip files; a record's compressed length stands in the
extra field of its gzip header, so a reader can pass over it. Files appear under their names when the job commits.
Reading: partitions are planned from file sizes; a record's headers are parsed first, and a record that the
pushed-down conditions exclude is passed over without inflating its payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from pitgrid.functions.staging import stage, stage_folder
from pitgrid.llm.common import find_package

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name space of URLs (fixed value)
COLUMNS = "record_type string, record_id string, page_id long, url string, date string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: condition column -> record header; names of headers have no case
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "url": "warc-target-uri", "date": "warc-date", "page_id": "x-page-id",
           "payload_digest": "warc-payload-digest", "refers_to": "x-refers-to-page"}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_LENGTH_FIELD = b"PL"  # two-byte name and, in 8 bytes, the whole length of the member


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it, of a URI or a local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{page_id}:{url}')}>"


def target(page_id: int | None, url: str | None) -> str:
    """URL without white space, or a name made of the id."""
    return "".join((url or "").split()) or f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None, date: str, refers_url: str | None = None) -> bytes:
    """One record: a response with its payload, or a revisit without, which names the record it refers to."""
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP + (payload or b"") if refers_to is None else _HTTP
    url = target(page_id, url)
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, url)), ("WARC-Date", date), ("WARC-Target-URI", url),
             ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-Length", size)]
    if page_id is not None:
        lines.append(("X-Page-ID", page_id))
    if refers_to is not None:
        first = target(refers_to, refers_url)
        lines += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, first)), ("WARC-Refers-To-Target-URI", first), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", refers_to)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*lines, ("Content-Length", len(block))]) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that says its own length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = _LENGTH_FIELD + (8).to_bytes(2, "little") + total.to_bytes(8, "little")
    head = b"\x1f\x8b\x08\x04\0\0\0\0\x04\xff" + len(extra).to_bytes(2, "little") + extra
    return head + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def _parse_head(head: bytes) -> dict[str, str]:
    """Headers by their names in lower case."""
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


class _Input:
    """Buffered bytes of a file from the front, with a skip."""

    def __init__(self, file, size: int):
        self.file, self.left, self.data = file, size, b""

    def need(self, n: int) -> bytes:
        """At least ``n`` buffered bytes, fewer at the end of the file."""
        while len(self.data) < n and self.left:
            got = self.file.read(max(1 << 16, n - len(self.data)))
            if not got:
                self.left = 0
                break
            self.left -= len(got)
            self.data += got
        return self.data

    def drop(self, n: int) -> None:
        if n > len(self.data):
            n -= len(self.data)
            self.data = b""
            self.file.seek(self.file.tell() + n)
            self.left = max(0, self.left - n)
        else:
            self.data = self.data[n:]


def records(file, size: int, zipped: bool, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of the records of a file for whose headers ``wanted`` gives True, or (headers, None)
    where it gives None (headers only). Others are passed over: by a seek where the length is known, else by inflating in pieces."""
    src = _Input(file, size)
    while src.need(18):
        if not zipped:
            while b"\r\n\r\n" not in src.data and src.left:
                src.need(len(src.data) + 1)
            head, _, _ = src.data.partition(b"\r\n\r\n")
            headers = _parse_head(head)
            n = int(headers.get("content-length", 0))
            src.drop(len(head) + 4)
            choice = wanted(headers)
            if choice:
                yield headers, src.need(n)[:n]
            elif choice is None:
                yield headers, None
            src.drop(n + 4)
            continue
        start = src.data
        # the field counts only where the header says that there are extra fields
        told = start[3] & 4 and start[12:14] == _LENGTH_FIELD and len(src.need(24)) >= 24
        length = int.from_bytes(src.data[16:24], "little") if told else 0
        z = zlib.decompressobj(31)
        if length:
            # headers come from the first piece; the rest is inflated only if wanted
            whole = src.need(min(length, 1 << 13))[: min(length, 1 << 13)]
            text = z.decompress(whole, 1 << 14)
            if b"\r\n\r\n" not in text:
                whole = src.need(length)[:length]
                z = zlib.decompressobj(31)
                text = z.decompress(whole)
            at = text.index(b"\r\n\r\n")
            headers = _parse_head(text[:at])
            choice = wanted(headers)
            if choice:
                body = zlib.decompress(src.need(length)[:length], 31)[at + 4 :]
                yield headers, body[: int(headers.get("content-length", 0))]
            elif choice is None:
                yield headers, None
            src.drop(length)
            continue
        # a member of unknown length: inflate to its end, keep the block only if wanted
        text, headers, choice = b"", None, True
        while not z.eof:
            piece = z.decompress(z.unconsumed_tail or src.need(1), 1 << 16)
            if not z.unconsumed_tail:
                src.data = z.unused_data if z.eof else b""
            if headers is None or choice:
                text += piece
            if headers is None and b"\r\n\r\n" in text:
                headers = _parse_head(text[: text.index(b"\r\n\r\n")])
                choice = wanted(headers)
            if not piece and not src.data and not src.left and not z.eof:
                raise ValueError("the archive ends inside a record")
        if headers is not None and choice:
            at = text.index(b"\r\n\r\n") + 4
            yield headers, text[at : at + int(headers.get("content-length", 0))]
        elif headers is not None and choice is None:
            yield headers, None


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.split = int(options.get("splitBytes", 64 << 20))
        self.tests: list[tuple[str, set[str]]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in HEADERS:
                values = [f.value] if isinstance(f, EqualTo) else f.value
                mark = "sha1:" if name == "payload_digest" else ""
                self.tests.append((HEADERS[name], {f"{mark}{v}" for v in values if v is not None}))
            else:
                yield f

    def partitions(self):
        fs, path = filesystem(self.path)
        found = [f for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith(("_", "."))]
        groups, size = [[]], 0
        for f in sorted(found, key=lambda f: f.path):
            if groups[-1] and size + f.size > self.split:
                groups.append([])
                size = 0
            groups[-1].append((f.path, f.size))
            size += f.size
        return [_Files(g) for g in groups]

    def read(self, partition):
        fs, _ = filesystem(self.path)

        def wanted(headers):
            if any(headers.get(h) not in values for h, values in self.tests):
                return False
            return True if self.payload and headers.get("warc-type") == "response" else None

        number = lambda v: None if v is None else int(v)
        for path, size in partition.files:
            with fs.open_input_file(path) as file:
                for h, block in records(file, size, path.endswith(".gz"), wanted):
                    payload = None if block is None else payload_of(h, block)
                    yield (h.get("warc-type"), h.get("warc-record-id"), number(h.get("x-page-id")), h.get("warc-target-uri"), h.get("warc-date"),
                           len(payload) if payload is not None else number(h.get("x-payload-length")),
                           digest(payload) if payload is not None else h.get("warc-payload-digest", "").removeprefix("sha1:"), number(h.get("x-refers-to-page")), payload)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """Body of an HTTP message; the whole block of any other record (or of a message that has no body)."""
    if not headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        return block
    head, end, body = block.partition(b"\r\n\r\n")
    return body if end or head.startswith(b"HTTP/") else block


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of page_id, url, payload, payload_bytes, sha1 (hex), refers_to, refers_url."""

    def __init__(self, options):
        self.path, self.date, self.roll = options["path"], options.get("date", "1970-01-01T00:00:00Z"), int(options.get("rollBytes", 256 << 20))

    def write(self, iterator):
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        files, sink, size = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if sink is None:
                    files.append(f"{path}/_part-{uuid.uuid4().hex}.warc.gz")
                    sink, size = fs.open_output_stream(files[-1], compression=None), 0
                data = member(record(row["page_id"], row["url"], row["payload"], row["payload_bytes"], base64.b32encode(bytes.fromhex(row["sha1"])).decode(), row["refers_to"], self.date, row["refers_url"]))
                sink.write(data)
                size += len(data)
                if size >= self.roll:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        return _Written(files)

    def commit(self, messages):
        """Only the files of successful attempts get a name that readers see."""
        fs, _ = filesystem(self.path)
        for f in [f for m in messages if m for f in m.files]:
            fs.move(f, f.replace("/_part-", "/part-"))

    def abort(self, messages):
        fs, _ = filesystem(self.path)
        for f in [f for m in messages if m for f in m.files]:
            fs.delete_file(f)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    find_package(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> None:
    """Write a record per row of ``pages``; payload: the text in UTF-8, null counts as empty.

    Of records with equal payloads of ``min_bytes`` or more, the one with the smallest id is a response and the others are revisits of it; smaller ones
    are responses. Repeated rows of that smallest id are responses too; a null id is never the smallest, and a group of null ids only is of responses.
    A first pass over digests finds the groups of copies (hash and id only); payloads are shuffled at most once, by id.
    """
    register(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("sha1"))
    light = stage(rows.select("page_id", "url", "sha1", "payload_bytes"), "digests")
    groups = light.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1 AND f IS NOT NULL").select("sha1", F.col("f.page_id").alias("first"), F.col("f.url").alias("refers_url"))
    again = light.join(groups, "sha1").where("page_id IS NULL OR page_id <> first").select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("first").alias("refers_to"), "refers_url").distinct()
    again = stage(again, "revisits")
    out = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left")
    out = out.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "sha1", "refers_to", "refers_url")
    out.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records below ``path``. Conditions on record_type, page_id, url, date, digest and refers_to are tested on the headers.

    payload_bytes and payload_digest are computed from the payload where it is read, and taken from the headers of revisits.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` into a new folder of the shared one and read it back."""
    path = stage_folder(pages.sparkSession, "warc")
    write_archives(pages, path, **columns)
    return read_archives(pages.sparkSession, path)
