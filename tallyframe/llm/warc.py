"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records, and a footer
in a skippable frame: the seek table of the Zstandard seekable format (compressed and plain size of
each frame). The index, a Parquet table, maps each record id to its bundle, its frame and its
offset and length inside the plain frame, so that one record costs one ranged read and one frame.

Equal payloads of at least ``least`` bytes are stored once: the record of the largest id is the
response, the others are revisits that name it. Groups are found from digests alone; payloads are
never grouped, so that a payload with a third of all pages costs its own rows only.

Files are written by tasks through Arrow's file systems, under names that hold the attempt's
number, and get their final name when they are whole; a repeated task leaves its first files behind,
but the index names only those of the attempt that counted, and reads keep to the index.

Defined results: a null html is the empty payload, a null url gives no target URI. Rows that repeat
are records of their own (ties on the id go to the later row). A null id loses against any other;
among nulls alone the later row is the response. Other columns are ignored. An empty table gives no
bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import ROW, column_lists, salted_left_join, sha256_hex, utf8_values, with_row

#: Fixed values of the Zstandard seekable format and of the WARC revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


class Bundle:
    """Writes one bundle; ``add`` gives a record's frame and offset in it."""

    def __init__(self, out, frame_bytes: int, level: int):
        self.out, self.frame_bytes, self.sizes = out, frame_bytes, []
        self.compressor, self.frame, self.written = zstandard.ZstdCompressor(level=level, write_checksum=True), io.BytesIO(), 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.frame.tell() and self.frame.tell() + len(record) > self.frame_bytes:
            self.end_frame()
        at = len(self.sizes), self.frame.tell()
        self.frame.write(record)
        return at

    def end_frame(self) -> None:
        plain = self.frame.getvalue()
        packed = self.compressor.compress(plain)
        self.out.write(packed)
        self.sizes.append((len(packed), len(plain)))
        self.written += len(packed)
        self.frame = io.BytesIO()

    def close(self) -> None:
        if self.frame.tell():
            self.end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        self.out.close()


def seek_table(read, size: int) -> list[tuple[int, int, int]]:
    """(start, packed size, plain size) of each frame; ``read(offset, length)`` reads the file."""
    frames, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    raw, table, at = read(size - 9 - frames * entry, frames * entry), [], 0
    for i in range(frames):
        packed, plain = struct.unpack_from("<II", raw, i * entry)
        table.append((at, packed, plain))
        at += packed
    return table


def plain_frame(packed: bytes, plain: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=plain)


def record_id(page: object, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORDS, f'{page}/{row}')}>"


def record(page: object, row: int, url: str | None, payload: bytes, refers: tuple[object, int] | None, date: str) -> bytes:
    """One WARC record: the page's response, or a revisit of ``refers`` (its id and row)."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", record_id(page, row)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe=PRINTABLE)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if refers else None),
        ("WARC-Refers-To", record_id(*refers) if refers else None),
        ("Page-ID", None if page is None else str(page)),
        ("Refers-To-Page-ID", str(refers[0]) if refers and refers[0] is not None else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(plain: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """The header fields, HTTP head and payload of each record of a frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        version, *lines = plain[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]}")
        fields = dict(line.split(": ", 1) for line in lines)
        start, length = end + 4, int(fields["Content-Length"])
        head, _, payload = plain[start : start + length].partition(b"\r\n\r\n")
        yield fields, head, payload
        at = start + length + 4


def marked(pages: DataFrame, least: int, salts: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page, url, html, __row and ``first`` (id and row of the response; null: its own)."""
    rows = with_row(pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least, sha256_hex(F.col("html"))).otherwise(F.col(ROW).cast("string")))
    groups = (
        rows.where(F.octet_length("html") >= least)
        .select("digest", F.struct(F.col("page").isNotNull().alias("some"), "page", ROW).alias("last"))
        .groupBy("digest")
        .agg(F.max("last").alias("last"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", F.struct("last.page", f"last.{ROW}").alias("first"))
    )
    out = salted_left_join(rows, groups, "digest", F.col(ROW), salts)
    return out.withColumn("first", F.when(F.col(f"first.{ROW}") != F.col(ROW), F.col("first"))).drop("digest")


def write_archives(pages: DataFrame, folder: str, least: int = 1000, frame_bytes: int = 256 << 10, bundle_bytes: int = 8 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z", salts: int = 16, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the bundles to ``folder`` as the returned index is computed (write it once, read it
    after): page, record_id, bundle, frame, offset, length."""
    rows = marked(pages, least, salts, id_col, url_col, html_col)
    kind = rows.schema["page"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        bundle, name, made = None, "", 0

        def end() -> None:
            nonlocal bundle
            bundle.close()
            files.move(f"{base}/{name}.part", f"{base}/{name}")
            bundle = None

        for page, row, url, html, first in column_lists(batches, "page", ROW, "url", "html", "first"):
            places = []
            pages_l, rows_l = page.to_pylist(), row.to_pylist()
            for key, number, link, payload, of in zip(pages_l, rows_l, url.to_pylist(), utf8_values(html), first.to_pylist()):
                if bundle is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{made:05d}.warc.zst"
                    files.create_dir(base, recursive=True)
                    bundle, made = Bundle(files.open_output_stream(f"{base}/{name}.part", compression=None), frame_bytes, level), made + 1
                raw = record(key, number, link, payload, of and (of["page"], of[ROW]), date)
                places.append((record_id(key, number), name, *bundle.add(raw), len(raw)))
                if bundle.written >= bundle_bytes:
                    end()
            ids, names, frames, offsets, lengths = zip(*places)
            yield pa.RecordBatch.from_arrays([page, pa.array(ids), pa.array(names), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["page", "record_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            end()

    return rows.mapInArrow(task, f"page {kind}, record_id string, bundle string, frame int, offset long, length long")


RECORD = "page_id string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, bundle string"


def _described(records: Iterator[tuple[dict[str, str], bytes, bytes]]) -> Iterator[tuple]:
    for fields, head, payload in records:
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
        size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
        yield fields.get("Page-ID"), fields["WARC-Record-ID"], fields["WARC-Type"], size, digest, fields.get("Refers-To-Page-ID")


def _batch(rows: list[tuple], bundles: list[str]) -> pa.RecordBatch:
    page, ids, types, sizes, digests, refers = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(page, pa.string()), pa.array(ids), pa.array(types), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(refers, pa.string()), pa.array(bundles)], ["page_id", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "bundle"])


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names, frame by frame. What is joined with the
    index are the records' rows, never the files' contents."""
    if index.isEmpty():
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, content in column_lists(batches, "bundle", "content"):
            for name, whole in zip(names.to_pylist(), content):
                raw = whole.as_py()
                for start, packed, plain in seek_table(lambda o, n, raw=raw: raw[o : o + n], len(raw)):
                    rows = list(_described(parse(plain_frame(raw[start : start + packed], plain))))
                    yield _batch(rows, [name] * len(rows))

    found = files.select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content").mapInArrow(task, RECORD)
    return found.join(index.select("bundle").distinct(), "bundle", "left_semi").select(*[c.split()[0] for c in RECORD.split(", ")])


def lookup(index: DataFrame, folder: str) -> DataFrame:
    """The records of ``index`` (any part of it) by ranged reads: a frame that several of the rows
    name is read once a task."""
    asked = index.select("bundle", "frame", "offset", "length").repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        name = at = None
        for cols in column_lists(batches, "bundle", "frame", "offset", "length"):
            rows, names = [], []
            for bundle, frame, offset, length in zip(*(c.to_pylist() for c in cols)):
                if bundle != name:
                    source, name, at = files.open_input_file(f"{base}/{bundle}"), bundle, None
                    table = seek_table(lambda o, n, s=source: s.read_at(n, o), source.size())
                if frame != at:
                    start, packed, plain_size = table[frame]
                    plain, at = plain_frame(source.read_at(packed, start), plain_size), frame
                rows += _described(parse(plain[offset : offset + length]))
                names.append(bundle)
            yield _batch(rows, names)

    return asked.mapInArrow(task, RECORD)
