"""Web archives as seekable Zstandard bundles.

A bundle holds independent frames of many WARC records each, then two skippable frames: a map from record identifiers to
their places (frame, offset within the frame, length), and the seek table of the seekable format, whose last nine bytes
are the footer. So a bundle is read as a whole by any Zstandard reader, and one record by decompressing one frame.

Spark's own writer puts each bundle into a file of its own, so files of lost or repeated task attempts never show, and
any file system that Spark reads will do.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.llm.common import written
from epispark.session import shared_folder

# fixed values of the Zstandard format and its seekable variant
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page-records")
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
INDEX_COLUMNS = [c.split()[0] for c in INDEX.split(", ")]
RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so a revisit can name its response before either is written."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def record_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> tuple[str, bytes]:
    """Identifier and bytes of one WARC/1.1 record. A revisit keeps the HTTP head of its response, without the payload."""
    digest = digest_of(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    name = record_id(page_id, digest)
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name, "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
        if head["WARC-Target-URI"] != url:
            head["Page-URL"] = json.dumps(url)
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{digest_of(block)}"}
    if page_id is not None:
        head["Page-ID"] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, digest)}
        head |= {} if refers_to is None else {"Refers-To-Page-ID": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return name, text.encode() + block + b"\r\n\r\n"


def parsed_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The fields of RECORD of the record that starts at this place of data, and where the next one starts; ValueError
    where digests disagree."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(line.split(": ", 1) for line in lines)
    stop = end + 4 + int(head["Content-Length"])
    block = data[end + 4 : stop]
    if head["WARC-Block-Digest"] != f"sha1:{digest_of(block)}" or data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit, digest = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:")
    n = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    if not revisit and (len(payload) != n or digest_of(payload) != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    number = lambda k: int(head[k]) if k in head else None
    url = json.loads(head["Page-URL"]) if "Page-URL" in head else head.get("WARC-Target-URI")
    fields = {"record_id": head["WARC-Record-ID"], "page_id": number("Page-ID"), "url": url, "record_type": head["WARC-Type"], "refers_to": number("Refers-To-Page-ID"), "payload_bytes": n, "payload_digest": digest, "payload": None if revisit else payload}
    return fields, stop + 4


class Bundle:
    """Collects records into frames of about frame_bytes, and frames into one bundle."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.out, self.table, self.places, self.open = bytearray(), [], [], bytearray()

    def add(self, page_id: int | None, name: str, record: bytes) -> None:
        self.places.append((name, page_id, len(self.table), len(self.open), len(record)))
        self.open += record
        if len(self.open) >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            data = bytes(self.open)
            frame = self.packer.compress(data)
            self.out += frame
            self.table.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.open = bytearray()

    def closed(self) -> bytes:
        """All bytes of the bundle."""
        self.close_frame()
        places = self.packer.compress(json.dumps(self.places).encode())
        self.table.append((len(places) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *t) for t in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE, len(places)) + places + struct.pack("<II", SEEK_TABLE, len(entries) + 9) + entries + footer


def seek_table(content: bytes) -> list[tuple[int, int, int, int]]:
    """(start, size, decompressed size, checksum) of each frame before the seek table, from the footer."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    size = 12 if flags & CHECKSUMS else 8
    at = len(content) - 9 - n * size
    if magic != SEEKABLE or struct.unpack("<II", content[at - 8 : at]) != (SEEK_TABLE, n * size + 9):
        raise ValueError("no seek table at the end")
    out, start = [], 0
    for k in range(n):
        entry = struct.unpack("<III" if size == 12 else "<II", content[at + k * size : at + (k + 1) * size])
        out.append((start, entry[0], entry[1], entry[2] if size == 12 else None))
        start += entry[0]
    return out


def frame_at(content: bytes, entry: tuple[int, int, int, int]) -> bytes:
    start, size, n, check = entry
    data = zstandard.ZstdDecompressor().decompress(content[start : start + size], max_output_size=n)
    if len(data) != n or check is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("a frame is damaged")
    return data


def places_of(content: bytes) -> list[list]:
    """(record_id, page_id, frame, offset, length) of the records of a bundle, from its map alone."""
    start, size, *_ = seek_table(content)[-1]
    return json.loads(zstandard.ZstdDecompressor().decompress(content[start + 8 : start + size]))


def write_archives(pages: DataFrame, folder: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 23, least_bytes: int = 0, level: int = 3, date: str = "2000-01-01T00:00:00Z", broadcast_rows: int = 100_000, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one WARC record per row of pages into bundles `<folder>/bundle=<name>/`, one file each.

    The payload is the html in UTF-8; null html is an empty payload. Of the rows whose payloads are equal and have at
    least least_bytes bytes, those with the largest page_id are responses and the others revisit them; all smaller
    payloads are responses. Rows without page_id count as smaller than any id. Rows that repeat page_id and payload share
    a record identifier. Null urls have no target. Other columns are ignored, whatever their names; an empty table writes
    no bundle. A long payload stays whole in one frame, which grows with it.

    Payloads are not shuffled where at most broadcast_rows of them occur more than once (counted first, some 100 bytes
    each): each partition bundles its own rows. Beyond that the rows meet their payload's largest id in a join, whose hot
    keys Spark splits. Task attempts may repeat: Spark commits the files of one.
    """
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "size": F.length("payload"), "more": F.xxhash64("payload")})
    same = ["digest", "size", "more"]
    groups = p.where(F.col("size") >= least_bytes).groupBy(*same).agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1").select(*same, "top", F.lit(True).alias("shared")))
    rows = p.join(F.broadcast(groups) if groups.count() <= broadcast_rows else groups, same, "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("top"))
    # ids as text: a null beside a large id would make pandas round it
    rows = rows.select(F.col("page_id").cast("string").alias("page"), "url", "payload", F.col("top").cast("string").alias("top"), revisit.alias("revisit"))

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, part, made = Bundle(frame_bytes, level), TaskContext.get().partitionId(), 0
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for page, target, payload, top, again in zip(b["page"], b["url"], b["payload"], b["top"], b["revisit"], strict=True):
                name, record = record_of(number(page), target, payload, number(top) if again else None, again, date)
                bundle.add(number(page), name, record)
                if len(bundle.out) >= bundle_bytes:
                    yield pd.DataFrame({"bundle": [f"{part:06d}-{made:06d}"], "content": [bundle.closed()]})
                    bundle, made = Bundle(frame_bytes, level), made + 1
        if bundle.places:
            yield pd.DataFrame({"bundle": [f"{part:06d}-{made:06d}"], "content": [bundle.closed()]})

    bundles = rows.mapInPandas(bundled, "bundle string, content binary")
    # the text writer passes bytes on as they are and ends a row by the separator: the last four bytes of the footer
    magic = struct.pack("<I", SEEKABLE)
    body = F.expr(f"substring(content, 1, length(content) - {len(magic)})").cast("string")
    writer = bundles.select("bundle", body.alias("value")).write.partitionBy("bundle").option("compression", "none")
    writer.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", magic.decode("ISO-8859-1")).text(folder)


def bundles(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle, content) of the archives below folder."""
    found = spark.read.format("binaryFile").load(folder)
    name = F.col("bundle").cast("string") if "bundle" in found.columns else F.lit(None).cast("string")  # absent without files
    return found.select(name.alias("bundle"), "content")


def frame_of(rows: list[dict]) -> pd.DataFrame:
    """Ids as nullable integers, at no point as doubles."""
    frame = pd.DataFrame(rows, dtype=object)
    return frame.astype({c: "Int64" for c in ("page_id", "refers_to") if c in frame})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records (RECORD) of the archives below folder, digests and checksums verified; revisits have no payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                for entry in seek_table(content)[:-1]:
                    data, at, rows = frame_at(content, entry), 0, []
                    while at < len(data):
                        fields, at = parsed_record(data, at)
                        rows.append(fields)
                    yield frame_of(rows)

    return bundles(spark, folder).mapInPandas(run, RECORD)


def archive_index(spark: SparkSession, folder: str) -> DataFrame:
    """Where each record lies (INDEX), from the maps of the bundles; no frame is decompressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["bundle"], b["content"], strict=True):
                fields = ("record_id", "page_id", "frame", "offset", "length")
                yield frame_of([dict(zip(fields, place, strict=True)) for place in places_of(content)]).assign(bundle=name)[INDEX_COLUMNS]

    return bundles(spark, folder).mapInPandas(run, INDEX)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Records (RECORD) of the places in wanted (rows of INDEX): of each bundle only the frames asked for are read."""
    asked = wanted.select("bundle", "frame", "offset").distinct().groupBy("bundle", "frame").agg(F.collect_list("offset").alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, frame, at in zip(b["content"], b["frame"], b["at"], strict=True):
                data = frame_at(content, seek_table(content)[frame])
                rows = [parsed_record(data, x)[0] for x in at]
                yield frame_of(rows)

    return asked.join(bundles(spark, folder), "bundle").mapInPandas(run, RECORD)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def archived(pages: DataFrame, columns: Sequence[str] = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), **options) -> DataFrame:
    """Write pages as archives into a new folder below the shared one, and read them back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "archives")
    write_archives(pages, folder, **options)
    return read_archives(spark, folder).select(*columns)
