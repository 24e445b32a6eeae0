"""WARC archives as seekable Zstandard bundles.

Records are packed into frames of about `frame_bytes`, frames into bundles of about
`bundle_bytes`. Frames are compressed independently; a skippable frame at the end of a bundle is
its seek table (compressed and decompressed size of each frame), so any Zstandard reader reads a
bundle and one that knows the table jumps to a frame. The index maps each record identifier to
(bundle, frame, offset in the decompressed frame, length). Bundles are rows of a table that Spark
writes, so they live in whatever store it reaches; `data` is the file's content.

Of records with equal payloads of at least `min_bytes` bytes, that with the largest id is a
response and the others revisit it: their block holds the HTTP header alone.

Defined cases: a null payload is an empty one; a null id counts as the smallest and has an
identifier without a number; rows with the same payload that share the largest id are all
responses; line ends and other control characters in a URL are percent-encoded, and a null URL
has no header; other columns are not archived. An empty table gives no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import stored, table

# Fixed values of the seekable format: magic numbers of its skippable frame and footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
RECORD_ID = "<urn:page:{}>"

BUNDLES = (
    "bundle string, data binary, "
    "index array<struct<record_id:string,frame:int,offset:int,length:int>>"
)
RECORDS = (
    "page_id long, record_type string, url string, payload binary, payload_bytes long, "
    "payload_digest string, refers_to long"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _escaped(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _identifier(page_id: int | None) -> str:
    return RECORD_ID.format("" if page_id is None else page_id)


def _page_id(identifier: str) -> int | None:
    number = identifier[len("<urn:page:"):-1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: {_identifier(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    if revisits:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_identifier(refers_to)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at `at`, its digests checked, and where it ends."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block = raw[end + 4:end + 4 + size]
    http_end = block.index(b"\r\n\r\n") + 4
    http = dict(line.split(": ", 1) for line in block[:http_end - 4].decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    payload = block[http_end:] if fields["WARC-Type"] == "response" else None
    if payload is not None and base32_sha1(payload) != digest:
        raise ValueError(f"wrong payload digest in {fields['WARC-Record-ID']}")
    found = {
        "page_id": _page_id(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"],
        "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": int(http["Content-Length"]),
        "payload_digest": digest,
        "refers_to": _page_id(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }
    return found, end + 4 + size + 4


class Bundle:
    """Frames of records that become one file."""

    def __init__(self, level: int):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[bytes] = []
        self.table = b""
        self.index: list[dict] = []
        self.open = bytearray()
        self.size = 0

    def add(self, identifier: str, raw: bytes, frame_bytes: int) -> None:
        if self.open and len(self.open) + len(raw) > frame_bytes:
            self.close_frame()
        self.index.append({"record_id": identifier, "frame": len(self.frames), "offset": len(self.open), "length": len(raw)})
        self.open += raw

    def close_frame(self) -> None:
        if self.open:
            frame = self.compressor.compress(bytes(self.open))
            self.frames.append(frame)
            self.table += struct.pack("<II", len(frame), len(self.open))
            self.size += len(frame)
            self.open.clear()

    def content(self) -> bytes:
        self.close_frame()
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(self.table) + len(footer)) + self.table + footer


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame."""
    frames, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    at, found = 0, []
    start = len(data) - 9 - 8 * frames
    for i in range(frames):
        packed, size = struct.unpack_from("<II", data, start + 8 * i)
        found.append((at, packed, size))
        at += packed
    return found


def frame(data: bytes, place: tuple[int, int, int]) -> bytes:
    import zstandard

    at, packed, size = place
    return zstandard.ZstdDecompressor().decompress(data[at:at + packed], max_output_size=size) if size else b""


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """pages with `digest`, `revisits` and `refers_to`. Digests meet their response in a join whose
    sides Spark can split, so one payload may hold any share of the rows."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    keyed = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"),
        F.concat(F.sha1(payload), F.octet_length(payload).cast("string")).alias("digest"),
    )
    winners = stored(
        keyed.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", "winner"),
        "warc-responses",
    ).withColumn("repeated", F.lit(True))
    met = keyed.join(winners, "digest", "left")
    revisits = F.coalesce(F.col("repeated"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return met.select("page_id", "url", "payload", revisits.alias("revisits"), F.when(revisits, F.col("winner")).alias("refers_to"))


def write_bundles(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
    frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 21, level: int = 3, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """The stored table of bundles (bundle, data, index)."""
    renamed = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{payload_col}`").alias("payload")
    )
    rows = with_revisits(renamed, "page_id", "payload", min_bytes)

    def emit(bundle: Bundle) -> pa.RecordBatch:
        data = bundle.content()
        name = hashlib.blake2b(data, digest_size=16).hexdigest()
        return pa.RecordBatch.from_pydict(
            {"bundle": [name], "data": [data], "index": [bundle.index]},
            schema=pa.schema([
                ("bundle", pa.string()), ("data", pa.binary()),
                ("index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))),
            ]),
        )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle(level)
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "revisits", "refers_to")]
            for row in range(batch.num_rows):
                page_id, url, payload, revisits, refers_to = (c[row].as_py() for c in columns)
                bundle.add(_identifier(page_id), record(page_id, url, payload, revisits, refers_to, date), frame_bytes)
                if bundle.size + len(bundle.open) >= bundle_bytes:
                    yield emit(bundle)
                    bundle = Bundle(level)
        if bundle.index:
            yield emit(bundle)

    return stored(rows.mapInArrow(packed, BUNDLES), "warc-bundles")


_ARROW_RECORDS = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records, read through the seek tables frame by frame; payload is null for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("data"):
                data = cell.as_py()
                for place in seek_table(data):
                    raw, at, found = frame(data, place), 0, []
                    while at < len(raw):
                        one, at = parse(raw, at)
                        found.append(one)
                    yield pa.RecordBatch.from_pylist(found, schema=_ARROW_RECORDS)

    return bundles.select("data").mapInArrow(read, RECORDS)


def index_of(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle, frame, offset, length)."""
    return bundles.select("bundle", F.inline("index")).select("record_id", "bundle", "frame", "offset", "length")


def fetch(bundles: DataFrame, record_ids: DataFrame) -> DataFrame:
    """Records of the identifiers in the column record_id; only their frames are decompressed."""
    places = index_of(bundles).join(record_ids.select("record_id").distinct(), "record_id")
    wanted = places.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))
    chosen = bundles.select("bundle", "data").join(wanted, "bundle").select("data", "places")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table_, frames = seek_table(row["data"]), {}
                for p in row["places"]:
                    if p["frame"] not in frames:
                        frames = {p["frame"]: frame(row["data"], table_[p["frame"]])}
                    one, _ = parse(frames[p["frame"]][p["offset"]:p["offset"] + p["length"]])
                    yield pa.RecordBatch.from_pylist([one], schema=_ARROW_RECORDS)

    return chosen.mapInArrow(read, RECORDS)


def query(spark, sf_dir: str) -> DataFrame:
    bundles = write_bundles(table(spark, sf_dir, "pages"))
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
judged AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, h, max(page_id) OVER (PARTITION BY html) AS winner FROM hashed)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM judged
"""
