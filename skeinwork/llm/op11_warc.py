"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are decompressed on their own; a bundle is a sequence of frames, then a skippable
frame with the record index, then a skippable frame with the seek table in the public seekable format (compressed and
decompressed size and checksum of every frame), so any Zstandard reader sees plain WARC and a seeking one opens one frame.

Bundles are written by Spark's text writer, one bundle per file: its line end is set to the last four bytes of the seek
table. So files are committed with the job, on any file system that Spark writes to, and a task that runs again leaves no
second copy. File names are the writer's.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.copies import first_of_copies, seats

# Fixed values of the Zstandard and seekable formats and of WARC 1.1.
SKIP_INDEX, SKIP_TABLE, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LAST = struct.pack("<I", SEEKABLE)
INDEX_COLUMNS = "record_id string, bundle string, frame long, frame_start long, frame_length long, offset long, length long"
RECORD_COLUMNS = "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
_PLAIN = "".join(chr(c) for c in range(33, 127))


def _uri(id_: str | None) -> str:
    return f"<urn:record:{quote(id_ or '', safe='')}>"


def _id(uri: str) -> str | None:
    return unquote(uri[len("<urn:record:") : -1]) or None


def _record(kind: str, head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in head], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(id_: str | None, url: str | None, payload: bytes, digest: str, first: str | None, date: str) -> bytes:
    """A response record, or without the payload a revisit record when ``first`` names the record that holds it."""
    head = [("WARC-Record-ID", _uri(id_)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        # Control characters, blanks and other than ASCII characters of a url are percent-encoded.
        head.insert(1, ("WARC-Target-URI", quote(url, safe=_PLAIN)))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        return _record("response", head, block + payload)
    return _record("revisit", [*head, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(first))], block)


def parse_record(raw: bytes) -> dict:
    """Fields of a record; ``payload`` is None where the record has none. The digest of a payload is computed from it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")]
    out = {"record_id": _id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
           "refers_to": _id(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": None,
           "payload_bytes": int(sizes[0].split()[1]) if sizes else 0, "payload_digest": fields.get("WARC-Payload-Digest", "sha1:")[5:]}
    if out["record_type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != out["payload_digest"] or len(payload) != out["payload_bytes"]:
            raise ValueError(f"record {out['record_id']}: payload and its digest or length differ")
        out["payload"] = payload
    return out


class Bundle:
    """A bundle being filled: whole frames, and the records that wait for the next one."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.codec = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.body, self.table, self.open, self.held = io.BytesIO(), [], [], 0
        self.ids, self.frames, self.offsets, self.lengths = [], [], [], []

    def add(self, id_: str | None, record: bytes) -> None:
        if self.held and self.held + len(record) > self.frame_bytes:
            self.close_frame()
        self.ids.append(id_)
        self.frames.append(len(self.table))
        self.offsets.append(self.held)
        self.lengths.append(len(record))
        self.open.append(record)
        self.held += len(record)

    def close_frame(self) -> None:
        if not self.open:
            return
        plain = b"".join(self.open)
        packed = self.codec.compress(plain)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.body.write(packed)
        self.open, self.held = [], 0

    def finish(self) -> bytes:
        """The bundle without its last four bytes, which are the writer's line end."""
        self.close_frame()
        table = pa.table({"record_id": pa.array(self.ids, pa.string()), "frame": pa.array(self.frames, pa.int64()),
                          "offset": pa.array(self.offsets, pa.int64()), "length": pa.array(self.lengths, pa.int64())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        index = self.codec.compress(sink.getvalue())
        self.body.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        entries = [*self.table, (len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        seek = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IB", len(entries), CHECKSUMS)
        self.body.write(struct.pack("<II", SKIP_TABLE, len(seek) + len(LAST)) + seek)
        return self.body.getvalue()


class Opened:
    """A bundle being read: its seek table and record index; frames are decompressed when asked for."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        count, flags, magic = struct.unpack("<IBI", self.content[-9:])
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("not a seekable bundle")
        entries = struct.iter_unpack("<III", self.content[len(content) - 9 - 12 * count : len(content) - 9])
        self.starts, self.sizes, self.sums, at = [], [], [], 0
        for packed, plain, checksum in entries:
            self.starts.append(at)
            self.sizes.append((packed, plain))
            self.sums.append(checksum)
            at += packed
        raw = self.content[self.starts[-1] + 8 : self.starts[-1] + self.sizes[-1][0]]
        self.index = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw)).read_all()

    def frame(self, number: int) -> bytes:
        start, (packed, plain) = self.starts[number], self.sizes[number]
        out = zstandard.ZstdDecompressor().decompress(self.content[start : start + packed], max_output_size=plain)
        if xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != self.sums[number]:
            raise ValueError(f"frame {number}: checksum differs")
        return out

    def records(self, ids: set[str] | None = None) -> Iterator[bytes]:
        """Records in order; with ``ids`` only theirs, and only the frames that hold them are decompressed."""
        now, plain = -1, b""
        for id_, number, offset, length in zip(*(self.index.column(c).to_pylist() for c in ("record_id", "frame", "offset", "length"))):
            if ids is not None and id_ not in ids:
                continue
            if number != now:
                now, plain = number, self.frame(number)
            yield plain[offset : offset + length]


def _fill(frame_bytes: int, bundle_bytes: int, level: int, date: str):
    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for id_, url, payload, digest, first in zip(*(batch.column(k) for k in range(5))):
                if bundle is None:
                    bundle = Bundle(frame_bytes, level)
                    info = f"software: {__name__}\r\nformat: WARC File Format 1.1\r\n".encode()
                    bundle.add(None, _record("warcinfo", [("WARC-Record-ID", _uri("info")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info))
                    bundle.close_frame()
                key = id_.as_py()
                digest32 = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                bundle.add(key, page_record(key, url.as_py(), payload.as_py(), digest32, first.as_py(), date))
                if bundle.body.tell() >= bundle_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bundle.finish()], pa.binary())], ["bundle"])
                    bundle = None
        if bundle is not None:
            yield pa.RecordBatch.from_arrays([pa.array([bundle.finish()], pa.binary())], ["bundle"])

    return fill


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0,
          frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 25, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record per row below ``folder``: ``bundles`` and the record index ``index`` (``INDEX_COLUMNS``, parquet).

    Of rows with equal payloads (SHA-1 and length) of ``least_bytes`` or more, the one with the smallest id is a response
    and the others revisit it; smaller payloads are all responses. A frame closes before it exceeds ``frame_bytes`` (a
    longer record is a frame of its own), a bundle when it has ``bundle_bytes``, so a task holds one bundle at most.
    Payloads are shuffled only where the table of repeated payloads is too large for Spark to broadcast; then a hot payload
    is dealt over seats (``copies.first_of_copies``).

    Null text: empty payload. Null url: no target header. Null ids: record without id, revisits the smallest id there is.
    Rows that share the smallest id: all responses. Empty table: empty folders. Further columns are not looked at.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), _payload(f"`{html_col}`").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    rows = rows.withColumn("seat", F.pmod(F.xxhash64("id", "url"), F.lit(seats(pages))))
    first = first_of_copies(rows.where(F.col("size") >= least_bytes), ["digest", "size"], "seat", F.col("id"))
    told = rows.join(first, ["digest", "size", "seat"], "left")
    revisits = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    told = told.select(F.col("id").cast("string"), "url", "payload", "digest", F.when(revisits, F.col("first")).cast("string").alias("first"))
    bundles = told.mapInArrow(_fill(frame_bytes, bundle_bytes, level, date), "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    # The line end in this encoding is exactly these four bytes.
    bundles.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", LAST.decode("latin-1")).text(f"{folder}/bundles")
    _entries(spark, folder).write.parquet(f"{folder}/index")


def _bundles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1).alias("bundle")
    return spark.read.format("binaryFile").load(paths).where("length > 0").select(name, "content")


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    def entries(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                opened = Opened(content.as_py())
                frames = opened.index.column("frame").to_pylist()
                columns = [opened.index.column("record_id").combine_chunks(), pa.array([name.as_py()] * len(frames), pa.string()), pa.array(frames, pa.int64()),
                           pa.array([opened.starts[f] for f in frames], pa.int64()), pa.array([opened.sizes[f][0] for f in frames], pa.int64()),
                           opened.index.column("offset").combine_chunks(), opened.index.column("length").combine_chunks()]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX_COLUMNS.split(", ")])

    return _bundles(spark, f"{folder}/bundles").mapInArrow(entries, INDEX_COLUMNS)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """Where every record is: its bundle, the start and length of its frame there, its place in the decompressed frame."""
    return spark.read.schema(INDEX_COLUMNS).parquet(f"{folder}/index")


def _records(bundles: DataFrame, payload: bool, ids: set[str] | None) -> DataFrame:
    schema = RECORD_COLUMNS + (", payload binary" if payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string() for c in names]

    def records(batches):
        for batch in batches:
            for content in batch.column(1):
                done, held = [], 0
                for raw in Opened(content.as_py()).records(ids):
                    record = parse_record(raw)
                    if record["record_type"] == "warcinfo":
                        continue
                    done.append(record)
                    held += len(raw) if payload else 200
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], t) for c, t in zip(names, types)], names)
                        done, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], t) for c, t in zip(names, types)], names)

    return bundles.mapInArrow(records, schema)


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """All records of the bundles (``RECORD_COLUMNS``, and the payload of responses); frames and payloads are verified."""
    return _records(_bundles(spark, f"{folder}/bundles"), payload, None)


def fetch(spark: SparkSession, folder: str, ids: list[str]) -> DataFrame:
    """Records of the given ids: only their bundles are opened and only their frames decompressed. For lists that fit the
    driver; ids that are not there give no row."""
    wanted = {str(i) for i in ids}
    names = [r.bundle for r in index(spark, folder).where(F.col("record_id").isin(sorted(wanted))).select("bundle").distinct().collect()]
    if not names:
        return spark.createDataFrame([], RECORD_COLUMNS + ", payload binary")
    return _records(_bundles(spark, [f"{folder}/bundles/{n}" for n in sorted(names)]), True, wanted)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM d),
r AS (SELECT *, first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM r
"""
