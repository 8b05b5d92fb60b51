"""WARC bundles: round trip, revisits, the public formats, selective reads."""

import base64
import hashlib
import io
import random
import struct

import zstandard

from skeinwork.llm import op11_warc as op
from skeinwork.llm import queries
from skeinwork.llm.common import work_dir

MIDDLE = "/root/testdata/sf0.01"


def told(rows, least):
    """(id, html) -> expected (id, bytes, digest, type, refers_to)."""
    first, out = {}, []
    for id_, html in rows:
        body = (html or "").encode()
        if id_ is not None and len(body) >= least:
            first[body] = min(id_, first.get(body, id_))
    for id_, html in rows:
        body = (html or "").encode()
        ref = first.get(body)
        again = ref is not None and ref != id_ and len(body) >= least
        out.append((str(id_) if id_ is not None else None, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", str(ref) if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").select("page_id", "html").collect()]
    found = queries.QUERIES["op11_seekable_bundles"](spark, MIDDLE)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    have = sorted(((str(r[0]), *r[1:4], str(r[4]) if r[4] is not None else None) for r in found.collect()), key=str)
    assert have == told(rows, 0)


def odd_rows():
    rng = random.Random(2)
    rows = [(k, f"http://h/{k}", "hot page") for k in range(300)] + [(k, f"http://h/{k}", f"<p>é {k}</p>" * rng.randrange(1, 400)) for k in range(300, 400)]
    rows += [(500, None, None), (501, "http://x/a b\r\nX: y", ""), (502, "é", "\r\n\r\nWARC/1.1\r\n"), (503, "u", "x" * 300_000), (400, "u", "twice"), (400, "u", "twice"), (401, "u", "twice")]
    return rows + [(None, "u", "hot page"), (None, None, "no other")]


def test_round_trip(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first long").repartition(3)
    for least in (0, 9):
        folder = work_dir(spark, "warc")
        op.write(df, folder, least_bytes=least, frame_bytes=20_000, bundle_bytes=2_000)
        records = op.read(spark, folder)
        assert got(records) == told([(r[0], r[2]) for r in rows], least)
        bodies = sorted((r.record_id or "", bytes(r.payload).decode()) for r in records.where("payload IS NOT NULL").collect())
        held = {x[0] for x in told([(r[0], r[2]) for r in rows], least) if x[3] == "response"}
        assert bodies == sorted((str(r[0]) if r[0] is not None else "", r[2] or "") for r in rows if (str(r[0]) if r[0] is not None else None) in held
                                and not (r[0] is None and r[2] == "hot page" and least < 9))
        assert records.where("url LIKE '%X:%'").first().url == "http://x/a%20b%0D%0AX:%20y"


def test_files_are_seekable_zstandard(spark):
    folder = work_dir(spark, "warc")
    df = spark.createDataFrame(odd_rows(), "page_id long, url string, html string").repartition(2)
    op.write(df, folder, frame_bytes=20_000, bundle_bytes=2_000)
    files = {r.bundle: bytes(r.content) for r in op._bundles(spark, f"{folder}/bundles").collect()}
    assert len(files) > 2
    for content in files.values():
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        count, flags, magic = struct.unpack("<IBI", content[-9:])
        assert (flags, magic) == (0x80, 0x8F92EAB1)
        sizes = list(struct.iter_unpack("<III", content[-9 - 12 * count : -9]))
        assert sum(s[1] for s in sizes) == len(plain) and sum(s[0] for s in sizes) + 8 + 12 * count + 9 == len(content)
        assert all(s[1] <= 20_000 or s[1] >= 300_000 for s in sizes)
    for r in op.index(spark, folder).where("record_id = '503'").collect():
        frame = files[r.bundle][r.frame_start : r.frame_start + r.frame_length]
        record = zstandard.ZstdDecompressor().decompress(frame)[r.offset : r.offset + r.length]
        assert op.parse_record(record)["payload"] == b"x" * 300_000


def test_fetch_opens_only_what_it_needs(spark, monkeypatch):
    folder = work_dir(spark, "warc")
    op.write(spark.createDataFrame(odd_rows(), "page_id long, url string, html string").repartition(4), folder, frame_bytes=20_000, bundle_bytes=2_000)
    asked = []
    plain = op._bundles
    monkeypatch.setattr(op, "_bundles", lambda s, paths: asked.append(paths) or plain(s, paths))
    found = {r.record_id: r for r in op.fetch(spark, folder, [0, 7, 399, 9999]).collect()}
    assert sorted(found) == ["0", "399", "7"] and bytes(found["0"].payload) == b"hot page" and found["7"].refers_to == "0"
    assert len(asked[0]) <= 3 < op.index(spark, folder).select("bundle").distinct().count()
    opened = op.Opened(plain(spark, asked[0][:1]).first().content)
    seen, frame = [], opened.frame
    monkeypatch.setattr(opened, "frame", lambda k: seen.append(k) or frame(k))
    held = set(opened.index.column("record_id").to_pylist()) & {"0", "7", "399"}
    assert len(list(opened.records(held))) == len(held) and len(seen) <= len(held)
    assert op.fetch(spark, folder, [9999]).count() == 0


def test_empty_table(spark):
    folder = work_dir(spark, "warc")
    op.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert op.read(spark, folder).count() == 0 and op.index(spark, folder).count() == 0


def test_a_changed_payload_is_found():
    raw = op.page_record("1", "u", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None, "2000-01-01T00:00:00Z")
    assert op.parse_record(raw)["payload"] == b"abc"
    try:
        op.parse_record(raw.replace(b"abc", b"abd"))
        raise AssertionError("not found")
    except ValueError:
        pass
