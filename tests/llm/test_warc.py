"""Archives there and back, and broken ones."""

import hashlib
import random
import struct
import time

import pytest
import zstandard as zstd

from lexispark.llm import warc

SCHEMA = "page_id long, url string, html string, payload_digest int, last string, n long"


def rows():
    big, hot = "é" * 700 + "<p>", "h" * 1000
    out = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (3, None, big), (5, "http://a/5", big), (7, "u\r\nx y", None), (8, "", ""), (9, "http://é", "short"), (10, "z", "short"), (None, "n", big), (None, "n", "alone" * 300), (11, "x", "x" * 999), (12, "x", "x" * 999)]
    out += [(100 + i, f"http://h/{i}", hot) for i in range(300)]
    return out + [(1000 + i, f"http://p/{i}", f"page {i} " * 400) for i in range(60)]


def want(data):
    groups = {}
    for p, _, h in data:
        groups.setdefault(h or "", []).append(p)
    out = []
    for p, _, h in data:
        raw = (h or "").encode()
        ids = [x for x in groups[h or ""] if x is not None]
        last = max(ids, default=None)
        again = len(raw) >= 1000 and last is not None and p != last
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None, None))
    return sorted(out, key=str)


def test_round_trip(spark):
    data = rows()
    pages = spark.createDataFrame([(*r, 1, "l", 2) for r in data], SCHEMA).repartition(6)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == want(data)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_files_hold_dictionary_and_a_frame_per_record(spark, tmp_path):
    data = rows()
    pages = spark.createDataFrame([(*r, 1, "l", 2) for r in data], SCHEMA).coalesce(1)
    done = warc.write(pages, f"file://{tmp_path}", archive_bytes=300_000).collect()
    files = sorted(tmp_path.glob("*.warc.zst"))
    assert len(files) == len(done) > 1 and sum(r["records"] for r in done) == len(data)
    held = [f.read_bytes() for f in files]
    assert any(struct.unpack("<I", h[:4])[0] == warc.SKIPPABLE for h in held)
    assert [len(list(warc.frames(h))) for h in held] == [r["records"] for r in sorted(done, key=lambda r: r["path"])]
    got = warc.read(spark, f"file://{tmp_path}")
    payloads = {r["page_id"]: bytes(r["payload"]) for r in got.where("record_type = 'response'").collect()}
    assert payloads[5].decode() == "é" * 700 + "<p>" and payloads[7] == b""
    assert {r["page_id"]: r["url"] for r in got.collect()}[7] == "u%0D%0Ax%20y"


def test_compressed_dictionary_and_unknown_sizes():
    records = [warc.record(i, "u", f"body {i} ".encode() * 900, hashlib.sha1(f"body {i} ".encode() * 900).hexdigest(), None) for i in range(40)]
    data = warc.archive(records)
    n = struct.unpack("<I", data[4:8])[0]
    packed = zstd.ZstdCompressor().compress(data[8 : 8 + n])
    other = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + data[8 + n :]
    assert [r.page_id for r in warc.records(other)] == list(range(40))
    plain = b"".join(zstd.ZstdCompressor(write_content_size=False).compress(r) for r in records)
    assert [r.error for r in warc.records(plain)] == [None] * 40


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9.1"), "no WARC version"),
        (lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), "no warc-date"),
        (lambda r: r.replace(b"body", b"bodx"), "the block digest is another"),
        (lambda r: r[:-4], "content-length doesn't fit the record"),
        (lambda r: r.replace(b"WARC-Block-Digest: sha1:", b"WARC-Other: ").replace(b"body", b"bodx"), "the payload digest is another"),
    ],
)
def test_records_are_validated(change, error):
    good = warc.record(1, "u", b"body", hashlib.sha1(b"body").hexdigest(), None)
    assert warc.parse(good).error is None
    assert warc.parse(change(good)).error == error


def test_cut_off_files_say_so():
    data = warc.archive([warc.record(1, "u", b"body", hashlib.sha1(b"body").hexdigest(), None)] * 3)
    got = list(warc.records(data[:-5]))
    assert [r.error for r in got[:2]] == [None, None] and "cut off" in got[2].error
    assert list(warc.records(b"junk"))[0].error


def cut_files():
    """A small file, one of a record of several blocks, one with a skippable frame and one with a dictionary."""
    small = warc.archive([warc.record(i, "u", b"x" * i, hashlib.sha1(b"x" * i).hexdigest(), None) for i in range(2)])
    noise = bytes(random.Random(1).randbytes(400_000))
    several = warc.archive([warc.record(1, "u", noise, hashlib.sha1(noise).hexdigest(), None)])
    skipped = struct.pack("<II", 0x184D2A50, 9) + b"123456789" + small
    trained = warc.archive([warc.record(i, "u", f"body {i} ".encode() * 900, hashlib.sha1(f"body {i} ".encode() * 900).hexdigest(), None) for i in range(40)])
    return {"small": (small, 1), "several": (several, 7919), "skipped": (skipped, 1), "trained": (trained, 97)}


@pytest.mark.parametrize("name", ["small", "several", "skipped", "trained"])
def test_every_cut_ends(name):
    """A file cut anywhere gives fewer records or an error, and soon."""
    data, step = cut_files()[name]
    whole = list(warc.records(data))
    assert not any(r.error for r in whole)
    bounds = {0, *(b for _, b in warc.frames(data))} | ({17} if name == "skipped" else {8 + struct.unpack("<I", data[4:8])[0]} if name == "trained" else set())
    began = time.time()
    for at in {*range(0, len(data), step), *range(min(len(data), 40)), len(data) - 1}:
        got = list(warc.records(data[:at]))
        assert len(got) <= len(whole) and (got and got[-1].error) or at in bounds, at
        assert [r.page_id for r in got if not r.error] == [r.page_id for r in whole[: len(got) - bool(got and got[-1].error)]]
    assert time.time() - began < 60


def test_damaged_bytes_end():
    data = bytearray(cut_files()["trained"][0])
    rng = random.Random(3)
    began = time.time()
    for _ in range(300):
        bad = bytearray(data)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        assert len(list(warc.records(bytes(bad)))) <= 60
    assert time.time() - began < 60
