"""Top-k against brute force, archives as round trips."""

import random
import struct

import pytest
import zstandard

from runloom.llm import topk, warc

VECTORS = "vec_id long, embedding array<float>, rank string, score string, v string"


def brute(rows, every, k):
    import math

    sound = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in sound:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in sound if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("dims", [1, 3, 64])
def test_top_k(llm, monkeypatch, dims):
    draw = random.Random(dims)
    near = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    rows = [(i, [near(draw.gauss(0, 1)) for _ in range(dims)]) for i in range(300)]
    rows += [(1000 + i, list(rows[7][1])) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [None] * dims), (2002, [float("nan")] * dims), (2003, [float("inf")] * dims), (None, [1.0] * dims), (2050, [0.0] * dims), (2004, []), rows[5]]
    df = llm.createDataFrame([(*r, "x", "x", "x") for r in rows], VECTORS)
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    got = sorted(tuple(r) for r in topk.top_k(df, every=50, k=5).collect())
    assert got == brute(rows, 50, 5)


def test_top_k_of_few(llm):
    df = llm.createDataFrame([(0, [1.0], "", "", ""), (50, [2.0], "", "", "")], VECTORS)
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


PAGES = "page_id long, url string, html string, payload string, sha1 string, n string"


def test_round_trip(llm):
    rows = [(i, f"http://x/{i}", f"page {i % 5} é" if i % 2 else "same") for i in range(40)]
    rows += [(100, None, None), (101, "a\r\nb", ""), (102, "u", "<p>" * 50_000), (None, "n", "only"), (None, "n", "same"), (39, "http://x/39", "page 4 é")]
    archives = warc.write(llm.createDataFrame([(*r, "", "", "") for r in rows], PAGES), archive_bytes=4000)
    got = warc.read(archives, payloads=True).collect()
    texts = {i: (h or "") for i, _, h in rows if i is not None}
    newest = {t: max(i for i in texts if texts[i] == t) for t in texts.values()}
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            assert (r.record_type, r.refers_to) in (("response", None), ("revisit", newest["same"]))
            continue
        payload = texts[r.page_id].encode()
        want = newest[texts[r.page_id]]
        assert r.payload_bytes == len(payload) and r.payload_digest == warc.sha1_base32(payload)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == want else ("revisit", want))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    assert warc.read(warc.write(llm.createDataFrame([], PAGES))).count() == 0


def test_only_large_payloads_are_shared(llm):
    df = llm.createDataFrame([(1, "", "ab", "", "", ""), (2, "", "ab", "", "", ""), (3, "", "abcdef", "", "", ""), (4, "", "abcdef", "", "", "")], PAGES)
    got = {r.page_id: r.refers_to for r in warc.read(warc.write(df, min_bytes=4)).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_archives_are_files_too(llm, tmp_path):
    df = llm.createDataFrame([(i, "u", f"text {i}", "", "", "") for i in range(20)], PAGES)
    for r in warc.write(df).collect():
        (tmp_path / r.archive).write_bytes(r.content)
    got = warc.read(llm.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted(r.page_id for r in got) == list(range(20))
    data = next(tmp_path.glob("*.zst")).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    words = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert magic == 0x184D2A5D and len(words) > 0


def test_broken_archives_are_refused():
    records = [warc.record(i, "u", f"payload {i}".encode(), None, "2020-01-01T00:00:00Z") for i in range(5)]
    good = warc.pack(records)
    assert [warc.parse(x)["page_id"] for x in warc.unpack(good)] == list(range(5))
    for bad in (good[:-3], good[1:], b"", b"\x50\x2a\x4d\x18\xff\xff\xff\xff"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            [warc.parse(x) for x in warc.unpack(bad)]
    for bad in (
        records[0].replace(b"WARC/1.1", b"WARC/9"),
        records[0].replace(b"payload 0", b"payload 1"),
        records[0].replace(b"WARC-Date", b"X-Date"),
        records[0] + b"x",
        records[0][:-5],
    ):
        with pytest.raises(ValueError):
            warc.parse(bad)
