"""WARC bundles: exact round trip, random access, revisits and recovery."""

import base64
import hashlib

import pytest

from lodestar.llm import common, warc


def pages(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}?q=a b\r\nX", f"<p>page {i % 7}</p>" * (i % 7 + 1)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "ü€𝄞" * 50_000), (None, "u", "alone"), (None, "u", rows[0][2]), (59, "u", rows[59][2])]
    rows += [(103, "u", "x\r\n\r\nWARC/1.1\r\n\r\n")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")


def expected(rows):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max([x for x in (i, top.get(h or "")) if x is not None], default=None)
    out = []
    for i, _, h in rows:
        data, first = (h or "").encode(), top[h or ""]
        kind = "revisit" if first is not None and first != i else "response"
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, first if kind == "revisit" else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows, df = pages(spark)
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == expected(rows)


def test_random_access_and_payloads(spark, tmp_path):
    rows, df = pages(spark)
    index = warc.write_archives(df, str(tmp_path / "out"))
    texts = {i: (h or "").encode() for i, _, h in rows if i is not None}
    for r in index.where("record_id in (3, 102, 103)").collect():
        record_id, size, _, kind, refers, payload = warc.read_record(r.bundle, r.frame, r.offset)
        assert record_id == r.record_id and size == len(texts[record_id])
        assert payload == (texts[record_id] if kind == "response" else None)
        assert refers is None or texts[refers] == texts[record_id]
    got = {r.record_id: bytes(r.payload) for r in warc.read_archives(index, payloads=True).collect() if r.payload is not None and r.record_id is not None}
    assert all(texts[k] == v for k, v in got.items())
    (tmp_path / "out" / "stray.warc.zst").write_bytes(b"of a lost attempt")
    assert warc.sweep(index, str(tmp_path / "out")) == 1
    damaged = next(p for p in (tmp_path / "out").iterdir())
    damaged.write_bytes(damaged.read_bytes()[:-1] + b"?")
    with pytest.raises(ValueError, match="seek table"):
        warc.BundleReader(f"file://{damaged}")


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).collect() == []
