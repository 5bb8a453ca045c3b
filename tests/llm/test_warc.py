"""Archives: lines of both versions by hand, whole round trips, and revisits against brute force."""

import base64
import hashlib
import io
import random

import pytest

from findery.llm import warc

SCHEMA = "page_id long, url string, html string, name string, key int, id string"


def arc(version, records, name="x.arc"):
    out = warc.arc_description(version, name, "19990102030405")
    for url, ip, date, kind, block in records:
        out += warc.arc_line(version, url, ip, date, kind, len(block), name, "200") + block + b"\n"
    return out


RECORDS = [
    ("http://a.example/with space", "10.0.0.1", "20010203040506", "text/html; charset=utf-8", b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\n<p>\n\nWARC/1.0\r\n\r\n"),
    ("dns:a.example", "10.0.0.2", "200102030405", "text/dns", b"20010203\na.example. 60 IN A 10.0.0.1\n"),
    ("http://b.example/", "-", "-", "no-type", b""),
    ("http://c.example/", "::1", "20010203040507", "text/html", b"HTTP/1.0 200 OK\nA: b\n\nold line ends"),
]


@pytest.mark.parametrize("version", [1, 2])
def test_lines_and_lengths(version):
    got = list(warc.read_arc(io.BytesIO(arc(version, RECORDS))))
    assert got[0].url == "filedesc://x.arc" and [r.position for r in got] == [0, 1, 2, 3, 4]
    assert [(r.url, r.ip, r.date, r.type, r.block) for r in got[1:]] == RECORDS
    made = b"".join(warc.converted("x.arc", r, "19990102030405") for r in got)
    back = list(warc.read_warc(io.BytesIO(made)))
    assert [h["warc-type"] for h, _ in back] == ["warcinfo", "response", "resource", "resource", "response"]
    assert [h["warc-date"] for h, _ in back] == [f"{d}Z" for d in ("1999-01-02T03:04:05", "2001-02-03T04:05:06", "2001-02-03T04:05:00", "1999-01-02T03:04:05", "2001-02-03T04:05:07")]
    assert [b for _, b in back[1:]] == [r[4] for r in RECORDS]
    assert [h["x-payload-length"] for h, _ in back[1:]] == [str(len(warc.http_split(r[4])[1])) for r in RECORDS]
    assert back[1][0]["warc-target-uri"] == "http://a.example/with space" and back[1][0]["warc-ip-address"] == "10.0.0.1" and "warc-ip-address" not in back[3][0]
    assert back[4][0]["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"old line ends").digest()).decode()
    assert len({h["warc-record-id"] for h, _ in back}) == 5 and made == b"".join(warc.converted("x.arc", r, "19990102030405") for r in got)


def test_without_description_and_broken():
    line = warc.arc_line(1, "http://a/", "1.2.3.4", "20000101000000", "text/html", 3, "n")
    assert [r.block for r in warc.read_arc(io.BytesIO(b"\n\n" + line + b"abc\n\n\n" + line + b"def"))] == [b"abc", b"def"]
    with pytest.raises(ValueError, match="declares"):
        list(warc.read_arc(io.BytesIO(line + b"ab")))
    with pytest.raises(ValueError, match="no ARC"):
        list(warc.read_arc(io.BytesIO(b"what is this\n")))
    with pytest.raises(ValueError, match="declares"):
        list(warc.read_warc(io.BytesIO(warc.warc_record([("WARC-Type", "resource")], b"abc")[:-6])))
    with pytest.raises(ValueError, match="no WARC"):
        list(warc.read_warc(io.BytesIO(b"HTTP/1.1 200 OK\r\n")))


def brute(rows, min_bytes=0):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, other in rows if (other or "") == (html or "") and j is not None]
        first = min(same) if same and len(body) >= min_bytes else i
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    rng = random.Random(2)
    texts = [None, "", "a", "é\r\n\r\nb", "WARC/1.0\r\nWARC-Type: response\r\n\r\n", "x" * 3_000_000] + [f"page {i}" for i in range(20)]
    rows = [(i, rng.choice(["http://a/é b", None, "ftp://x\n", ""]), rng.choice(texts)) for i in rng.sample(range(-50, 500), 120)]
    rows += [(rows[0][0], rows[0][1], rows[0][2])] * 2 + [(None, "http://n/", "a"), (None, None, "only here")]
    df = spark.createDataFrame([(*r, "n", 1, "z") for r in rows], SCHEMA).repartition(5)
    for least in (0, 2):
        got = warc.archive(df, min_bytes=least, with_payload=True).collect()
        assert sorted(((r.key, r.payload_bytes, r.payload_digest, r.type, r.refers_to_key) for r in got), key=str) == brute(rows, least)
        responses = {r.id: r for r in got if r.type == "response"}
        for r in got:
            assert r.type == "response" or (r.payload is None and responses[r.refers_to_id].key == r.refers_to_key and responses[r.refers_to_id].payload_digest == r.payload_digest)
        want = {(i, (h or "").encode()) for i, _, h in rows}
        assert {(r.key, bytes(r.payload)) for r in responses.values()} <= want


def test_without_keys(spark):
    rows = [(None, "http://a/", "same")] * 3 + [(None, "http://b/", "")]
    got = warc.archive(spark.createDataFrame([(*r, "n", 1, "z") for r in rows], SCHEMA)).collect()
    assert sorted((r.payload_bytes, r.type, r.refers_to_id is None) for r in got) == [(0, "response", True), (4, "response", True), (4, "revisit", False), (4, "revisit", False)]
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0
