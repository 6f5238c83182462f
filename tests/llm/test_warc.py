import base64
import gzip
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import warc
from tests.llm.conftest import rows

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2\r\nX: y", "<p>x</p>"), (3, None, "é\r\n\r\nWARC/1.1\r\n"), (4, "http://b", None), (5, "http://b", ""), (None, "u", "<p>x</p>"), (6, "v", "z" * 300_000), (2, "again", "<p>x</p>"), (None, "w", "only")]


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'k' as keeper", "'s' as sha1", "1 as id")
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "") or -1, i or -1)
    want = []
    for i, _, h in PAGES:
        b, keep = (h or "").encode(), best[h or ""]
        first = i == keep or keep == -1
        want.append((i, len(b), sha(b), "response" if first else "revisit", None if first else keep))
    got = rows(warc.archive_round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(want, key=lambda t: tuple((x is None, x) for x in t))
    assert warc.archive_round_trip(df.limit(0)).collect() == []


def archive(n, plain=False):
    parts = [warc.record(i, f"http://x/{i}", (f"<p>{i}</p>" * (i + 1)).encode()) for i in range(n)]
    return parts if plain else [warc.member(p) for p in parts]


def kinds(data):
    return [("gap", x.first, x.end) if isinstance(x, warc.Gap) else x.headers["warc-record-id"] for x in warc.salvage(data)]


def name(i):
    return f"<urn:page:{i}>"


@pytest.mark.parametrize("plain", [False, True])
def test_records_after_damage_are_recovered(plain):
    parts = archive(5, plain)
    assert kinds(b"".join(parts)) == [name(i) for i in range(5)]
    start = len(parts[0])
    broken = bytearray(b"".join(parts))
    broken[start + len(parts[1]) // 2] ^= 0x55
    assert kinds(bytes(broken)) == [name(0), ("gap", start, start + len(parts[1])), name(2), name(3), name(4)]
    cut = b"".join(parts)[: -len(parts[4]) // 2 or None]
    assert kinds(cut)[:4] == [name(i) for i in range(4)] and kinds(cut)[4][0] == "gap"
    junk = b"junk\x1f\x8b\x08junk"
    assert kinds(junk + b"".join(parts)) == [("gap", 0, len(junk)), *[name(i) for i in range(5)]]
    assert kinds(b"") == [] and kinds(b"nothing here")[0][0] == "gap"


def test_each_failed_check_has_a_reason():
    r = warc.record(1, "u", b"payload")
    reasons = [next(warc.salvage(x)).reason for x in (r.replace(b"payload", b"paYload"), r.replace(b"WARC/1.1", b"WARC/9.9"), r[:-2], r.replace(b"Content-Length: ", b"Content-Width: "), gzip.compress(r)[:-5])]
    assert reasons == ["payload digest differs", "no version line", "no end of record", "no content length", "member is cut off"]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 10**6), st.integers(0, 255))
def test_payloads_survive_and_no_damage_raises(payload, at, to):
    good = warc.member(warc.record(7, "u", payload)) + warc.member(warc.record(8, "u", b"tail"))
    assert [x.payload for x in warc.salvage(good)] == [payload, b"tail"]
    bad = bytearray(good)
    bad[at % len(bad)] = to
    ends = list(dict.fromkeys((x.first, x.end) for x in warc.salvage(bytes(bad))))
    assert ends[0][0] == 0 and ends[-1][1] == len(bad) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_one_bad_record_of_a_member_costs_no_other():
    parts = archive(5, plain=True)
    start, end = len(parts[0]), len(parts[0]) + len(parts[1])
    one = warc.member(b"".join([parts[0], parts[1].replace(b"<p>1</p>", b"<p>x</p>", 1), *parts[2:]]))
    got = list(warc.salvage(one + warc.member(warc.record(9, "u", b"after"))))
    assert [x.reason if isinstance(x, warc.Gap) else x.headers["warc-record-id"] for x in got] == [name(0), "payload digest differs", name(2), name(3), name(4), name(9)]
    assert got[1].inner == (start, end) and {(x.first, x.end) for x in got[:5]} == {(0, len(one))}


def test_a_damaged_member_is_read_up_to_the_damage():
    r = random.Random(3)
    parts = [warc.record(i, "u", r.randbytes(3000)) for i in range(5)]
    one = bytearray(warc.member(b"".join(parts)))
    after = warc.member(warc.record(9, "u", b"after"))
    cut = list(warc.salvage(bytes(one[: 10_000])))
    assert [x.headers["warc-record-id"] for x in cut[:-1]] == [name(i) for i in range(len(cut) - 1)] and len(cut) > 3
    assert cut[-1].reason == "member is cut off" and cut[-1].inner[0] == sum(map(len, parts[: len(cut) - 1]))
    one[10_000] ^= 0xFF
    got = list(warc.salvage(b"junk" + bytes(one) + after))
    names = ["gap" if isinstance(x, warc.Gap) else x.headers["warc-record-id"] for x in got]
    assert names[:4] == ["gap", name(0), name(1), name(2)] and names[-2:] == ["gap", name(9)]
    assert (got[0].first, got[0].end) == (0, 4) and {(x.first, x.end) for x in got[1:-1]} == {(4, 4 + len(one))}


def test_gaps_are_logged_by_the_reader(spark):
    parts = archive(3)
    data = parts[0] + b"\x1f\x8b\x08" + parts[1][5:] + parts[2]
    out = warc.read_archives(spark.createDataFrame([("a", data), ("b", None), ("c", b"")], "name string, content binary")).collect()
    assert [(r["gap"] is None, r["record_id"]) for r in out] == [(True, "urn:page:0"), (False, None), (True, "urn:page:2")]


def test_a_long_url_and_a_record_that_cannot_be_read(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://a/" + " " * 30_000, "x")], "page_id long, url string, html string")
    assert rows(warc.archive_round_trip(df), "page_id", "payload_bytes") == [(1, 1)]
    monkeypatch.setattr(warc, "read_archives", lambda a: a.selectExpr("name archive", "'bad' gap", "'' record_id", "1 payload_bytes", "'' payload_digest", "'' record_type", "'' refers_to"))
    with pytest.raises(Exception, match="bad"):
        warc.archive_round_trip(df).collect()
