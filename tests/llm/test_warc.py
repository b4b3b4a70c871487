import hashlib

import pytest

from oscilla.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def want(rows):
    payload = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, x in payload:
        if len(x) >= 100 and p is not None:
            first[x] = min(p, first.get(x, p))
    out = []
    for p, x in payload:
        head = first.get(x)
        revisit = head is not None and head != p
        out.append((p, len(x), hashlib.sha256(x).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    big, small = "é" * 60, "x" * 99
    rows = [(5, "http://a/ b", big), (3, "http://a", big), (9, None, big), (1, "u", small), (2, "u", small), (4, "u", None), (6, "u", ""), (None, "u", big), (-7, "u", "\r\n\r\nWARC/1.0\r\n" * 20), (3, "http://a", big), (8, "u", "y" * 100), (2**62, "u", "z" * 5_000_000)]
    got = warc.read_archives(warc.archive(pages(spark, rows)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want(rows)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert warc.read_archives(warc.archive(pages(spark, rows).filter("false"))).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_legacy_records(version):
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<html>\n\n1 2 3 text/html 5\n"
    data = warc.arc_head("x.arc", version) + warc.arc_record(version, "x.arc", 7, "http://h/ü x", "20010203040506", "text/html", body) + warc.arc_record(version, "x.arc", 9, "dns:h", "200102030405", "text/dns", b"h. A 1.2.3.4")
    one, two = warc.converted(data)
    assert one[2] == "http://h/%C3%BC%20x" and one[4] == "2001-02-03T04:05:06Z" and one[6] + one[7] == body and one[10] is True
    assert two[4] == "2001-02-03T04:05:00Z" and two[6] == b"" and two[7] == b"h. A 1.2.3.4" and two[5] == "text/dns"
    cut = list(warc.converted(data[:-6]))
    assert [x[10] for x in cut] == [True, False]
    assert [x[11] for x in warc.converted(b"junk")] == ["4 bytes without a header line"] and warc.warc_date("") == "1970-01-01T00:00:00Z"


def test_identifiers_hold_the_number():
    for n in (None, 0, 1, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(n, "u", "d")) == n


def test_clashing_columns_make_no_difference(spark):
    rows = [(1, "http://a", "x" * 150), (2, "http://b", "x" * 150), (3, "http://c", None)]
    clash = ["payload_digest", "record_type", "refers_to", "payload_bytes", "id", "part", "data", "offset", "number", "first", "a.b", "name", "digest"]
    df = pages(spark, rows).selectExpr("*", *(f"7 AS `{c}`" for c in clash))
    assert sorted((tuple(r) for r in warc.read_archives(warc.archive(df)).collect()), key=repr) == want(rows)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("zipped", [False, True])
def test_damaged_archives(spark, version, zipped):
    """Junk between records, a header line without a length, a cut record; gzip members, one of them damaged."""
    import gzip

    record = lambda n: warc.arc_record(version, "x.arc", 7, f"http://h/{n}", "20010203040506", "text/html", f"HTTP/1.1 200 OK\r\n\r\nbody {n}".encode())
    parts = [warc.arc_head("x.arc", version), record(1), b"lost bytes\nhttp://h/ 1.1.1.1 2001 text/html none\n", record(2), record(3), record(4)[:-8]]
    if zipped:
        members = [gzip.compress(p, mtime=0) for p in parts]
        members[4] = members[4][:12] + b"\x00" * 4 + members[4][16:]
        data, left = b"".join(members), [1, 2]
    else:
        data, left = b"".join(parts), [1, 2, 3]
    rows = list(warc.converted(data))
    good = [r for r in rows if r[11] is None]
    assert [r[2] for r in good if r[10]] == [f"http://h/{n}" for n in left]
    assert [r[2] for r in good if not r[10]] == ["http://h/4"]
    assert any("without a header line" in r[11] for r in rows if r[11])
    archives = spark.createDataFrame([("x", bytearray(data))], "name string, data binary")
    assert warc.convert_arc(archives).filter("error is not null").count() >= 1
    texts = [bytes(r.data) for r in warc.archived(archives).collect()]
    headers = [h for t in texts for h, _ in warc.read_warc(t) if h["WARC-Type"] != "warcinfo"]
    assert {h["WARC-Target-URI"]: h.get("WARC-Truncated") for h in headers} == {**{f"http://h/{n}": None for n in left}, "http://h/4": "length"}


def test_long_junk_is_stepped_over_in_linear_time():
    import time

    began = time.monotonic()
    rows = list(warc.converted(warc.arc_head("x.arc", 1) + b"http://h/ x 1\n" * 200_000 + b"a" * 1_000_000))
    assert time.monotonic() - began < 10 and len(rows) == 1 and rows[0][11]
