"""ARC archives to WARC: parsing by version, synthesised records, revisits, round trips."""

import hashlib
import zlib

import pytest

from livetick.llm import arc

BODY = b"HTTP/1.0 200 Document follows\nServer: old\n\n<p>one</p>"
OLD = {
    1: b"filedesc://IA-1.arc 0.0.0.0 19960923142103 text/plain %d\n" + b"%s"
       + b"\nhttp://a.example/b c.html 127.0.0.1 19961104142103 text/html; charset=x %d\n" % len(BODY) + BODY
       + b"\n\ndns:a.example 10.0.0.1 19961104 text/dns 9\n1996 1.2.\n",
    2: b"filedesc://IA-2.arc 0.0.0.0 19960923 text/plain 200 - - 0 IA-2.arc %d\n" + b"%s"
       + b"\nhttp://a.example/ 127.0.0.1 199611041421 text/html 200 fac069150613fe55599cc7fa88aa089d - 209 IA-2.arc %d\n" % len(BODY) + BODY + b"\n",
}


def archive(version):
    block = f"{version} 0 Alexa Internet\n{arc.FIELDS[version]}\n".encode()
    return OLD[version] % (len(block), block)


def test_headers_of_both_versions():
    first, second = arc.parse_arc(archive(1), "x")
    assert (first.name, first.url, first.date, first.type) == ("IA-1.arc", "http://a.example/b c.html", "19961104142103", "text/html; charset=x")
    assert first.split() == (b"HTTP/1.0 200 Document follows\nServer: old\n\n", b"<p>one</p>") and first.http
    assert (second.url, second.block, second.http, second.split()) == ("dns:a.example", b"1996 1.2.", False, (b"", b"1996 1.2."))
    (only,) = arc.parse_arc(archive(2), "x")
    assert (only.url, only.date, only.type, only.block) == ("http://a.example/", "199611041421", "text/html", BODY)
    assert only.record_id != first.record_id == next(arc.parse_arc(archive(1), "x")).record_id != next(arc.parse_arc(archive(1), "y")).record_id
    assert [arc.iso_time(d) for d in ("19961104142103", "19961104", "19961104142103999")] == [
        "1996-11-04T14:21:03Z", "1996-11-04T00:00:00Z", "1996-11-04T14:21:03Z"]


def test_gzip_members_and_damage():
    data = archive(1)

    def packed(part):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(part) + z.flush()

    whole = [r.block for r in arc.parse_arc(data, "x")]
    cut = data.index(b"dns:")
    assert [r.block for r in arc.parse_arc(packed(data[:cut]) + packed(data[cut:]), "x")] == whole
    assert list(arc.parse_arc(b"", "x")) == []
    for broken in (data[:-4], b"not an archive 5\n", data.replace(b"text/dns 9", b"text/dns nine"), data.replace(b"1 0 Alexa", b"3 0 Alexa", 1)):
        with pytest.raises(ValueError):
            list(arc.parse_arc(broken, "x"))


def test_warc_records():
    record = next(arc.parse_arc(archive(1), "x"))
    data = b"\r\n\r\n".join([arc.warc_info("IA-1.arc"), arc.warc_record(record, None), arc.warc_record(record, "<urn:uuid:1>")]) + b"\r\n\r\n"
    (info, _), (response, block), (revisit, short) = arc.parse_warc(data)
    digest = "sha256:" + hashlib.sha256(b"<p>one</p>").hexdigest()
    assert info["warc-type"] == "warcinfo" and info["warc-filename"] == "IA-1.warc"
    assert (response["warc-type"], response["warc-date"], response["warc-target-uri"], block) == ("response", "1996-11-04T14:21:03Z", "http://a.example/b c.html", BODY)
    assert (revisit["warc-type"], revisit["warc-refers-to"], revisit["warc-profile"], short) == ("revisit", "<urn:uuid:1>", arc.PROFILE, record.split()[0])
    assert response["warc-payload-digest"] == revisit["warc-payload-digest"] == digest
    assert response["content-type"] == "application/http; msgtype=response" and response["x-payload-length"] == "10"
    dns = list(arc.parse_arc(archive(1), "x"))[1]
    assert b"WARC-Type: resource\r\n" in arc.warc_record(dns, None) and b"Content-Type: text/dns\r\n" in arc.warc_record(dns, None)


LONG = "<p>" + "é" * 60 + "</p>"
PAGES = [
    (7, "http://a/1", LONG), (3, "http://a/2 x\n", LONG), (3, "http://a/2", LONG), (None, None, LONG), (9, "http://a/3", "z" * 99),
    (8, "http://a/3", "z" * 99), (1, "http://a/4", None), (2, "", ""), (5, "http://a/5", "HTTP/1.1 200 OK\r\n\r\n" * 9), (4, "u", "\r\n\r\n" * 30),
    (6, "u", "WARC/1.1\r\n\r\n" + "x" * 500_000), (11, "u", "x" * 101), (10, "u", "x" * 101), (None, "u", "only without id" * 9), (None, "u", "only without id" * 9),
]


@pytest.mark.parametrize("archive_bytes", [1, 4000, 1 << 24])
def test_round_trip(spark, tmp_path, archive_bytes):
    pages = spark.createDataFrame([(*p, "x", 1, b"y") for p in PAGES], "page_id int, url string, html string, path string, at int, digest binary").repartition(3)
    for k, rows in enumerate((pages, pages.limit(0))):
        arc.write_arc(rows, f"file://{tmp_path}/arc{k}", archive_bytes)
        arc.convert(spark, f"file://{tmp_path}/arc{k}", f"file://{tmp_path}/warc{k}")
    assert arc.read_warc(spark, f"file://{tmp_path}/warc1").count() == 0
    names = {r.url for f in (tmp_path / "arc0").glob("*.gz") for r in arc.parse_arc(f.read_bytes(), "")}
    assert {"http://a/2%20x%0A", "-"} <= names
    got = [tuple(r) for r in arc.resolved(arc.read_warc(spark, f"file://{tmp_path}/warc0")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    want, seen = [], {}
    for page_id, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
        payload = (html or "").encode()
        again = len(payload) >= 100 and payload in seen
        want.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", seen[payload] if again else None))
        seen.setdefault(payload, page_id)
    assert sorted(got, key=repr) == sorted(want, key=repr)
