"""Round trips of archives, and packages that Python's zipfile wrote."""

import base64
import hashlib
import io
import zipfile

import pytest

from runassay.llm import warc

SCHEMA = "page_id long, url string, html string, first string, package string"


def plain(rows, least=0):
    out = []
    firsts = {}
    for i, _, html in rows:
        if i is not None:
            firsts[html or ""] = min(i, firsts.get(html or "", i))
    for i, _, html in rows:
        data = (html or "").encode()
        first = firsts.get(html or "")
        again = len(data) >= least and first is not None and first != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://example.org/{i}", f"<p>page {i % 7} é \r\n\r\n WARC/1.1</p>") for i in range(60)]
ROWS += [(100 + i, None, "<p>hot</p>") for i in range(300)] + [(400, "bad \r\n url", None), (401, "", ""), (None, "x", "<p>hot</p>")]
ROWS += [(402, "long", "<b>" + "x" * 300_000), (403, "u", "twice"), (403, "u", "twice"), (404, "u", "twice"), (None, "y", "only nobody")]


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, tmp_path, least):
    table = spark.createDataFrame([(*r, "c", "c") for r in ROWS], SCHEMA).repartition(3)
    listed = warc.write_packages(table, str(tmp_path / "a"), least, package_bytes=3000, package_records=40)
    assert listed.agg({"records": "sum"}).first()[0] == len(ROWS) and listed.count() > 3
    read = warc.read_packages(listed, payload=True, block=500).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read), key=str)
    assert got == plain(ROWS, least)
    texts = {i: (html or "").encode() for i, _, html in ROWS}
    for r in read:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or r["page_id"] is None or bytes(r["payload"]) == texts[r["page_id"]]
    assert len({(r["package"], r["file"], r["offset"]) for r in read}) == len(ROWS)
    assert warc.archived_pages(table.limit(0)).count() == 0


def package(force64=False, comment=b"", front=b"", stored=True, extra_members=0, count=25):
    out = io.BytesIO(front)
    out.seek(len(front))
    records, lines, at = [], [], 0
    for i in range(count):
        record = warc.record_of(i, f"http://h/{i}", b"x" * i, None)
        lines.append(f'{i} 2024 {{"filename": "données.warc", "offset": "{at}", "length": "{len(record)}"}}')
        records.append(record)
        at += len(record)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for k in range(extra_members):
            z.writestr(f"pages/{k}.txt", "x")
        for name, data in (("archive/données.warc", b"".join(records)), ("indexes/index.cdxj", "\n".join(lines).encode())):
            with z.open(zipfile.ZipInfo(name) if stored else name, "w", force_zip64=force64) as f:
                f.write(data)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("options", [{}, {"force64": True}, {"comment": b"a PK\x05\x06 comment" * 9}, {"front": b"MZ" * 500}, {"extra_members": 70_000}])
def test_foreign_packages(spark, tmp_path, options):
    path = tmp_path / "foreign.wacz"
    path.write_bytes(package(**options))
    table = spark.createDataFrame([(str(path),)], "package string")
    got = sorted((r["page_id"], r["payload_bytes"]) for r in warc.read_packages(table, block=100).collect())
    assert got == [(i, i) for i in range(25)]
    assert warc.read_packages(spark.createDataFrame([("file:" + str(path),)], "package string")).count() == 25


def test_zip64_sizes_of_the_directory(tmp_path, monkeypatch):
    """Offsets that only fit the 64-bit fields, as if the package were huge."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    data = package(force64=True)
    assert warc.END64_MARK in data and warc.LOCATOR_MARK in data
    found = list(warc.members(io.BytesIO(data), len(data), block=64))
    assert [m.name for m in found] == ["archive/données.warc", "indexes/index.cdxj"]
    start = warc.data_start(io.BytesIO(data), found[0])
    assert warc.parse_record(data[start : start + 400])["page_id"] == 0


def test_broken_packages(spark, tmp_path):
    for data, message in ((b"no zip", "no end record"), (package(stored=False), "compressed")):
        path = tmp_path / f"{message[:2]}.wacz"
        path.write_bytes(data)
        with pytest.raises(Exception, match=message):
            warc.read_packages(spark.createDataFrame([(str(path),)], "package string")).count()
    record = warc.record_of(1, None, b"payload", None)
    with pytest.raises(ValueError, match="another digest"):
        warc.parse_record(record.replace(b"payload\r\n", b"pAyload\r\n"))


def test_own_packages_open_elsewhere(spark, tmp_path):
    table = spark.createDataFrame([(*r, "c", "c") for r in ROWS], SCHEMA).coalesce(1)
    path = warc.write_packages(table, str(tmp_path / "b")).first()["package"]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        assert z.read("indexes/index.cdxj").count(b"\n") == len(ROWS)
