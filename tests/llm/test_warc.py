import base64
import hashlib
import re

import pytest

from emberlog.llm.warc import archive_pages, export_warc, read_records, write_archive

SCHEMA = "page_id long, url string, html string, payload string, sha256 long"


def rows():
    texts = ["<p>é</p>", "", None, "a\r\n\r\nWARC/1.1\r\n", "x" * 300_000]
    out = [(i, f"http://h/{i}\r\nX: 1", texts[i % 5] if i % 3 else "hot", "p", 1) for i in range(60)]
    return out + [(7, "http://again", texts[2], "p", 1), (7, "http://again", texts[2], "p", 1), (59, None, texts[4], "p", 1)]


def want(data, least=0):
    largest = {}
    for i, _, html, *_ in data:
        largest[html or ""] = max(largest.get(html or "", i), i)
    seen, out = set(), []
    for i, _, html, *_ in data:
        body = (html or "").encode()
        own = i == largest[html or ""] and (i, html or "") not in seen
        seen.add((i, html or ""))
        revisit = not own and len(body) >= least
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if revisit else "response", largest[html or ""] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archive_says_what_the_pages_say(spark, least):
    data = rows()
    got = archive_pages(spark.createDataFrame(data, SCHEMA), least).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == want(data, least)


def test_records_round_trip(spark, tmp_path):
    data = rows()
    write_archive(spark.createDataFrame(data, SCHEMA), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({r[2] or "" for r in data})
    records = read_records(spark, str(tmp_path / "a")).collect()
    assert len(records) == len(data)
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)$", head, re.M)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and rest[length:] == b"\r\n\r\n"
        assert rest[:length] == (bytes(r.payload) if r.record_type == "response" else b"")
        assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.payload_digest
    export_warc(spark, str(tmp_path / "a"), str(tmp_path / "warc"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    found = []
    while text:
        head, _, text = text.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)$", head, re.M)[1])
        found.append(head + b"\r\n\r\n" + text[:length] + b"\r\n\r\n")
        assert text[length : length + 4] == b"\r\n\r\n"
        text = text[length + 4 :]
    assert sorted(found) == sorted(bytes(r.record) for r in records)


def test_damage_is_found_and_empty_table(spark, tmp_path):
    write_archive(spark.createDataFrame([(1, "u", "abc", "", 1)], SCHEMA), str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a/payloads")).selectExpr("repeat('0', 64) as sha256", "packed").write.parquet(
        str(tmp_path / "b/payloads")
    )
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="damaged payload"):
        read_records(spark, str(tmp_path / "b")).collect()
    assert archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("mark", ["\u0085", "\u2028", "\u2029", "\x0b", "\x0c", "\r", "\n", "\r\n"])
def test_urls_with_line_separators(spark, mark):
    fields = ["Content-Length: 5", "WARC-Payload-Digest: sha1:AAAA", "WARC-Refers-To: <urn:page:77:1>", "WARC-Type: revisit"]
    data = [(i, f"http://h/{i}{mark}{field}{mark}", f"text {i}", "p", 1) for i, field in enumerate(fields)]
    data += [(10 + i, f"http://h/{i}{mark}{field}", "same", "p", 1) for i, field in enumerate(fields)]
    got = archive_pages(spark.createDataFrame(data, SCHEMA)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    assert sorted(map(tuple, got.collect()), key=str) == want(data)
