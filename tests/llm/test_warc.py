"""Archives against a plain recount of the pages."""

import gzip
import hashlib

from sitelens.llm import warc

BIG = "x" * 120


def resolved(spark, rows):
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, payload STRING, extra INT")
    found = warc.deduplicated(df)
    return sorted(
        ((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in found.collect()),
        key=repr,
    )


def expected(rows):
    first = {}
    for page, _, text, _ in rows:
        if page is not None and len((text or "").encode()) >= 100:
            first[text] = min(page, first.get(text, page))
    out = []
    for page, _, text, _ in rows:
        data, other = (text or "").encode(), first.get(text)
        revisit = other is not None and other != page
        out.append((page, "revisit" if revisit else "response", len(data), hashlib.sha256(data).hexdigest(),
                    other if revisit else None))
    return sorted(out, key=repr)


def test_every_case(spark):
    rows = [
        (5, "http://a/", BIG, 1), (3, "http://b/", BIG, 1), (9, None, BIG, 1), (3, "http://b/", BIG, 1),
        (1, "http://c/\r\nX: y", "short", 1), (2, "http://c/", "short", 1), (4, "http://d/", None, 1), (6, "http://d/", "", 1),
        (None, "http://e/", BIG, 1), (None, "http://e/", "alone" * 40, 1),
        (7, "http://f/", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, 1),
        (8, "http://g/", "ünï" * 50_000, 1), (10, "http://h/", "y" * 99, 1), (11, "http://h/", "y" * 99, 1),
        (12, "http://i/", "z" * 100, 1), (13, "http://i/", "z" * 100, 1),
    ]
    assert resolved(spark, rows) == expected(rows)


def test_hot_payload(spark):
    rows = [(i, f"http://a/{i}", BIG if i % 3 else f"{BIG}{i}", 0) for i in range(600)]
    assert resolved(spark, rows) == expected(rows)


def test_no_pages(spark):
    assert resolved(spark, []) == []


def test_archives_are_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", BIG), (2, "http://b/", BIG)], "page_id BIGINT, url STRING, payload STRING")
    warc.write_archives(df.coalesce(1), str(tmp_path / "w"), records_per_file=1)
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")
    assert data.count(b"WARC-Type: revisit") == 1 and data.count(BIG.encode()) == 1
    assert b"WARC-Refers-To: <urn:uuid:" in data and b"WARC-Target-URI: http://b/" in data
    kept = warc.read_archives(spark, str(tmp_path / "w"), payloads=True).filter("payload IS NOT NULL").collect()
    assert [bytes(r.payload) for r in kept] == [BIG.encode()]
