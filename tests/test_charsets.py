"""Charset resolution and decoding against Python's codecs."""

import pytest

from sitelens.functions import charsets
from sitelens.sources.snapshots import page_scan


def scanned(spark, rows):
    df = spark.createDataFrame([(i, "u", t, b) for i, (t, b) in enumerate(rows)], "page_id INT, url STRING, content_type STRING, body BINARY")
    return [(r.charset, r.text, r.body) for r in page_scan(df, "page_id").orderBy("page_id").collect()]


HTML = "text/html"


def test_a_mark_beats_the_header_and_the_header_beats_the_markup(spark):
    meta = b'<html><meta charset="koi8-r">'
    rows = [
        (f"{HTML}; charset=windows-1251", b"\xef\xbb\xbf\xc3\xa9"),
        (f"{HTML}; charset=utf-8", b"\xff\xfea\x00"),
        (f"{HTML}; charset=windows-1251", meta + b"\xe0"),
        (HTML, meta + b"\xc1"),
        (f"{HTML}; charset=bogus", meta + b"\xc1"),
        (HTML, b"\xc3\xa9"),
        (f"{HTML}; charset=bogus", b'<meta charset="bogus">\xc3\xa9'),
        ("application/json", meta + b"\xc3\xa9"),
        ("image/png", meta),
        (None, b"x"),
        (HTML, None),
    ]
    got = scanned(spark, rows)
    assert [c for c, _, _ in got] == [
        "utf-8", "utf-16le", "windows-1251", "koi8-r", "koi8-r", "utf-8", "utf-8", "utf-8", None, None, "utf-8",
    ]
    assert [(t or "")[-1:] for _, t, _ in got] == ["é", "a", "а", "а", "а", "é", "é", "é", "", "", ""]
    assert [b for _, _, b in got[8:]] == [meta, b"x", None] and all(b is None for _, _, b in got[:8])


def test_declarations_are_looked_for_in_the_first_kilobyte_only(spark):
    rows = [
        (HTML, b" " * 1000 + b"<meta charset=koi8-r>\xc1"),
        (HTML, b" " * 1100 + b"<meta charset=koi8-r>\xc1"),
        (HTML, b"<META HTTP-EQUIV='Content-Type' CONTENT='text/html; CHARSET=KOI8-R'>\xc1"),
        (HTML, b"<meta charset=utf-16>\xc3\xa9"),
    ]
    assert [(c, t[-1]) for c, t, _ in scanned(spark, rows)] == [
        ("koi8-r", "а"), ("utf-8", "�"), ("koi8-r", "а"), ("utf-8", "é"),
    ]


@pytest.mark.parametrize("charset", sorted(charsets._LABELS))
def test_every_byte_is_decoded_as_the_codec_does(spark, charset):
    """All single bytes, and whole texts of charsets with more."""
    codec = charsets._CODECS.get(charset, charset.replace("windows-", "cp") if charset.startswith("windows") else charset)
    sample = "Текст ありがとう 中文 한국어 é" if charset.startswith(("utf", "gb")) else {
        "shift_jis": "ありがとう", "euc-jp": "ありがとう", "iso-2022-jp": "ありがとう", "big5": "中文", "euc-kr": "한국어",
    }.get(charset, "plain")
    whole = sample.encode(codec)
    every = bytes(range(256)) + b"\xd8"
    got = scanned(spark, [(f"{HTML};charset={charset}", b"z" + whole), (f"{HTML};charset={charset}", b"z" + every)] if not charset.startswith("utf-16") else [(f"{HTML};charset={charset}", whole), (f"{HTML};charset={charset}", every)])
    prefix = "" if charset.startswith("utf-16") else "z"
    assert got[0][:2] == (charset, prefix + sample)
    if charset == "utf-8":
        assert got[1][1].startswith("z" + "".join(map(chr, range(128)))) and "�" in got[1][1]
    else:
        want = every.decode(codec, "replace").encode("utf-8", "replace").decode()
        assert got[1][:2] == (charset, prefix + want)


def test_labels_have_one_charset():
    labels = [a for aliases in charsets._LABELS.values() for a in aliases.split()]
    assert len(labels) == len(set(labels)) < 200
