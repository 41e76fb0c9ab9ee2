"""Spelling variants against plain edit distance over all pairs."""

import zlib

import pytest

from sitelens.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_force(words):
    out = {}
    for w, n in words.items():
        near = sorted((-m, x) for x, m in words.items() if one_edit(w, x))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] += (root,)
    return out


def rows(df):
    return {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in df.collect()}


WORDS = {
    "garden": 400, "gardens": 180, "gardeen": 60, "arden": 20, "gardn": 9, "gadrens": 3, "ardens": 3,
    "table": 5, "tabel": 5, "tables": 5, "cable": 12, "fable": 12, "stable": 4, "ablet": 3,
    "élève": 50, "éleve": 10, "eleve": 4, "élèves": 30, "abcdefgh": 9, "bcdefgh": 4, "abcdefg": 4, "abcdefghi": 4,
    "zabcdefgh": 3, "aaaaa": 8, "aaaaaa": 4, "aaaaaaa": 16, "solitary": 3,
}


def test_groups_equal_brute_force(spark):
    df = spark.createDataFrame(list(WORDS.items()), "word STRING, n BIGINT")
    assert rows(spelling.grouped(df)) == brute_force(WORDS)


def test_every_single_edit_is_found(spark):
    """Each place of an insertion, deletion and replacement, for even and odd lengths."""
    words = {}
    for base in ("qwertyu", "asdfghjk"):
        words[base] = 100
        for i in range(len(base) + 1):
            words[base[:i] + "é" + base[i:]] = 3
        for i in range(len(base)):
            words[base[:i] + base[i + 1 :]] = 4
            words[base[:i] + "x" + base[i + 1 :]] = 5
    df = spark.createDataFrame(list(words.items()), "word STRING, n BIGINT")
    assert rows(spelling.grouped(df)) == brute_force(words)


def test_no_words(spark):
    assert spelling.grouped(spark.createDataFrame([], "word STRING, n BIGINT")).count() == 0


def test_vocabulary_counts_whole_texts(spark, documents, odd):
    filler = [(100 + i, " ".join(f"Straße{chr(97 + i % 5)}ÀÉ Wortform wortform, x1wortform_y" for _ in range(3))) for i in range(300)]
    found = [(d, t) for d, t in odd + filler]
    want = {}
    for doc_id, text in found:
        for run, n in spelling.runs(text).items():
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run if h % 97 else "".join(c for k, c in enumerate(run) if k != h % len(run))
            if len(word) >= 5:
                want[word] = want.get(word, 0) + n
    got = spelling.vocabulary(documents(found))
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if n >= 3}
    assert "wortform" in want and len(want) > 8
    assert spelling.vocabulary(documents([])).count() == 0


@pytest.mark.parametrize("text", [None, "", " 123 !! "])
def test_texts_without_runs(text):
    assert not spelling.runs(text)


def test_only_ascii_is_lowered():
    assert spelling.runs("ÀB×C a-z ΑΒ İI") == {"Àb×c": 1, "a": 1, "z": 1, "i": 1}
