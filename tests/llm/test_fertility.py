import re

import public_tokenizers
import pytest
from helpers import documents, words

from statelog.llm import fertility


def brute(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(found) < 10 or 100 * len(inside) > 20 * len(found)
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), again, len(inside), failed)


CASES = [
    None, "", " \n\t ", "one", "a b c d e", "a a a a a a", "x\x1cy\x85z\xa0w \x0bq\x0c", "A <b> | c\n" * 4,
    "l1 ñandú\n\nl1 ñandú\n l1 ñandú\n", " ".join(words(1, 300)), " ".join(words(2, 60, 3)),
    " ".join(words(3, 40) + words(4, 8) + words(5, 9) + words(4, 8)), "%%% " * 30, "漢字 " * 50, "\x00 ퟿ " * 12,
]


def test_counts_equal_brute_force(spark):
    docs = documents(spark, list(enumerate(CASES)) + [(None, "a b"), (3, "one")])
    rows = fertility.quality_report(docs).collect()
    assert len(rows) == len(CASES) + 2
    for row in rows:
        if row.doc_id is not None:
            assert tuple(row[1:7]) == brute(CASES[row.doc_id]), row.doc_id
        assert not (row.base_failed and row.kept)


def test_bands(spark):
    good = " ".join(words(1, 400, 4000))
    shout = good.upper()
    bytes_only = " ".join("一龥㐀"[i % 3] * 3 for i in range(90))
    pieces = fertility.Pieces(public_tokenizers.path(fertility.VOCABULARY))

    def fits(lang, text):
        tokens = pieces.lookup([text.encode()]).tokens(0)
        return fertility.fits(lang, text, sum(map(len, text.split())), tokens, pieces)

    assert pieces.lookup([b"x", b"abc abc"]).tokens(1).tolist() == 2 * pieces.model.encode("abc")
    assert not fits("en", shout)
    assert not fits(None, bytes_only)
    assert fits("en", "few words only")


def test_keep_good_keeps_columns(spark):
    docs = documents(spark, [(1, " ".join(words(1, 12))), (2, "short"), (3, None)])
    assert fertility.keep_good(docs).columns == docs.columns
    assert [r.doc_id for r in fertility.keep_good(docs).collect()] == [1]
    assert fertility.keep_good(docs.drop("lang")).count() == 1
    assert fertility.quality_report(docs.limit(0)).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = {r.doc_id: r for r in fertility.quality_report(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for number in list(texts)[:60]:
        assert tuple(rows[number][1:7]) == brute(texts[number])
    good = [rows[r.doc_id] for r in labels.collect() if r.quality == 1]
    sound = [r for r in good if not r.base_failed]
    assert sum(r.kept for r in sound) >= 0.97 * len(sound)
