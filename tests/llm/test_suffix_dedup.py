import hashlib
import random
from collections import Counter

import pytest
from helpers import documents, words

from statelog.llm import suffix_dedup


def brute(rows):
    starts = Counter()
    for _, text in rows:
        data = (text or "").encode()
        starts.update(data[p : p + 200] for p in range(len(data) - 199))
    out = {}
    for number, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 199):
            if starts[data[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[number] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    pick = random.Random(seed)
    shared = [" ".join(words(100 + i, n)) for i, n in enumerate((30, 45, 60, 200))]
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * 300), (4, "é" * 150), (5, "x" * 199), (6, "x" * 199)]
    for i in range(10, 60):
        text = words(i, pick.randint(1, 260))
        for _ in range(pick.randint(0, 3)):
            passage = pick.choice(shared).split(" ")
            if pick.random() < 0.5:
                passage[pick.randrange(len(passage))] = "changed"
            cut = pick.randint(0, len(passage) // 2)
            at = pick.randint(0, len(text))
            text[at:at] = passage[cut:]
        rows.append((i, " ".join(text)))
    rows += [(60, rows[20][1]), (61, rows[20][1] + "!"), (62, rows[30][1][37:] + " ñ"), (63, rows[31][1][:-1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    found = suffix_dedup.removal_report(documents(spark, rows).repartition(5, "doc_id")).collect()
    assert {r.doc_id: tuple(r[1:]) for r in found} == brute(rows)


def test_repeated_rows_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    monkeypatch.setattr(suffix_dedup.windows, "PIECE", 300)
    long = " ".join(words(7, 500))
    rows = [(1, long), (2, "aa " + long), (3, "the end " + long[100:900] + " of it"), (4, "z" * 1000)]
    found = suffix_dedup.removal_report(documents(spark, rows)).collect()
    assert {r.doc_id: tuple(r[1:]) for r in found} == brute(rows)
    twice = suffix_dedup.removal_report(documents(spark, [(1, long), (1, long)])).collect()
    assert [(r.n_removed, r.n_spans) for r in twice] == [(len(long), 1)] * 2


def test_texts_keep_columns(spark):
    long = " ".join(words(7, 80))
    docs = documents(spark, [(1, "first " + long), (2, long + " last"), (3, None), (None, "alone")])
    found = suffix_dedup.remove_repeats(docs)
    assert found.columns == docs.columns
    texts = {r.doc_id: (r.text, r.id, r.lang) for r in found.collect()}
    assert texts == {1: ("first ", "x", "en"), 2: (" last", "x", "en"), 3: (None, "x", "en"),
                     None: ("alone", "x", "en")}
    assert suffix_dedup.removal_report(docs.limit(0)).count() == 0
