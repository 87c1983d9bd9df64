import zlib

import numpy as np
import public_tokenizers
from helpers import documents, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statelog.llm import packing
from statelog.llm import words as table

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def expected(rows):
    out = {}
    for number, text in rows:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]
        for n, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            out[number, n] = (start, len(part), zlib.crc32(part.tobytes()))
    return out


def check(rows, found):
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == expected(rows)
    assert len(found) == len(expected(rows))
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return sequences


ODD = [
    None, "", "   ", "It's THE user's <|endoftext|> and <|startoftext|>x", "ñandú ÀÉÎ é   x\x1cy",
    "İstanbul ΣΑΣ ß 漢字かな 😀!!", "a1b22c333 don't we'll 'tis 've", "tab\tnew\nline\x0bv\x0cf\rr", "\x00\x7f x\x85y",
    "%%%$$$ A!!B!! (x)...", "word " * 9000,
]


def test_ids_are_the_tokenizers(spark):
    words_ = packing.Words(public_tokenizers.path(packing.VOCABULARY))
    texts = [text or "" for text in ODD] * 2
    for text, ids in zip(texts, words_.ids([t.encode() for t in texts])):
        assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, text
    assert words_.ids([]) == [] and words_.ids([b""])[0].tolist() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_ids_of_any_text(text):
    from statelog.llm.common import worker_cache

    words_ = worker_cache("test-words", lambda: packing.Words(public_tokenizers.path(packing.VOCABULARY)))
    found = words_.ids([text.encode(), b"", text.upper().encode()])
    assert found[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert found[2].tolist() == TOKENIZER.encode(text.upper(), add_special_tokens=False).ids


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(table, "CACHED_WORDS", 50)
    monkeypatch.setattr(packing, "CACHED_PARTS", 10)
    words_ = packing.Words(public_tokenizers.path(packing.VOCABULARY))
    for i in range(8):
        text = " ".join(words(i, 40)) + " été, " * 3
        assert words_.ids([text.encode()])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
        assert len(words_.keys) <= 50


def test_best_fit():
    assert packing.best_fit([5, 5, 3, 2, 4], 10) == [[0, 1], [4, 2, 3]]
    assert packing.best_fit([], 10) == []
    assert packing.best_fit([10, 10], 10) == [[0], [1]]


def test_odd_texts(spark):
    rows = list(enumerate(ODD))
    docs = documents(spark, rows).repartition(4)
    check(rows, packing.pack(docs).collect())
    assert packing.pack(docs.limit(0)).count() == 0
    twice = packing.pack(documents(spark, [(1, "same"), (1, "same"), (None, "x")])).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3


def test_many_partitions(spark):
    rows = [(i, " ".join(words(i, 40 + 37 * i % 900))) for i in range(150)]
    found = packing.pack(documents(spark, rows).repartition(40)).collect()
    sequences = check(rows, found)
    total = sum(r.length for r in found)
    # Few pieces, dealt over more partitions than there are sequences.
    assert len(sequences) <= 1.15 * -(-total // 4096)


def test_carry_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "CARRIED", 2)
    rows = [(i, " ".join(["word"] * 2500)) for i in range(40)]
    check(rows, packing.pack(documents(spark, rows).repartition(12)).collect())
