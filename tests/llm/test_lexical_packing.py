"""Lexical packing: exact ids and places, no padding, and scores by the formula."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, words

from statelog.llm import lexical_packing

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def own():
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, found, own):
    """Every id in one piece, sequences without gaps, no padding; returns sequences by number."""
    want = Counter()
    for doc_id, text in rows:
        want[doc_id, tuple(own.encode(text or "", add_special_tokens=False).ids) + (1,)] += 1
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in parts])
        assert [r.offset for r in parts] == [0, *ends[:-1]]
        assert ends[-1] <= 2048 and ends[-1] & (ends[-1] - 1) == 0
    ids_of = defaultdict(Counter)
    for (doc_id, ids), times in want.items():
        ids_of[doc_id][ids] += times
    for doc_id, options in ids_of.items():
        places = Counter()
        for r in by_doc[doc_id]:
            fitting = [
                i for i in options
                if len(i) == r.doc_tokens
                and zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
            assert fitting
            places.update((r.doc_tokens, p) for p in range(r.start, r.start + r.length))
        assert places == sum(
            (Counter({(len(i), p): n for p in range(len(i))}) for i, n in options.items()), Counter())
    assert set(by_doc) == {d for d, _ in rows}
    return sequences


def test_exact_ids_and_places(spark, own):
    rows = [(i, " ".join(words(i, 1 + i * 37 % 900))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 30_000), (1003, "a  b\n\n c\t  d é\U0001f600 <|endoftext|> e")]
    rows += [(7, rows[7][1]), (1004, "日本語" * 3000), (None, "no id here"), (1005, " \n" * 4000)]
    found = lexical_packing.pack(documents(spark, rows)).collect()
    sequences = check(rows, found, own)
    total = sum(r.length for r in found)
    # All sequences are full but the last powers of two of each task.
    short = [sum(r.length for r in parts) for parts in sequences.values() if sum(r.length for r in parts) < 2048]
    assert len(sequences) - len(short) >= total // 2048 - len(short)
    assert len(short) <= 11 * 4


def test_ids_of_both_libraries_on_the_given_texts(spark, own):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    tokens = lexical_packing.Tokens(
        public_tokenizers.path(lexical_packing.VOCABULARY), public_tokenizers.path(lexical_packing.RANKS))
    odd = ["", " ", "  ", "a ", "a  ", " a", "  a\n b", "x \u00a0 y", "x\u2003 y z", "\u3000 a", "a \u3000b", "é è  ö",
           "it's we'll 'S a'b", "1 22  333 4a", "\t a\x1c b\x85 c", "日本 語 \U0001f600 x", "a" * 200_000, "b " * 90_000,
           " <|endoftext|> x", "\n\n \n a", "- -- ---  ----", "\ufeff a \u200b b"]
    texts = odd + texts[:400] + [t[1:] for t in texts[:50]]
    got = tokens.ids([t.encode() for t in texts])
    for text, ids, found in zip(texts, got, own.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == found.ids + [1], text[:80]
    # Once more, with every piece known.
    assert all((a == b).all() for a, b in zip(tokens.ids([t.encode() for t in texts]), got))


def test_scores_by_the_formula():
    pick = random.Random(2)
    parts = [np.array([pick.randrange(30) + 5 for _ in range(pick.randint(1, 60))] + [1], "<u4") for _ in range(40)]
    there = Counter(t for p in parts for t in set(p[:-1].tolist()))
    frequency = np.array([there[t] for t in range(40)])
    corpus = lexical_packing.Corpus(len(parts), sum(map(len, parts)), frequency)
    shard = lexical_packing.Shard(parts, corpus)
    mean = corpus.tokens / len(parts)
    for q in range(0, 40, 7):
        got = shard.scores(q)
        for d, part in enumerate(parts):
            count, want = Counter(part[:-1].tolist()), 0.0
            for t in set(parts[q][:-1].tolist()):
                idf = math.log(1 + (len(parts) - there[t] + 0.5) / (there[t] + 0.5))
                want += idf * count[t] * 2.2 / (count[t] + 1.2 * (0.25 + 0.75 * len(part) / mean))
            assert got[d] == pytest.approx(want, rel=1e-4)


def test_fill_takes_the_best_that_fit():
    lengths = np.array([5, 9, 3, 4, 1, 2])
    assert lexical_packing.fill(np.array([1, 0, 3, 2, 5, 4]), lengths, 13) == ([1, 3], 0)
    assert lexical_packing.fill(np.array([0, 1, 2]), lengths, 9) == ([0, 2], 1)
    assert lexical_packing.fill(np.array([], int), lengths, 9) == ([], 9)


def test_statistics_cover_all_documents(spark):
    rows = [(i, "alpha beta" if i % 3 else "gamma") for i in range(90)]
    tokens = lexical_packing.Tokens(
        public_tokenizers.path(lexical_packing.VOCABULARY), public_tokenizers.path(lexical_packing.RANKS))
    paths = [public_tokenizers.path(p) for p in (lexical_packing.VOCABULARY, lexical_packing.RANKS)]
    kind = "part int, doc_id long, ids binary, first int, second int, third int"
    counted = documents(spark, rows).repartition(5).select("doc_id", "text").mapInArrow(
        lambda batches: lexical_packing._tokenised(batches, *paths), kind)
    corpus = lexical_packing.statistics(counted.where("part = 1").repartition(3))
    ids = tokens.ids([t.encode() for _, t in rows])
    assert corpus.documents == 90 and corpus.tokens == sum(map(len, ids))
    for term in set(ids[1][:-1].tolist()):
        assert corpus.frequency[term] == 60
    assert corpus.frequency.sum() == sum(len(set(i[:-1].tolist())) for i in ids)


def test_routes():
    assert lexical_packing.route(np.array([], int), np.array([], int)).tolist() == [-1, -1, -1]
    assert lexical_packing.route(np.array([10, 9000]), np.array([1, 1])).tolist() == [9000, 10, -1]
    # Frequent in the document, then late in the vocabulary.
    assert lexical_packing.route(np.array([8000, 9000, 9001, 30]), np.array([9, 1, 1, 50])).tolist()[:2] == [8000, 9001]


def test_neighbours_share_their_window(spark, own):
    """Documents of a topic share words; most of a window is of the seed's topic."""
    pools = [words(100 + t, 60, 60) for t in range(12)]
    common = words(7, 80, 80)
    pick = random.Random(4)
    rows = []
    for i in range(600):
        pool = pools[i % 12]
        rows.append((i, " ".join(pick.choice(pool if pick.random() < 0.6 else common) for _ in range(pick.randint(60, 180)))))
    sequences = check(rows, lexical_packing.pack(documents(spark, rows)).collect(), own)
    same = total = 0
    for parts in sequences.values():
        topics = Counter()
        for r in parts:
            topics[r.doc_id % 12] += r.length
        same, total = same + max(topics.values()), total + sum(topics.values())
    assert same >= 0.8 * total


def test_copies_and_tiny_documents(spark, own):
    rows = [(i, "the same words again and again") for i in range(3000)] + [(5000 + i, "") for i in range(3000)]
    found = lexical_packing.pack(documents(spark, rows)).collect()
    check(rows, found, own)


def test_empty_table_and_clashing_columns(spark, own):
    assert lexical_packing.pack(documents(spark, [])).collect() == []
    docs = spark.createDataFrame([(1, "a b", b"x", 3)], "doc_id long, text string, ids binary, first int")
    check([(1, "a b")], lexical_packing.pack(docs).collect(), own)


def test_large_ids_are_kept():
    for ids in ([1], [70_000, 1], [65_535, 3, 1]):
        assert lexical_packing._unpacked(lexical_packing._packed(np.array(ids, "<u4"))).tolist() == ids
