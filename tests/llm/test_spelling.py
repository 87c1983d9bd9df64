"""Spelling variants against a plain count and all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents

from statelog.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance_is_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def expected(rows):
    words = counted(rows)
    near = {w: [x for x in words if distance_is_one(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def found(frame):
    rows = frame.select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_checksum_of_joined_parts():
    sums = spelling._Checksums()
    pick = random.Random(1)
    for _ in range(200):
        a, b = pick.randbytes(pick.randint(0, 30)), pick.randbytes(pick.randint(0, 64))
        got = sums.joined(*(np.array([zlib.crc32(x)], np.uint32) for x in (a, b)), np.array([len(b)]))
        assert got[0] == zlib.crc32(a + b)


def test_neighbourhood_meets_every_word_one_edit_away():
    pick = random.Random(5)
    letters = "abé"
    words = sorted({"".join(pick.choice(letters) for _ in range(pick.randint(5, 8))) for _ in range(900)})
    batch = pa.RecordBatch.from_pydict({"word": words, "id": list(range(len(words)))})

    def keys(kind):
        out = {}
        for rows in spelling._keyed(kind)(iter([batch])):
            for key, i in zip(*(rows.column(c).to_pylist() for c in ("key", "id"))):
                out.setdefault(i, Counter())[key] += 1
        return out

    published, around = keys("published"), keys("neighbourhood")
    # Each reduced word of a neighbourhood comes once.
    assert all(max(c.values()) == 1 for c in around.values())
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if distance_is_one(a, b):
                assert around[i].keys() & published[j].keys()


def test_full_neighbourhood_of_a_word():
    words = spelling._Words(np.frombuffer(b"abcde", np.uint8).reshape(1, 5))
    symbols = words.symbols[0].tolist()
    k = spelling.SYMBOLS
    every = {(5, tuple(symbols))}
    for i in range(5):
        every |= {(5, (*symbols[:i], s, *symbols[i + 1 :])) for s in range(1, k + 1)}
        every.add((4, (*symbols[:i], *symbols[i + 1 :])))
    for i in range(6):
        every |= {(6, (*symbols[:i], s, *symbols[i:])) for s in range(1, k + 1)}
    per_zone = sum(len(keys) for _, keys in words.neighbourhood())
    # Zones overlap where an edit within a run of symbols may lie in either of two.
    assert len(every) <= per_zone <= len(every) + (spelling.ZONES - 1) * (1 + 2 * k)


@pytest.mark.parametrize("seed", [0, 1])
def test_variants_against_all_pairs(spark, seed):
    pick = random.Random(seed)
    stems = ["".join(pick.choice("abcdeéü") for _ in range(pick.randint(5, 9))) for _ in range(150)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(80):
            w = stems[int(len(stems) * pick.random() ** 2)]
            if pick.random() < 0.3:
                at = pick.randrange(len(w))
                w = pick.choice([w[:at] + w[at + 1 :], w[:at] + pick.choice("ab") + w[at:], w[:at] + "c" + w[at + 1 :]])
            words.append(pick.choice([w, w.title(), w.upper()]))
        rows.append((i, pick.choice([" ", "-", "1", ", "]).join(words)))
    rows += [(None, "Straße straße STRASSE straße"), (900, None), (901, ""), (902, "× ÷ Œuvre")]
    rows += [(903, "encore " * 30), (903, "encore " * 30), (904, "z" * 5000 + " " + "z" * 5001)] * 3
    want = expected(rows)
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)
    assert found(spelling.variants(documents(spark, rows))) == want


def test_long_runs_chains_and_empty_tables(spark):
    long = "ab" * 1_500
    rows = [(i, f"{long} {long}x") for i in range(4)]
    # Chains of forms, each twice as frequent as the one before.
    for k, word in enumerate(["lantern", "lanterns", "lanternst", "lanternsta", "lanternstab", "lanternstabl"]):
        rows += [(10 * k + 1000, " ".join([word] * (4 * 2**k)))]
    want = expected(rows)
    assert found(spelling.variants(documents(spark, rows))) == want
    assert spelling.variants(documents(spark, [])).collect() == []
    assert spelling.variants(documents(spark, [(1, "one two")])).collect() == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "apples apples apples", 5, "w")], "doc_id int, text string, n int, word string")
    assert found(spelling.variants(docs)) == expected([(1, "apples apples apples")])


def test_nothing_of_the_vocabulary_is_broadcast(spark, monkeypatch):
    plans = []

    def planned(frame):
        # The plan that ran, with what Spark changed on the way.
        frame.collect()
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return frame

    stored = spelling.stored
    monkeypatch.setattr(spelling, "stored", lambda frame, purpose: stored(planned(frame), purpose))
    # Chains of forms; all tables are far below the size that Spark broadcasts.
    words = ["lantern", "lanterns", "lanternst", "lanternsta", "marble", "marbles"]
    rows = [(k, " ".join([word] * (4 * 2**k))) for k, word in enumerate(words)]
    assert found(planned(spelling.variants(documents(spark, rows)))) == expected(rows)
    assert sum("SortMergeJoin" in plan for plan in plans) >= 4
    assert not any("Broadcast" in plan for plan in plans)
