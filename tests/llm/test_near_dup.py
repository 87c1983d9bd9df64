import random
import re

import numpy as np
from helpers import documents, words

from statelog.llm import near_dup
from statelog.llm.components import components
from statelog.llm.shingles import shingle_set, word_hashes
from statelog.llm.windows import Powers


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < 4:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 4]) for i in range(len(found) - 3)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (number, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), number), number)
    return [(n, len(sets[i]), low[find(i)], n == low[find(i)]) for i, (n, _) in enumerate(rows)]


def corpus(seed):
    pick = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one\ttwo"), (5, "one"), (6, "a b c d"), (7, "A B C D")]
    base = [words(i, pick.randint(20, 200)) for i in range(12)]
    for i in range(8, 120):
        text = list(pick.choice(base))
        for _ in range(pick.randint(0, len(text) // 25)):
            text[pick.randrange(len(text))] = f"w{pick.randint(0, 50)}"
        rows.append((i, " ".join(text)))
    pick.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        found = near_dup.near_duplicate_report(documents(spark, rows).repartition(5, "doc_id")).collect()
        assert sorted(tuple(r) for r in found) == sorted(brute(rows))


def test_chain_and_large_group(spark):
    pick, text = random.Random(5), words(9, 120)
    rows = [(i, " ".join(text)) for i in range(300, 330)]
    for i in range(60):
        # A chain: neighbours are alike, the ends are not.
        text = list(text)
        text[pick.randrange(len(text))] = f"x{i}"
        rows.append((200 - i, " ".join(text)))
    found = near_dup.near_duplicate_report(documents(spark, rows)).collect()
    assert sorted(tuple(r) for r in found) == sorted(brute(rows))


def test_members_that_the_centre_does_not_reach(spark, monkeypatch):
    """Many texts near 0.8 of each other, with the neighbours' step and without it."""
    pick, text = random.Random(6), words(11, 150)
    rows = []
    for i in range(90):
        changed = list(text)
        for _ in range(pick.randint(1, 5)):
            changed[pick.randrange(len(text))] = f"y{pick.randint(0, 9)}"
        rows.append((i, " ".join(changed)))
    docs = documents(spark, rows)
    expected = sorted(brute(rows))
    assert 1 < len({r[2] for r in expected}) < 90
    assert sorted(tuple(r) for r in near_dup.near_duplicate_report(docs).collect()) == expected
    monkeypatch.setattr(near_dup._Join, "_neighbours", lambda self, members: members.select(
        near_dup.F.col("rep").alias("a"), near_dup.F.col("rep").alias("b")).limit(0))
    assert sorted(tuple(r) for r in near_dup.near_duplicate_report(docs).collect()) == expected


def test_signature_distance_is_guaranteed():
    pick = np.random.default_rng(1)
    for _ in range(300):
        one = pick.integers(0, 65536, near_dup.POSITIONS)
        two = one.copy()
        where = pick.choice(near_dup.POSITIONS, near_dup.DISTANCE, replace=False)
        two[where] ^= 1
        errors = (one != two).reshape(near_dup.CHUNKS, near_dup.WIDTH).sum(1)
        assert errors.min() <= near_dup.ERRORS


def test_bit_maps_never_differ_more_than_sets():
    pick = np.random.default_rng(3)
    for size in (1, 30, 500, 5000):
        one = pick.integers(0, 2**63, size, dtype=np.uint64)
        two = np.concatenate((one[size // 5 :], pick.integers(0, 2**63, size // 7, dtype=np.uint64)))
        bits = np.bitwise_count((near_dup.bit_map(one) ^ near_dup.bit_map(two)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(one, two))


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "other words here now"), (2, None)]
    docs = documents(spark, rows)
    found = sorted(map(tuple, near_dup.near_duplicate_report(docs).collect()), key=repr)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True),
                            (2, 0, 2, True)], key=repr)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted([r.text for r in kept.collect()], key=str) == ["None" and None, "a b c d e", "other words here now"]
    assert near_dup.near_duplicate_report(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (3, 2), (5, 4), (6, 5), (9, 8), (8, 7), (7, 6), (10, 10), (20, 21)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert roots == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4, 9: 4, 20: 20, 21: 20}
    assert len(found) == len(roots)


def test_long_words(monkeypatch):
    from statelog.llm import shingles as module

    powers = Powers()
    text = b"aa bb " + b"c" * 50 + b" dd ee " + b"f" * 30
    whole = word_hashes(text, powers)
    monkeypatch.setattr(module, "PIECE", 12)
    parts = word_hashes(text, powers)
    assert (parts[[0, 1, 3, 4]] == whole[[0, 1, 3, 4]]).all()
    assert len(shingle_set(whole[:2], 4)) == 1 and len(shingle_set(whole[:0], 4)) == 0
