"""The Merkle manifest against trees built one node at a time."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import documents

from statelog.llm import merkle, sha_lanes


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return sha([field(row[k]) for k in ("doc_id", "source", "lang", "n_chars")] + [field(text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha(last[i : i + 3]) for i in range(0, len(last), 3)])
    return out


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of each row, by plain hashing."""
    def changed(row):
        text = row["text"]
        if row["doc_id"] is not None and text is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
            return text.replace("\n", "")
        return text

    sources = {}
    for row in rows:
        sources.setdefault(row["source"], []).append(row)
    trees = {}
    for name, members in sources.items():
        keyed = sorted(
            (((r["doc_id"] is not None, r["doc_id"] or 0), leaf(r, r["text"]), leaf(r, changed(r)), r["doc_id"])
             for r in members), key=lambda m: m[:3])
        trees[name] = (keyed, levels([m[1] for m in keyed]))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    top = levels([trees[n][1][-1][0] for n in names])

    def climb(tree, at, now):
        proof = []
        for level in tree[:-1]:
            first = at // 3 * 3
            run = level[first : first + 3]
            proof += [h for i, h in enumerate(run) if first + i != at]
            now = sha([now if first + i == at else h for i, h in enumerate(run)])
            at //= 3
        return proof, now

    out = []
    for number, name in enumerate(names):
        keyed, tree = trees[name]
        for at, (_, own, new, doc_id) in enumerate(keyed):
            below, now = climb(tree, at, new)
            above, now = climb(top, number, now)
            out.append((doc_id, own, tree[-1][0], top[-1][0], sha(below + above), now, now == top[-1][0]))
    return out


def found(frame):
    return [tuple(r) for r in frame.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def check(spark, docs):
    rows = [r.asDict() for r in docs.collect()]
    got = found(merkle.manifest(docs, merkle.without_line_ends(docs)))
    order = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(got, key=order) == sorted(expected(rows), key=order)
    return got


def test_states_resume_as_hashes_go_on():
    rng = np.random.default_rng(3)
    digests = rng.integers(0, 256, (3, 10_000, 32), dtype=np.uint8)
    states = sha_lanes.fresh(10_000)
    for part in digests:
        states = sha_lanes.resumed(states, part)
    whole = sha_lanes.finished(states, np.full(10_000, 3))
    for i in (0, 1, 8_191, 8_192, 9_999):
        assert whole[i].tobytes() == hashlib.sha256("".join(d[i].tobytes().hex() for d in digests).encode()).digest()


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 27, 28])
def test_small_sources(spark, count):
    check(spark, documents(spark, [(i, f"text {i}\nmore") for i in range(count)]))


def test_sources_of_many_sizes_against_plain_hashing(spark):
    pick = random.Random(11)
    rows = []
    for source, size in (("hot", 1200), ("b", 243), ("c", 244), ("d", 1), ("é", 7), ("", 3), (None, 5), ("z", 81)):
        for _ in range(size):
            text = pick.choice([None, "", "a\nb", "plain", "née\n\n", "x" * pick.randint(1, 400)])
            rows.append((pick.randrange(10**6), text, pick.choice(["en", None]), source, pick.choice([None, 3])))
    rows += [(None, "no id\n", None, "hot", None), (None, None, None, "hot", None)]
    # Repeated ids, with equal and with other texts.
    rows += [(77, "same\n", "en", "hot", 5)] * 40 + [(77, "other", "en", "hot", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = check(spark, docs.repartition(7))
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_many_sources(spark):
    rows = [(i, f"t{i}\n", "en", f"s{i % 800}", 1) for i in range(1000)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_untouched_rows_are_verified(spark):
    docs = documents(spark, [(i, "a\nb") for i in range(50)])
    assert all(r.verified for r in merkle.manifest(docs).collect())


def test_empty_table_absent_and_clashing_columns(spark):
    assert merkle.manifest(documents(spark, [])).collect() == []
    docs = spark.createDataFrame(
        [(1, "a\n", 5, "x"), (2, "b", 6, "y")], "doc_id int, text string, pos long, digest string")
    rows = [r.asDict() | {"source": None, "lang": None, "n_chars": None} for r in docs.collect()]
    assert sorted(found(merkle.manifest(docs, merkle.without_line_ends(docs)))) == sorted(expected(rows))


def test_very_long_text(spark):
    check(spark, documents(spark, [(1, "ab\n" * 500_000), (2, "c"), (3, "d")]))
