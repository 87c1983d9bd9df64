import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from helpers import documents, words

from statelog.llm import hmm


def toy(states=3, kinds=5, seed=0):
    pick = np.random.default_rng(seed)
    rows = lambda *shape: (x := pick.random(shape) + 0.1) / x.sum(-1, keepdims=True)
    return hmm.Model(rows(states), rows(states), rows(states, states), rows(states, kinds).T.copy())


def paths(model, tokens, start):
    for path in itertools.product(range(len(start)), repeat=len(tokens)):
        p = start[path[0]] * model.emit[tokens[0], path[0]]
        for a, b, token in zip(path, path[1:], tokens[1:]):
            p *= model.move[a, b] * model.emit[token, b]
        yield path, p


def laid(sequences):
    lengths = np.array([len(s) for s in sequences])
    return np.concatenate(sequences).astype(np.uint16), np.cumsum(lengths) - lengths, lengths


def test_likelihood_and_counts_equal_all_paths():
    model = toy()
    sequences = [[0, 1, 2, 4], [3], [1, 1], [4, 3, 2, 1, 0], [2, 2, 2]]
    opening = np.array([True, False, True, True, False])
    tokens, starts, lengths = laid(sequences)
    found = hmm.log_likelihood(model, tokens, starts, lengths)
    for sequence, value in zip(sequences, found):
        total = sum(p for _, p in paths(model, sequence, model.start))
        assert math.isclose(value, math.log10(total), rel_tol=1e-9)
    start, mean, move, emit = np.zeros(3), np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for sequence, opens in zip(sequences, opening):
        every = list(paths(model, sequence, model.start if opens else model.mean))
        total = sum(p for _, p in every)
        for path, p in every:
            start[path[0]] += opens * p / total
            for at, state in enumerate(path):
                mean[state] += p / total
                emit[sequence[at], state] += p / total
                if at:
                    move[path[at - 1], state] += p / total
    for a, b in zip(hmm.expected(model, tokens, starts, lengths, opening), (start, mean, move, emit)):
        np.testing.assert_allclose(a, b, rtol=1e-4, atol=1e-5)


def base(rows):
    split = {n: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
             for n, t in rows}
    rest = {n: zlib.crc32(str(n).encode()) % 10 for n in split}
    count = Counter(w for n, ws in split.items() if rest[n] for w in ws)
    total, types = sum(count.values()), len(count)
    out = {}
    for n, ws in split.items():
        score = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (types + 1))) for w in ws)
        out[n] = (rest[n] == 0, len(ws), sum(count[w] > 0 for w in ws), total, score)
    return out


def corpus():
    rows = [(0, None), (1, ""), (2, "One TWO one"), (3, " \t\n")]
    for i in range(4, 120):
        # Two languages of their own words, which only a state can tell apart.
        rows.append((i, " ".join(words(i, 5 + 13 * i % 150, 60) if i % 2 else
                                 [w.upper() + "z" for w in words(i, 5 + 17 * i % 700, 60)])))
    return rows


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(hmm, "TOP", 40)
    monkeypatch.setattr(hmm, "SEGMENT", 64)
    monkeypatch.setattr(hmm, "_WORD_CLASSES", 1 + hmm.ENDINGS + 40)
    rows = corpus()
    found = hmm.score_texts(documents(spark, rows).repartition(3, "doc_id")).collect()
    expected = base(rows)
    assert len(found) == len(rows)
    for r in found:
        want = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert math.isclose(r.base_score, want[4], rel_tol=1e-9)
        assert r.score <= 0
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_the_model_sums_to_one(spark):
    """Over all texts of one word: every known word, and the unseen one."""
    share = np.array([0.1, 0.4, 0.5])
    model = hmm.Model.first(share, 4)
    model = hmm.Model.from_counts(model.start * 9, model.mean * 9, model.move * 9, model.emit * 50, share)
    np.testing.assert_allclose(model.emit.sum(0), 1)
    np.testing.assert_allclose(model.move.sum(1), 1)
    tokens, starts, lengths = laid([[a, b] for a in range(3) for b in range(3)])
    assert math.isclose((10 ** hmm.log_likelihood(model, tokens, starts, lengths)).sum(), 1)


def test_rare_words_tell_the_state(spark, monkeypatch):
    """Words of one ending class, which only their own counts by state tell apart."""
    monkeypatch.setattr(hmm, "TOP", 4)
    monkeypatch.setattr(hmm, "_WORD_CLASSES", 1 + hmm.ENDINGS + 4)
    pick, rows = np.random.default_rng(3), []
    for i in range(300):
        side = "ab"[i % 2]
        rows.append((i, " ".join(f"the{side}" if pick.random() < 0.4 else f"{side}{pick.integers(40)}xyz" for _ in range(60))))
    mixed = " ".join(f"{'ab'[j % 2]}{j % 40}xyz" for j in range(60))
    pure = " ".join(f"a{j % 20 * 2}xyz" for j in range(60))
    rows += [(10_000, mixed), (10_001, pure)]
    found = {r.doc_id: r for r in hmm.score_texts(documents(spark, rows)).collect()}
    # Words of one kind of document follow each other more likely than words of both.
    gain = {i: found[i].score - found[i].base_score for i in (10_000, 10_001)}
    assert gain[10_001] > gain[10_000] + 5


def test_word_emissions_sum_to_their_class():
    pick = np.random.default_rng(1)
    kind, count = np.array([0, 1, 1, 1, 2, hmm.ENDINGS + 1], np.uint16), np.array([0, 3, 5, 1, 4, 9])
    share = np.ones(hmm.ENDINGS + 2) / (hmm.ENDINGS + 2)
    model, mass = hmm.Model.first(share), np.bincount(kind, count + hmm.SMOOTH, hmm.ENDINGS + 2)
    states = pick.random((4, hmm.STATES))
    sums = np.zeros((hmm.ENDINGS + 2, hmm.STATES))
    np.add.at(sums, kind[1:5], states)
    emit = hmm.word_emissions(model, hmm.Unigrams(22, 5, mass), sums, kind, count, states)
    np.testing.assert_allclose(emit[1:4].sum(0), model.emit[1])
    np.testing.assert_allclose(emit[[0, 4, 5]], model.emit[[0, 2, hmm.ENDINGS + 1]])


def test_odd_tables(spark):
    rows = hmm.score_texts(documents(spark, [(None, "a b"), (5, None), (5, None)]), 1).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens) for r in rows) == [(0, False, 3), (5, False, 1), (5, False, 1)]
    assert all(r.train_tokens == 2 for r in rows)
    assert hmm.score_texts(documents(spark, rows=[(1, "x")]).limit(0), 1).count() == 0
    only = hmm.score_texts(documents(spark, [(None, "a b")]), 1).collect()
    assert only[0].train_tokens == 0 and only[0].n_known == 0 and only[0].base_score == 0


def test_words_are_packed_and_blocks_add_up(spark, monkeypatch):
    """A few rows a block instead of one for each word, and the same scores from one block and many."""
    monkeypatch.setattr(hmm, "TOP", 40)
    monkeypatch.setattr(hmm, "_WORD_CLASSES", 1 + hmm.ENDINGS + 40)
    written, keep, found = {}, hmm.stored, []
    monkeypatch.setattr(hmm, "stored", lambda frame, name: written.setdefault(name, keep(frame, name)))
    for tokens in (10**6, 2_000):
        monkeypatch.setattr(hmm, "BLOCK_TOKENS", tokens)
        written.clear()
        found.append({r.doc_id: r.score for r in hmm.score_texts(documents(spark, corpus()).coalesce(1), 2).collect()})
    blocks = written["hmm-read"].count()
    assert blocks > 5 and max(written[n].count() for n in ("hmm-words", "hmm-states")) <= (blocks + 1) * (hmm.SLOTS + 1)
    for i, score in found[0].items():
        assert math.isclose(score, found[1][i], rel_tol=1e-4), i
