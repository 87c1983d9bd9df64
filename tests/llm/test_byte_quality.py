import zlib

import numpy as np
from helpers import documents, words

from statelog.llm import byte_quality


def corpus(count=300):
    rows, labels = [], []
    for i in range(count):
        text = words(i, 40 + i * 7 % 200)
        good = i % 3 != 0
        rows.append((i, " ".join(text) if good else " ".join(w + "%%$" for w in text)))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    odd = [(None, None), (1000, ""), (1001, None), (1002, "ab cd" * 40_000), (7, rows[7][1])]
    docs = documents(spark, rows + odd)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    found = byte_quality.quality_scores(docs, known).collect()
    assert len(found) == len(rows) + len(odd)
    scores = {r.doc_id: r for r in found}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scores[i].held_out for i in held)
    assert sum(scores[i].predicted == int(i % 3 != 0) for i in held) >= 0.95 * len(held)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    assert scores[1000].score == scores[1001].score == scores[None].score


def test_empty_tables(spark):
    rows, labels = corpus(20)
    docs = documents(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    assert byte_quality.quality_scores(docs.limit(0), known).count() == 0
    assert {r.score for r in byte_quality.quality_scores(docs, known.limit(0)).collect()} == {0.5}


def test_chunks_cover_every_byte():
    for length in (0, 1, 511, 512, 513, 896, 897, 5000):
        text = bytes(1 + i % 250 for i in range(length))
        rows, first = byte_quality.chunks([b"other", text])
        starts = byte_quality.chunk_starts(length)
        covered = {i for s in starts for i in range(s, min(s + byte_quality.CHUNK, length))}
        assert len(covered) == length and first[1] == 1 and len(rows) == 1 + len(starts)
        for row, start in zip(rows[1:], starts):
            part = text[start : start + byte_quality.CHUNK]
            assert row.tobytes() == part + b"\0" * (byte_quality.CHUNK - len(part))


def test_the_end_of_a_long_text_counts():
    rows, labels = corpus()
    network = byte_quality.train([t.encode() for _, t in rows], np.array([y for _, y in labels], float))
    pairs = network.pair_tables()
    good = " ".join(words(1, 3000))
    bad = " ".join(w + "%%$" for w in words(2, 600))
    scores = network.scores([good.encode(), (good + " " + bad).encode()], pairs)
    assert scores[1] < scores[0]


def test_gradients_equal_differences():
    pick = np.random.default_rng(4)
    network = byte_quality.Network()
    network.parameters = {k: v.astype(float) for k, v in network.parameters.items()}
    for value in network.parameters.values():
        value += 0.05 * pick.standard_normal(value.shape)
    network.parameters["out"] /= 20
    texts = [bytes(pick.integers(32, 120, n, dtype=np.uint8)) for n in (30, 700, 1500)]
    rows, first = byte_quality.chunks(texts)
    labels, weights = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    found = network.gradients(rows, first, labels, weights)

    def loss():
        p = network.scores(texts, network.pair_tables())
        return float(np.mean(weights * -np.where(labels > 0, np.log(p), np.log(1 - p))))

    for name, value in network.parameters.items():
        flat, slope = value.reshape(-1), found[name].reshape(-1)
        for i in np.argsort(-abs(slope))[:4]:
            before = flat[i]
            flat[i] = before + 1e-5
            high = loss()
            flat[i] = before - 1e-5
            low = loss()
            flat[i] = before
            # Largest values are computed in 32 bits.
            assert abs((high - low) / 2e-5 - slope[i]) < 0.02 * abs(slope[i]) + 5e-3, name


def test_one_text_has_one_score_in_any_batch():
    rows, labels = corpus(120)
    network = byte_quality.train([t.encode() for _, t in rows], np.array([y for _, y in labels], float))
    pairs, text = network.pair_tables(), (" ".join(words(3, 700))).encode()
    pick = np.random.default_rng(6)
    found = set()
    for size in (1, 2, 3, 7, 16, 33, 100):
        others = [rows[i][1].encode() for i in pick.integers(0, len(rows), size)]
        at = int(pick.integers(0, size))
        found.add(network.scores([*others[:at], text, *others[at:]], pairs)[at])
    assert len(found) == 1


def test_scores_by_a_plain_forward_pass():
    rows, labels = corpus(60)
    network = byte_quality.train([t.encode() for _, t in rows], np.array([y for _, y in labels], float), epochs=2)
    p = {k: v.astype(float) for k, v in network.parameters.items()}

    def plain(text):
        hidden = []
        for start in byte_quality.chunk_starts(len(text)):
            chunk = text[start : start + byte_quality.CHUNK].ljust(byte_quality.CHUNK, b"\0")
            most = np.full(byte_quality.FILTERS, -np.inf)
            for at in range(0, byte_quality.CHUNK - byte_quality.WIDTH + 1, byte_quality.STRIDE):
                response = sum(p["bytes"][chunk[at + o]] @ p["filters"][o] for o in range(byte_quality.WIDTH))
                most = np.maximum(most, response)
            hidden.append(np.maximum(np.maximum(most + p["shift"], 0) @ p["hidden"] + p["hidden_shift"], 0))
        top = np.concatenate((np.max(hidden, 0), np.mean(hidden, 0)))
        return 1 / (1 + np.exp(-(top @ p["out"] + p["bias"][0])))

    texts = [b"", b"a", *(t.encode() for _, t in rows[:6]), ("xy%% " * 400).encode()]
    for text, score in zip(texts, network.scores(texts, network.pair_tables())):
        assert abs(plain(text) - score) < 1e-4
