import zlib

import numpy as np
from helpers import documents, words

from statelog.llm import toxicity, training, windows

BAD = ["grumful", "grumfest", "zarkon", "blixen"]


def corpus(count=400):
    pick = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(count):
        text = words(i, int(pick.integers(20, 120)))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                text.insert(int(pick.integers(0, len(text))), BAD[int(pick.integers(0, 4))])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    odd = [(None, None), (1000, ""), (1001, None), (1002, "zarkon " * 30_000), (5, rows[5][1])]
    docs = documents(spark, rows + odd)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.toxicity_scores(docs, known).collect()
    assert len(found) == len(rows) + len(odd)
    scores = {r.doc_id: r for r in found}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scores[i].held_out for i in held) and sum(r.held_out for r in found) >= len(held)
    right = sum(scores[i].predicted == int(i % 4 == 0) for i in held)
    assert right >= 0.9 * len(held)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found)
    assert scores[1002].predicted == 1 and scores[1000].score == scores[1001].score == scores[None].score
    # The same text has the same score, whatever its other columns say.
    again = toxicity.toxicity_scores(docs.selectExpr("doc_id", "text", "'xx' lang", "'y' source"), known).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in found}


def test_empty_tables(spark):
    rows, labels = corpus(20)
    docs = documents(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs.limit(0), known).count() == 0
    found = toxicity.toxicity_scores(docs, known.limit(0)).collect()
    assert {r.score for r in found} == {0.5}


def test_gradients_equal_differences():
    pick = np.random.default_rng(0)
    network = toxicity.Network(np.zeros(toxicity.BUCKETS))
    texts = [pick.integers(1, 50, (n, 2)).astype(np.int32) for n in (1, 7, 30)]
    labels, weights = np.array([1.0, 0, 1]), np.ones(3)
    for value in network.parameters.values():
        value += 0.05 * pick.standard_normal(value.shape).astype(value.dtype)
    network.parameters["table"][0] = 0
    network.parameters = {k: v.astype(float) for k, v in network.parameters.items()}
    found = network.gradients(texts, labels, weights)

    def loss():
        logits = network.logits(texts, network.tables())
        return float(np.mean(np.log1p(np.exp(np.where(labels > 0, -logits, logits)))))

    for name in ("out", "bias", "filters1", "filters2", "filters3", "shift2", "table"):
        flat = network.parameters[name].reshape(-1)
        places = np.flatnonzero(found[name].reshape(-1))[:4] if name == "table" else range(min(4, len(flat)))
        for i in places:
            before = flat[i]
            flat[i] = before + 1e-4
            high = loss()
            flat[i] = before - 1e-4
            low = loss()
            flat[i] = before
            assert abs((high - low) / 2e-4 - found[name].reshape(-1)[i]) < 2e-3, name


def test_long_text_and_languages():
    powers = windows.Powers()
    marks = toxicity._language_marks(powers)
    tell = lambda t: toxicity.LANGUAGES[toxicity.language(toxicity._hashes(t.encode(), powers), marks)]
    assert [tell(t) for t in ("the cat of x", "der und das", "le et dans", "el los por", "zzz", "")] == [
        "en", "de", "fr", "es", "other", "other"]
    text = ("abc déf 12! " * 30_000).encode()
    parts = toxicity._hashes(text, powers)
    assert len(parts) == 90_000 and (parts[:3] == parts[-3:]).all()


def test_every_character_is_read():
    powers = windows.Powers()
    pick = np.random.default_rng(4)
    han = "".join(chr(c) for c in pick.integers(0x4E00, 0x9FFF, 90))
    for text in (han, "ก็" * 50 + "ดี", "x" * 200 + "é" * 45, han[:40] + "、" + han[40:], "ab" * 70_000):
        whole = toxicity._hashes(text.encode(), powers)
        for at in {0, 20, 21, 22, 41, len(text) // 2, len(text) - 1}:
            if text[at] != "、":
                other = text[:at] + "字" + text[at + 1 :]
                found = toxicity._hashes(other.encode(), powers)
                assert found.shape != whole.shape or (found != whole).any(), (text[:3], at)
    count = lambda t: len(toxicity._hashes(t.encode(), powers))
    assert count("a" * 64) == count("é" * 32) == 1 and count("a" * 65) == 5
    # Punctuation and spaces of any script stand between words, symbols are words.
    assert count("dos\u00a0and—more“so”") == 4 and count("привет，мир。") == 2 and count("so \U0001f92c\U0001f92c") == 3
    same = toxicity._hashes("xé, zü".encode(), powers)
    assert (same == toxicity._hashes("xé\u00a0—zü".encode(), powers)).all()


def test_a_phrase_late_in_an_unspaced_text_counts():
    pick = np.random.default_rng(2)
    texts, labels = [], np.array([float(i % 4 == 0) for i in range(400)])
    for label in labels:
        text = "".join(chr(c) for c in pick.integers(0x4E00, 0x4F00, int(pick.integers(80, 160))))
        at = int(pick.integers(40, len(text)))
        texts.append((text[:at] + "去死吧蠢货" * int(label) + text[at:]).encode())
    network, powers = toxicity.train(texts[:300], labels[:300]), windows.Powers()
    tokens = [toxicity.buckets(toxicity._hashes(t, powers)) for t in texts[300:]]
    found = network.logits(tokens, network.tables()) > network.offsets[-1]
    assert (found == labels[300:]).mean() >= 0.95


def test_threshold():
    logits, labels = np.array([3.0, 2, 2, 1, 0]), np.array([1.0, 1, 0, 0, 0])
    assert training.best_threshold(logits, labels) in (1.5, 2.5)
    assert training.best_threshold(logits, labels, 10.0) == 2.5


def test_one_text_has_one_logit_in_any_batch():
    rows, labels = corpus(120)
    network, powers = toxicity.train([t.encode() for _, t in rows], np.array([y for _, y in labels], float)), windows.Powers()
    tables = network.tables()
    tokens = [toxicity.buckets(toxicity._hashes(t.encode(), powers)) for _, t in rows]
    pick, found = np.random.default_rng(6), set()
    for size in (1, 2, 3, 7, 16, 33, 100):
        others = [tokens[i] for i in pick.integers(0, len(tokens), size)]
        at = int(pick.integers(0, size))
        found.add(network.logits([*others[:at], tokens[5], *others[at:]], tables)[at])
    assert len(found) == 1


def test_logits_by_a_plain_forward_pass():
    rows, labels = corpus(80)
    network = toxicity.train([t.encode() for _, t in rows], np.array([y for _, y in labels], float), epochs=2)
    p, powers = {k: v.astype(float) for k, v in network.parameters.items()}, windows.Powers()

    def plain(tokens):
        pads = max(toxicity.WIDTHS) - 1
        embedded = [np.zeros(toxicity.EMBEDDED)] * pads + [p["table"][a] + p["table"][b] for a, b in tokens]
        embedded += [np.zeros(toxicity.EMBEDDED)] * pads
        most = []
        for width in toxicity.WIDTHS:
            first = pads - width + 1
            places = range(first, first + len(tokens) + width)
            responses = [
                sum(embedded[at + o] @ p[f"filters{width}"][o] for o in range(width) if at + o < len(embedded))
                for at in places]
            most.append(np.maximum(np.max(responses, 0) + p[f"shift{width}"], 0))
        return np.concatenate(most) @ p["out"] + p["bias"][0]

    tokens = [toxicity.buckets(toxicity._hashes(t.encode(), powers)) for _, t in rows[:10]]
    for one, logit in zip(tokens, network.logits(tokens, network.tables())):
        assert abs(plain(one) - logit) < 1e-3


def test_an_id_brings_one_row(spark):
    docs = spark.createDataFrame(
        [(1, f"text {i}") for i in range(50)] + [(2, "b"), (3, "c"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] * 2, "doc_id long, toxic int")
    learnt = {i for i in range(1, 9) if zlib.crc32(str(i).encode()) % 5}
    texts, known, _ = training.labelled_sample(docs, labels, "toxic", 10, 100)
    want = [(i, t) for i, t in ((1, b"text 0"), (2, b"b"), (3, b"c")) if i in learnt]
    assert texts == [t for _, t in want] and known.tolist() == [i % 2 for i, _ in want]


def test_all_labelled_texts_teach(spark, monkeypatch):
    """Texts of any length, in several shards; a word that only long texts hold is learnt."""
    monkeypatch.setattr(toxicity, "SHARD", 60)
    rows, labels = corpus(200)
    rows = [(i, t.replace("grumful", "zarkon") + " " + "aa bb cc dd " * (3_500 if i % 4 == 0 else 10)) for i, t in rows]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity_scores(documents(spark, rows), known).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(found[i].predicted == int(i % 4 == 0) for i in held) >= 0.9 * len(held)


def test_shards_hold_every_document_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 60)
    rows, labels = corpus(400)
    seen = []
    monkeypatch.setattr(toxicity, "total", lambda shards, vector: seen.append(
        sorted((k, int(y), s.pairs(i).tobytes()) for r in shards.collect() for s in [toxicity.Shard(r.__getitem__)]
               for i, (k, y) in enumerate(zip(s.keys, s.labels)))))
    for parts in (1, 5):
        toxicity.train_shards(documents(spark, rows + rows[:9]).repartition(parts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    learnt = [(t, y) for (i, t), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5]
    words = lambda t: toxicity.buckets(toxicity._hashes(t.encode(), windows.Powers())).astype("<u2").tobytes()
    assert seen[0] == seen[1] and len({k for k, _, _ in seen[0]}) == len(seen[0])
    assert sorted((y, w) for _, y, w in seen[0]) == sorted((y, words(t)) for t, y in learnt)


def test_gradients_in_pieces(monkeypatch):
    pick = np.random.default_rng(0)
    network = toxicity.Network(pick.standard_normal(toxicity.BUCKETS))
    texts = [pick.integers(1, 50, (n, 2)).astype(np.int32) for n in (0, 1, 7, 30, 2)]
    whole = network.gradients(texts, np.array([1.0, 0, 1, 0, 1]), np.ones(5))
    for piece in (1, 3, 8):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        for name, value in network.gradients(texts, np.array([1.0, 0, 1, 0, 1]), np.ones(5)).items():
            np.testing.assert_allclose(value, whole[name], rtol=1e-4, atol=1e-6, err_msg=name)
