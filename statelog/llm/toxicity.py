"""Toxicity by a convolutional network over hashed word embeddings, trained on all labelled texts.

Words are runs of letters, marks and digits of any script, A-Z in lower case; a run longer than 64
bytes is as many words as it has pieces. A word is hashed into a bucket, and so are its first four
bytes, which inflected forms share; its embedding is the sum of the two buckets'. Scripts that set no
spaces have a word for each character, hashed with the next one and alone; symbols such as emoji are
words in the same way.
Filters over one, two and three neighbours are max-pooled over the whole text, and a logistic layer
reads them. One direction of the embeddings starts from the log odds of a bucket between the labels;
everything is trained from there. The language of a text is told by its most frequent function
words; each language has a threshold of its own, and a score of 0.5 is at the threshold.

Labelled documents are dealt out by their ids into shards. In each round every shard takes the network
for one pass over its documents, by Adam in numpy, and the parameters of all shards are averaged by
their numbers of documents. The log odds come from all of these documents, the thresholds from those of a fifth
that no shard learns from. Texts are learnt from in full, whatever their length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.llm import windows
from statelog.llm.common import as_bytes, batched, stored, worker_cache
from statelog.llm.shingles import _LOWER
from statelog.llm.training import Adam, best_threshold, labelled, remainder, row_products, sigmoid, total

BUCKETS = 1 << 15
EMBEDDED = 16
FILTERS = 16
WIDTHS = (1, 2, 3)
EPOCHS = 6
BATCH = 64
RATE = 0.004
#: Labelled documents of a shard, on average.
SHARD = 16_384
#: One of so many labelled documents sets the thresholds alone; fewer documents than LEAST teach nothing.
VALID = 5
LEAST = 10
#: Steps of a threshold in a logit, which is told apart up to LARGEST.
STEPS, LARGEST = 256, 64
#: Words whose responses are held at once in training.
PIECE = 65_536
#: Toxic documents of a language that its own threshold needs.
LEAST_TOXIC = 25
#: Bucket 0 stands between texts and has no embedding.
PAD = 0

#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "that", "is", "was", "for", "with", "this"),
    "de": ("der", "die", "und", "das", "ist", "von", "den", "mit", "zu", "ein"),
    "fr": ("le", "et", "les", "des", "est", "dans", "que", "une", "du", "pour"),
    "es": ("el", "los", "las", "por", "se", "un", "su", "para", "del", "que"),
}
LANGUAGES = (*FUNCTION_WORDS, "other")

#: What a character is: between words, part of a word, or a word by itself.
_BETWEEN, _PART, _ALONE = range(3)
#: Characters of scripts that set no spaces: Thai, Lao, Burmese, Khmer, kana, Bopomofo, Han, Yi.
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF),
    (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))
#: A word has so many bytes at most; a longer run is cut after so many characters, of four bytes at most.
LONGEST_WORD = 64
_CUT = LONGEST_WORD // 4

#: Bytes that stand for a word's beginning.
PREFIX = 4


def _character_kinds() -> np.ndarray:
    """The kind of each code point; A-Z do not occur, and ASCII symbols are between words."""
    kinds = np.full(0x110000, _PART, np.uint8)
    for code in range(0x110000):
        category = unicodedata.category(chr(code))
        if category[0] in "PZ" or category == "Cc" or code < 128 and category[0] == "S":
            kinds[code] = _BETWEEN
        elif category[0] == "S":
            kinds[code] = _ALONE
    for first, last in _UNSPACED:
        part = kinds[first : last + 1]
        part[part == _PART] = _ALONE
    return kinds


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each character of UTF-8, and where each begins, with the end of the data."""
    kinds = worker_cache("toxicity: character kinds", _character_kinds)
    if not (data >= 128).any():
        return kinds[data], np.arange(len(data) + 1)
    begins = (data & 0xC0) != 0x80
    begins[0] = True
    at = np.flatnonzero(begins)
    byte = lambda i: data[np.minimum(at + i, len(data) - 1)].astype(np.uint32) & 63
    code = data[at].astype(np.uint32)
    for size, least in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):
        wide = data[at] >= least
        code[wide] = data[at][wide] & (0xFF >> (size + 1))
        for i in range(1, size):
            code[wide] = code[wide] << 6 | byte(i)[wide]
    return kinds[np.minimum(code, 0x10FFFF)], np.append(at, len(data))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and where its beginning ends. Every character that is not
    between words is in a word."""
    kinds, bounds = _characters(data)
    part = np.zeros(len(kinds) + 2, bool)
    part[1:-1] = kinds == _PART
    edges = np.flatnonzero(part[1:] != part[:-1])
    first, last = edges[0::2], edges[1::2]
    pieces = np.where(bounds[last] - bounds[first] > LONGEST_WORD, -(-(last - first) // _CUT), 1)
    step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + step * _CUT
    end = np.where(np.repeat(pieces, pieces) == 1, np.repeat(last, pieces), np.minimum(begin + _CUT, np.repeat(last, pieces)))
    starts, ends = bounds[begin], bounds[end]
    heads = np.minimum(ends, starts + PREFIX)
    alone = np.flatnonzero(kinds == _ALONE)
    if len(alone):
        follows = np.append(kinds[1:], _BETWEEN)[alone] == _ALONE
        starts = np.concatenate((starts, bounds[alone]))
        ends = np.concatenate((ends, bounds[alone + 1 + follows]))
        heads = np.concatenate((heads, bounds[alone + 1]))
        order = np.argsort(starts, kind="stable")
        starts, ends, heads = starts[order], ends[order], heads[order]
    return starts, ends, heads


def _hashes(text: bytes, powers: windows.Powers) -> np.ndarray:
    """For each word a hash of it and one of its beginning."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, heads = _words(data)
    out = np.empty((len(starts), 2), np.uint64)
    at = 0
    while at < len(starts):
        stop = int(np.searchsorted(ends, starts[at] + windows.PIECE, side="right"))
        sums = windows.prefix(data[starts[at] : ends[stop - 1]], powers)
        begin, end = starts[at:stop] - starts[at], ends[at:stop] - starts[at]
        out[at:stop, 0] = windows.hashes(sums, begin, end, powers)
        out[at:stop, 1] = windows.mixed(windows.hashes(sums, begin, heads[at:stop] - starts[at], powers))
        at = stop
    return out


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The two buckets of each word."""
    return (hashes % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


def _language_marks(powers: windows.Powers) -> np.ndarray:
    """For each known function word, its hash and the number of its language."""
    rows = [(int(_hashes(w.encode(), powers)[0, 0]), i) for i, lang in enumerate(FUNCTION_WORDS)
            for w in FUNCTION_WORDS[lang]]
    return np.array(sorted(rows), np.uint64)


def language(hashes: np.ndarray, marks: np.ndarray) -> int:
    """The language whose function words are most; the first of equals, ``other`` without any."""
    hashes = hashes[:, 0]
    at = np.minimum(np.searchsorted(marks[:, 0], hashes), len(marks) - 1)
    known = at[marks[at, 0] == hashes]
    # A word that two languages share counts for both.
    count = np.bincount(marks[known, 1].astype(np.int64), minlength=len(LANGUAGES))
    twin = known[(known + 1 < len(marks))]
    twin = twin[marks[np.minimum(twin + 1, len(marks) - 1), 0] == marks[twin, 0]] + 1
    count += np.bincount(marks[twin, 1].astype(np.int64), minlength=len(LANGUAGES))
    return int(count.argmax()) if count.any() else len(LANGUAGES) - 1


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in a row, with pads before, between and after them, and where each begins."""
    gap = max(WIDTHS) - 1
    pad = np.full((gap, 2), PAD, np.int32)
    parts, starts, at = [pad], [], 0
    for text in texts:
        starts.append(at)
        parts += [text, pad]
        at += len(text) + gap
    return np.concatenate(parts), np.array(starts, np.int64)


class Network:
    """Embeddings, filters by width, and the logistic layer."""

    def __init__(self, odds: np.ndarray, seed: int = 3) -> None:
        pick = np.random.default_rng(seed)
        table = 0.1 * pick.standard_normal((BUCKETS, EMBEDDED))
        table[:, 0] = odds
        table[PAD] = 0
        self.parameters = {"table": table.astype(np.float32), "bias": np.zeros(1, np.float32),
                           "out": (0.1 * pick.standard_normal(FILTERS * len(WIDTHS))).astype(np.float32)}
        for i, width in enumerate(WIDTHS):
            filters = 0.3 * pick.standard_normal((width, EMBEDDED, FILTERS))
            filters[:, 0, : FILTERS // 2] = 1.0 / width
            self.parameters[f"filters{width}"] = filters.astype(np.float32)
            self.parameters[f"shift{width}"] = np.zeros(FILTERS, np.float32)
            self.parameters["out"][i * FILTERS : i * FILTERS + FILTERS // 2] = 0.3
        self.offsets = np.zeros(len(LANGUAGES))

    def tables(self) -> dict[int, list[np.ndarray]]:
        """What a bucket adds to each filter at each place, so that a text only looks up and adds."""
        p = self.parameters
        return {w: [row_products(p["table"], p[f"filters{w}"][o]) for o in range(w)] for w in WIDTHS}

    def pooled(self, texts: list[np.ndarray], tables) -> np.ndarray:
        """The largest response of every filter in each text; borders count as empty words."""
        tokens, starts = _joined(texts)
        out = []
        for width in WIDTHS:
            count = len(tokens) - width + 1
            value = np.zeros((count, FILTERS), np.float32)
            for o in range(width):
                for part in (0, 1):
                    value += tables[width][o][tokens[o : count + o, part]]
            # Starts of windows that touch a text: from the pads before it to its last word.
            begin = starts + (max(WIDTHS) - width)
            out.append(np.maximum.reduceat(value, begin, axis=0) + self.parameters[f"shift{width}"])
        return np.maximum(np.concatenate(out, axis=1), 0)

    def logits(self, texts: list[np.ndarray], tables) -> np.ndarray:
        p = self.parameters
        found = row_products(self.pooled(texts, tables), p["out"][:, None])[:, 0]
        return found.astype(np.float64) + float(p["bias"][0])

    def _largest(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[list, list]:
        """By width, the largest response of every filter in each text and the first place of it."""
        p = self.parameters
        most, places, bounds = [], [], []
        for width in WIDTHS:
            count = len(tokens) - width + 1
            begin = starts + (max(WIDTHS) - width)
            bounds.append((begin, np.minimum(np.concatenate((begin[1:], [count])), count)))
            most.append(np.full((len(starts), FILTERS), -np.inf, p["table"].dtype))
            places.append(np.zeros((len(starts), FILTERS), np.int64))
        column = np.arange(FILTERS)
        for at in range(0, len(tokens), PIECE):
            part = tokens[at : at + PIECE + max(WIDTHS) - 1]
            embedded = p["table"][part[:, 0]] + p["table"][part[:, 1]]
            for w, width in enumerate(WIDTHS):
                count = min(PIECE, len(embedded) - width + 1)
                if count <= 0:
                    continue
                value = sum(embedded[o : count + o] @ p[f"filters{width}"][o] for o in range(width))
                begin, stop = bounds[w]
                for i in range(np.searchsorted(stop, at, "right"), np.searchsorted(begin, at + count)):
                    low, high = max(begin[i] - at, 0), min(stop[i] - at, count)
                    place = value[low:high].argmax(0) + low
                    better = value[place, column] > most[w][i]
                    most[w][i] = np.where(better, value[place, column], most[w][i])
                    places[w][i] = np.where(better, place + at, places[w][i])
        return most, places

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> dict:
        p = self.parameters
        tokens, starts = _joined(texts)
        most, places = self._largest(tokens, starts)
        raw = np.concatenate([m + p[f"shift{w}"] for w, m in zip(WIDTHS, most)], axis=1)
        active = np.maximum(raw, 0)
        error = (sigmoid(active @ p["out"] + p["bias"][0]) - labels) * weights / len(texts)
        out = {"out": active.T @ error + 1e-5 * p["out"], "bias": np.array([error.sum()], np.float32)}
        back = (error[:, None] * p["out"]) * (raw > 0)
        found, downs = [], []
        for i, width in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            out[f"shift{width}"] = g.sum(0)
            filters = np.zeros_like(p[f"filters{width}"])
            for o in range(width):
                pair = tokens[places[i] + o]
                embedded = p["table"][pair[..., 0]] + p["table"][pair[..., 1]]
                filters[o] = np.einsum("bfd,bf->df", embedded, g)
                down = (g[:, :, None] * p[f"filters{width}"][o].T).reshape(-1, EMBEDDED)
                found += [pair[..., 0].ravel(), pair[..., 1].ravel()]
                downs += [down, down]
            out[f"filters{width}"] = filters
        found, downs = np.concatenate(found), np.concatenate(downs)
        order = np.argsort(found, kind="stable")
        rows, first = np.unique(found[order], return_index=True)
        table = np.zeros_like(p["table"])
        table[rows] = np.add.reduceat(downs[order], first, axis=0)
        table[PAD] = 0
        out["table"] = table
        return out


def _constant(ones: float, count: float) -> Network:
    """The share of label 1 as the score of every text."""
    network = Network(np.zeros(BUCKETS))
    network.parameters["out"][:] = 0
    rate = (ones + 0.5) / (count + 1)
    network.parameters["bias"][:] = np.log(rate / (1 - rate))
    return network


def _log_odds(seen: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of a bucket between the labels, by the texts of each that hold it."""
    odds = np.log((seen[1] + 1) / (sizes[1] + 2)) - np.log((seen[0] + 1) / (sizes[0] + 2))
    return np.clip(odds * (seen.sum(0) / (seen.sum(0) + 5)), -2.5, 2.5)


def _pass(network: Network, optimiser: Adam, tokens, labels: np.ndarray, share: float, order: np.ndarray) -> None:
    """One pass over texts, with labels weighted as if each were half of them; ``tokens`` gives a text's."""
    weights = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    for at in range(0, len(order), BATCH):
        batch = order[at : at + BATCH]
        optimiser.update(network.gradients([tokens(i) for i in batch], labels[batch], weights[batch]))


def train(
    texts: list[bytes], labels: np.ndarray, share: float = 0.5, epochs: int = EPOCHS, seed: int = 5
) -> Network:
    """A network and its thresholds from texts in memory, as one shard. A fifth sets the thresholds alone, as if it
    held ``share`` of label 1; with fewer than two labels every score is the share of label 1."""
    powers = windows.Powers()
    hashed = [_hashes(t, powers) for t in texts]
    tokens = [buckets(h) for h in hashed]
    if len(texts) < LEAST or labels.min() == labels.max():
        return _constant(labels.sum(), len(labels))
    pick = np.random.default_rng(seed)
    order = pick.permutation(len(texts))
    held, learnt = order[: len(order) // VALID], order[len(order) // VALID :]
    seen = np.zeros((2, BUCKETS))
    for i in learnt:
        seen[int(labels[i]), np.unique(tokens[i])] += 1
    network = Network(_log_odds(seen, np.bincount(labels[learnt].astype(int), minlength=2)))
    optimiser = Adam(network.parameters, RATE)
    for epoch in range(epochs):
        optimiser.rate = RATE * (1 - epoch / epochs)
        _pass(network, optimiser, tokens.__getitem__, labels, labels[learnt].mean(), pick.permutation(learnt))
    common = labels[held].mean() / max(1 - labels[held].mean(), 1e-9) * (1 - share) / max(share, 1e-9)
    _calibrate(network, [hashed[i] for i in held], [tokens[i] for i in held], labels[held], common, powers)
    return network


def _calibrate(network: Network, hashed, tokens, labels: np.ndarray, common: float, powers) -> None:
    tables, marks = network.tables(), _language_marks(powers)
    logits = np.concatenate([network.logits(tokens[i : i + 64], tables) for i in range(0, len(tokens), 64)])
    langs = np.array([language(h, marks) for h in hashed])
    network.offsets[:] = best_threshold(logits, labels, common) if labels.any() else 0.0
    for lang in range(len(LANGUAGES)):
        mine = langs == lang
        if labels[mine].sum() >= LEAST_TOXIC and (labels[mine] == 0).sum() >= LEAST_TOXIC:
            network.offsets[lang] = best_threshold(logits[mine], labels[mine], common)


# ---- shards -----------------------------------------------------------------------------------


def _packed(keys, labels, valid, langs, tokens: list[np.ndarray]) -> list:
    """Columns of documents in one row; words are numbers in the list of different ones, the most
    frequent first, so that they compress well."""
    words = np.concatenate([np.zeros(0, "<u4"), *tokens])
    found, inverse, count = np.unique(words, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), "<u4")
    rank[order] = np.arange(len(order), dtype="<u4")
    shrink = zstandard.ZstdCompressor(level=1).compress
    planes = np.ascontiguousarray(rank[inverse].view(np.uint8).reshape(-1, 4).T)
    return [pa.array([np.asarray(keys, "<i8").tobytes()], pa.binary()),
            pa.array([np.array([labels, valid, langs], np.uint8).tobytes()], pa.binary()),
            pa.array([np.array([len(t) for t in tokens], "<i8").tobytes()], pa.binary()),
            pa.array([shrink(found[order].tobytes())], pa.binary()),
            pa.array([shrink(planes.tobytes())], pa.binary())]


_COLUMNS = ["keys", "marks", "lengths", "words", "tokens"]
_SHARD = "shard int, " + ", ".join(f"{c} binary" for c in _COLUMNS)


class Shard:
    """Labelled documents of a row: keys, labels, whether they set the thresholds, languages, words."""

    def __init__(self, row) -> None:
        """``row`` gives a column's value by its name."""
        expand = zstandard.ZstdDecompressor().decompress
        self.keys = np.frombuffer(row("keys"), "<i8")
        self.labels, self.valid, self.langs = np.frombuffer(row("marks"), np.uint8).reshape(3, -1)
        self.ends = np.cumsum(np.frombuffer(row("lengths"), "<i8"))
        self._words = np.frombuffer(expand(row("words")), "<u4")
        planes = np.frombuffer(expand(row("tokens")), np.uint8).reshape(4, -1)
        self._tokens = np.ascontiguousarray(planes.T).view("<u4").ravel()

    @classmethod
    def of(cls, batch, i: int) -> Shard:
        return cls(lambda name: batch.column(name)[i].as_py())

    def pairs(self, i: int) -> np.ndarray:
        """The words of a document, each as one number of its two buckets."""
        return self._words[self._tokens[(self.ends[i - 1] if i else 0) : self.ends[i]]]

    def tokens(self, i: int) -> np.ndarray:
        return self.pairs(i).view("<u2").reshape(-1, 2).astype(np.int32)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled documents, by shard, in rows of a few hundred."""
    powers = worker_cache("toxicity: powers", windows.Powers)
    marks, waiting = _language_marks(powers), {}

    def row(shard: int) -> pa.RecordBatch:
        docs = waiting.pop(shard)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), *_packed(*(list(c) for c in zip(*docs)))], names=["shard", *_COLUMNS])

    for batch in batched(batches, "text"):
        hashed = [_hashes(t, powers) for t in as_bytes(batch.column("text"))]
        columns = [batch.column(c).to_pylist() for c in ("shard", "key", "label", "valid")]
        for words, shard, key, label, valid in zip(hashed, *columns):
            pairs = np.ascontiguousarray(buckets(words).astype("<u2")).view("<u4").ravel()
            waiting.setdefault(shard, []).append((key, label, valid, language(words, marks), pairs))
            if sum(len(d[-1]) for d in waiting[shard][-512:]) > 1 << 18 or len(waiting[shard]) >= 512:
                yield row(shard)
    for shard in list(waiting):
        yield row(shard)


def _gathered(table: pa.Table) -> pa.Table:
    """One row of a shard's documents, in the order of their keys."""
    parts = [Shard.of(table, i) for i in range(table.num_rows)]
    docs = [(s.keys[i], s.labels[i], s.valid[i], s.langs[i], s.pairs(i)) for s in parts for i in range(len(s.keys))]
    docs.sort(key=lambda d: (d[0], len(d[-1])))
    return pa.table([table.column("shard")[:1].combine_chunks(), *_packed(*(list(c) for c in zip(*docs)))],
                    names=["shard", *_COLUMNS])


def _seen(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Documents of each label, those that set the thresholds last, and those that hold a bucket."""
    shard = Shard.of(batch, i)
    sizes, seen = np.zeros((2, 2)), np.zeros((2, BUCKETS))
    for k, (label, valid) in enumerate(zip(shard.labels, shard.valid)):
        sizes[valid, label] += 1
        if not valid:
            seen[label, np.unique(shard.pairs(k).view("<u2"))] += 1
    return np.concatenate((sizes.ravel(), seen.ravel()))


def _flat(network: Network) -> np.ndarray:
    return np.concatenate([v.ravel() for v in network.parameters.values()]).astype(float)


def _passed(network: Network, share: float, epoch: int, epochs: int):
    """What the network's parameters become in a pass over a shard, times the documents, and their number."""

    def learn(batch: pa.RecordBatch, i: int) -> np.ndarray:
        shard, mine = Shard.of(batch, i), Network.__new__(Network)
        mine.parameters = {k: v.copy() for k, v in network.parameters.items()}
        learnt = np.flatnonzero(shard.valid == 0)
        pick = np.random.default_rng([epoch, batch.column("shard")[i].as_py()])
        optimiser = Adam(mine.parameters, RATE * (1 - epoch / epochs))
        _pass(mine, optimiser, shard.tokens, shard.labels.astype(float), share, pick.permutation(learnt))
        return np.append(_flat(mine) * len(learnt), len(learnt))

    return learn


def _logits(network: Network):
    """Language, label and logit, in whole steps, of the documents that set the thresholds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard.of(batch, i)
                valid = np.flatnonzero(shard.valid)
                found = [network.logits([shard.tokens(k)], tables)[0] for k in valid]
                step = np.floor(np.clip(found, -LARGEST, LARGEST) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.langs[valid].astype(np.int32)), pa.array(shard.labels[valid].astype(np.int32)),
                     pa.array(step, pa.int32())], names=["lang", "label", "step"])

    return rows


def _threshold(counts: np.ndarray) -> float:
    """The logit above which the F1 of label 1 is best, from counts by label and step of a logit, in the
    middle of its gap."""
    steps = np.flatnonzero(counts.any(0))[::-1]
    hits, misses = np.cumsum(counts[1, steps]), np.cumsum(counts[0, steps])
    at = int(np.argmax(2 * hits / (hits + misses + counts[1].sum())))
    below = steps[at + 1] if at + 1 < len(steps) else steps[at] - STEPS
    return (steps[at] + below + 1) / 2 / STEPS - LARGEST


def train_shards(docs: DataFrame, labels: DataFrame, epochs: int = EPOCHS) -> Network:
    """A network and its thresholds from all labelled documents that are not held out; with fewer than
    two labels every score is the share of label 1. The same rows give the same network, up to the
    order in which sums are rounded, however they are partitioned."""
    rows, count = labelled(docs, labels, "toxic")
    rows = rows.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-count // SHARD)))).cast("int").alias("shard"),
        F.xxhash64("doc_id", F.lit(1)).alias("key"), F.col("label").cast("int").alias("label"),
        (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(VALID)) == 0).cast("int").alias("valid"), "text")
    # A shard in a folder of its own, so that the next steps read each in another task.
    shards = stored(rows.mapInArrow(_hashed, _SHARD).groupBy("shard").applyInArrow(_gathered, _SHARD),
                    "toxicity-shards", partitioned="shard")
    found = total(shards, _seen)
    if found is None:
        return _constant(0, 0)
    sizes, seen = found[:4].reshape(2, 2), found[4:].reshape(2, BUCKETS)
    if sizes.sum() < LEAST or not sizes.sum(0).all():
        return _constant(sizes[:, 1].sum(), sizes.sum())
    network = Network(_log_odds(seen, sizes[0]))
    if not sizes[0].sum():
        return network
    cuts = np.cumsum([v.size for v in network.parameters.values()])
    for epoch in range(epochs):
        found = total(shards, _passed(network, sizes[0, 1] / sizes[0].sum(), epoch, epochs))
        parts = np.split(found[: cuts[-1]] / found[-1], cuts[:-1])
        network.parameters = {
            k: x.reshape(v.shape).astype(v.dtype) for x, (k, v) in zip(parts, network.parameters.items())}
    counts = np.zeros((len(LANGUAGES), 2, 2 * LARGEST * STEPS + 1))
    steps = shards.mapInArrow(_logits(network), "lang int, label int, step int").groupBy("lang", "label", "step").count()
    for row in steps.collect():
        counts[row.lang, row.label, row.step + LARGEST * STEPS] = row["count"]
    network.offsets[:] = _threshold(counts.sum(0)) if counts[:, 1].any() else 0.0
    for lang, mine in enumerate(counts):
        if mine.sum(1).min() >= LEAST_TOXIC:
            network.offsets[lang] = _threshold(mine)
    return network


def _scorer(network: Network):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = worker_cache("toxicity: powers", windows.Powers)
        tables, marks = network.tables(), _language_marks(powers)
        for batch in batched(batches, "text"):
            hashed = [_hashes(t or b"", powers) for t in as_bytes(batch.column("text"))]
            logits = network.logits([buckets(h) for h in hashed], tables)
            logits -= network.offsets[[language(h, marks) for h in hashed]]
            scores = sigmoid(logits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                 pa.array((scores >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and decision for every whole text.

    A score uses the text alone. NULL and empty texts are scored as texts without words; a document
    without an id is scored and never learnt from. Repeated rows are scored alike. An empty
    ``docs`` gives no rows, empty ``labels`` a constant score; other columns are ignored.
    """
    network = train_shards(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held_out).mapInArrow(
        _scorer(network), f"doc_id {kind}, held_out boolean, score double, predicted int")
