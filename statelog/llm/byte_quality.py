"""Quality by a byte-level convolutional network in numpy.

A document is its UTF-8 bytes, cut into overlapping chunks that cover all of it. Bytes have learned
embeddings; filters over eight bytes run over each chunk and are max-pooled there. A hidden layer
reads a chunk's maxima; its values are pooled over the chunks, by largest and by mean, and one
logistic unit gives the probability of a good document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.llm.common import as_bytes, batched
from statelog.llm.training import Adam, labelled_sample, remainder, row_products, sigmoid

CHUNK, STEP = 512, 384
WIDTH = 8
#: Filters start at every second byte.
STRIDE = 2
EMBEDDED, FILTERS, HIDDEN = 8, 40, 24
PLACES = (CHUNK - WIDTH) // STRIDE + 1
#: Documents of each label to learn from, at most, and the longest of them in code points; a step
#: of training looks at so many chunks of a document, drawn anew each time.
PER_LABEL = 2_000
LONGEST = 40_000
DRAWN = 6
EPOCHS = 12
BATCH = 16
KEEP = 0.3


def chunk_starts(length: int) -> np.ndarray:
    return np.arange(0, max(length - CHUNK, 0) + STEP, STEP)[: 1 + -(-max(length - CHUNK, 0) // STEP)]


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts, ends filled with zeros, and the first chunk of each text."""
    fill = np.zeros(CHUNK, np.uint8)
    parts, starts, first, at, count = [], [], [], 0, 0
    for text in texts:
        begin = chunk_starts(len(text))
        parts += [np.frombuffer(text, np.uint8), fill]
        starts.append(begin + at)
        first.append(count)
        at += len(text) + CHUNK
        count += len(begin)
    data = np.concatenate(parts)
    # Only the end of a text's own bytes and zeros after it are in its last chunk.
    return data[np.concatenate(starts)[:, None] + np.arange(CHUNK)], np.array(first)


class Network:
    def __init__(self, seed: int = 11) -> None:
        pick = np.random.default_rng(seed)
        shapes = {"bytes": (256, EMBEDDED), "filters": (WIDTH, EMBEDDED, FILTERS), "shift": (FILTERS,),
                  "hidden": (FILTERS, HIDDEN), "hidden_shift": (HIDDEN,), "out": (2 * HIDDEN,), "bias": (1,)}
        scale = {"bytes": 1.0, "filters": 0.3, "hidden": 0.25, "out": 0.2}
        self.parameters = {
            k: (scale.get(k, 0.0) * pick.standard_normal(v)).astype(np.float32) for k, v in shapes.items()}

    def tables(self) -> list[np.ndarray]:
        """What a byte adds to each filter at each of its places."""
        return [row_products(self.parameters["bytes"], f) for f in self.parameters["filters"]]

    def pair_tables(self) -> list[np.ndarray]:
        """The same for two bytes at once."""
        one = self.tables()
        return [(one[o][:, None, :] + one[o + 1][None, :, :]).reshape(-1, FILTERS) for o in range(0, WIDTH, 2)]

    def _top(self, pooled: np.ndarray, first: np.ndarray):
        p = self.parameters
        hidden = np.maximum(row_products(pooled, p["hidden"]) + p["hidden_shift"], 0)
        size = np.diff(np.concatenate((first, [len(hidden)])))
        most = np.maximum.reduceat(hidden, first, axis=0)
        mean = np.add.reduceat(hidden, first, axis=0) / size[:, None]
        return hidden, size, np.concatenate((most, mean), axis=1)

    def scores(self, texts: list[bytes], pairs: list[np.ndarray]) -> np.ndarray:
        """The probability of label 1 of each whole text."""
        rows, first = chunks(texts)
        pooled = np.empty((len(rows), FILTERS), np.float32)
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256].astype(np.int32)
            code = part[:, 0::2] * 256 + part[:, 1::2]
            value = pairs[0][code[:, :PLACES]]
            for j in range(1, WIDTH // 2):
                value += pairs[j][code[:, j : j + PLACES]]
            pooled[at : at + 256] = value.max(axis=1)
        pooled = np.maximum(pooled + self.parameters["shift"], 0)
        top = self._top(pooled, first)[2]
        logits = row_products(top, self.parameters["out"][:, None])[:, 0]
        return sigmoid(logits.astype(np.float64) + float(self.parameters["bias"][0]))

    def gradients(self, rows: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
        p, tables = self.parameters, self.tables()
        value = tables[0][rows[:, 0 : STRIDE * PLACES : STRIDE]]
        for o in range(1, WIDTH):
            value += tables[o][rows[:, o : o + STRIDE * PLACES : STRIDE]]
        place = value.argmax(axis=1)
        raw = np.take_along_axis(value, place[:, None, :], 1)[:, 0] + p["shift"]
        pooled = np.maximum(raw, 0)
        hidden, size, top = self._top(pooled, first)
        error = (sigmoid(top @ p["out"] + p["bias"][0]) - labels) * weights / len(first)
        out = {"out": top.T @ error + 1e-4 * p["out"], "bias": np.array([error.sum()], np.float32)}
        down = error[:, None] * p["out"]
        owner = np.repeat(np.arange(len(first)), size)
        # The largest value of a text goes back to the first chunk that has it.
        is_most = hidden == top[owner, :HIDDEN]
        order = np.cumsum(is_most, axis=0)
        before = np.concatenate((np.zeros((1, HIDDEN), int), order))[first][owner]
        back = np.where(is_most & (order - before == 1), down[owner, :HIDDEN], 0)
        back = (back + down[owner, HIDDEN:] / size[owner][:, None]) * (hidden > 0)
        out["hidden"], out["hidden_shift"] = pooled.T @ back, back.sum(0)
        g = (back @ p["hidden"].T) * (raw > 0)
        out["shift"] = g.sum(0)
        column = np.broadcast_to(np.arange(FILTERS), place.shape)
        filters, table = np.zeros_like(p["filters"]), np.zeros_like(p["bytes"])
        for o in range(WIDTH):
            found = np.take_along_axis(rows, place * STRIDE + o, 1)
            each = np.bincount((found.astype(np.int64) * FILTERS + column).ravel(), g.ravel(), 256 * FILTERS)
            each = each.reshape(256, FILTERS).astype(p["bytes"].dtype)
            filters[o] = p["bytes"].T @ each
            table += each @ p["filters"][o].T
        return out | {"filters": filters, "bytes": table}


def train(texts: list[bytes], labels: np.ndarray, share: float = 0.5, epochs: int = EPOCHS, seed: int = 17) -> Network:
    """A network whose probabilities are those of a table with ``share`` of label 1. With fewer than
    two labels it gives the share of label 1 to every text."""
    network = Network()
    if len(texts) < 10 or labels.min() == labels.max():
        network.parameters["out"][:] = 0
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        network.parameters["bias"][:] = np.log(rate / (1 - rate))
        return network
    pick = np.random.default_rng(seed)
    weights = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    # Learnt with the labels in balance; their odds are put into the bias afterwards.
    even = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    optimiser = Adam(network.parameters, 0.004)
    for epoch in range(epochs):
        optimiser.rate = 0.004 * (1 - epoch / epochs)
        order = pick.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            rows, first = chunks([texts[i] for i in batch])
            rows, first = _drawn(rows, first, pick)
            optimiser.update(network.gradients(rows, first, labels[batch], even[batch]))
    odds = np.log(weights[labels == 1][0] / even[labels == 1][0]) - np.log(
        weights[labels == 0][0] / even[labels == 0][0])
    network.parameters["bias"] += np.float32(odds)
    return network


def _drawn(rows: np.ndarray, first: np.ndarray, pick: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """At most DRAWN chunks of each text."""
    keep, begin = [], []
    for a, b in zip(first, [*first[1:], len(rows)]):
        begin.append(sum(map(len, keep)))
        keep.append(np.arange(a, b) if b - a <= DRAWN else np.sort(pick.choice(np.arange(a, b), DRAWN, False)))
    return rows[np.concatenate(keep)], np.array(begin)


def _scorer(network: Network):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = network.pair_tables()
        for batch in batched(batches, "text", 1 << 18):
            scores = network.scores([t or b"" for t in as_bytes(batch.column("text"))], pairs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                 pa.array((scores >= KEEP).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Probability of a good document and decision for every whole text.

    A score uses the bytes of the text alone. NULL and empty texts are a chunk of zeros; a document
    without an id is scored and never learnt from. Repeated rows are scored alike. An empty ``docs``
    gives no rows, empty ``labels`` a constant score; other columns are ignored.
    """
    texts, known, share = labelled_sample(docs, labels, "quality", PER_LABEL, LONGEST)
    network = train(texts, known, share)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held_out).mapInArrow(
        _scorer(network), f"doc_id {kind}, held_out boolean, score double, predicted int")
