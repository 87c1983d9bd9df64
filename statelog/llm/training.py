"""What the classifiers trained in numpy share: labelled rows, Adam, and calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A document whose remainder is 0 is held out; labels are learnt from the others only.
FOLDS = 5


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_label: int, longest: int
) -> tuple[list[bytes], np.ndarray, float]:
    """Texts, labels, and the share of label 1 among all that may be learnt from, of at most ``per_label`` documents of each label, none longer than
    ``longest`` code points, so that the driver holds a bounded sample.

    The documents are the first ones in the order of a hash of their ids; held-out ones and those
    without an id, a text or a label are not among them. Of rows that share an id, the smallest text
    counts, so that an id brings one row to the driver however often it is repeated.
    """
    known = labels.where(F.col(label).isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = [
        known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        for value in (0, 1)
    ]
    # One row for each of the chosen ids, twice ``per_label`` at most.
    rows = docs.select("doc_id", "text").where(F.length("text") <= longest).join(
        F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    share = known.agg(F.coalesce(F.avg("label"), F.lit(0.5))).first()[0]
    found = sorted((r.doc_id, r.text, r.label) for r in rows.collect())
    return [text.encode() for _, text, _ in found], np.array([y for _, _, y in found], np.float64), float(share)


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, int]:
    """(doc_id, label, text) of all documents that may be learnt from, and how many labels say so.

    Held-out documents and those without an id, a text or a label are not among them. Of rows that
    share an id, the smallest text counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 0))
    return rows.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), known.count()


#: Numbers in a row of a vector, and rows of sums that one task of a first step adds up.
_CHUNK, _NEAR = 8_192, 16
_SUMS = "chunk int, salt int, sums binary"


def total(rows: DataFrame, vector: Callable[[pa.RecordBatch, int], np.ndarray]) -> np.ndarray | None:
    """The sum of a vector over all rows, None without rows. Vectors are added across partitions, in
    two steps; only the sum reaches the driver."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = None
        for batch in batches:
            for i in range(batch.num_rows):
                found = vector(batch, i)
                out = found if out is None else out + found
        if out is not None:
            parts = range(0, len(out), _CHUNK)
            salt = TaskContext.get().partitionId() % _NEAR
            yield pa.RecordBatch.from_arrays(
                [pa.array([p // _CHUNK for p in parts], pa.int32()), pa.array([salt] * len(parts), pa.int32()),
                 pa.array([out[p : p + _CHUNK].astype("<f8").tobytes() for p in parts], pa.binary())],
                names=["chunk", "salt", "sums"])

    def add(table: pa.Table) -> pa.Table:
        # In the order of their bytes, whatever order they come in.
        out = sum(np.frombuffer(x, "<f8") for x in sorted(table.column("sums").to_pylist()))
        return pa.table({"chunk": table.column("chunk")[:1], "salt": table.column("salt")[:1],
                         "sums": pa.array([out.tobytes()], pa.binary())})

    near = rows.mapInArrow(vectors, _SUMS).groupBy("chunk", "salt").applyInArrow(add, _SUMS)
    found = sorted(near.groupBy("chunk").applyInArrow(add, _SUMS).collect(), key=lambda r: r.chunk)
    return np.concatenate([np.frombuffer(r.sums, "<f8") for r in found]) if found else None


def row_products(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """``rows @ matrix``, each row's products added one after another.

    A row's result depends on the row alone. A library's product may add in another order for other
    numbers of rows, and equal texts would then differ in their last bits from batch to batch.
    """
    out = np.zeros((len(rows), matrix.shape[1]), np.result_type(rows, matrix))
    for k, weights in enumerate(matrix):
        out += rows[:, k, None] * weights
    return out


class Adam:
    """Steps for a dictionary of parameters."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float) -> None:
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.square = {k: np.zeros_like(v) for k, v in parameters.items()}

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        for name, gradient in gradients.items():
            mean, square = self.mean[name], self.square[name]
            mean += 0.1 * (gradient - mean)
            square += 0.001 * (gradient * gradient - square)
            rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
            self.parameters[name] -= rate * mean / (np.sqrt(square) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def best_threshold(logits: np.ndarray, labels: np.ndarray, common: float = 1.0) -> float:
    """The logit above which the F1 of label 1 is best, in the middle of its gap, where each row of
    label 0 stands for ``common`` rows."""
    order = np.argsort(-logits, kind="stable")
    ranked, hits = logits[order], np.cumsum(labels[order])
    f1 = 2 * hits / (hits + common * np.cumsum(1 - labels[order]) + labels.sum())
    # A cut lies between different values only.
    f1[:-1][ranked[:-1] == ranked[1:]] = -1
    at = int(np.argmax(f1))
    below = ranked[at + 1] if at + 1 < len(ranked) else ranked[at] - 1
    return float((ranked[at] + below) / 2)
