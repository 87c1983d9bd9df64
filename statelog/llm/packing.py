"""Hierarchical residual packing: documents as tokens into sequences of a fixed length.

Each partition packs its pieces by best fit, longest first, and lets go of bins that are nearly
full. What is left travels up a tree: the underfull bins of ``FAN_IN`` neighbours are items of one
more best-fit round, until one group is left. A group passes on its ``CARRIED`` emptiest bins at
most and lets the others go, so no task ever holds more than ``FAN_IN * CARRIED`` items, whatever
the size of the corpus; every piece is in a bin either way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.llm.common import as_bytes, batched, stored, worker_cache
from statelog.llm.words import WordTable

VOCABULARY = "word_bpe_49k.json"
LENGTH = 4096
END = 1
#: A bin with fewer free places than this is nearly full.
SLACK = 8
FAN_IN = 8
CARRIED = 4096
#: Parts of words that a worker keeps, at most; then it starts anew.
CACHED_PARTS = 60_000

_PIECE = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"
#: The pre-tokeniser's parts of an ASCII word without an apostrophe.
_PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+").findall
_MARKS = b".,;:!?()[]{}#*$%&|-+=/"


class Words(WordTable):
    """Token ids of texts by the public vocabulary.

    The vocabulary's normaliser and pre-tokeniser keep no token across a blank, so the ids of a text
    are those of its words in a row, and it lower-cases A-Z. A text that may hold one of the special
    marks is tokenised as a whole.
    """

    lower = True

    def __init__(self, path: str) -> None:
        import tokenizers

        super().__init__()
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.parts: dict[bytes, tuple[int, ...]] = {}

    def tokenised(self, words: list[bytes]) -> list[tuple[int, ...]]:
        return [self._word(word) for word in words]

    def _part(self, part: bytes) -> tuple[int, ...]:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) > CACHED_PARTS:
                self.parts.clear()
            ids = self.parts[part] = tuple([t.id for t in self.tokenize(part.decode())])
        return ids

    def _word(self, word: bytes) -> tuple[int, ...]:
        # Most words are ASCII letters, with a mark behind them or not.
        if word.isalpha():
            return tuple([t.id for t in self.tokenize(word.decode())])
        if word[:-1].isalpha() and word[-1:] in _MARKS:
            return self._part(word[:-1]) + self._part(word[-1:])
        # Printable ASCII stands for itself in the byte-level alphabet.
        if word.isascii() and b"'" not in word and word.decode().isprintable():
            return self._parts(word)
        # ASCII marks after a letter are a part of their own.
        stem = word.rstrip(_MARKS)
        text = stem.decode()
        if len(stem) < len(word) and text[-1:].isalpha():
            return self._stem(stem, text) + self._parts(word[len(stem) :])
        return self._stem(word, word.decode())

    def _parts(self, text: bytes) -> tuple[int, ...]:
        return tuple([i for part in _PARTS(text) for i in self._part(part)])

    def _stem(self, stem: bytes, text: str) -> tuple[int, ...]:
        ids = self.parts.get(stem)
        if ids is None:
            if len(self.parts) > CACHED_PARTS:
                self.parts.clear()
            parts = self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text))
            ids = self.parts[stem] = tuple([t.id for part, _ in parts for t in self.tokenize(part)])
        return ids

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        marked = {i: t for i, t in enumerate(texts) if b"<|" in t}
        found = self.lookup([b"" if i in marked else t for i, t in enumerate(texts)])
        out = [found.tokens(i) for i in range(len(texts))]
        for i, text in marked.items():
            out[i] = np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return out


def _cut(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The pieces of each document: places and a checksum of the ids."""
    words = worker_cache(f"packing: {path}", lambda: Words(path))
    for batch in batched(batches, "text"):
        owner, rows = [], []
        for i, ids in enumerate(words.ids([t or b"" for t in as_bytes(batch.column("text"))])):
            ids = np.append(ids, np.uint32(END)).astype("<u4")
            for n, start in enumerate(range(0, len(ids), LENGTH)):
                part = ids[start : start + LENGTH]
                owner.append(i)
                rows.append((n, start, len(part), zlib.crc32(part.tobytes())))
        n, start, length, crc = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(n, pa.int32()),
             *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers: longest first, each item into the fullest bin that holds it."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(length + 1)]
    #: Bit r says that a bin with r free places exists.
    open_ = 0
    for i in order:
        size = sizes[i]
        fitting = open_ >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = free[room].pop()
            if not free[room]:
                open_ &= ~(1 << room)
            bins[number].append(i)
        else:
            room, number = length, len(bins)
            bins.append([i])
        room -= size
        if room:
            free[room].append(number)
            open_ |= 1 << room
    return bins


def _round(items: list[tuple[int, list]], last: bool) -> tuple[list, list]:
    """(bins to let go, bins to carry on) of one group; an item is (fill, pieces)."""
    bins = []
    for numbers in best_fit([fill for fill, _ in items]):
        bins.append((sum(items[i][0] for i in numbers), [p for i in numbers for p in items[i][1]]))
    if last:
        return bins, []
    under = sorted((b for b in bins if b[0] < LENGTH - SLACK), key=lambda b: b[0])
    done = [b for b in bins if b[0] >= LENGTH - SLACK] + under[CARRIED:]
    return done, under[:CARRIED]


def _bin_rows(done: list, carried: list, group: int, piece: pa.DataType) -> pa.Table:
    bins = done + carried
    return pa.table(
        {
            "done": pa.array([True] * len(done) + [False] * len(carried)),
            "bucket": pa.array([group] * len(bins), pa.int64()),
            "fill": pa.array([b[0] for b in bins], pa.int64()),
            "pieces": pa.array([b[1] for b in bins], pa.list_(piece)),
        }
    )


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    table = [b for b in batches if b.num_rows]
    if not table:
        return
    rows = pa.Table.from_batches(table).to_struct_array().combine_chunks()
    items = [(p["length"], [p]) for p in rows.to_pylist()]
    done, carried = _round(items, False)
    yield from _bin_rows(done, carried, TaskContext.get().partitionId(), rows.type).to_batches()


def _merge(last: bool):
    def merge(table: pa.Table) -> pa.Table:
        items = list(zip(table.column("fill").to_pylist(), table.column("pieces").to_pylist()))
        # Groups are small enough to be held; in any order of arrival the result is the same.
        items.sort(key=lambda b: (-b[0], str(b[1][0])))
        done, carried = _round(items, last)
        group = table.column("bucket")[0].as_py()
        return _bin_rows(done, carried, group, table.schema.field("pieces").type.value_type)

    return merge


def pieces_of(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every document, of LENGTH tokens but the last; see ``pack``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _cut(batches, path), _PIECE.format(kind=kind))


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece with its sequence and its place there.

    A document is the ids of its whole text and the end id; a NULL text is empty, so its piece is
    the end id alone. Only documents longer than a sequence are cut. Equal lengths and repeated rows
    are packed like any others; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"done boolean, bucket long, fill long, pieces array<struct<{_colons(_PIECE.format(kind=kind))}>>"
    # The first round reads what tokenisation wrote, so that a lost task does not tokenise again.
    pieces = pieces_of(docs, vocabulary)
    rows = stored(pieces.mapInArrow(_first_round, shape), "packing-0")
    finished, rest = [rows.where("done")], rows.where("not done")
    groups = (rest.agg(F.max("bucket")).first()[0] or 0) + 1
    level = 1
    while not rest.isEmpty():
        groups = -(-groups // FAN_IN)
        grouped = rest.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        merged = grouped.groupBy("bucket").applyInArrow(_merge(groups == 1), shape)
        rows = stored(merged, f"packing-{level}")
        finished.append(rows.where("done"))
        rest = rows.where("not done")
        level += 1
    bins = reduce(DataFrame.union, finished).withColumn("sequence_id", F.monotonically_increasing_id())
    lengths = F.transform("pieces", lambda p: p["length"])
    at = F.transform("pieces", lambda p, i: F.struct(
        *(p[c].alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), i.alias("place")))
    each = bins.select("sequence_id", lengths.alias("lengths"), F.explode(at).alias("p"))
    before = F.aggregate(F.slice("lengths", 1, F.col("p.place")), F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", before.alias("offset"))


def _colons(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(","))
