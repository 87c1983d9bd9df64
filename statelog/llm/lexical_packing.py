"""Lexical retrieval packing: each sequence holds a seed document and its nearest neighbours.

Documents are token ids; a token of the public vocabulary is a term, so document frequencies are one
bounded table, counted over all documents. Every document is routed by its three most characteristic
terms, frequent in it and late in the vocabulary, which lists its terms from common to rare: a range
sort brings documents with the same such terms together. A task goes
through its range in shards of bounded size. A shard is an inverted index with BM25 weights; the next
unused document is a seed, the index ranks the unused ones, and they fill the seed's window greedily,
best first. The best one that does not fit is cut to fill the window to the last token, and its rest
is the next seed. What a shard leaves over goes into the next one. So no sequence is padded: all are
full, but for those of the last few tokens of a task, which have powers of two as their lengths.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.llm import words
from statelog.llm.common import as_bytes, batched, stored, worker_cache
from statelog.llm.windows import segment_hashes
from statelog.llm.words import WordTable

VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks, which another library reads faster.
RANKS = "byte_bpe_50k.tiktoken"
LENGTH = 2048
END = 1
#: Usual constants of BM25.
SATURATION, NORMALISED = 1.2, 0.75
#: Tokens and documents of a shard.
SHARD_TOKENS, SHARD_DOCUMENTS = 1 << 19, 1 << 12
#: Tokens that a task goes through, about, where there are more than the session's partitions hold.
TASK_TOKENS = 1 << 28

_PIECE = ("doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


# ------------------------------------------------------------------ tokens


#: Bytes that may follow a space at which the pre-tokeniser cuts for certain: visible ASCII, and first
#: bytes of characters of which none is white space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = _VISIBLE[0xC3:0xE1] = _VISIBLE[0xE4:0xF5] = True


class Tokens(WordTable):
    """Ids of whole texts, as the vocabulary's own tokeniser gives them.

    A space before a visible character always begins a new part of the pre-tokeniser, which joins it
    to that character; so a text is cut there, and each distinct piece is tokenised once in a worker.
    """

    def __init__(self, vocabulary: str, ranks: str) -> None:
        import tiktoken
        import tokenizers

        super().__init__()
        self.own = tokenizers.Tokenizer.from_file(vocabulary)
        #: Texts with one of these strings are not ordinary text to the tokeniser.
        self.marks = [t.content.encode() for t in self.own.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        #: The ids of one part, without looking for others in it.
        self.one = self.fast._core_bpe.encode_single_piece
        self.after = {mark.encode(): self.fast.encode_ordinary(mark) for mark in ".,;:!?)"}

    def tokenised(self, words: list[bytes]) -> list[list[int]]:
        return [self._piece(word) for word in words]

    def _piece(self, piece: bytes) -> list[int]:
        # ASCII letters, with a space before them or not, are one part; so is a mark behind them.
        if piece[piece[:1] == b" " :].isalpha():
            return self.one(piece)
        if piece[-1:] in self.after and piece[piece[:1] == b" " : -1].isalpha():
            return self.one(piece[:-1]) + self.after[piece[-1:]]
        return self.fast.encode_ordinary(piece.decode())

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, with its end."""
        marked = {i for i, t in enumerate(texts) if any(mark in t for mark in self.marks)}
        found, bounds = self._pieces([b"" if i in marked else t for i, t in enumerate(texts)])
        out = []
        for i, (first, last) in enumerate(zip(bounds, bounds[1:])):
            ids = found[first:last]
            if i in marked:
                ids = self.own.encode(texts[i].decode(), add_special_tokens=False).ids
            out.append(np.append(np.asarray(ids, "<u4"), np.uint32(END)))
        return out

    def _pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts in a row, and where those of each text begin."""
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 0x20) & _VISIBLE[data[1:]] if len(data) else False
        # What follows the last space of a text is another text.
        cut[np.maximum(at - 1, 0)] = False
        cut[at] = True
        begin = np.flatnonzero(cut)
        starts, ends = begin[:-1], begin[1:]
        keys, first, which = np.unique(
            segment_hashes(data, starts, ends, self.powers), return_index=True, return_inverse=True)
        known = self._known(keys)
        if not known.all():
            if len(self.keys) + len(keys) > words.CACHED_WORDS:
                self._clear()
                known[:] = False
            new = first[~known]
            self._learn(keys[~known], [joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        place = np.searchsorted(self.keys, keys)
        begin, count = self.start[place][which], self.count[place][which]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        ids = np.frombuffer(self.flat or b"", np.uint32)[np.repeat(begin, count) + step]
        before = np.concatenate(([0], np.cumsum(count)))
        return ids, before[np.searchsorted(starts, at)]


def _packed(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit, else in four after an odd byte."""
    return ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\0" + ids.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4", offset=1) if len(data) % 2 else np.frombuffer(data, "<u2").astype("<u4")


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a document or a part of it, with their counts; its end is no term."""
    return np.unique(ids[:-1] if len(ids) and ids[-1] == END else ids, return_counts=True)


def route(term: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The three most characteristic terms, the first one first; -1 stands for a missing one."""
    weight = np.log1p(term) * (count / (count + SATURATION))
    out = np.full(3, -1, np.int32)
    heavy = term[np.lexsort((term, -weight))[:3]]
    out[: len(heavy)] = heavy
    return out


_ROW = ["part", "doc_id", "ids", "first", "second", "third"]


def _tokenised(batches: Iterator[pa.RecordBatch], vocabulary: str, ranks: str) -> Iterator[pa.RecordBatch]:
    """Documents with their route (part 0), and at the end the counts of the task (part 1): in how
    many documents each term is, documents and tokens."""
    tokens = worker_cache(f"lexical packing: {vocabulary}", lambda: Tokens(vocabulary, ranks))
    found, documents, size, kind = np.zeros(0, np.int64), 0, 0, None
    for batch in batched(batches, "text"):
        kind = batch.schema.field("doc_id").type
        packed, routes = [], []
        for ids in tokens.ids([t or b"" for t in as_bytes(batch.column("text"))]):
            term, count = terms_of(ids)
            if len(term) and term[-1] >= len(found):
                found = np.concatenate((found, np.zeros(int(term[-1]) + 1 - len(found), np.int64)))
            found[term] += 1
            documents, size = documents + 1, size + len(ids)
            packed.append(_packed(ids))
            routes.append(route(term, count))
        keys = np.array(routes, np.int32).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(packed), np.int32)), batch.column("doc_id"), pa.array(packed, pa.binary()),
             *(pa.array(keys[:, k]) for k in range(3))], names=_ROW)
    if documents:
        counts = np.concatenate(([documents, size], found)).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([1], pa.int32()), pa.nulls(1, kind), pa.array([counts], pa.binary()),
             *(pa.nulls(1, pa.int32()) for _ in range(3))], names=_ROW)


# ------------------------------------------------------------------ statistics of the corpus


@dataclass(frozen=True)
class Corpus:
    """Number of documents and of tokens, and in how many documents each term is."""

    documents: int
    tokens: int
    frequency: np.ndarray

    def idf(self) -> np.ndarray:
        there = self.frequency
        return np.log1p((self.documents - there + 0.5) / (there + 0.5)).astype(np.float32)

    def weights(self, count: np.ndarray, term: np.ndarray, size: np.ndarray) -> np.ndarray:
        """BM25 weights of terms that occur ``count`` times in documents of ``size`` tokens."""
        norm = SATURATION * (1 - NORMALISED + NORMALISED * size * (self.documents / max(1, self.tokens)))
        return self.idf()[term] * count * (SATURATION + 1) / (count + norm)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of some tasks together, a row for each that is not 0."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for data in as_bytes(batch.column("ids")):
            counts = np.frombuffer(data, "<i8")
            total = np.concatenate((total, np.zeros(max(0, len(counts) - len(total)), np.int64)))
            total[: len(counts)] += counts
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])


def statistics(counts: DataFrame) -> Corpus:
    """The counts over all documents; no more rows than the vocabulary has terms come to the driver."""
    rows = counts.select("ids").mapInArrow(_summed, "place long, n long")
    found = {r["place"]: r["n"] for r in rows.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    whole = np.zeros(max(found, default=1) + 1, np.int64)
    whole[list(found)] = list(found.values())
    return Corpus(int(whole[0]), int(whole[1]), whole[2:])


# ------------------------------------------------------------------ shards


@dataclass
class _Item:
    """A document, or what is left of one, from ``start`` on."""

    doc: object
    ids: np.ndarray
    start: int

    @property
    def length(self) -> int:
        return len(self.ids) - self.start


class Shard:
    """An inverted index over items, with BM25 weights by the statistics of the whole corpus."""

    def __init__(self, parts: list[np.ndarray], corpus: Corpus) -> None:
        found = [terms_of(ids) for ids in parts]
        owner = np.repeat(np.arange(len(parts)), [len(t) for t, _ in found])
        term = np.concatenate([t for t, _ in found]).astype(np.int64)
        count = np.concatenate([c for _, c in found])
        size = np.array([len(ids) for ids in parts], np.float32)
        order = np.argsort(term, kind="stable")
        items = owner[order]
        weights = corpus.weights(count[order].astype(np.float32), term[order], size[items]).astype(float)
        #: The postings of each term: items and their weights.
        self.terms, first = np.unique(term[order], return_index=True)
        self.items, self.weights = np.split(items, first[1:]), np.split(weights, first[1:])
        self.queries = [t for t, _ in found]
        self.size = len(parts)

    def scores(self, item: int) -> np.ndarray:
        """The BM25 score of every item for the distinct terms of one of them."""
        at = np.searchsorted(self.terms, self.queries[item]).tolist()
        if not at:
            return np.zeros(self.size)
        met = np.concatenate([self.items[t] for t in at])
        return np.bincount(met, np.concatenate([self.weights[t] for t in at]), self.size)


def fill(ranked: np.ndarray, lengths: np.ndarray, room: int) -> tuple[list[int], int]:
    """Items that fit, best first, and the room that is left."""
    taken: list[int] = []
    while room and len(ranked):
        ranked = ranked[lengths[ranked] <= room]
        fits = int(np.searchsorted(np.cumsum(lengths[ranked]), room, side="right"))
        taken += ranked[:fits].tolist()
        room -= int(lengths[ranked[:fits]].sum())
        ranked = ranked[fits:]
    return taken, room


class _Packer:
    """Packs the documents of a task, a shard at a time, and gathers the rows of their pieces."""

    def __init__(self, corpus: Corpus, first_sequence: int) -> None:
        self.corpus, self.sequence = corpus, first_sequence
        self.items: list[_Item] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc: object, ids: np.ndarray) -> None:
        """A document; its full sequences stand alone, the rest is packed with others."""
        start = 0
        while len(ids) - start >= LENGTH:
            self._sequence([(_Item(doc, ids, start), LENGTH)])
            start += LENGTH
        if start < len(ids):
            self.items.append(_Item(doc, ids, start))
            self.tokens += len(ids) - start
        if self.tokens >= SHARD_TOKENS or len(self.items) >= SHARD_DOCUMENTS:
            self._shard()

    def _sequence(self, parts: list[tuple[_Item, int]]) -> None:
        offset = 0
        for item, length in parts:
            ids = item.ids[item.start : item.start + length]
            self.rows.append(
                (item.doc, item.start, length, zlib.crc32(ids.tobytes()), len(item.ids), self.sequence, offset))
            item.start += length
            offset += length
        self.sequence += 1

    def _shard(self) -> None:
        """Full windows of the items at hand; those that are left make no full one."""
        items = self.items
        lengths = np.array([i.length for i in items])
        index = Shard([i.ids[i.start :] for i in items], self.corpus)
        left, seed = int(lengths.sum()), 0
        while left >= LENGTH:
            if not lengths[seed]:
                seed = int(np.flatnonzero(lengths)[0])
            room = LENGTH - int(lengths[seed])
            unused = lengths > 0
            unused[seed] = False
            candidates = np.flatnonzero(unused)
            ranked = candidates[np.argsort(-index.scores(seed)[candidates], kind="stable")]
            taken, room = fill(ranked, lengths, room)
            parts = [(items[i], int(lengths[i])) for i in (seed, *taken)]
            lengths[[seed, *taken]] = 0
            if room:
                # The best one that is left is longer than the room.
                seed = int(next(i for i in ranked if lengths[i]))
                parts.append((items[seed], room))
                lengths[seed] -= room
            self._sequence(parts)
            left -= LENGTH
        self.items = [item for item, length in zip(items, lengths) if length]
        self.tokens = left

    def close(self) -> None:
        """The last tokens, fewer than a window, in sequences of powers of two."""
        if self.items:
            self._shard()
        left = self.tokens
        while left:
            room = 1 << left.bit_length() - 1
            left -= room
            parts = []
            while room:
                item = self.items[0]
                length = min(room, item.length)
                parts.append((item, length))
                room -= length
                if length == item.length:
                    self.items.pop(0)
            self._sequence(parts)
        self.tokens = 0

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _packs(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    packer, kind = _Packer(corpus, TaskContext.get().partitionId() << 40), None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for doc, data in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("ids"))):
            packer.add(doc, _unpacked(data))
        yield packer.batch(kind)
    if kind is not None:
        packer.close()
        yield packer.batch(kind)


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is the ids of its whole text and the end id; a NULL text is empty, so its only piece
    is the end id. The pieces of a document follow one another and hold each id once. Documents
    without terms, ties of scores and repeated rows keep the order of the sort; repeated rows are
    packed each for itself, and a NULL ``doc_id`` stays NULL. A very long text is many full sequences,
    and only its last tokens meet others. An empty table gives no rows; other columns are ignored.

    ``vocabulary`` and ``ranks`` are the same vocabulary for the two libraries that read it.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    ranks = ranks or public_tokenizers.path(RANKS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Two jobs read the tokens; none of them tokenises again.
    written = stored(
        docs.select("doc_id", "text").mapInArrow(
            lambda batches: _tokenised(batches, vocabulary, ranks),
            f"part int, doc_id {kind}, ids binary, first int, second int, third int"),
        "lexical-tokens", partitioned="part")
    corpus = statistics(written.where("part = 1"))
    routed = written.where("part = 0").drop("part")
    # The last key spreads documents with the same terms, copies above all.
    routed = routed.withColumn("tie", F.monotonically_increasing_id())
    keys = ["first", "second", "third", "doc_id", "tie"]
    session = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(session, -(-corpus.tokens // TASK_TOKENS))
    ranges = routed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return ranges.select("doc_id", "ids").mapInArrow(
        lambda batches: _packs(batches, corpus), _PIECE.format(kind=kind))
