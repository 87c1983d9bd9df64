"""A hidden Markov language model, trained by Baum-Welch over all training documents.

Documents are read once, as blocks of word numbers with the words of the block. Words are dealt into
slots by their hash; a block's words of a slot are one packed row, and counts are summed over all blocks
slot by slot. The most frequent words, ``TOP`` at most, are classes of their own; all others fall
into ``ENDINGS`` classes by their last bytes, and unseen words are one class. Rounds learn the classes;
a last one gathers the expected count of every word of an ending class in each state, as a table that
grows with the corpus. The probability of a word is that of its class in the state times its share of
the class in the state, smoothed by its share in all states, so the model sums to one over the words
and the unseen one.

Each round, every block gives expected counts of its transitions and emissions; they are summed in
two steps across partitions, and only the sums, by class, reach the driver. For
training, documents are cut into runs of ``SEGMENT`` tokens; a run inside a document starts from the
mean state. Scores are exact: the scaled forward recursion runs over whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.llm import windows
from statelog.llm.common import as_bytes, stored, worker_cache
from statelog.llm.shingles import _LOWER, word_bounds, word_hashes

STATES = 8
TOP = 16_384
ENDINGS = 2_048
ROUNDS = 5
SEGMENT = 512
#: Tokens of a block, at least one document.
BLOCK_TOKENS = 2_000_000
SMOOTH = 0.1
#: Weight of the unigram shares in the emissions of a state.
PRIOR = 200.0
#: Weight of a word's share of its class in the emissions of the word by a state.
WORD_PRIOR = 5.0

#: The end of a document among word hashes.
END = np.uint64(0x5EED0FE4D)
_WORD_CLASSES = 1 + ENDINGS + TOP


# ---- blocks -----------------------------------------------------------------------------------


def _squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _expanded(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _endings(text: bytes) -> np.ndarray:
    """A number below ENDINGS for each word, from its last three bytes."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    starts, ends = word_bounds(data)
    value = np.zeros(len(starts), np.uint64)
    for back in (1, 2, 3):
        inside = ends - back >= starts
        byte = np.where(inside, data[np.maximum(ends - back, 0)] if len(data) else 0, 0)
        value = windows.mixed(value * np.uint64(0x9E3779B97F4A7C15) + byte.astype(np.uint64) + np.uint64(1))
    return (value % np.uint64(ENDINGS)).astype(np.int16)


def _block(number: int, docs: list[tuple]) -> tuple[tuple, tuple]:
    """The row of a block, and the columns of its words."""
    words = np.concatenate([d[2] for d in docs])
    ending = np.concatenate([d[3] for d in docs])
    lengths = np.array([len(d[2]) for d in docs], np.int64)
    trained = np.repeat(np.array([d[4] for d in docs], bool), lengths)
    found, first, token, count = np.unique(words, return_index=True, return_inverse=True, return_counts=True)
    # Frequent words get small numbers, which compress well.
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    used = np.bincount(token, trained, len(found))[order].astype(np.int64)
    row = (number, [d[0] for d in docs], [d[1] for d in docs], lengths.tolist(), [d[4] for d in docs],
           _squeezed(rank[token]))
    return row, (found[order].view(np.int64), ending[first[order]], used)


_BLOCK = ["block", "doc_ids", "held_out", "trained", "lengths", "tokens", "words", "endings", "used"]


def _read(doc_type: pa.DataType):
    """A function from documents to blocks, with the packed words of each."""

    def block(number: int, docs: list[tuple]) -> pa.RecordBatch:
        row, (word, ending, used) = _block(number, docs)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([row[1]], pa.list_(doc_type)),
             pa.array([row[2]], pa.list_(pa.bool_())), pa.array([row[4]], pa.list_(pa.bool_())),
             pa.array([row[3]], pa.list_(pa.int64())), pa.array([row[5]], pa.binary()),
             pa.array([_squeezed(word)], pa.binary()), pa.array([_planes(ending.astype("<u2"))], pa.binary()),
             pa.array([_planes(used)], pa.binary())], names=_BLOCK)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        powers = worker_cache("hmm: powers", windows.Powers)
        number, docs, total = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held, trained = batch.column("held_out").to_pylist(), batch.column("trained").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for i, text in enumerate(as_bytes(batch.column("text"))):
                words = np.append(word_hashes(text or b"", powers), END)
                if docs and total + len(words) > BLOCK_TOKENS:
                    yield block(number, docs)
                    number, docs, total = number + 1, [], 0
                docs.append((ids[i], held[i], words, np.append(_endings(text or b""), np.int16(0)), trained[i]))
                total += len(words)
        if docs:
            yield block(number, docs)

    return read


def _planes(values: np.ndarray) -> bytes:
    """Integers packed by the planes of their bytes: small ones leave the high planes empty."""
    size = values.dtype.itemsize
    return _squeezed(np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T)


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(_expanded(data, "u1").reshape(size, -1).T).view(kind).ravel()


def _slots(word: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by slot and word, and where each slot begins in it, with the end."""
    slot = windows.mixed(word.view(np.uint64)) % np.uint64(slots)
    order = np.lexsort((word, slot))
    return order, np.searchsorted(slot[order], np.arange(slots + 1))


def _slotted(slots: int):
    """The words of each block in packed rows by slot: a few rows a block, which Spark deals out."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                word = _expanded(batch.column("words")[i].as_py(), "<i8")
                columns = (word, _from_planes(batch.column("endings")[i].as_py(), "<u2"),
                           _from_planes(batch.column("used")[i].as_py(), "<i8"))
                order, bounds = _slots(word, slots)
                parts = [order[a:b] for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(slots, batch.column("block")[i].as_py(), np.int64)),
                     pa.array(np.arange(slots, dtype=np.int32)),
                     *(pa.array([pack(c[p]) for p in parts], pa.binary())
                       for c, pack in zip(columns, (_squeezed, _planes, _planes)))],
                    names=["block", "slot", "words", "endings", "used"])

    return pieces


_TOTALS = "block long, slot int, totals binary, index binary, words binary, endings binary"


def _totalled(table: pa.Table) -> pa.Table:
    """For the words of a slot, their counts over all blocks: a row for each block, in its order, with the
    word's number in the slot, 0 if no other block has it; and a row without a block of all words."""
    blocks = table.column("block").to_pylist()
    lists = [_expanded(x, "<i8") for x in table.column("words").to_pylist()]
    word, first, inverse, holders = np.unique(
        np.concatenate(lists), return_index=True, return_inverse=True, return_counts=True)
    used = np.concatenate([_from_planes(x, "<i8") for x in table.column("used").to_pylist()])
    ending = np.concatenate([_from_planes(x, "<u2") for x in table.column("endings").to_pylist()])[first]
    total = np.zeros(len(word), np.int64)
    np.add.at(total, inverse, used)
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    mine = np.split(inverse, cuts)
    known = total > 0
    size = len(blocks)
    return pa.table({
        "block": pa.array([*blocks, None], pa.int64()),
        "slot": pa.array(table.column("slot").to_pylist() + [table.column("slot")[0].as_py()], pa.int32()),
        "totals": pa.array([*(_planes(total[k]) for k in mine), _planes(total[known])], pa.binary()),
        "index": pa.array([*(_planes(np.where(holders[k] > 1, k + 1, 0)) for k in mine), None], pa.binary()),
        "words": pa.array([None] * size + [_squeezed(word[known])], pa.binary()),
        "endings": pa.array([None] * size + [_planes(ending[known])], pa.binary())})


def _steps(total: np.ndarray) -> np.ndarray:
    """Steps of a sixteenth of a power of two."""
    return np.floor(np.log2(total) * 16).astype(np.int32)


def _counted_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and tokens by step of the count, of each slot."""
    for batch in batches:
        for i in range(batch.num_rows):
            total = _from_planes(batch.column("totals")[i].as_py(), "<i8")
            step, inverse = np.unique(_steps(total), return_inverse=True)
            tokens = np.zeros(len(step), np.int64)
            np.add.at(tokens, inverse, total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(step, pa.int32()), pa.array(np.bincount(inverse, minlength=len(step)).astype(np.int64)), pa.array(tokens)],
                names=["step", "types", "tokens"])


def _top_words(least: int):
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                total = _from_planes(batch.column("totals")[i].as_py(), "<i8")
                found = _expanded(batch.column("words")[i].as_py(), "<i8")[_steps(total) >= least]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["word"])

    return words


def _kinds(word: np.ndarray, ending: np.ndarray, total: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The class of each word; ``top`` holds the frequent words in order."""
    at = np.searchsorted(top, word)
    frequent = np.zeros(len(word), bool)
    if len(top):
        frequent = top[np.minimum(at, len(top) - 1)] == word
    return np.where(total == 0, 0, np.where(frequent, at + 1 + ENDINGS, ending.astype(np.int64) + 1)).astype(np.uint16)


def _class_mass(top: np.ndarray):
    """Words and tokens by class, of each slot."""

    def mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                total = _from_planes(batch.column("totals")[i].as_py(), "<i8")
                kind, inverse = np.unique(_kinds(
                    _expanded(batch.column("words")[i].as_py(), "<i8"),
                    _from_planes(batch.column("endings")[i].as_py(), "<u2"), total, top), return_inverse=True)
                tokens = np.zeros(len(kind), np.int64)
                np.add.at(tokens, inverse, total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind.astype(np.int32)), pa.array(np.bincount(inverse, minlength=len(kind)).astype(np.int64)),
                     pa.array(tokens)], names=["kind", "types", "tokens"])

    return mass


def _by_ending(kind: np.ndarray) -> np.ndarray:
    return (kind > 0) & (kind <= ENDINGS)


class Unigrams:
    """What base scores and class shares need: N, V, and the smoothed mass of each class."""

    def __init__(self, tokens: int, types: int, mass: np.ndarray) -> None:
        self.tokens, self.types = tokens, types
        self.total = tokens + SMOOTH * (types + 1)
        self.mass = mass
        self.share = mass / self.total


def _classified(unigrams: Unigrams, top: np.ndarray, slots: int):
    """A block with counts and classes of its words, and known words and base score of its documents.
    Words of ending classes that other blocks hold have their numbers in the slot in ``index``, by slot."""

    def classify(blocks: pa.Table, pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("slot")
        one = lambda name: blocks.column(name)[0].as_py()
        word = _expanded(one("words"), "<i8")
        order, _ = _slots(word, slots)
        count, index = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
        count[order] = np.concatenate([_from_planes(x, "<i8") for x in pieces.column("totals").to_pylist()])
        index[order] = np.concatenate([_from_planes(x, "<i8") for x in pieces.column("index").to_pylist()])
        kind = _kinds(word, _from_planes(one("endings"), "<u2"), count, top)
        index[~_by_ending(kind)] = 0
        token, lengths = _expanded(one("tokens"), "<u4"), np.array(one("lengths"), np.int64)
        starts = np.cumsum(lengths) - lengths
        known = np.add.reduceat((count > 0)[token].astype(np.int64), starts)
        base = np.add.reduceat(np.log10((count + SMOOTH) / unigrams.total)[token], starts)
        # The places of words that others hold, by slot and word.
        shared = order[index[order] > 0]
        slot = (windows.mixed(word.view(np.uint64)) % np.uint64(slots)).astype(np.int64)
        columns = {c: blocks.column(c) for c in ("block", "doc_ids", "held_out", "trained", "lengths", "tokens")}
        columns |= {
            "counts": pa.array([_planes(count)], pa.binary()), "kinds": pa.array([_planes(kind)], pa.binary()),
            "index": pa.array([_planes(slot[shared] << 32 | index[shared] - 1)], pa.binary()),
            "order": pa.array([_planes(shared.astype("<u4"))], pa.binary()),
            "known": pa.array([known], pa.list_(pa.int64())), "base": pa.array([base], pa.list_(pa.float64()))}
        return pa.table(columns)

    return classify


# ---- the model --------------------------------------------------------------------------------


class Model:
    """Start, transition and emission probabilities; emissions by class, then state."""

    def __init__(self, start: np.ndarray, mean: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.mean, self.move, self.emit = start, mean, move, emit

    @classmethod
    def first(cls, share: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        """States that differ at random from the unigram shares and seldom change."""
        pick = np.random.default_rng(seed)
        emit = share[:, None] * np.exp(0.7 * pick.standard_normal((len(share), states)))
        emit = cls._unseen(emit, share)
        move = np.full((states, states), 0.02 / max(states - 1, 1))
        np.fill_diagonal(move, 0.98 if states > 1 else 1.0)
        even = np.full(states, 1.0 / states)
        return cls(even, even, move, emit)

    @classmethod
    def from_counts(cls, start, mean, move, emit, share) -> Model:
        start = (start + 1) / (start + 1).sum()
        move = (move + 0.5) / (move + 0.5).sum(1, keepdims=True)
        mean = (mean + 1) / (mean + 1).sum()
        return cls(start, mean, move, cls._unseen(emit + PRIOR * share[:, None], share))

    @staticmethod
    def _unseen(emit: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Emissions that sum to one, in which the unseen class, which no training text can teach,
        has its unigram share in every state."""
        emit[0] = 0
        emit *= (1 - share[0]) / np.maximum(emit.sum(0), 1e-300)
        emit[0] = share[0]
        return emit


def _by_time(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of sequences, active ones at each step, offset of each step), longest first."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(order) else 0
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    return order, active, np.concatenate(([0], np.cumsum(active)))


def _arranged(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Tokens step by step, and the layout."""
    order, active, offset = _by_time(lengths)
    size, begin = lengths[order], starts[order]
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    rank = np.repeat(np.arange(len(order)), size)
    laid = np.empty(len(step), tokens.dtype)
    laid[offset[step] + rank] = tokens[np.repeat(begin, size) + step]
    return laid, order, active, offset


def log_likelihood(model: Model, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 of the probability of each sequence, by the scaled forward recursion."""
    out = np.zeros(len(lengths))
    if not len(lengths) or not lengths.max():
        return out
    laid, order, active, offset = _arranged(tokens, starts, lengths)
    total = np.zeros(len(lengths))
    state = np.broadcast_to(model.start, (active[0], len(model.start)))
    for t, n in enumerate(active):
        if t:
            state = state[:n] @ model.move
        state = state * model.emit[laid[offset[t] : offset[t] + n]]
        scale = state.sum(1)
        state = state / scale[:, None]
        total[:n] += np.log10(scale)
    out[order] = total
    return out


def expected(model: Model, tokens, starts, lengths, opening) -> tuple[np.ndarray, ...]:
    """Expected counts (start, mean, move, emit) of sequences; ``opening`` ones start documents."""
    states, kinds = len(model.start), len(model.emit)
    laid, order, active, offset = _arranged(tokens, starts, lengths)
    opening = opening[order]
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    likely = emit[laid]
    forward = np.empty((len(laid), states), np.float32)
    scale = np.empty(len(laid), np.float32)
    state = np.where(opening[:, None], model.start, model.mean).astype(np.float32)
    for t, n in enumerate(active):
        here = slice(offset[t], offset[t] + n)
        state = (state[:n] @ move if t else state) * likely[here]
        scale[here] = state.sum(1)
        state /= scale[here, None]
        forward[here] = state
    pairs = np.zeros((states, states))
    backward = np.ones((active[-1], states), np.float32)
    for t in range(len(active) - 1, -1, -1):
        here = slice(offset[t], offset[t] + active[t])
        if t:
            coming = backward * likely[here] / scale[here, None]
            pairs += forward[offset[t - 1] : offset[t - 1] + active[t]].T @ coming
        # From here on these are the shares of the states, given the whole sequence.
        forward[here] *= backward
        if t:
            backward = np.ones((active[t - 1], states), np.float32)
            backward[: active[t]] = coming @ move.T
    counts = np.stack([np.bincount(laid, forward[:, s], kinds) for s in range(states)], 1)
    first = forward[: active[0]]
    return (first[opening].sum(0).astype(float), forward.sum(0).astype(float), pairs * model.move, counts)


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of SEGMENT tokens at most: starts, lengths, and whether a run opens a document."""
    count = -(-lengths // SEGMENT)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(lengths) - lengths, count) + step * SEGMENT
    size = np.minimum(SEGMENT, np.repeat(lengths, count) - step * SEGMENT)
    return begin, size, step == 0


_CHUNK = 8_192


def _counted(model: Model):
    """Expected counts of the training documents of a partition, in chunks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
                trained = np.array(batch.column("trained")[i].as_py(), bool)
                tokens = _from_planes(batch.column("kinds")[i].as_py(), "<u2")[
                    _expanded(batch.column("tokens")[i].as_py(), "<u4")]
                begin, size, opening = _segments(lengths)
                mine = np.repeat(trained, -(-lengths // SEGMENT))
                if mine.any():
                    found = expected(model, tokens, begin[mine], size[mine], opening[mine])
                    flat = np.concatenate([x.ravel() for x in found])
                    total = flat if total is None else total + flat
        if total is not None:
            parts = range(0, len(total), _CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p // _CHUNK for p in parts], pa.int32()),
                 pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32()),
                 pa.array([total[p : p + _CHUNK].astype("<f4").tobytes() for p in parts], pa.binary())],
                names=["chunk", "salt", "sums"])

    return count


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<f4").astype(float) for x in table.column("sums").to_pylist())
    return pa.table({"chunk": table.column("chunk")[:1], "salt": table.column("salt")[:1],
                     "sums": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def _trained(sequences: DataFrame, share: np.ndarray, rounds: int) -> Model:
    """Baum-Welch over the training documents of all blocks."""
    model = Model.first(share)
    shape = "chunk int, salt int, sums binary"
    kinds = len(share)
    for _ in range(rounds):
        parts = sequences.select("lengths", "trained", "tokens", "kinds").mapInArrow(_counted(model), shape)
        # Two steps, so that no task holds the counts of all partitions.
        near = parts.withColumn("salt", F.col("salt") % 16).groupBy("chunk", "salt").applyInArrow(_summed, shape)
        rows = near.groupBy("chunk").applyInArrow(_summed, shape).collect()
        if not rows:
            break
        flat = np.concatenate([np.frombuffer(r.sums, "<f4") for r in sorted(rows, key=lambda r: r.chunk)]).astype(float)
        cuts = np.cumsum([STATES, STATES, STATES * STATES])
        start, mean, move, emit = np.split(flat, cuts)
        model = Model.from_counts(
            start, mean, move.reshape(STATES, STATES), emit.reshape(kinds, STATES), share)
    return model


#: Expected counts by word are whole numbers of this part, so that any order of adding gives the same sum.
UNIT = 2.0**-20


def _by_place(model: Model, batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Expected counts by state of the words of a block in its training documents."""
    lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
    trained = np.array(batch.column("trained")[i].as_py(), bool)
    kind = _from_planes(batch.column("kinds")[i].as_py(), "<u2")
    begin, size, opening = _segments(lengths)
    mine = np.repeat(trained, -(-lengths // SEGMENT))
    if not mine.any():
        return np.zeros((len(kind), STATES), np.float32)
    token = _expanded(batch.column("tokens")[i].as_py(), "<u4")
    local = Model(model.start, model.mean, model.move, model.emit[kind])
    return expected(local, token, begin[mine], size[mine], opening[mine])[3].astype(np.float32)


_STATES = "block long, slot int, index binary, states binary, classes binary"


def _by_word(model: Model, slots: int):
    """Expected counts by state in each block, in units: of every word of an ending class that other
    blocks hold as well, packed by slot, and, without a slot, of its classes of endings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                kind = _from_planes(batch.column("kinds")[i].as_py(), "<u2")
                sums = np.rint(_by_place(model, batch, i).astype(float) / UNIT).astype(np.int64)
                tail = np.flatnonzero(_by_ending(kind))
                classes = np.zeros((1 + ENDINGS, STATES), np.int64)
                np.add.at(classes, kind[tail], sums[tail])
                index = _from_planes(batch.column("index")[i].as_py(), "<i8")
                place = _from_planes(batch.column("order")[i].as_py(), "<u4")
                bounds = np.searchsorted(index >> 32, np.arange(slots + 1))
                parts = [slice(a, b) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * (slots + 1), pa.int64()), pa.array([*range(slots), None], pa.int32()),
                     pa.array([*(_planes(index[p] & 0xFFFFFFFF) for p in parts), None], pa.binary()),
                     pa.array([*(_planes(sums[place[p]].T.ravel()) for p in parts), None], pa.binary()),
                     pa.array([None] * slots + [_planes(classes.ravel())], pa.binary())],
                    names=["block", "slot", "index", "states", "classes"])

    return count


def _states_totalled(table: pa.Table) -> pa.Table:
    """For the words of a slot, their counts by state over all blocks: a row for each block, in its order."""
    index = [_from_planes(x, "<i8") for x in table.column("index").to_pylist()]
    total = np.zeros((max((int(x[-1]) + 1 for x in index if len(x)), default=0), STATES), np.int64)
    for x, states in zip(index, table.column("states").to_pylist()):
        total[x] += _from_planes(states, "<i8").reshape(STATES, -1).T
    return pa.table({"block": table.column("block"), "slot": table.column("slot"),
                     "states": pa.array([_planes(total[x].T.ravel()) for x in index], pa.binary())})


def _class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of classes, by state, of a task's blocks."""
    total = np.zeros((1 + ENDINGS) * STATES, np.int64)
    for batch in batches:
        for x in batch.column("classes").to_pylist():
            total += _from_planes(x, "<i8")
    place = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["place", "sum"])


def _word_counts(sequences: DataFrame, model: Model, slots: int) -> tuple[DataFrame, np.ndarray]:
    """The expected counts over all training documents, by state, of each block's words that others
    hold as well, by slot, and the sums by class."""
    rows = stored(sequences.select("block", "lengths", "trained", "tokens", "kinds", "index", "order").mapInArrow(
        _by_word(model, slots), _STATES), "hmm-states")
    sums = np.zeros((_WORD_CLASSES, STATES))
    found = rows.where("slot is null").select("classes").mapInArrow(_class_sums, "place long, sum long")
    for row in found.groupBy("place").agg(F.sum("sum").alias("sum")).collect():
        sums[divmod(row.place, STATES)] = row.sum * UNIT
    totals = rows.where("slot is not null").select("block", "slot", "index", "states")
    return totals.groupBy("slot").applyInArrow(_states_totalled, "block long, slot int, states binary"), sums


def word_emissions(model: Model, unigrams: Unigrams, sums, kind, count, states) -> np.ndarray:
    """Emissions of words by state: the class's, times the word's share of it in the state."""
    emit = model.emit[kind].copy()
    tail = _by_ending(kind)
    share = (count[tail] + SMOOTH) / np.maximum(unigrams.mass[kind[tail]], 1e-300)
    emit[tail] *= (states + WORD_PRIOR * share[:, None]) / (sums[kind[tail]] + WORD_PRIOR)
    return emit


def _scored(model: Model, unigrams: Unigrams, sums: np.ndarray, doc_type: pa.DataType, tokens: int):
    def score(blocks: pa.Table, pieces: pa.Table) -> pa.Table:
        batch, pieces = blocks.to_batches()[0], pieces.sort_by("slot")
        lengths = np.array(batch.column("lengths")[0].as_py(), np.int64)
        token = _expanded(batch.column("tokens")[0].as_py(), "<u4")
        kind = _from_planes(batch.column("kinds")[0].as_py(), "<u2")
        count = _from_planes(batch.column("counts")[0].as_py(), "<i8")
        place = _from_planes(batch.column("order")[0].as_py(), "<u4")
        states = np.rint(_by_place(model, batch, 0).astype(float) / UNIT)
        parts = [_from_planes(x, "<i8").reshape(STATES, -1).T for x in pieces.column("states").to_pylist()]
        if parts:
            states[place] = np.concatenate(parts)
        states = states[_by_ending(kind)] * UNIT
        emit = word_emissions(model, unigrams, sums, kind, count, states)
        found = log_likelihood(
            Model(model.start, model.mean, model.move, emit), token, np.cumsum(lengths) - lengths, lengths)
        return pa.table(
            [pa.array(batch.column("doc_ids")[0].as_py(), doc_type),
             pa.array(batch.column("held_out")[0].as_py(), pa.bool_()), pa.array(lengths),
             pa.array(batch.column("known")[0].as_py(), pa.int64()),
             pa.array(np.full(len(lengths), tokens, np.int64)),
             pa.array(batch.column("base")[0].as_py(), pa.float64()), pa.array(found)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


#: Slots that words are dealt into, at least, and blocks whose words one slot may hold a part of, a slot.
SLOTS, BLOCKS_A_SLOT = 32, 16


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Base score and model score (log10 probability) of every whole text.

    Tokens are the words, A-Z in lower case, and one end; NULL texts have the end alone. The model
    learns from documents whose ``crc32(doc_id as text) % 10`` is not 0; a document without an id is
    scored, but neither learnt from nor held out. Repeated rows count as often as they occur.
    An empty table gives no rows; other columns are ignored.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % 10
    marked = docs.select(
        "doc_id", "text", F.coalesce(rest == 0, F.lit(False)).alias("held_out"),
        F.coalesce(rest != 0, F.lit(False)).alias("trained"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    doc_type = docs.limit(0).select("doc_id").toArrow().schema.field(0).type
    ids = f"block long, doc_ids array<{kind}>, held_out array<boolean>, trained array<boolean>, lengths array<long>, tokens binary"
    blocks = stored(marked.mapInArrow(_read(doc_type), f"{ids}, words binary, endings binary, used binary"), "hmm-read")
    slots = max(SLOTS, -(-blocks.count() // BLOCKS_A_SLOT))
    pieces = blocks.select("block", "words", "endings", "used").mapInArrow(
        _slotted(slots), "block long, slot int, words binary, endings binary, used binary")
    totals = stored(pieces.groupBy("slot").applyInArrow(_totalled, _TOTALS), "hmm-words")
    types = totals.where("block is null").select("totals", "words", "endings")
    rows = types.mapInArrow(_counted_types, "step int, types long, tokens long").groupBy("step").agg(
        F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()
    tokens, distinct = sum(r.tokens for r in rows), sum(r.types for r in rows)
    # The words above a count that at most TOP words exceed, by steps of a sixteenth of a power of two.
    top, least = 0, 0
    for row in sorted(rows, key=lambda r: -r.step):
        top += row.types
        if top > TOP:
            least = row.step + 1
            break
    # TOP words at most.
    top = np.array(sorted(r.word for r in types.mapInArrow(_top_words(least), "word long").collect()), np.int64)
    mass = np.zeros(_WORD_CLASSES)
    found = types.mapInArrow(_class_mass(top), "kind int, types long, tokens long").groupBy("kind").agg(
        F.sum("types").alias("types"), F.sum("tokens").alias("tokens"))
    for row in found.collect():
        mass[row.kind] = row.tokens + SMOOTH * row.types
    mass[0] = SMOOTH
    unigrams = Unigrams(tokens, distinct, mass)
    sequences = blocks.drop("used").groupBy("block").cogroup(
        totals.where("block is not null").select("block", "slot", "totals", "index").groupBy("block")).applyInArrow(
        _classified(unigrams, top, slots),
        f"{ids}, counts binary, kinds binary, index binary, order binary, known array<long>, base array<double>")
    sequences = stored(sequences, "hmm-sequences")
    model = _trained(sequences, unigrams.share, rounds)
    states, sums = _word_counts(sequences, model, slots)
    return sequences.drop("index").groupBy("block").cogroup(states.groupBy("block")).applyInArrow(
        _scored(model, unigrams, sums, doc_type, int(tokens)),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")
