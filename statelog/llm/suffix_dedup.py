"""Exact removal of repeated passages: sorted suffixes, range-partitioned by sampled splitters.

Sorting a suffix for every byte would move many times the input. Here the suffixes are those at the
anchors of ``windows``: each 200-byte window has one, and equal windows have equal suffixes at equal
distances, so nothing is missed.

1. Each run of windows with one anchor becomes a row: the leading bytes of its anchor's suffix and a
   hash of its first 32 bytes (``k1``), a hash of all bytes of the run (``k2``), and its place.
   ``repartitionByRange`` samples splitters and deals the rows out by ``k1``, ``k2`` and the place,
   so that one passage in a third of all documents still spreads over buckets. A bucket sorts its
   rows by multikey quicksort, compares neighbours, and keeps the rows that meet an equal ``k1``;
   the first and last keys of buckets are compared across boundaries.
2. Runs equal as a whole repeat as a whole. Runs that only share ``k1`` are cut into blocks of 16
   windows, sorted in the same way by the bytes that all windows of a block have in common. Blocks
   with equal cores are compared window by window by the 15 bytes on either side. Where the rows of
   a core span buckets, the windows of its distinct blocks are dealt out once more, one by one.
3. The repeated windows of a document are joined with it, and their bytes are cut out.

Hashes have 64 bits besides the leading bytes; only equal content meets in a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelog.llm import windows
from statelog.llm.common import as_bytes, batched, releasing, stored, worker_cache
from statelog.llm.windows import GRAM, PIECE, REACH, WINDOW

BLOCK = 16
#: Bytes of the anchor's suffix that lead the sort key, above 40 bits of hash.
LEADING = 3

_RUN = "k1 long, k2 long, id long, first int, last int, anchor int, known binary"
_BLOCK = "k1 long, k2 long, id long, start int, own int, wanted boolean, margin binary"
_GROUPED = "bucket int, same1 boolean, same2 boolean, lead boolean, many boolean, edge boolean"


# ---- sorting a bucket -------------------------------------------------------------------------


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key; only ties are looked at again, by the next key."""
    order = np.argsort(keys[0], kind="stable")
    for depth in range(1, len(keys)):
        ranked = keys[0][order]
        equal = np.ones(max(len(order) - 1, 0), bool)
        for key in keys[:depth]:
            ranked = key[order]
            equal &= ranked[1:] == ranked[:-1]
        tied = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
        tied = tied[: len(order)]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        group = np.cumsum(~np.concatenate(([False], equal)))[places]
        order[places] = order[places[np.lexsort((keys[depth][order[places]], group))]]
    return order


def _groups(key: list[np.ndarray]) -> np.ndarray:
    """Group numbers of sorted keys."""
    new = np.zeros(len(key[0]), bool)
    new[:1] = True
    for column in key:
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new) - 1


def _bucket_columns(rows: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray]]:
    """The sorted rows of a bucket, and what their neighbours say."""
    k1, k2 = (rows.column(c).to_numpy().astype(np.int64) for c in ("k1", "k2"))
    order = multikey_order([k1, k2])
    k1, k2 = k1[order], k2[order]
    outer, inner = _groups([k1]), _groups([k1, k2])
    lead = np.concatenate(([True], inner[1:] != inner[:-1]))
    kinds = np.bincount(outer, lead)
    found = {
        "outer": outer,
        "same1": np.bincount(outer)[outer] > 1,
        "same2": np.bincount(inner)[inner] > 1,
        "lead": lead,
        "many": kinds[outer] > 1,
        "edge": (outer == 0) | (outer == outer[-1]),
    }
    return rows.take(pa.array(order)), found


def _whole_bucket(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    rows = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(rows).combine_chunks() if rows else None


@releasing
def _sorted_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    rows = _whole_bucket(batches)
    if rows is None:
        return
    rows, found = _bucket_columns(rows)
    keep = found["same1"] | found["edge"]
    if "known" in rows.column_names:
        keep |= rows.column("known").is_valid().to_numpy()
    rows = rows.filter(pa.array(keep))
    rows = rows.append_column(
        "bucket", pa.array(np.full(len(rows), TaskContext.get().partitionId(), np.int32))
    )
    for name in ("same1", "same2", "lead", "many", "edge"):
        rows = rows.append_column(name, pa.array(found[name][keep]))
    yield from rows.to_batches(max_chunksize=50_000)


def _across(grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that two buckets in a row share: ``k1`` alone, and both. Two rows a bucket at most."""
    edges = grouped.where("edge").groupBy("bucket").agg(
        F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high")
    )
    follow = edges.withColumn("next", F.lead("low").over(Window.orderBy("bucket")))
    outer = follow.where("high.k1 = next.k1").select(F.col("high.k1").alias("k1")).distinct()
    both = follow.where("high = next").select("high.k1", "high.k2").distinct()
    return outer, both


def _compared(rows: DataFrame, bucket, schema: str, purpose: str) -> DataFrame:
    """Rows dealt out by range and sorted in their buckets, with boundaries compared."""
    dealt = rows.repartitionByRange(F.col("k1"), F.col("k2"), F.col("id"))
    grouped = stored(dealt.mapInArrow(bucket, schema), purpose)
    outer, both = _across(grouped)
    # As many rows as buckets at most.
    outer = F.broadcast(outer.withColumn("spans", F.lit(True)))
    both = F.broadcast(both.withColumn("spans2", F.lit(True)))
    joined = grouped.join(outer, "k1", "left").join(both, ["k1", "k2"], "left")
    spans = F.coalesce("spans", F.lit(False)) & F.col("edge")
    return joined.withColumns(
        {
            "spans": spans,
            "same1": F.col("same1") | spans,
            "many": F.col("many") | spans,
            "same2": F.col("same2") | (F.coalesce("spans2", F.lit(False)) & F.col("edge")),
        }
    ).drop("spans2")


# ---- runs -------------------------------------------------------------------------------------


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Starts and bytes of pieces such that every window starts in one of them."""
    for start in range(0, max(len(data) - WINDOW + 1, 0), PIECE):
        yield start, data[start : start + PIECE + REACH]


def _leading(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    value = np.zeros(len(places), np.uint64)
    for i in range(LEADING):
        value = (value << np.uint64(8)) | data[places + i].astype(np.uint64)
    return value


def _runs_of(data: np.ndarray, powers) -> tuple[np.ndarray, ...]:
    """Keys and places of the runs of a text."""
    parts = []
    for start, piece in _pieces(data):
        sums = windows.prefix(piece[: PIECE + WINDOW - 1], powers)
        first, last, anchor = windows.runs(sums, powers)
        gram = windows.hashes(sums, anchor, anchor + GRAM, powers)
        k1 = (_leading(piece, anchor) << np.uint64(40)) | (gram >> np.uint64(24))
        shape = ((anchor - first) << 10 | (last - first)).astype(np.uint64)
        k2 = windows.mixed(windows.hashes(sums, first, last + WINDOW, powers) + shape)
        parts.append((k1, k2, first + start, last + start, anchor + start))
    return tuple(np.concatenate(x) for x in zip(*parts))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal ones, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(new) - 1]))]


@releasing
def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of step 1. Runs that a text repeats itself come once, with the bytes they cover."""
    powers = worker_cache("suffixes: powers", windows.Powers)
    for batch in batched(batches, "text"):
        columns, known, count = [], [], 0
        for number, text in zip(batch.column("id").to_pylist(), as_bytes(batch.column("text"))):
            if text is None or len(text) < WINDOW:
                continue
            k1, k2, first, last, anchor = _runs_of(np.frombuffer(text, np.uint8), powers)
            order = multikey_order([k1, k2])
            group = _groups([k1[order], k2[order]])
            again = np.empty(len(order), bool)
            again[order] = np.bincount(group)[group] > 1
            keep = np.sort(order[np.concatenate(([True], group[1:] != group[:-1]))])
            spans = None
            if again.any():
                low, high = merged(first[again], last[again] + WINDOW)
                spans = np.stack((low, high), 1).astype("<i4").tobytes()
            known.extend([spans] + [None] * (len(keep) - 1))
            columns.append((k1[keep], k2[keep], np.full(len(keep), number),
                            first[keep], last[keep], anchor[keep]))
            count += len(keep)
            if count > 50_000:
                yield _run_batch(columns, known)
                columns, known, count = [], [], 0
        if columns:
            yield _run_batch(columns, known)


def _run_batch(columns, known) -> pa.RecordBatch:
    k1, k2, number, first, last, anchor = (np.concatenate(x) for x in zip(*columns))
    small = [pa.array(x.astype(np.int32)) for x in (first, last, anchor)]
    return pa.RecordBatch.from_arrays(
        [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(number.astype(np.int64)),
         *small, pa.array(known, pa.binary())],
        names=["k1", "k2", "id", "first", "last", "anchor", "known"],
    )


# ---- blocks -----------------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, so that a shuffle moves less."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [None if x is None else squeeze(x) for x in as_bytes(batch.column("text"))]
        rest = [batch.column(c) for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.binary())], names=[*names, "text"])


def _blocks_of(data: np.ndarray, runs: np.ndarray, powers) -> tuple[np.ndarray, ...]:
    """Blocks of runs (first, last, anchor, wanted): core, whole, start, own windows as bits."""
    out = []
    for at, piece in _pieces(data):
        part = runs[(runs[:, 0] >= at) & (runs[:, 0] < at + PIECE)]
        if not len(part):
            continue
        first, last, anchor = part[:, 0] - at, part[:, 1] - at, part[:, 2] - at
        low, high = (anchor - last) // BLOCK, (anchor - first) // BLOCK
        count = high - low + 1
        row = np.repeat(np.arange(len(part)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        distance = (low[row] + step) * BLOCK
        start = anchor[row] - distance - (BLOCK - 1)
        sums = windows.prefix(piece, powers)
        core = windows.hashes(sums, start + BLOCK - 1, start + WINDOW, powers)
        core = windows.mixed(core + distance.astype(np.uint64))
        own = np.zeros(len(row), np.int64)
        for i in range(BLOCK):
            mine = (start + i >= first[row]) & (start + i <= last[row])
            own |= mine.astype(np.int64) << i
        padded = np.concatenate((np.zeros(BLOCK, np.uint8), piece, np.zeros(BLOCK, np.uint8)))
        left = padded[(start + BLOCK)[:, None] + np.arange(BLOCK - 1)]
        right = padded[(start + BLOCK + WINDOW)[:, None] + np.arange(BLOCK - 1)]
        out.append((core, start + at, own, part[row, 3], np.concatenate((left, right), 1)))
    return tuple(np.concatenate(x) for x in zip(*out))


@releasing
def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = worker_cache("suffixes: powers", windows.Powers)
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        columns, count = [], 0
        numbers, lists = batch.column("id").to_pylist(), batch.column("runs").to_pylist()
        for number, text, runs in zip(numbers, batch.column("text").to_pylist(), lists):
            data = np.frombuffer(expand(text), np.uint8)
            places = np.array([(r["first"], r["last"], r["anchor"], r["wanted"]) for r in runs], np.int64)
            core, start, own, wanted, margin = _blocks_of(data, places, powers)
            columns.append((core, start, own, wanted, margin, np.full(len(core), number)))
            count += len(core)
            if count > 30_000:
                yield _block_batch(columns)
                columns, count = [], 0
        if columns:
            yield _block_batch(columns)


def _block_batch(columns) -> pa.RecordBatch:
    core, start, own, wanted, margin, number = (np.concatenate(x) for x in zip(*columns))
    width = 2 * (BLOCK - 1)
    # Sorting by the margins too brings equal blocks together.
    side = np.zeros(len(core), np.uint64)
    for i in range(width):
        side = (side + margin[:, i]) * np.uint64(0x9E3779B97F4A7C15)
    margins = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(core), [None, pa.py_buffer(np.ascontiguousarray(margin).tobytes())]
    ).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(core.view(np.int64)), pa.array(windows.mixed(side).view(np.int64)),
         pa.array(number.astype(np.int64)), pa.array(start.astype(np.int32)),
         pa.array(own.astype(np.int32)), pa.array(wanted.astype(bool)), margins],
        names=["k1", "k2", "id", "start", "own", "wanted", "margin"],
    )


def _margins(column: pa.ChunkedArray) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, 2 * (BLOCK - 1))


def _window_keys(core: np.ndarray, margin: np.ndarray, i: int) -> np.ndarray:
    """A hash of the window at place i of each block: core, bytes before it, bytes after it."""
    key = core.view(np.uint64) + np.uint64(i)
    for column in [*range(i, BLOCK - 1), *range(BLOCK - 1, BLOCK - 1 + i)]:
        key = (key + margin[:, column] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return windows.mixed(key)


@releasing
def _block_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a bucket with the bits of their repeated windows; others are left out."""
    from pyspark import TaskContext

    rows = _whole_bucket(batches)
    if rows is None:
        return
    rows, found = _bucket_columns(rows)
    keep = found["same1"] | found["edge"]
    rows = rows.filter(pa.array(keep))
    core = rows.column("k1").to_numpy().astype(np.int64)
    own = rows.column("own").to_numpy().astype(np.int64)
    margin = _margins(rows.column("margin"))
    bits = np.zeros(len(core), np.int64)
    for i in range(BLOCK):
        mine = np.flatnonzero((own >> i) & 1)
        if len(mine):
            _, group, count = np.unique(
                _window_keys(core[mine], margin[mine], i), return_inverse=True, return_counts=True)
            bits[mine] |= (count[group] > 1).astype(np.int64) << i
    rows = rows.append_column(
        "bucket", pa.array(np.full(len(rows), TaskContext.get().partitionId(), np.int32)))
    for name in ("same1", "same2", "lead", "many", "edge"):
        rows = rows.append_column(name, pa.array(found[name][keep]))
    rows = rows.append_column("bits", pa.array(bits.astype(np.int32)))
    # Margins are needed again only where the bucket may not hold all of a core, once each.
    edge = pc.and_(rows.column("edge"), rows.column("lead"))
    place = rows.schema.get_field_index("margin")
    empty = pa.array([b""] * len(rows), pa.binary())
    margins = pc.if_else(edge, rows.column("margin"), empty)
    rows = rows.set_column(place, "margin", margins)
    yield from rows.to_batches(max_chunksize=50_000)


def _split_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each own window of the blocks, by a hash of the window's bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        core = batch.column("k1").to_numpy().astype(np.int64)
        own, margin = batch.column("own").to_numpy(), _margins(batch.column("margin"))
        for i in range(BLOCK):
            mine = np.flatnonzero((own >> i) & 1)
            key = _window_keys(core[mine], margin[mine], i).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(core[mine]), batch.column("id").take(pa.array(mine)),
                 pa.array((batch.column("start").to_numpy()[mine] + i).astype(np.int32)),
                 batch.column("wanted").take(pa.array(mine))],
                names=["k1", "k2", "id", "start", "wanted"],
            )


def _bit_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of bytes that the marked windows of each block cover."""
    for batch in batches:
        number = batch.column("id").to_numpy()
        start = batch.column("start").to_numpy().astype(np.int64)
        bits = batch.column("bits").to_numpy().astype(np.int64)
        out = []
        for i in range(BLOCK):
            begins = ((bits >> i) & 1).astype(bool) & ~(((bits >> (i - 1)) & 1).astype(bool) if i else False)
            mine = np.flatnonzero(begins)
            rest = (~(bits[mine] >> i)) | (1 << (BLOCK - i))
            length = np.log2((rest & -rest).astype(np.float64)).astype(np.int64)
            out.append((number[mine], start[mine] + i, start[mine] + i + length - 1 + WINDOW))
        number, low, high = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays(
            [pa.array(number), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
            names=["id", "low", "high"])


# ---- the operator -----------------------------------------------------------------------------


def _known_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(np.full(len(x) // 8, number), np.frombuffer(x, "<i4"))
               for number, x in zip(batch.column("id").to_pylist(), batch.column("known").to_pylist())]
        if out:
            number = np.concatenate([x[0] for x in out]).astype(np.int64)
            ends = np.concatenate([x[1] for x in out]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), pa.array(ends[:, 0]), pa.array(ends[:, 1])],
                names=["id", "low", "high"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(id, spans): the bytes to remove, as little-endian 32-bit pairs, not merged, by document.

    ``texts`` has ``id`` and ``text``. Documents without repeats are absent.
    """
    runs = _compared(
        texts.mapInArrow(_run_rows, _RUN), _sorted_bucket, f"{_RUN}, {_GROUPED}", "suffix-runs"
    )
    span = "id long, low int, high int"
    # Runs that repeat inside one text are known already, whatever the other texts hold.
    sure = [
        runs.where("same2").select("id", F.col("first").alias("low"),
                                   (F.col("last") + WINDOW).alias("high")),
        runs.where("known is not null").select("id", "known").mapInArrow(_known_spans, span),
    ]
    places = runs.where("same1 and many and (lead or not same2)").groupBy("id").agg(
        F.collect_list(
            F.struct("first", "last", "anchor", (~F.col("same2")).alias("wanted"))
        ).alias("runs")
    )
    packed = texts.mapInArrow(_packed, "id long, text binary")
    blocks = _compared(
        packed.join(places, "id").mapInArrow(_block_rows, _BLOCK),
        _block_bucket, f"{_BLOCK}, {_GROUPED}, bits int", "suffix-blocks",
    )
    # Blocks that are equal as a whole repeat as a whole, and one of them stands for all.
    bits = F.when(F.col("same2"), F.col("own")).otherwise(F.col("bits")).alias("bits")
    sure.append(
        blocks.where("wanted and (same2 or bits != 0)").select("id", "start", bits).mapInArrow(_bit_spans, span)
    )
    single = blocks.where("spans and lead").select(
        "k1", "id", "start", "own", F.expr("wanted and not same2").alias("wanted"), "margin")
    each = _compared(
        single.mapInArrow(_split_windows, "k1 long, k2 long, id long, start int, wanted boolean"),
        _sorted_bucket, f"k1 long, k2 long, id long, start int, wanted boolean, {_GROUPED}",
        "suffix-windows",
    )
    sure.append(
        each.where("same2 and wanted").select("id", F.col("start").alias("low"),
                                              (F.col("start") + WINDOW).alias("high"))
    )
    together = sure[0].union(sure[1]).union(sure[2]).union(sure[3])
    return together.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def cut(text: bytes, spans: list[dict] | None) -> tuple[list[bytes], int, int]:
    """The parts outside the spans, how many bytes are inside, and how many maximal spans there are."""
    if not spans:
        return [text], 0, 0
    ends = np.array([(s["low"], s["high"]) for s in spans], np.int64)
    low, high = merged(ends[:, 0], ends[:, 1])
    kept, at = [], 0
    for a, b in zip(low.tolist(), high.tolist()):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return kept, int((high - low).sum()), len(low)


def _with_spans(docs: DataFrame) -> DataFrame:
    """(rest: the columns of docs but the text, text compressed, spans).

    Rows are numbered as they are read: ``docs`` must give the same rows in the same order whenever
    it is read, as a table in files does.
    """
    others = F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("rest")
    rows = docs.select(F.monotonically_increasing_id().alias("id"), others, docs["text"].alias("text"))
    spans = stored(repeated_spans(rows.select("id", "text")), "suffix-spans")
    schema = rows.drop("text").schema.add("text", "binary")
    return rows.mapInArrow(_packed, schema).join(spans, "id", "left").drop("id")


@releasing
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            text = expand(text) if text is not None else b""
            rest, removed, count = cut(text, spans)
            rows.append((len(text), removed, count, hashlib.sha256(b"".join(rest)).hexdigest()))
        size, removed, count, digest = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, count)),
             pa.array(digest, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_report(docs: DataFrame) -> DataFrame:
    """What is removed from each document.

    Every byte covered by a 200-byte string that also starts at another place goes. NULL texts are
    empty; texts below 200 bytes lose nothing; identical rows are copies of each other. An empty
    table gives no rows; other columns are ignored.
    """
    ready = _with_spans(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ready.select("rest.doc_id", "text", "spans").mapInArrow(
        _digests, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


@releasing
def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batched(batches, "text", 1 << 18):
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            parts = None if text is None else cut(expand(text), spans)[0]
            texts.append(None if parts is None else "".join(p.decode("utf-8", "ignore") for p in parts))
        names = [n for n in batch.schema.names if n not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out of ``text``; all other columns stay.

    What a cut leaves of a character goes as well. NULL texts stay NULL.
    """
    ready = _with_spans(docs)
    schema = ready.select("rest").schema.add("text", "string")
    rests = ready.mapInArrow(_rests, schema)
    return rests.select(*(F.col("text") if c == "text" else F.col("rest").getField(c) for c in docs.columns)).toDF(*docs.columns)


SQL = """
with bytes as (select row_number() over () as id, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
starts as (select id, unnest(range(0, len(h) // 2 - 199)) as p, h from bytes where len(h) >= 400),
strings as (select id, p, md5_number(substr(h, 2 * p + 1, 400)) as s from starts),
again as (select s from strings group by s having count(*) > 1),
covered as (select id, p, lag(p) over (partition by id order by p) as before from strings semi join again using (s)),
numbered as (select id, p, count(*) filter (where before is null or p > before + 200)
  over (partition by id order by p) as run from covered),
spans as (select id, min(p) as low, max(p) + 200 as high from numbered group by id, run),
edges as (select id, low, high, lag(high, 1, 0) over (partition by id order by low) as after from spans),
parts as (select id, string_agg(substr(h, 2 * after + 1, 2 * (low - after)), '' order by low) as head,
  max(high) as last, sum(high - low) as n_removed, count(*) as n_spans
  from edges join bytes using (id) group by id)
select doc_id, len(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) as kept_sha256
from bytes left join parts using (id)
"""
