"""Merkle manifest of a table: a tree of SHA-256 digests whose parents keep their hash states.

Each row is a leaf, each source a tree of runs of three, and the roots of the sources are the leaves
of one more such tree. A parent hashes its children from left to right and keeps a copy of the hash
state before each child. A changed leaf is then folded to the root by resuming, at each parent, the
state before its slot with the replacement and the siblings to the right; those to the left are not
read again.

In Spark, leaves are numbered within their source and grouped into blocks of ``WIDTH ** HEIGHT``
neighbours, a bounded row each whatever the size of the source. A block is hashed up ``HEIGHT``
levels at once; the block tops are the nodes of the next round. On the way back each node gets its
path: slots, siblings and the stored states of its parents up to the root. Only leaf digests are
shuffled, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statelog.llm import sha_lanes
from statelog.llm.checksum_sql import ascii_codes, crc32
from statelog.llm.common import column_or_null, stored

WIDTH = 3
#: Levels of a block.
HEIGHT = 5
BLOCK = WIDTH**HEIGHT
#: A document is tampered with where this divides the checksum of its id.
TAMPERED = 2

_FIELDS = (("doc_id", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "bigint"), ("text", "string"))
_PATH = "slots binary, counts binary, states binary, siblings binary"


# ------------------------------------------------------------------ leaves


def _field(value: Column) -> Column:
    """A value with its length in bytes before it, or a dash for NULL."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(_field(value) for value in fields)), 256))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, source, digest, changed): the leaf of each row, and the one it has after tampering.

    ``tampered`` is the text after tampering; without it, the text stays as it is.
    """
    values = {name: column_or_null(docs, name, kind) for name, kind in _FIELDS}
    changed = values["text"] if tampered is None else tampered
    return docs.select(
        column_or_null(docs, "doc_id", "long").alias("doc_id"),
        values["source"].alias("source"),
        _digest(list(values.values())).alias("digest"),
        _digest([*list(values.values())[:-1], changed]).alias("changed"),
    )


def without_line_ends(docs: DataFrame) -> Column:
    """The text without its line feeds, where TAMPERED divides the CRC-32 of the decimal id."""
    text = column_or_null(docs, "text", "string")
    chosen = F.crc32(column_or_null(docs, "doc_id", "string").cast("binary")) % TAMPERED == 0
    return F.when(chosen, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


# ------------------------------------------------------------------ numbering and blocks


def _numbered(rows: DataFrame, order: list[str], purpose: str, tree: str | None = None) -> DataFrame:
    """The rows with their place ``pos`` within their tree, and the tree's size ``n``.

    The rows are range-partitioned and sorted; a place is the row's number in its partition plus the
    rows that earlier partitions hold of the tree. The last key tells equal rows apart, so a key with a
    third of all rows is spread over partitions.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, "_tie"]
    placed = stored(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id()), f"merkle-{purpose}")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    name = F.lit(None).cast("string") if tree is None else F.col(tree)
    placed = placed.withColumn("tree", name)
    each = Window.partitionBy("tree")
    # A row for each partition and tree.
    counts = placed.groupBy("_part", "tree").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(
        F.col("_part").alias("_p"), F.col("tree").alias("_t"), "_first",
        F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(each).alias("n"))
    joined = placed.join(counts, (F.col("_part") == F.col("_p")) & F.col("tree").eqNullSafe(F.col("_t")))
    return joined.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_at", "_part", "_p", "_t", "_first", "_before")


def _blocks(nodes: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """A row for each block: its nodes in order, BLOCK of them at most."""
    block = F.expr(f"pos div {BLOCK}").alias("block")
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *carried)))
    return nodes.groupBy("tree", block, "n").agg(members.alias("nodes"))


# ------------------------------------------------------------------ trees in a task


@dataclass
class _Level:
    """One level of many trees: each node's parent and slot, and what the parents keep."""

    parent: np.ndarray
    slot: np.ndarray
    #: The hash state before each slot, and the children's digests and number.
    states: np.ndarray
    children: np.ndarray
    counts: np.ndarray
    #: False where a tree has a single node left, which goes up as it is.
    hashed: np.ndarray


def _grown(children: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states that parents keep before each slot, and their digests."""
    states = np.zeros((len(children), WIDTH, 8), np.uint32)
    now = sha_lanes.fresh(len(children))
    for slot in range(WIDTH):
        states[:, slot] = now
        there = np.flatnonzero(counts > slot)
        now[there] = sha_lanes.resumed(now[there], children[there, slot])
    return states, sha_lanes.finished(now, counts)


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 32)


class _Trees:
    """The trees of the blocks of a batch, hashed level by level together."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        nodes = batch.column("nodes")
        self.nodes = nodes.flatten()
        lengths = np.diff(np.asarray(nodes.offsets))
        #: The block of each node.
        self.block = np.repeat(np.arange(len(lengths)), lengths)
        self.levels: list[_Level] = []
        rows, size = self.block, np.asarray(batch.column("n"))[self.block]
        pos, digest = np.asarray(self.nodes.field("pos")), _digests(self.nodes.field("digest"))
        for _ in range(HEIGHT):
            hashed = size > 1
            if not hashed.any():
                break
            up = np.where(hashed, pos // WIDTH, pos)
            new = (rows[1:] != rows[:-1]) | (up[1:] != up[:-1])
            first = np.flatnonzero(np.concatenate(([True], new)))
            counts = np.diff(np.append(first, len(rows)))
            parent = np.repeat(np.arange(len(first)), counts)
            slot = np.arange(len(rows)) - first[parent]
            children = np.zeros((len(first), WIDTH, 32), np.uint8)
            children[parent, slot] = digest
            states, digest = _grown(children, counts)
            hashed = hashed[first]
            digest[~hashed] = children[~hashed, 0]
            self.levels.append(_Level(parent, slot, states, children, counts, hashed))
            rows, pos, size = rows[first], up[first], np.where(hashed, -(-size[first] // WIDTH), 1)
        self.tops, self.left = digest, size

    def folded(self, replacement: np.ndarray) -> np.ndarray:
        """The top of each node's block if the node alone had another digest."""
        node, now = np.arange(len(replacement)), replacement.copy()
        for level in self.levels:
            parent, slot = level.parent[node], level.slot[node]
            on = np.flatnonzero(level.hashed[parent])
            p, s = parent[on], slot[on]
            now[on] = _resume(
                level.states[p, s], now[on], level.counts[p],
                [(s + k < level.counts[p], level.children[p, np.minimum(s + k, WIDTH - 1)])
                 for k in range(1, WIDTH)])
            node = parent
        return now

    def paths(self) -> list[tuple[bytes, bytes, bytes, bytes]]:
        """Slots, counts, kept states and siblings of each node up to the top of its block."""
        out = []
        for node in range(len(self.block)):
            slots, counts, states, siblings = bytearray(), bytearray(), [], []
            for level in self.levels:
                parent, slot = level.parent[node], level.slot[node]
                if level.hashed[parent]:
                    slots.append(slot)
                    counts.append(level.counts[parent])
                    states.append(level.states[parent, slot].astype("<u4").tobytes())
                    siblings += [level.children[parent, k].tobytes()
                                 for k in range(level.counts[parent]) if k != slot]
                node = parent
            out.append((bytes(slots), bytes(counts), b"".join(states), b"".join(siblings)))
        return out

    def siblings(self) -> list[list[np.ndarray]]:
        """For each level and slot, which nodes have a sibling there, and its digest."""
        out, node = [], np.arange(len(self.block))
        for level in self.levels:
            parent, slot = level.parent[node], level.slot[node]
            for k in range(WIDTH):
                there = level.hashed[parent] & (slot != k) & (level.counts[parent] > k)
                out.append((there, level.children[parent, k]))
            node = parent
        return out


def _resume(states: np.ndarray, digests: np.ndarray, counts: np.ndarray, right: list) -> np.ndarray:
    """The parents' digests: resume each state with the replacement and the siblings to its right."""
    states = sha_lanes.resumed(states, digests)
    for there, sibling in right:
        there = np.flatnonzero(there)
        states[there] = sha_lanes.resumed(states[there], sibling[there])
    return sha_lanes.finished(states, counts)


# ------------------------------------------------------------------ jobs


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The top of each block: a node of the next round, or the root of its tree."""
    for batch in batches:
        if batch.num_rows:
            trees = _Trees(batch)
            left = np.asarray(batch.column("n"))
            for _ in range(HEIGHT):
                left = -(-left // WIDTH)
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("block"), pa.array(left, pa.int64()),
                 pa.array([d.tobytes() for d in trees.tops], pa.binary())],
                names=["tree", "pos", "n", "digest"])


def _grow(nodes: DataFrame, carried: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, lowest first, and the root of each tree."""
    rounds, roots = [], []
    while True:
        rounds.append(stored(_blocks(nodes, () if rounds else carried), f"merkle-blocks-{len(rounds)}"))
        tops = stored(
            rounds[-1].mapInArrow(_tops, "tree string, pos long, n long, digest binary"), "merkle-tops")
        roots.append(tops.where("n = 1").select("tree", "digest"))
        nodes = tops.where("n > 1")
        if nodes.isEmpty():
            return rounds, reduce(DataFrame.union, roots)


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each node: that to the top of its block, then the block's own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        trees = _Trees(batch)
        above = [batch.column(name).to_pylist() for name in ("slots", "counts", "states", "siblings")]
        parts = [[own + beyond[row] for own, beyond in zip(path, above)]
                 for row, path in zip(trees.block, trees.paths())]
        owner = pa.array(trees.block)
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree").take(owner), trees.nodes.field("pos"), batch.column("subroot").take(owner),
             *(pa.array([p[i] for p in parts], pa.binary()) for i in range(4))],
            names=["tree", "pos", "subroot", "slots", "counts", "states", "siblings"])


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    above = paths.select(F.col("tree").alias("_t"), F.col("pos").alias("_b"), "subroot", *_PATH_NAMES)
    return blocks.join(above, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b"))).drop("_t", "_b")


_PATH_NAMES = ("slots", "counts", "states", "siblings")


def _descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The path of every block of the lowest round; ``tops`` holds those of the roots.

    The top block of a tree, in whatever round it is, takes the path of the tree's root.
    """
    shape = f"tree string, pos long, subroot binary, {_PATH}"
    paths = tops
    for number in range(len(rounds) - 1, 0, -1):
        # Trees that end in this round take their root's path, the others the one of the round above.
        below = stored(_with_paths(rounds[number], paths).mapInArrow(_extend, shape), "merkle-paths")
        paths = below.union(tops.join(
            rounds[number].select(F.col("tree").alias("_t")).distinct(),
            F.col("tree").eqNullSafe(F.col("_t")), "left_anti"))
    return paths


def _hex(digests: np.ndarray) -> pa.Array:
    """Digests as text of 64 hex digits."""
    data = digests.tobytes().hex().encode()
    ends = np.arange(len(digests) + 1, dtype=np.int32) * 64
    return pa.StringArray.from_buffers(len(digests), pa.py_buffer(ends), pa.py_buffer(data))


def _fold(batches: Iterator[pa.RecordBatch], root: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of the manifest: each leaf's proof, and the root that its changed leaf gives."""
    want = np.frombuffer(root, np.uint8)
    for batch in batches:
        if not batch.num_rows:
            continue
        trees = _Trees(batch)
        slots, counts, states, siblings = (batch.column(name).to_pylist() for name in _PATH_NAMES)
        now = trees.folded(_digests(trees.nodes.field("changed")))
        depth = np.array([len(s) for s in slots])
        deepest = int(depth.max())
        kept = np.zeros((len(slots), deepest, 8), np.uint32)
        slot, count = np.zeros((2, len(slots), deepest), np.int64)
        beside = np.zeros((len(slots), deepest, WIDTH - 1, 32), np.uint8)
        for i, d in enumerate(depth):
            kept[i, :d] = np.frombuffer(states[i], "<u4").reshape(d, 8)
            slot[i, :d], count[i, :d] = list(slots[i]), list(counts[i])
            others = np.frombuffer(siblings[i], np.uint8).reshape(-1, 32)
            step = np.repeat(np.arange(d), count[i, :d] - 1)
            beside[i, step, np.arange(len(step)) - np.searchsorted(step, step)] = others
        block = trees.block
        proofs = trees.siblings()
        for level in range(deepest):
            on = np.flatnonzero(depth[block] > level)
            b = block[on]
            now[on] = _resume(
                kept[b, level], now[on], count[b, level],
                # Siblings after the slot are those to the right.
                [((slot[b, level] <= k) & (count[b, level] - 1 > k), beside[b, level, k])
                 for k in range(WIDTH - 1)])
            for k in range(WIDTH - 1):
                there = (depth[block] > level) & (count[block, level] - 1 > k)
                proofs.append((there, beside[block, level, k]))
        yield pa.RecordBatch.from_arrays(
            [trees.nodes.field("doc_id"), _hex(_digests(trees.nodes.field("digest"))),
             _hex(_digests(batch.column("subroot"))).take(pa.array(block)),
             pa.array([root.hex()] * len(block), pa.string()), pa.array(_proofs(proofs, len(block)), pa.string()),
             _hex(now), pa.array((now == want).all(1))],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _proofs(siblings: list, count: int) -> list[str]:
    """The digest of each node's siblings, read as hex text in order."""
    if not siblings:
        return [hashlib.sha256().hexdigest()] * count
    there = np.stack([t for t, _ in siblings], 1)
    digests = np.stack([d for _, d in siblings], 1)
    return [hashlib.sha256(d[t].tobytes().hex().encode()).hexdigest() for d, t in zip(digests, there)]


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """A row for each document: its leaf, the roots, its proof, and the root after tampering.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``; digests are hex text.
    ``tampered`` is the text that is folded to the root instead of the original; without it every
    row is verified.

    A NULL in any column is a dash in the leaf, and an absent column is all NULL; NULL and the empty
    text differ. NULL is a source of its own, before all others, and a NULL ``doc_id`` comes first in
    its source and is never tampered with. Equal ids are in the order of their leaves, then of what
    tampering makes of them; equal rows are leaves side by side. An empty table has no rows. A source
    of one document has the document's leaf as its root, and a proof without siblings is the digest
    of the empty text. Other columns are ignored, whatever their names.
    """
    rows = leaves(docs, tampered)
    numbered = _numbered(rows, ["source", "doc_id", "digest", "changed"], "leaves", "source")
    rounds, subroots = _grow(numbered, ("doc_id", "changed"))
    numbered = _numbered(subroots.withColumnRenamed("tree", "source"), ["source"], "sources")
    # The tree of the sources; its nodes carry the name of their source.
    upper, root = _grow(numbered, ("source",))
    top = root.first()
    if top is None:
        top = {"digest": b""}
    whole = bytes(top["digest"])
    empty = F.lit(b"")
    start = root.select(
        "tree", F.lit(0).cast("long").alias("pos"), F.lit(whole).alias("subroot"),
        *(empty.alias(name) for name in _PATH_NAMES))
    lowest = _with_paths(upper[0], _descend(upper, start))
    shape = f"tree string, pos long, subroot binary, {_PATH}"
    tops = stored(lowest.mapInArrow(_source_paths, shape), "merkle-source-paths")
    leaf_blocks = _with_paths(rounds[0], _descend(rounds, tops))
    return leaf_blocks.mapInArrow(
        lambda batches: _fold(batches, whole),
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
        "verified boolean")


def _source_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each source's root, and that root, by the name of the source."""
    for batch in batches:
        for out in _extend(iter([batch])):
            nodes = batch.column("nodes").flatten()
            columns = [nodes.field("source"), pa.array([0] * len(nodes), pa.int64()), nodes.field("digest")]
            yield pa.RecordBatch.from_arrays(
                columns + [out.column(name) for name in _PATH_NAMES],
                names=["tree", "pos", "subroot", *_PATH_NAMES])


_VALUES = "doc_id::varchar, source, lang, n_chars::varchar"
_LEAF = "sha256(concat_ws('', {}))".format(", ".join(
    f"case when {v} is null then '-' else octet_length(encode({v}))::varchar || ':' || {v} end"
    for v in [*(x.strip() for x in _VALUES.split(",")), "{text}"]))

#: DuckDB's statement of the manifest of ``documents``: both trees climbed a level at a time.
SQL = f"""with recursive
marked as (select *, {crc32(ascii_codes("doc_id::varchar"))} % {TAMPERED} = 0 as chosen from documents),
leaves as (select doc_id, source, {_LEAF.format(text="text")} as leaf,
  {_LEAF.format(text="(case when chosen then replace(text, chr(10), '') else text end)")} as changed from marked),
placed as (select *, row_number() over (partition by source
  order by doc_id nulls first, leaf, changed) - 1 as pos from leaves),
up as (select 0 as level, source, pos, leaf as h, count(*) over (partition by source) as n from placed
  union all select level + 1, source, pos // 3, sha256(string_agg(h, '' order by pos)), (any_value(n) + 2) // 3
  from up where n > 1 group by level, source, pos // 3),
subroots as (select source, h as subroot, row_number() over (order by source nulls first) - 1 as place
  from up where n = 1),
over as (select 0 as level, place as pos, subroot as h, count(*) over () as n from subroots
  union all select level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (any_value(n) + 2) // 3
  from over where n > 1 group by level, pos // 3),
below as (select row_number() over () as id, doc_id, source, leaf, 0 as level, pos, changed as h, '' as proof from placed
  union all select b.id, any_value(b.doc_id), any_value(b.source), any_value(b.leaf), any_value(b.level) + 1,
    any_value(b.pos) // 3, sha256(string_agg(case when u.pos = b.pos then b.h else u.h end, '' order by u.pos)),
    any_value(b.proof) || coalesce(string_agg(u.h, '' order by u.pos) filter (where u.pos <> b.pos), '')
  from below b join up u on u.source is not distinct from b.source and u.level = b.level
    and u.pos // 3 = b.pos // 3 and u.n > 1 group by b.id),
tops as (select b.*, place from below b join subroots s on s.source is not distinct from b.source
  where b.level = (select max(level) from up u where u.source is not distinct from b.source)),
above as (select id, doc_id, leaf, source, 0 as level, place as pos, h, proof from tops
  union all select a.id, any_value(a.doc_id), any_value(a.leaf), any_value(a.source), any_value(a.level) + 1,
    any_value(a.pos) // 3, sha256(string_agg(case when o.pos = a.pos then a.h else o.h end, '' order by o.pos)),
    any_value(a.proof) || coalesce(string_agg(o.h, '' order by o.pos) filter (where o.pos <> a.pos), '')
  from above a join over o on o.level = a.level and o.pos // 3 = a.pos // 3 and o.n > 1 group by a.id),
whole as (select h as root, level from over where n = 1)
select a.doc_id, a.leaf, s.subroot, w.root, sha256(a.proof) as proof_sha256, a.h as folded_root, a.h = w.root as verified
from above a join whole w on a.level = w.level join subroots s on s.source is not distinct from a.source"""
