"""MinHash near-duplicates by a multi-index Hamming join of signatures.

A document's set of 4-word shingles gets a signature of 80 positions of 16 bits. The signature is
split into 16 chunks of 5 positions. Two signatures that differ in 31 positions or fewer have, by
the pigeonhole principle, a chunk with one differing position at most; so each chunk is looked up
under every choice of the position that may differ, and all pairs within that distance meet. At a
similarity of exactly 0.8 a pair differs in 16 positions on average and in more than 31 with
probability below 0.0001.

Documents with the same set are one class. The members of a bucket are tested against one of them;
links are confirmed on the full sets, and components are formed. Members that are still apart are
tested against a neighbour in a random order of each of their buckets, which joins what is left of
a large group of near copies. Only then do members that are in different components meet pair by
pair. No pair is left out, and a group of near copies costs a few tests for each member, not one for
each pair.

Before texts are read, a map of 1024 bits of each set rules pairs out for certain: a shingle that
only one set has changes one bit at most, so two maps never differ in more bits than the sets do in
shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelog.llm import windows
from statelog.llm.common import as_bytes, batched, releasing, stored, worker_cache
from statelog.llm.components import components
from statelog.llm.decontaminate import sql_words
from statelog.llm.shingles import shingle_set, word_hashes

SHINGLE = 4
#: Links need 100 * intersection >= SIMILAR * union.
SIMILAR = 80
CHUNKS, WIDTH = 16, 5
POSITIONS = CHUNKS * WIDTH
#: Errors allowed in a chunk, and the distance within which every pair is found.
ERRORS = 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1

#: Bits of the map of a set.
BITS = 1024

_RANDOM = np.random.default_rng(4_711)
_FACTORS = _RANDOM.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, POSITIONS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the smallest shingle under each of POSITIONS orders."""
    least = np.full(POSITIONS, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None] * _FACTORS + _SHIFTS
        least = np.minimum(least, part.min(axis=0))
    return ((least >> np.uint64(24)) & np.uint64(0xFFFF)).astype("<u2")


def bit_map(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle, several shingles a bit where they meet."""
    found = np.zeros(BITS, bool)
    found[(windows.mixed(shingles) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(found).view(np.int64)


def _shingles(text: bytes | None) -> np.ndarray:
    powers = worker_cache("near duplicates: powers", windows.Powers)
    return shingle_set(word_hashes(text or b"", powers), SHINGLE)


@releasing
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, two hashes and signature of each document's set."""
    for batch in batched(batches, "text"):
        sizes, one, two, signatures, maps = [], [], [], [], []
        for text in as_bytes(batch.column("text")):
            found = _shingles(text)
            sizes.append(len(found))
            one.append(int(np.bitwise_xor.reduce(windows.mixed(found))) if len(found) else 0)
            two.append(int(windows.mixed(found * _FACTORS[0]).sum()) if len(found) else 0)
            signatures.append(signature(found).view(np.int16) if len(found) else None)
            maps.append(bit_map(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("doc_id"), pa.array(sizes, pa.int64()),
             pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)),
             pa.array(signatures, pa.list_(pa.int16())), pa.array(maps, pa.list_(pa.int64()))],
            names=["id", "doc_id", "size", "one", "two", "signature", "bits"])


def _signatures(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint16).reshape(-1, POSITIONS).astype(np.uint64)


@releasing
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each chunk and each position of it that may differ, with what is held there."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            value = _signatures(part.column("signature"))
            keys, held = [], []
            for chunk in range(CHUNKS):
                for free in range(WIDTH):
                    key = np.full(len(value), np.uint64(chunk * WIDTH + free))
                    for i in range(WIDTH):
                        if i != free:
                            key = windows.mixed(key * _FACTORS[1] + value[:, chunk * WIDTH + i])
                    keys.append(key)
                    held.append(value[:, chunk * WIDTH + free].astype(np.int32))
            ids = part.column("rep").to_numpy()
            slots = np.repeat(np.arange(len(keys), dtype=np.int32), len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, len(keys))), pa.array(slots),
                 pa.array(np.concatenate(held))],
                names=["key", "rep", "slot", "held"])


@releasing
def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each key's group with the group's smallest; single members only at the edges."""
    from pyspark import TaskContext

    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    key, rep, slot, held = (rows.column(c).to_numpy() for c in ("key", "rep", "slot", "held"))
    order = np.lexsort((rep, key))
    key, rep, slot, held = key[order], rep[order], slot[order], held[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.cumsum(new) - 1
    edge = (group == 0) | (group == group[-1])
    keep = (np.bincount(group)[group] > 1) | edge
    center = rep[np.flatnonzero(new)][group]
    count = int(keep.sum())
    table = pa.table({
        "key": key[keep], "rep": rep[keep], "slot": slot[keep], "held": held[keep], "center": center[keep], "edge": edge[keep],
        "bucket": np.full(count, TaskContext.get().partitionId(), np.int32)})
    yield from table.to_batches(max_chunksize=50_000)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures lie within the distance."""
    for batch in batches:
        if batch.num_rows:
            a, b = (_signatures(batch.column(c)) for c in ("signature_a", "signature_b"))
            near = (a != b).sum(1) <= DISTANCE
            yield batch.select(["a", "b"]).filter(pa.array(near))


@releasing
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batched(batches, "text"):
        texts = [squeeze(x or b"") for x in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(texts, pa.binary())], names=["rep", "text"])


@releasing
def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    expand = zstandard.ZstdDecompressor().decompress
    last, of_last = None, None
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = []
        for i in range(batch.num_rows):
            if a[i] != last:
                last, of_last = a[i], _shingles(expand(batch.column("text_a")[i].as_py()))
            other = _shingles(expand(batch.column("text_b")[i].as_py()))
            shared = len(np.intersect1d(of_last, other, assume_unique=True))
            keep.append(100 * shared >= SIMILAR * (len(of_last) + len(other) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Join:
    """Classes of equal sets, and the tests of pairs of them."""

    def __init__(self, docs: DataFrame) -> None:
        rows = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text")
        kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"id long, doc_id {kind}, size long, one long, two long, signature array<short>, bits array<long>"
        self.texts = rows.select("id", "text")
        self.rows = stored(rows.mapInArrow(_sketch, schema), "near-rows")
        ranked = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
        self.classes = stored(
            self.rows.where("size > 0").groupBy("one", "two", "size").agg(
                F.min("id").alias("rep"), F.min(ranked).alias("low"), F.first("signature").alias("signature"),
                F.first("bits").alias("bits")),
            "near-classes")

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs within the signature distance that sizes and bit maps do not rule out."""
        sides = self.classes.select("rep", "size", "signature", "bits")
        for side in ("a", "b"):
            names = {c: f"{c}_{side}" for c in ("size", "signature", "bits")}
            pairs = pairs.join(sides.withColumnsRenamed({"rep": side} | names), side)
        fitting = pairs.where(_may_link("size_a", "size_b", "bits_a", "bits_b"))
        return fitting.select("a", "b", "signature_a", "signature_b").mapInArrow(_near, "a long, b long")

    def links(self, pairs: DataFrame, purpose: str) -> DataFrame:
        """The pairs that the full sets confirm."""
        pairs = stored(pairs, f"{purpose}-pairs")
        needed = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        texts = stored(self.texts.mapInArrow(_packed, "rep long, text binary").join(needed, "rep", "left_semi"),
                       f"{purpose}-texts")
        for side in ("b", "a"):
            pairs = pairs.join(texts.withColumnsRenamed({"rep": side, "text": f"text_{side}"}), side)
        return stored(pairs.mapInArrow(_confirmed, "a long, b long"), f"{purpose}-links")

    def components(self) -> DataFrame:
        """(node, root) of the classes that have links."""
        keys = self.classes.mapInArrow(_keys, "key long, rep long, slot int, held int")
        grouped = stored(
            keys.repartitionByRange("key", "rep").mapInArrow(
                _bucket, "key long, rep long, slot int, held int, center long, edge boolean, bucket int"), "near-groups")
        star = grouped.where("rep != center").select(F.col("center").alias("a"), F.col("rep").alias("b"))
        # A group that spans buckets has a centre in each; they are tested too.
        edges = grouped.where("edge").groupBy("bucket").agg(
            F.min(F.struct("key", "center")).alias("low"), F.max(F.struct("key", "center")).alias("high"))
        order = Window.orderBy("bucket")
        across = edges.withColumn("next", F.lead("low").over(order)).where("high.key = next.key")
        between = across.select(F.col("high.center").alias("a"), F.col("next.center").alias("b"))
        links = self.links(self._near(star.union(between).distinct()), "near-star")
        roots = stored(components(links), "near-roots")
        for step in (self._neighbours, self._apart):
            more = self.links(step(self._open(grouped, roots)), "near-more")
            if not more.isEmpty():
                # Roots stand for what they have reached.
                links = roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
                roots = stored(components(links), "near-roots")
        return roots

    def _open(self, grouped: DataFrame, roots: DataFrame) -> DataFrame:
        """The members of groups of three or more that are in several components. Groups of two have
        been tested, but where they span buckets they are no group of two."""
        placed = grouped.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
            "key", "rep", "slot", "held", "center", F.coalesce("root", "rep").alias("root"))
        mixed = placed.groupBy("key").agg(
            F.count("*").alias("members"), F.min("root").alias("least"), F.max("root").alias("most"),
        ).where("least != most and members > 2").select("key")
        return stored(placed.join(mixed, "key", "left_semi"), "near-open")

    def _neighbours(self, members: DataFrame) -> DataFrame:
        """Each member with the one before it in a random order of its group, in half the groups."""
        order = Window.partitionBy("key").orderBy(F.xxhash64("rep", "key"))
        before = members.where("slot % 2 = 0").withColumns(
            {"other": F.lag("rep").over(order), "other_root": F.lag("root").over(order)})
        pairs = before.where("root != other_root").select(
            F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
        return self._near(pairs.distinct())

    def _apart(self, members: DataFrame) -> DataFrame:
        """Pairs of a group in different components that sizes and bit maps do not rule out.

        Equal chunks meet under the choice of any position; only the first one counts then.
        """
        sides = members.join(self.classes.select("rep", "size", "bits"), "rep").drop("center")
        other = sides.drop("slot").withColumnsRenamed(
            {c: f"{c}2" for c in ("rep", "root", "size", "bits", "held")})
        return sides.join(other, "key").where(
            (F.col("rep") < F.col("rep2")) & (F.col("root") != F.col("root2"))
            & ((F.col("slot") % WIDTH == 0) | (F.col("held") != F.col("held2")))
            & _may_link("size", "size2", "bits", "bits2")
        ).select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct()


def _may_link(size: str, size2: str, bits: str, bits2: str):
    """Whether the sizes, and the bits in which the maps differ, allow a similar pair."""
    fits = 100 * F.least(size, size2) >= SIMILAR * F.greatest(size, size2)
    differ = F.aggregate(
        F.zip_with(bits, bits2, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    # intersection = (sizes - differing) / 2 and union = (sizes + differing) / 2
    most = (100 - SIMILAR) * (F.col(size) + F.col(size2))
    return fits & ((100 + SIMILAR) * differ <= most)


def duplicates(docs: DataFrame) -> DataFrame:
    """(id, doc_id, n_shingles, component_id, survivor) of each row.

    ``id`` numbers the rows as they are read: ``docs`` must give the same rows in the same order
    whenever it is read, as a table in files does.
    """
    join = _Join(docs)
    roots = join.components()
    classes = join.classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "one", "two", "size", "low", F.coalesce("root", "rep").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("lowest"))
    named = classes.join(lowest, "root").select("one", "two", "size", "lowest")
    rows = join.rows.select("id", "doc_id", "size", "one", "two").join(named, ["one", "two", "size"], "left")
    alone = F.col("lowest").isNull()
    return rows.select(
        "id", "doc_id", F.col("size").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("lowest.doc_id")).alias("component_id"),
        (alone | (F.col("lowest.id") == F.col("id"))).alias("survivor"))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """Set size and component of each document.

    Words are split at ASCII blanks, A-Z in lower case. Documents without words, and NULL texts,
    have no set and no links. The component id is the smallest ``doc_id`` reached; a NULL id counts
    after all others, and its row is kept if nothing else is in the component. Repeated rows are
    copies of each other and keep their rows. Other columns are ignored.
    """
    return duplicates(docs.select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest ``doc_id``, with all its columns."""
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    gone = stored(duplicates(docs.select("doc_id", "text")).where("not survivor").select("id"), "near-gone")
    return rows.join(gone, "id", "left_anti").select("row.*")


SQL = f"""
with recursive split as (select row_number() over () as id, doc_id, {sql_words("coalesce(text, '')")} as words from documents),
sets as (select id, doc_id, case when len(words) = 0 then []
  when len(words) < 4 then [array_to_string(words, ' ')]
  else list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')))
  end as shingles from split),
each_shingle as (select id, len(shingles) as n, unnest(shingles) as shingle from sets),
pairs as (select a.id as a, b.id as b from each_shingle a join each_shingle b
  on a.shingle = b.shingle and a.id < b.id group by a.id, b.id, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reached as (select id, id as other from sets union select r.id, l.b from reached r join links l on r.other = l.a),
lowest as (select r.id, min(s.doc_id) as component_id from reached r join sets s on s.id = r.other group by r.id)
select doc_id, len(shingles) as n_shingles, component_id, doc_id = component_id as kept
from sets join lowest using (id)
"""
