"""Benchmark decontamination: size-partitioned MinHash containment search, with exact checks.

A test item with n distinct 5-word shingles is in a document if the document holds 80 % of them.
At most ``n // 5`` may be missing, so of any k shingles of the item the document holds k - n // 5 at
least. Items are partitioned by size; within a partition every item is sketched by the same number
of its smallest shingle hashes, chosen so that more than half of the sketch has to be found. The
shingles of documents, whatever their length, meet the sketches in one join; nothing is missed, and
items that reach their number are checked on the shingles themselves.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statelog.llm.common import stored

SHINGLE = 5
#: Shared shingles times 100 are this times the item's at least.
CONTAINED = 80
#: So many sketch hashes are broadcast, after they have been counted; more are shuffled.
BROADCAST_HASHES = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: Column) -> Column:
    """Words between ASCII blanks, A-Z in lower case."""
    plain = F.translate(text, _UPPER, _UPPER.lower())
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _each_shingle(words: Column, build) -> Column:
    """An array of ``build`` of every shingle (an array of words); NULL for fewer words than SHINGLE.

    The words are an element of an array, so that they are computed once and not for each shingle.
    """

    def of(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(found) - (SHINGLE - 1))
        return F.when(F.size(found) >= SHINGLE, F.transform(starts, lambda i: build(F.slice(found, i, SHINGLE))))

    return F.transform(F.array(words), of)[0]


def _shingles(words: Column) -> Column:
    return _each_shingle(words, lambda s: s)


def _hashes(words: Column) -> Column:
    return _each_shingle(words, F.xxhash64)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, shingles, n): each row of the benchmark that has a shingle."""
    words = benchmark.select("item_id", _words(F.col("text")).alias("words"))
    items = words.select("item_id", F.array_distinct(_shingles(F.col("words"))).alias("shingles"))
    # Rows with the same id and text are one item.
    items = items.where("shingles is not null").distinct()
    return items.withColumns({"n": F.size("shingles"), "item": F.xxhash64("item_id", "shingles")})


def _sketches(items: DataFrame) -> DataFrame:
    """(hash, item, needed): the sketch of each item, by size partition."""
    missing = lambda size: F.floor(size * (100 - CONTAINED) / 100).cast("int")
    # A partition holds the sizes from a power of two to the next.
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("int") - 1
    length = F.least(F.col("n"), 2 * missing(upper) + 1)
    hashed = items.select(
        "item", "n", length.alias("length"),
        F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s))).alias("hashes"))
    return hashed.select(
        "item", (F.col("length") - missing(F.col("n"))).alias("needed"),
        F.explode(F.slice("hashes", F.lit(1), F.col("length"))).alias("hash"))


def _candidates(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(id, item): documents that hold enough of an item's sketch."""
    shingles = docs.select("id", F.explode(F.array_distinct(_hashes(_words(F.col("text"))))).alias("hash"))
    if sketches.count() <= BROADCAST_HASHES:
        sketches = F.broadcast(sketches)
    met = shingles.join(sketches, "hash")
    return met.groupBy("id", "item").agg(
        F.count("*").alias("found"), F.first("needed").alias("needed")
    ).where("found >= needed").select("id", "item")


def _contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, doc_id, item_id, n_shingles, n_shared) of documents and the items they contain.

    Rows are numbered as they are read: ``docs`` must give the same rows in the same order whenever
    it is read, as a table in files does.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text")
    items = stored(_items(benchmark), "leak-items")
    candidates = stored(_candidates(rows, _sketches(items)), "leak-candidates")
    # Written tables have a known size: Spark broadcasts small ones and shuffles others.
    texts = rows.join(candidates, "id").join(items, "item")
    shared = F.size(F.array_intersect(_shingles(_words(F.col("text"))), F.col("shingles")))
    checked = texts.select(
        "id", "doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))
    return checked.where(100 * F.col("n_shared") >= CONTAINED * F.col("n_shingles"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and each test item that it contains.

    Words are split at ASCII blanks, A-Z in lower case. Texts of fewer than 5 words, and NULL, have
    no shingle: such items match nothing and such documents hold nothing. Repeated document rows are
    reported each; items repeated with id and text are one. Empty tables give no rows; other columns
    are ignored.
    """
    found = _contained(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return found.select(
        "doc_id", "item_id", "n_shingles", "n_shared",
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no test item, with all their columns."""
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    found = _contained(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    gone = stored(found.select("id").distinct(), "leak-gone")
    return rows.join(gone, "id", "left_anti").select("row.*")


def sql_words(text: str) -> str:
    plain = f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"
    return f"list_filter(regexp_split_to_array({plain}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _sql_shingles(words: str) -> str:
    return f"list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i : i + 4], ' '))"


SQL = f"""
with item_words as (select distinct item_id, {sql_words("text")} as words from benchmark),
items as (select distinct item_id, list_sort(list_distinct({_sql_shingles("words")})) as shingles
          from item_words where len(words) >= 5),
item_shingles as (select item_id, len(shingles) as n, unnest(shingles) as shingle from items),
doc_words as (select doc_id, row_number() over () as id, {sql_words("text")} as words from documents),
doc_shingles as (select doc_id, id, unnest(list_distinct({_sql_shingles("words")})) as shingle
                 from doc_words where len(words) >= 5),
shared as (select doc_id, id, item_id, n, count(*) as n_shared
           from doc_shingles join item_shingles using (shingle) group by all)
select doc_id, item_id, n as n_shingles, n_shared, n_shared / n as containment
from shared where 100 * n_shared >= 80 * n
"""
