"""Spelling variants: words one edit apart, found in a reduced alphabet.

Every letter is hashed to one of ``SYMBOLS`` symbols. A word that differs by one edit has a reduced
word that is the same or differs by one edit, so each reduced word's full one-edit neighbourhood is
generated (deletions, replacements, insertions, and itself) and joined with the reduced vocabulary;
the original strings confirm. With few symbols a neighbourhood is small whatever the alphabet, but
many words share a reduced word. An edit lies in one of ``ZONES`` parts of a word and leaves the
letters of the others as they are, so the joined key holds those letters too: classes stay small and
no class forms all of its pairs.

Counting goes over bytes in numpy, combines in each task and again by word in Spark. A task keeps a
bounded table; the vocabulary is never on one machine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelog.llm.checksum_sql import crc32
from statelog.llm.common import as_bytes, batched, stored, worker_cache
from statelog.llm.windows import Powers, mixed, segment_hashes

SYMBOLS = 3
ZONES = 5
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: A form is at least so many times as frequent as the word.
FORM_RATIO = 2
#: A run loses a letter where this divides its checksum.
FAULT = 97
#: Distinct words that a task keeps before it hands them on.
KEPT_WORDS = 400_000

_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
#: The first byte of U+00C0 to U+00FF; a second one always follows.
_LEAD = 0xC3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ------------------------------------------------------------------ runs and their checksums


def _zero_tables(longest: int) -> np.ndarray:
    """[n, k, v]: what byte ``k`` of a CRC-32 becomes over ``n`` more bytes, to be combined by xor."""
    step = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
    tables = np.empty((longest + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(longest):
        now = tables[n]
        tables[n + 1] = (now >> np.uint32(8)) ^ step[now & np.uint32(255)]
    return tables


#: Longer runs are checked one by one.
_LONGEST = 64


class _Checksums:
    """CRC-32 of ``<doc_id>:<run>`` from those of its two parts."""

    def __init__(self) -> None:
        self.tables = _zero_tables(_LONGEST)

    def joined(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = second.copy()
        for k in range(4):
            out ^= self.tables[lengths, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
        return out


def run_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8."""
    inside = np.zeros(len(data) + 2, bool)
    lead = data == _LEAD
    inside[1:-1] = _ASCII[data] | lead
    inside[2:-1] |= lead[:-1]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def _count(ids: list, texts: list[bytes], counts: dict[bytes, int], powers: Powers, sums: _Checksums) -> None:
    """Add the words of some texts to ``counts``, faults applied."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends = run_bounds(data)
    if not len(starts):
        return
    _, first, which = np.unique(
        segment_hashes(data, starts, ends, powers), return_index=True, return_inverse=True)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    lengths = (ends - starts).astype(np.int64)
    own = np.array([zlib.crc32(w) for w in words], np.uint32)[which]
    before = [b"%s:" % (b"" if i is None else str(i).encode()) for i in ids]
    of_doc = np.array([zlib.crc32(b) for b in before], np.uint32)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    checksum = sums.joined(of_doc[doc], own, np.minimum(lengths, _LONGEST)).astype(np.int64)
    for i in np.flatnonzero(lengths > _LONGEST).tolist():
        checksum[i] = zlib.crc32(before[doc[i]] + words[which[i]])
    found = np.bincount(which, minlength=len(words))
    for i in np.flatnonzero(checksum % FAULT == 0).tolist():
        found[which[i]] -= 1
        letters = words[which[i]].decode()
        at = int(checksum[i]) % len(letters)
        word = (letters[:at] + letters[at + 1 :]).encode()
        counts[word] = counts.get(word, 0) + 1
    for word, n in zip(words, found.tolist()):
        if n:
            counts[word] = counts.get(word, 0) + n


def _batch(counts: dict[bytes, int]) -> pa.RecordBatch:
    """The counted words that are long enough."""
    letters = ((w.decode(), n) for w, n in counts.items() if len(w) >= LEAST_LETTERS)
    kept = [(w, n) for w, n in letters if len(w) >= LEAST_LETTERS]
    return pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())],
        names=["word", "n"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, sums = worker_cache("spelling: powers", Powers), worker_cache("spelling: checksums", _Checksums)
    counts: dict[bytes, int] = {}
    for batch in batched(batches, "text"):
        texts = [t or b"" for t in as_bytes(batch.column("text"))]
        _count(batch.column("doc_id").to_pylist(), texts, counts, powers, sums)
        if len(counts) > KEPT_WORDS:
            yield _batch(counts)
            counts = {}
    yield _batch(counts)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    counted = docs.select("doc_id", "text").mapInArrow(_word_counts, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ------------------------------------------------------------------ reduced words


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def reduced(letters: np.ndarray) -> np.ndarray:
    """The symbol, from 1 on, of each letter."""
    return (mixed(letters.astype(np.uint64) + np.uint64(1)) % np.uint64(SYMBOLS)) + np.uint64(1)


class _Words:
    """Words of one length: sums over their letters and symbols, for all edits at once."""

    def __init__(self, letters: np.ndarray) -> None:
        self.count, self.length = letters.shape
        self.symbols = reduced(letters)
        factors = np.full(self.length + 1, _BASE)
        factors[0] = 1
        self.up = np.multiply.accumulate(factors)
        #: Reduced words' sums of the symbols before each place.
        self.before = self._sums(self.symbols)
        self.whole = self.before[:, -1]
        self.letters = self._sums(mixed(letters.astype(np.uint64) + np.uint64(77)))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.count, self.length + 1), np.uint64)
        np.cumsum(values * self.up[: self.length], axis=1, out=out[:, 1:])
        return out

    def kept(self, zone: int, shorter: int) -> np.ndarray:
        """The original letters that an edit in a part of the word leaves as they are.

        ``shorter`` is the shorter length of a pair; it says where the parts end for both words.
        """
        head, tail = zone * shorter // ZONES, shorter - (zone + 1) * shorter // ZONES
        down = np.uint64(pow(int(_INVERSE), self.length - tail, 2**64))
        last = (self.letters[:, -1] - self.letters[:, self.length - tail]) * down
        return mixed(mixed(self.letters[:, head]) + last * np.uint64(3) + np.uint64(ZONES * shorter + zone))

    def key(self, words: np.ndarray, zone: int, shorter: int, length: int) -> np.ndarray:
        """Reduced words of ``length`` symbols, with the letters kept, as one number."""
        kept = self.kept(zone, shorter)
        return mixed(mixed(words * np.uint64(5) + np.uint64(length)) ^ (kept if words.ndim == 1 else kept[:, None]))

    def published(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, keys) under which a word is found, by its partner's length."""
        everyone = np.arange(self.count)
        for shorter in (self.length - 1, self.length):
            for zone in range(ZONES):
                yield everyone, self.key(self.whole, zone, shorter, self.length)

    def neighbourhood(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, keys) of the reduced words within one edit, each once a zone."""
        everyone = np.arange(self.count)
        for zone in range(ZONES):
            yield everyone, self.key(self.whole, zone, self.length, self.length)
            yield from self._replaced(zone)
            yield from self._deleted(zone)
            yield from self._inserted(zone)

    def _places(self, zone: int, shorter: int, end: int) -> np.ndarray:
        last = end if zone == ZONES - 1 else (zone + 1) * shorter // ZONES
        return np.arange(zone * shorter // ZONES, last)

    def _rows(self, keys: np.ndarray, new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Keys by word and place as rows; only those that no earlier place of the zone gave."""
        number = np.repeat(np.arange(self.count), keys.shape[1])
        if new is None:
            return number, keys.ravel()
        new[:, :1] = True
        return number[new.ravel()], keys[new]

    def _replaced(self, zone):
        at = self._places(zone, self.length, self.length)
        symbols = self.symbols[:, at]
        for step in range(1, SYMBOLS):
            other = (symbols - np.uint64(1) + np.uint64(step)) % np.uint64(SYMBOLS) + np.uint64(1)
            words = self.whole[:, None] + (other - symbols) * self.up[at]
            yield self._rows(self.key(words, zone, self.length, self.length))

    def _deleted(self, zone):
        at = self._places(zone, self.length - 1, self.length)
        words = self.before[:, at] + (self.whole[:, None] - self.before[:, at + 1]) * _INVERSE
        # Within a run of one symbol any deletion gives the same word.
        new = self.symbols[:, at] != self.symbols[:, at - 1]
        yield self._rows(self.key(words, zone, self.length - 1, self.length - 1), new)

    def _inserted(self, zone):
        at = self._places(zone, self.length, self.length + 1)
        rest = (self.whole[:, None] - self.before[:, at]) * _BASE + self.before[:, at]
        for symbol in range(1, SYMBOLS + 1):
            added = np.uint64(symbol)
            keys = self.key(rest + added * self.up[at], zone, self.length, self.length + 1)
            yield self._rows(keys, self.symbols[:, at - 1] != added)


def _keyed(wanted: str):
    """Rows of (key, id) of the reduced vocabulary, or of its neighbourhoods."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Every letter is one byte of Latin-1.
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            ids = np.asarray(batch.column("id"))
            lengths = np.array([len(w) for w in words])
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                # Long words a few at a time.
                step = max(1, (1 << 18) // length)
                for part in range(0, len(at), step):
                    here = at[part : part + step]
                    letters = np.frombuffer(b"".join(words[i] for i in here), np.uint8).reshape(-1, length)
                    for number, keys in getattr(_Words(letters), wanted)():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.view(np.int64)), pa.array(ids[here[number]])], names=["key", "id"])

    return rows


# ------------------------------------------------------------------ pairs and forms


def _joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by shuffle, whatever size Spark expects.

    Both sides grow with the vocabulary. Spark takes the bytes of the compressed files for their size,
    also for the keys made of them, many rows a word; by that it would broadcast them from the driver.
    """
    return left.join(right.hint("merge"), on, how)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every word with each word one edit away; ``words`` holds (id, word, n)."""
    few = words.select("word", "id")
    vocabulary = few.mapInArrow(_keyed("published"), "key long, id long")
    around = few.mapInArrow(_keyed("neighbourhood"), "key long, id long")
    near = vocabulary.withColumnRenamed("id", "near_id")
    # A pair may meet under several keys; ids are compared before any string is read.
    met = _joined(around, near, "key").where("id != near_id").select("id", "near_id").distinct()
    other = words.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = _joined(_joined(met, words.select("id", "word"), "id"), other, "near_id")
    return both.where(F.levenshtein("word", "near") == 1).select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, by doubling the step each round.

    A form is at least twice as frequent as its word, so chains are short and never turn back.
    """
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(_joined(steps, ahead, "root", "left").select("word", "root", "further"), "spelling-steps")
        steps = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.where("further is not null").isEmpty():
            return steps


def variants(docs: DataFrame) -> DataFrame:
    """A row for each word: ``word, form, root, n, n_near, form_n``.

    A run of letters is one of ``docs`` (doc_id, text); A-Z are lower-cased. A NULL text has no runs,
    and a NULL ``doc_id`` is empty in the checksum that decides about faults. Repeated rows count
    again. Ties of the most frequent near word go to the smallest in code-point order. A table without
    frequent words gives no rows; other columns are ignored. Runs of any length are words.
    """
    # Numbered in a written table, so that both sides of a pair know it by the same number.
    words = stored(vocabulary(docs), "spelling-vocabulary")
    words = stored(words.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = _joined(words.drop("id"), found, "word", "left")
    most = -F.col("best.less")
    is_form = most >= FORM_RATIO * F.col("n")
    judged = stored(joined.select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, most).alias("form_n")), "spelling-forms")
    roots = _roots(judged.where("form is not null"))
    return _joined(judged, roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CODES = ("flatten(list_transform(string_split({0}, ''), lambda x: case when unicode(x) < 128 "
          "then [unicode(x)::bigint] else [195, unicode(x)::bigint - 64] end))")
_RUNS = "[A-Za-z\\x{00C0}-\\x{00FF}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: DuckDB's statement of ``variants`` over ``documents``. Its edit distance counts bytes, so letters
#: beyond ASCII stand for other single bytes there.
SQL = f"""with recursive
runs as (select doc_id, run, count(*) as times from (select doc_id,
    unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_RUNS}')) as run
  from documents) group by all),
summed as (select run, times, {crc32("list_concat(list_transform(string_split(coalesce(doc_id::varchar, '') || ':', '')"
  ", lambda x: unicode(x)::bigint), " + _CODES.format("run") + ")")} as h from runs),
faulty as (select times, case when h % {FAULT} = 0
  then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word
  from summed),
words as (select word, sum(times)::bigint as n from faulty where length(word) >= {LEAST_LETTERS}
  group by word having sum(times) >= {LEAST_COUNT}),
plain as (select *, length(word) as len,
  translate(word, '{"".join(chr(i) for i in range(0xC0, 0x100))}',
    '{"".join(chr(i) for i in range(33, 97) if chr(i) != "'")}{{') as flat from words),
near as (select a.word, a.n, b.word as near, b.n as near_n from plain a join plain b
  on b.len between a.len - 1 and a.len + 1 and (left(a.flat, a.len // 2) = left(b.flat, a.len // 2)
    or right(a.flat, a.len // 2 - 1) = right(b.flat, a.len // 2 - 1))
  where levenshtein(a.flat, b.flat) = 1),
best as (select word, any_value(n) as n, count(*) as n_near, max(near_n) as most,
  arg_min(near, struct_pack(a := -near_n, b := near)) as form from near group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= {FORM_RATIO} * w.n then form end as form,
  case when most >= {FORM_RATIO} * w.n then most end as form_n from words w left join best b using (word)),
chain as (select word, word as root, form as next from forms
  union all select c.word, f.word, f.form from chain c join forms f on f.word = c.next)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from forms f
join chain c on c.word = f.word and c.next is null"""
