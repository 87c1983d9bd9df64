"""Quality rules: plain counts, and how well a public vocabulary fits the text.

Characters per token, the share of byte-fallback tokens and the entropy of the tokens are measured
with a public piece vocabulary; each language (else script) has bands outside which a text is
rejected. A word is tokenised by itself, as it stands after a blank, so each worker tokenises a
word once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from statelog.llm import windows
from statelog.llm.common import BLANKS, as_bytes, batched, column_or_null, worker_cache
from statelog.llm.words import WordTable

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
GRAM = 5

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Band:
    """What a text of so many tokens must reach: characters per token, bits of entropy."""

    tokens: int
    least_fertility: float
    least_entropy: float


#: Longest first; texts of fewer tokens than the last band are only held to LIMITS. Measured on
#: documents labelled as good: below the lowest half per cent.
BANDS: dict[str, tuple[Band, ...]] = {
    "en": (Band(300, 2.06, 6.13), Band(100, 1.88, 5.4)),
    "de": (Band(300, 2.06, 6.03), Band(100, 2.0, 5.4)),
    "fr": (Band(300, 1.83, 6.05), Band(100, 1.65, 5.4)),
    "es": (Band(300, 1.79, 6.05), Band(100, 1.75, 5.4)),
    "latin": (Band(300, 1.75, 5.9), Band(100, 1.6, 5.2)),
    "other": (Band(300, 0.4, 4.0), Band(100, 0.3, 3.5)),
}


@dataclass(frozen=True)
class Limits:
    """What holds in every language: characters per token, and the share of byte tokens."""

    least_fertility: float = 0.25
    most_fertility: float = 12.0
    most_bytes: float = 0.5
    tokens: int = 20


LIMITS = Limits()


class Pieces(WordTable):
    """The tokens of words by the public piece vocabulary."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def tokenised(self, words: list[bytes]) -> list[list[int]]:
        return self.model.encode([w.decode() for w in words], num_threads=1)


def repeated_words(words: np.ndarray) -> int:
    """Words, given by their hashes, inside 5-word windows that occur twice or more in the text."""
    count = len(words)
    if count <= GRAM:
        return 0
    window = np.zeros(count - GRAM + 1, np.uint64)
    for k in range(GRAM):
        window = windows.mixed(window * _FACTOR + words[k : count - GRAM + 1 + k])
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0
    again = np.zeros(len(window), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    inside = np.zeros(count, bool)
    for k in range(GRAM):
        inside[k : count - GRAM + 1 + k] |= again
    return int(inside.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """``latin`` where most letters of the text are, else ``other``."""
    letters = sum(map(str.isalpha, text))
    if text.isascii() or not letters:
        return "latin"
    latin = sum(1 for c in text if c.isalpha() and ord(c) < 0x250)
    return "latin" if 2 * latin >= letters else "other"


def fits(lang: str | None, text: str, chars: int, tokens: np.ndarray, pieces: Pieces) -> bool:
    """Whether fertility, byte share and entropy lie in the bands of the language or script."""
    total = len(tokens)
    if total < LIMITS.tokens:
        return True
    fertility = chars / total
    if not LIMITS.least_fertility <= fertility <= LIMITS.most_fertility:
        return False
    if pieces.is_byte[tokens].mean() > LIMITS.most_bytes:
        return False
    bands = BANDS.get(lang or "") or BANDS[script_of(text)]
    for band in bands:
        if total >= band.tokens:
            count = np.bincount(tokens, minlength=1)
            count = count[count > 0]
            entropy = np.log2(total) - float((count * np.log2(count)).sum()) / total
            return fertility >= band.least_fertility and entropy >= band.least_entropy
    return True


def _verdict(text: bytes, lang: str | None, words: np.ndarray, tokens: np.ndarray, pieces: Pieces) -> tuple:
    string = text.decode()
    chars = len(string) - sum(map(string.count, BLANKS))
    again = repeated_words(words)
    failed = len(words) < 10 or 100 * again > 20 * len(words)
    kept = not failed and fits(lang, string, chars, tokens, pieces)
    return (len(words), chars, sum(map(string.count, SYMBOLS)), duplicate_lines(string), again, failed, kept)


def _judge(path: str):
    def verdicts(texts: pa.Array, langs: pa.Array) -> list[tuple]:
        pieces = worker_cache(f"fertility: {path}", lambda: Pieces(path))
        whole = [t or b"" for t in as_bytes(texts)]
        found = pieces.lookup(whole)
        return [
            _verdict(text, lang, found.words(i), found.tokens(i), pieces)
            for i, (text, lang) in enumerate(zip(whole, langs.to_pylist()))
        ]

    return verdicts


def quality_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Counts and verdict of each document, by whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``. A NULL text has none; with fewer than 10 words a document
    fails. ``lang`` may be missing or NULL: then the script decides. Rows that come twice are judged
    twice; an empty table gives no rows; other columns are ignored.
    """
    judge = _judge(vocabulary or public_tokenizers.path(VOCABULARY))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
        for batch in batched(batches, "text"):
            found = judge(batch.column("text"), batch.column("lang"))
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", column_or_null(docs, "lang", "string").alias("lang"))
    return texts.mapInArrow(
        rows,
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean",
    )


def keep_good(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The documents that are kept, with all their columns; see ``quality_report``.

    Repeated rows are kept or go alike, an empty table stays empty, and other columns, NULL or not,
    stay as they are.
    """
    judge = _judge(vocabulary or public_tokenizers.path(VOCABULARY))
    has_lang = "lang" in docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, "text"):
            langs = batch.column("lang") if has_lang else pa.nulls(batch.num_rows)
            yield batch.filter(pa.array([v[-1] for v in judge(batch.column("text"), langs)], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
