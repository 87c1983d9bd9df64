"""Small fixtures shared by the tests of this folder."""

from __future__ import annotations

import random


def words(seed: int, count: int, size: int = 400) -> list[str]:
    pick = random.Random(seed)
    pool = ["".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 8))) for _ in range(size)]
    return [pick.choice(pool) for _ in range(count)]


def documents(spark, rows):
    """Documents of (doc_id, text), with the other columns of the table and one more."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), "x") for i, t in rows]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_chars long, id string"
    )
