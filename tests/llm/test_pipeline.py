import random

import corpus_pipeline
import test_decontaminate
import test_near_dup
import test_packing
import test_suffix_dedup
from helpers import documents, words

from statelog.llm import fertility


def tables():
    pick = random.Random(8)
    items = [(i, " ".join(words(5000 + i, 12 + i))) for i in range(8)]
    shared = " ".join(words(77, 60))
    rows = [(0, None), (1, ""), (2, "short text"), (3, "same words again and again " * 30)]
    for i in range(10, 70):
        text = words(i, pick.randint(15, 300))
        if i % 7 == 0:
            text[5:5] = items[i % 8][1].split(" ")
        if i % 5 == 0:
            text[3:3] = shared.split(" ")
        rows.append((i, " ".join(text)))
        if i % 4 == 0:
            rows.append((1000 - i, " ".join(text)))
        if i % 6 == 0:
            rows.append((500 + i, " ".join(text[:-1] + ["other"])))
    pick.shuffle(rows)
    return rows, items


def test_stages_equal_brute_force(spark, tmp_path, monkeypatch):
    # Random letters are no language.
    monkeypatch.setitem(fertility.BANDS, "en", (fertility.Band(100, 1.0, 4.0),))
    rows, items = tables()
    documents(spark, rows).drop("id").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id for r in fertility.quality_report(docs).where("kept").collect()}
    good = [r for r in rows if r[0] in kept]
    assert len(good) < len(rows)
    ones = {r[0] for r in test_near_dup.brute(good) if r[3]}
    unique = [r for r in good if r[0] in ones]
    assert len(unique) < len(good)
    cut = [(n, rest) for n, rest in rests(unique)]
    assert cut != unique
    dirty = {r[0] for r in test_decontaminate.brute(cut, items)}
    clean = [r for r in cut if r[0] not in dirty]
    assert len(clean) < len(cut)
    test_packing.check(clean, corpus_pipeline.run(spark, str(tmp_path)).collect())


def rests(rows):
    """What the suffix stage leaves of each text, by brute force on its bytes."""
    starts = {}
    for number, text in rows:
        data = text.encode()
        for p in range(len(data) - 199):
            starts[data[p : p + 200]] = starts.get(data[p : p + 200], 0) + 1
    for number, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 199):
            if starts[data[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        yield number, bytes(b for b, g in zip(data, gone) if not g).decode()


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = tables()
    docs = documents(spark, rows[:30]).withColumnRenamed("id", "kept")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "near_duplicates"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.names == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
    assert test_suffix_dedup.brute(rows[:2])
