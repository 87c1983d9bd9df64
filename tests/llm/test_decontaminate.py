import random
import re

import duckdb
from helpers import documents, words

from statelog.llm import decontaminate


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def brute(docs, items):
    out = []
    for number, text in docs:
        held = shingles(text)
        for item, test in {(i, t) for i, t in items}:
            wanted = shingles(test)
            both = len(held & wanted)
            if wanted and 100 * both >= 80 * len(wanted):
                out.append((number, item, len(wanted), both, both / len(wanted)))
    return sorted(out)


def tables():
    pick = random.Random(3)
    items = [(i, " ".join(words(i, pick.randint(5, 90)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "only four words here"), (33, "A b\tc d\nE"), (34, items[0][1]), (0, items[0][1])]
    docs = [(0, None), (1, ""), (2, "a B c D e"), (3, "four words are few")]
    for i in range(10, 120):
        text = words(1000 + i, pick.randint(0, 600))
        for _ in range(pick.randint(0, 2)):
            test = (pick.choice(items[:30])[1]).split(" ")
            for _ in range(pick.choice([0, 0, 1, 2, 3])):
                test[pick.randrange(len(test))] = "other"
            at = pick.randint(0, len(text))
            text[at:at] = test
        docs.append((i, " ".join(text).title() if i % 3 else "\n".join(text)))
    return docs + [docs[20]], items


def test_equals_brute_force_and_sql(spark, monkeypatch):
    docs, items = tables()
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    found = decontaminate.leaks(documents(spark, docs).repartition(4, "doc_id"), benchmark)
    expected = brute(docs, items)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 40
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", docs)
    duck.execute("create table benchmark (item_id bigint, text varchar)")
    duck.executemany("insert into benchmark values (?, ?)", items)
    assert sorted(duck.execute(decontaminate.SQL).fetchall()) == expected
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
    found = decontaminate.leaks(documents(spark, docs), benchmark)
    assert sorted(map(tuple, found.collect())) == expected


def test_clean_documents_stay(spark):
    docs, items = tables()
    table = documents(spark, docs)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = decontaminate.without_leaks(table, benchmark)
    assert clean.columns == table.columns
    dirty = {row[0] for row in brute(docs, items)}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(n for n, _ in docs if n not in dirty)


def test_empty_tables(spark):
    docs, items = tables()
    table = documents(spark, docs)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.leaks(table.limit(0), benchmark).count() == 0
    assert decontaminate.leaks(table, benchmark.limit(0)).count() == 0
    assert decontaminate.without_leaks(table, benchmark.limit(0)).count() == len(docs)


def test_no_python_on_the_executors(spark):
    docs, items = tables()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    plan = decontaminate.leaks(documents(spark, docs), benchmark)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
