import math
import re

import pytest
from helpers import documents, words

from statelog.llm import licences


def split(text):
    return [w for w in re.split(r"[^a-z0-9.]+|\.(?![0-9])", text.lower()) if w]


def bigrams(found):
    return {" ".join(p) for p in zip(found, found[1:])}


def brute(rows, model):
    """The scan, line by line, with the model's own weights."""
    out = []
    for number, text in rows:
        for place, line in enumerate((text or "").split("\n")):
            found = split(line)
            grams = [g for g in set(found) | bigrams(found) if g in model.weights]
            if not grams:
                continue
            logits = [b + sum(model.weights[g][i] for g in grams) for i, b in enumerate(model.intercepts)]
            best = max(range(1, len(logits)), key=lambda i: logits[i])
            probability = math.exp(logits[best]) / sum(map(math.exp, logits))
            family = model.families[best]
            if probability < model.thresholds[family]:
                continue
            near = []
            for f, name, template in licences.TEMPLATES:
                if f == family:
                    known, own = bigrams(split(template)), bigrams(found)
                    least = min(len(known), len(own))
                    near.append((len(known & own) / least if least else 0.0, name))
            similarity, name = max(near)
            out.append((number, place, family, round(probability, 9), name, round(similarity, 9),
                        similarity >= licences.LIKENESS))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "All rights reserved."), (4, "all RIGHTS reserved!\nthe end")]
    for i, (_, _, text) in enumerate(licences.TEMPLATES):
        rows.append((10 + i, " ".join(words(i, 20)) + "\n" + text + "\n" + " ".join(words(99 + i, 9))))
    rows += [(100 + i, text) for i, text in enumerate(licences.ORDINARY)]
    rows += [(200 + i, "the version of " + " ".join(words(i, 8)) + " is public work") for i in range(60)]
    return rows + [(3, "All rights reserved."), (None, "Released under the MIT License.")]


def test_equals_brute_force(spark, corpus):
    docs = documents(spark, corpus)
    model = licences.train(docs.select("doc_id", "text"))
    found = [(r.doc_id, r.paragraph, r.family, round(r.probability, 9), r.template, round(r.similarity, 9), r.confirmed)
             for r in licences.scan(docs, model).collect()]
    assert sorted(found, key=str) == brute(corpus, model)


def test_families(spark, corpus):
    docs = documents(spark, corpus)
    result = licences.scan(docs)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
    found = {(r.doc_id, r.paragraph): r for r in result.collect()}
    for i, (family, _, _) in enumerate(licences.TEMPLATES):
        assert found[10 + i, 1].family == family and found[10 + i, 1].confirmed
    assert found[3, 0].family == found[4, 0].family == "reserved" and found[None, 0].family == "mit"
    assert not [k for k, r in found.items() if k[0] is not None and k[0] >= 100 and r.confirmed]
    # Worded otherwise than the templates.
    other = documents(spark, [(1, "This file is made available under the Apache License, Version 2.0"),
                              (2, "Distributed under the GNU General Public License version 3 or later"),
                              (3, "The license of the driver was valid in all public places")])
    rows = {r.doc_id: r.family for r in licences.scan(other).collect() if r.confirmed}
    assert rows == {1: "apache", 2: "gpl"}


def test_empty_table(spark, corpus):
    assert licences.scan(documents(spark, corpus).limit(0)).count() == 0


def test_every_unlike_line_teaches(spark):
    """Different lines with template words, many of them, each once."""
    rows = [(i, f"public work number{i} of the village\nno such line") for i in range(3_000)]
    rows += [(5_000, rows[0][1]), (5_001, licences.TEMPLATES[0][2]), (5_002, None)]
    _, anchors = licences._vocabulary(spark)
    lines = licences._lines(documents(spark, rows).select("doc_id", "text"), anchors)
    found = [" ".join(r.words) for r in licences._unlike(spark, lines).collect()]
    assert sorted(found) == sorted(f"public work number{i} of the village" for i in range(3_000))
