"""Leakage against a comparison of all runs of words; changed outer form, full sieves, nulls, empty and long texts."""

import random
import re

import pytest
from locusframe.llm import leakage
from locusframe.llm.leakage import RUN, leaked_items, words


def runs(text):
    ws = [w.lower() for w in re.findall(r"[^\W_]+", re.sub(r"\\[A-Za-z]+", " ", text or ""))]
    return {tuple(ws[i : i + RUN]) for i in range(len(ws) - RUN + 1)}


def data():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["Über", "été", "x1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, items[0][1]), (0, items[0][1]), (0, items[5][1]), (33, "w1 " * 3000 + items[2][1])] + [items[4]] * 50
    docs = []
    for d in range(120):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if d % 2:
            source = items[rng.choice([0, 0, 0, rng.randrange(30)])][1].split()
            n = rng.randint(10, 25)
            at = rng.randint(0, max(0, len(source) - n))
            part = [w.upper() if rng.random() < 0.3 else w for w in source[at : at + n]]
            ws[3:3] = [rng.choice([w, "\\emph{" + w + "}", w + ",\r\n", "--" + w, w + "\\foo "]) for w in part]
        docs.append((d, " ".join(ws)))
    docs += [(200, None), (201, ""), (202, "w1 " * 40_000 + items[1][1]), (203, items[1][1]), (203, items[1][1]), (None, items[1][1])]
    return docs, items


@pytest.mark.parametrize("bits", [25, 6])
def test_brute_force_and_full_sieve(spark, monkeypatch, bits):
    monkeypatch.setattr(leakage, "MOST_BITS", bits)
    docs, items = data()
    item_runs = {(i, r) for i, t in items for r in runs(t)}
    want = set()
    by_run = {}
    for i, r in item_runs:
        by_run.setdefault(r, set()).add(i)
    for d, t in docs:
        if d is not None:
            for r in runs(t) & by_run.keys():
                want |= {(d, i) for i in by_run[r]}
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS segment")
    b = spark.createDataFrame(items, "item_id long, item_text string").selectExpr("*", "'y' AS text")
    assert len(want) > 30
    rows = [tuple(r) for r in leaked_items(a, b).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_words():
    assert words("\\section{A b_c} x\\y1 Z9-ß") == ["a", "b", "c", "x", "1", "z9", "ß"]
    assert words(None) == [] and words("İx") == ["i̇x"]


def test_empty(spark):
    docs, items = data()
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    assert leaked_items(a.limit(0), b).count() == 0
    assert leaked_items(a, b.limit(0)).count() == 0
