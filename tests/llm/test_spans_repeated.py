"""Shared spans of a passage that the document of lowest id holds twice, against a table of all windows."""

import random

import pytest
from locusframe.llm.spans import shared_spans
from test_spans import brute


@pytest.mark.parametrize("swapped", [False, True])
def test_passage_repeated_inside_one_document(spark, swapped):
    rng = random.Random(3)
    docs = []
    for k, n in enumerate((520, 560, 700, 1500)):
        p, x, q, r, s = ("".join(rng.choice("abcdefghij \n") for _ in range(m)) for m in (400, n, 400, 200, 300))
        pair = [p + x + q + r + x + s, p + x + q]
        docs += [(2 * k + i, t) for i, t in enumerate(pair[::-1] if swapped else pair)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in shared_spans(df).collect()} == brute(docs, 500)
