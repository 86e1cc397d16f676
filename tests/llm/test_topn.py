"""Top N per group against a plain sort: hot groups, ties, nulls, repeated rows, clashing columns, empty tables."""

import random

from locusframe.llm.topn import best_scores, top_n
from pyspark.sql import functions as F


def test_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), f"i{rng.randint(0, 300)}", rng.randint(0, 40), "x") for _ in range(3000)]
    rows += [("hot", None, 7, "x"), ("a", "i1", None, "x")]
    df = spark.createDataFrame(rows, "g string, item string, score long, salt string")
    scored = best_scores(df, ["g"], "item", "score")
    got = {(r["g"], r["item"], r["rank_no"]) for r in top_n(scored, ["g"], [F.desc("score")], ["item"], 5).collect()}
    best = {}
    for g, i, s, _ in rows:
        old = best.get((g, i))
        best[g, i] = s if old is None else old if s is None else max(old, s)
    want = set()
    for g in {k[0] for k in best}:
        order = sorted(((-(s if s is not None else -1), i or "", i) for (h, i), s in best.items() if h == g))
        want |= {(g, i, n + 1) for n, (_, _, i) in enumerate(order[:5])}
    assert got == want


def test_repeated_rows_and_columns(spark):
    df = spark.createDataFrame([("a", "x", 1, 9)] * 3 + [("a", "y", 1, 8)], "g string, item string, score long, rank_no long")
    got = [(r["item"], r["rank_no"]) for r in top_n(df, ["g"], [F.desc("score")], ["item"], 3).orderBy("rank_no").collect()]
    assert got == [("x", 1), ("x", 2), ("x", 3)]


def test_empty(spark):
    df = spark.createDataFrame([], "g string, item string, score long")
    assert top_n(df, ["g"], [F.desc("score")], ["item"], 3).count() == 0
