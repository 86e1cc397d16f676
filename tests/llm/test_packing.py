"""Packing: every token is placed once, nothing is overfull, only long items are split, little room is left."""

import random

import pytest
from locusframe.llm.packing import Windows, packed, token_counts
from locusframe.session import cut


@pytest.mark.parametrize("per_task", [50, 10_000])
def test_invariants(spark, per_task):
    rng = random.Random(per_task)
    sizes = {i: rng.choice([0, 1, 5, 100, 333, 1000, 1024, 4096, 5000]) if i % 3 else rng.randint(1, 900) for i in range(700)}
    table = cut(spark.createDataFrame(list(sizes.items()), "item long, n_tokens long"))
    rows = packed(table, 1024, open_windows=8, items_per_task=per_task).collect()
    used, seen = {}, {}
    for r in rows:
        used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        seen.setdefault(r["item"], []).append((r["first_token"], r["n_tokens"]))
    assert max(used.values()) <= 1024
    for i, n in sizes.items():
        parts = sorted(seen.get(i, []))
        assert sum(k for _, k in parts) == n
        assert len(parts) == (1 if 0 < n <= 1024 else -(-n // 1024))
        assert all(a == 1024 * j for j, (a, _) in enumerate(parts))
    assert sum(used.values()) / (len(used) * 1024) > 0.95


def test_best_fit():
    w = Windows(10, 2)
    assert w.place(6) == (0, None, False)
    assert w.place(7) == (1, None, False)
    assert w.place(3) == (1, None, True)
    assert w.place(5) == (2, None, False)
    assert w.place(8) == (3, 0, False)


def test_token_counts_and_empty(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "word " * 50_000), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r["item"]: r["n_tokens"] for r in token_counts(texts, "doc_id", "text").collect()}
    assert (got[1], got[2], got[3]) == (0, 0, 2) and got[4] >= 50_000 and got[5] > 1
    none = cut(spark.createDataFrame([], "item long, n_tokens long"))
    assert packed(none).count() == 0
    assert packed(cut(spark.createDataFrame([(1, 0)], "item long, n_tokens long"))).count() == 0
