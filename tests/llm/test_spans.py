"""Shared spans against a table of all windows: copies, overlapping borrowings, edges, runs of one character, long texts."""

import random

import pytest
from locusframe.llm.spans import PIECE, shared_share, shared_spans


def brute(docs, length):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - length + 1) if d is not None else ():
            where.setdefault(t[i : i + length], set()).add(d)
    out = set()
    for d in {d for d, _ in docs if d is not None}:
        hit = set()
        for e, t in docs:
            if e == d and t:
                for i in range(len(t) - length + 1):
                    if len(where[t[i : i + length]]) > 1:
                        hit |= set(range(i, i + length))
        spans = sorted(hit)
        start = None
        for i, c in enumerate(spans):
            if i == 0 or c != spans[i - 1] + 1:
                start = c
            if i + 1 == len(spans) or spans[i + 1] != c + 1:
                out.add((d, start, c + 1))
    return out


def made(seed, length, letters):
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice(letters) for _ in range(n))

    pool = [text(rng.randint(length - 4, 3 * length)) for _ in range(6)]
    docs = []
    for d in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            source = rng.choice(pool + pool[:1] * 6)
            n = rng.randint(length // 2, 2 * length)
            at = rng.randint(0, max(0, len(source) - n))
            parts += [text(rng.randint(0, length)), source[at : at + n]]
        docs.append((d, "".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "z" * (2 * length)), (105, "z" * (3 * length)), (106, docs[5][1][:length]), (107, "é😀" * length), (108, "x" + "é😀" * length)]
    return docs


@pytest.mark.parametrize(("length", "letters"), [(20, "ab"), (40, "abcdefghij \r\n"), (160, "abcdefghij😀")])
def test_brute_force(spark, length, letters):
    docs = made(length, length, letters)
    df = spark.createDataFrame([*docs, (None, docs[3][1])], "doc_id long, text string").selectExpr("*", "1 AS p", "'x' AS base")
    assert {tuple(r) for r in shared_spans(df, length=length).collect()} == brute(docs, length)


def test_long_texts_across_pieces(spark):
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefgh ") for _ in range(2 * PIECE + 3000))
    b = "".join(rng.choice("ijklmnop ") for _ in range(PIECE)) + a[PIECE - 700 : PIECE + 900] + "q" * 50
    df = spark.createDataFrame([(1, a), (2, b), (3, a[:499])], "doc_id long, text string")
    got = {tuple(r) for r in shared_spans(df).collect()}
    assert got == {(1, PIECE - 700, PIECE + 900), (2, PIECE, PIECE + 1600)}


def test_empty_and_share(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert shared_spans(none).count() == 0
    df = spark.createDataFrame([(1, "ab" * 300), (2, "ab" * 250), (3, None), (4, "q")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"], r["share"]) for r in shared_share(df).collect()}
    assert got == {1: (600, 600, 1.0), 2: (500, 500, 1.0), 3: (0, 0, 0.0), 4: (1, 0, 0.0)}
