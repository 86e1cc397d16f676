"""Itemset mining over combinations of open sets: which combinations are worth testing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.registry import operator

#: Fixed value: share of all rows that the rarest combination counts as at least. And most distinct flag vectors that the driver takes.
FLOOR = 1e-4
MOST_PATTERNS = 1 << 16


@operator("MOD-01", group="mining")
def squished(flags: DataFrame, column: str = "flags", floor: float = FLOOR) -> DataFrame:
    """(pattern, n, weight): every distinct 0/1 vector, weighted by the root of its abundance over the rarest's, rounded up.

    `floor`: the rarest counts as at least this share of all rows; no vector is left out. The weights of all vectors
    relate to one least count, which is read to the driver.
    """
    pattern = F.transform(column, lambda x: (x > 0).cast("int")).alias("pattern")
    counts = flags.select(pattern).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.sum("n").alias("all"), F.min("n").alias("least")).first()
    least = max(ends["least"] or 1, floor * (ends["all"] or 0)) ** 0.5
    return counts.select("pattern", "n", F.ceil(F.sqrt("n") / least).cast("bigint").alias("weight"))


def _matrix(patterns: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and weights on the driver: at most 2 ** sets rows, and no more than MOST_PATTERNS."""
    rows = patterns.select("pattern", "weight").orderBy(F.desc("weight"), "pattern").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} distinct combinations: raise the floor")
    return np.array([r["pattern"] for r in rows], float), np.array([r["weight"] for r in rows], float)


@operator("MOD-05", group="mining")
def normalized_rows(x: np.ndarray, seed: int = 42, jitter: float = 1e-5) -> np.ndarray:
    """Rows scaled to unit sum with a little seeded noise, so that equal rows can be told apart; zero rows stay zero."""
    noise = np.random.default_rng(seed).uniform(0, jitter, x.shape) * (x > 0)
    sums = (x + noise).sum(axis=1, keepdims=True)
    return np.divide(x + noise, sums, out=np.zeros_like(x), where=sums > 0)


def _codes(x: np.ndarray, words: np.ndarray, alpha: float, rounds: int = 50) -> np.ndarray:
    """Non-negative sparse codes of rows by coordinate descent on squared error + alpha * L1."""
    u = np.zeros((len(x), len(words)))
    gram, cross = words @ words.T, x @ words.T
    for _ in range(rounds):
        for j in range(len(words)):
            if gram[j, j] > 0:
                u[:, j] = np.maximum(0, (cross[:, j] - u @ gram[:, j] + u[:, j] * gram[j, j] - alpha) / gram[j, j])
    return u


def _learn(x: np.ndarray, weights: np.ndarray, n_words: int, alpha: float, seed: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), n_words, p=weights / weights.sum(), replace=len(x) < n_words)] + rng.uniform(0, 1e-3, (n_words, x.shape[1]))
    codes = np.zeros((len(x), n_words))
    for _ in range(rounds):
        words = np.divide(words, np.linalg.norm(words, axis=1, keepdims=True) + 1e-12)
        codes = _codes(x, words, alpha)
        weighted = codes * weights[:, None]
        grams, cross = codes.T @ weighted, weighted.T @ x
        for j in range(n_words):
            if grams[j, j] > 1e-12:
                words[j] = np.maximum(0, words[j] + (cross[j] - grams[j] @ words) / grams[j, j])
    return words, codes


@operator("MOD-02", "MOD-03", group="mining")
def candidate_words(patterns: DataFrame, n_words: int, most_sets: int | None = None, alphas: tuple[float, ...] = (0.0, 0.05, 0.1, 0.2, 0.4, 0.8), seed: int = 42) -> list[tuple[tuple[int, ...], float]]:
    """Candidate combinations with their usage: words of dictionaries learned at growing sparsity, as 0/1 vectors.

    At most 3 * n_words of greatest usage, of at most most_sets sets.
    """
    x, weights = _matrix(patterns)
    usage: dict[tuple[int, ...], float] = {}
    for fold, alpha in enumerate(alphas) if len(x) else ():
        words, codes = _learn(x, weights, max(1, min(n_words * 2, len(x) * 2)), alpha, seed + fold)
        for w, used in zip(words, (codes * weights[:, None]).sum(axis=0), strict=True):
            bits = tuple(int(v) for v in (w > 0.5 * w.max()) & (w > 0)) if w.max() > 0 else ()
            if sum(bits) and (most_sets is None or sum(bits) <= most_sets):
                usage[bits] = usage.get(bits, 0.0) + float(used)
    return sorted(usage.items(), key=lambda kv: (-kv[1], kv[0]))[: 3 * n_words]


def rebuild_error(x: np.ndarray, rebuilt: np.ndarray, codes: np.ndarray, words: np.ndarray, weights: np.ndarray, alpha: float = 0.01) -> float:
    """Weighted Manhattan distance plus alpha times the codes' sum; another function of this shape may be given instead."""
    return float((weights[:, None] * np.abs(x - rebuilt)).sum() + alpha * (weights[:, None] * codes).sum())


@operator("MOD-04", "EXT-02", group="mining")
def best_dictionary(patterns: DataFrame, candidates: list[tuple[int, ...]], n_words: int, error: Callable[..., float] = rebuild_error) -> list[tuple[tuple[int, ...], float]]:
    """(word, error after adding it): greedily the word whose addition lowers the error of rebuilding all patterns most."""
    x, weights = _matrix(patterns)
    chosen: list[tuple[tuple[int, ...], float]] = []
    rest = list(dict.fromkeys(candidates))
    while rest and len(chosen) < n_words:
        scored = []
        for c in rest:
            words = normalized_rows(np.array([w for w, _ in chosen] + [c], float), jitter=0.0) * np.array([[sum(w)] for w in [w for w, _ in chosen] + [c]])
            codes = _codes(x, words, 1e-4, 10)
            scored.append((error(x, codes @ words, codes, words, weights), c))
        best = min(scored)
        chosen.append((best[1], best[0]))
        rest.remove(best[1])
    return chosen


@operator("MOD-06", group="mining")
def frequent_combinations(flags: DataFrame, labels: list[str], column: str = "flags", least_support: float = 0.05) -> DataFrame:
    """(items, freq): frequent sets of open sets by FP-growth, which is parallel over conditional trees."""
    from pyspark.ml.fpm import FPGrowth

    names = F.array(*[F.lit(x) for x in labels])
    items = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda i: F.when(F.get(column, i) > 0, F.get(names, i))), lambda x: x.isNotNull())
    baskets = flags.select(items.alias("items")).where(F.size("items") > 0)
    found = FPGrowth(itemsCol="items", minSupport=least_support).fit(baskets).freqItemsets
    return found.select(F.array_sort("items").alias("items"), "freq")
