"""Long exact spans shared between records: level-wise doubling of repeated windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.skew import hot_keys
from locusframe.session import cut, drop_cut

#: Least length in characters of a shared stretch.
LENGTH = 500
#: Starts resolved together, in a first and a second round, before single starts are looked at.
CELLS = (73, 9, 1)
#: Characters that one vector operation covers; longer texts are read in overlapping pieces.
PIECE = 1 << 16
#: Low bits of a window's hash that give way to its place; the same everywhere, so that ties fall alike everywhere.
PLACE_BITS = np.uint64(24)

_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, size=1 << 16, dtype=np.uint64) | np.uint64(1)
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, kept and grown on demand."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest value of every `width` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(codes: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: the seed window that every window of `length` inside one text is looked up by.

    It is the leftmost one of least hash in the window, so equal windows have equal seed windows at equal places.
    Out come its start, the first and the last start of the windows that it stands for, and its hash.
    """
    width = length - seed + 1
    none = np.empty(0, np.int64)
    if len(codes) < length:
        return none, none, none, np.empty(0, np.uint64)
    up, down = _powers(len(codes) + 1)
    values = _TABLE[codes & 0xFFFF] ^ (codes >> 16).astype(np.uint64)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    hashes = (total[seed:] - total[:-seed]) * down[: len(codes) - seed + 1]
    hashes ^= hashes >> np.uint64(29)
    hashes *= _MIX
    hashes ^= hashes >> np.uint64(32)
    # The place rides along in the low bits, so that the least value says where it is; ties go to the left.
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    least = _sliding((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), width, np.minimum)
    at = (least & low).astype(np.int64)
    starts = np.arange(len(at))
    inside = np.repeat(ends, np.diff(np.concatenate(([0], ends))))[: len(at)] >= starts + length
    starts, at = starts[inside], at[inside]
    if not len(at):
        return none, none, none, np.empty(0, np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    return at[new], starts[new], starts[last], hashes[at[new]]


def _anchor_rows(length: int, seed: int):
    """A mapInPandas function: documents -> their anchors (doc_id, p, a, b, seed_hash)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, texts, ids, bases, size = [], [], [], [], 0

            def flush() -> None:
                codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                ends = np.cumsum([len(t) for t in texts])
                at, first, last, hashes = anchors(codes, ends, length, seed)
                of = np.searchsorted(ends, at, side="right")
                shift = np.array(bases)[of] - np.concatenate(([0], ends[:-1]))[of] if len(at) else at
                out.append(pd.DataFrame({"doc_id": np.array(ids, np.int64)[of], "p": at + shift, "a": first + shift, "b": last + shift, "seed_hash": hashes.view(np.int64)}))

            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                for base in range(0, len(text) - length + 1, PIECE):
                    part = text[base : base + PIECE + length - 1] if len(text) > PIECE else text
                    texts.append(part), ids.append(doc), bases.append(base)
                    size += len(part)
                    if size >= PIECE:
                        flush()
                        texts, ids, bases, size = [], [], [], 0
                    if len(text) <= PIECE:
                        break
            if texts:
                flush()
            yield from out

    return run


def _with_class(rows: DataFrame, keys: list[str], total: int, **more: Column) -> DataFrame:
    """Rows with the first and last document (first_doc, last_doc) that have their key, and further aggregates.

    A hot key's rows never meet in one task: the fewer than 256 keys that hold more than 1/256 of all rows are
    broadcast with their aggregates, only the other keys' rows are shuffled.
    """
    named = {"first_doc": F.min("doc_id"), "last_doc": F.max("doc_id"), **more}
    classes = rows.groupBy(*keys).agg(*(v.alias(k) for k, v in named.items()), F.count(F.lit(1)).alias("n"))
    hot = classes.join(F.broadcast(hot_keys(classes, keys, total)), keys, "left_semi")
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = marked.where("n IS NULL").drop(*named, "n").join(classes, keys)
    return marked.where("n IS NOT NULL").unionByName(cold).drop("n")


def _regions(length: int, seed: int):
    """A mapInPandas function: documents with anchors -> the stretches of text around them, with the anchors inside."""
    reach = length - seed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, found in zip(batch["doc_id"], batch["text"], batch["found"], strict=True):
                have: list[list] = []
                for x in sorted((x["p"], x["a"], x["b"]) for x in found):
                    lo, hi = max(0, x[0] - reach), min(len(text), x[0] + length)
                    if have and lo <= have[-1][1]:
                        have[-1][1] = hi
                        have[-1][2].append(x)
                    else:
                        have.append([lo, hi, [x]])
                out += [(doc, lo, text[lo:hi], [{"p": p - lo, "lo": p - b, "hi": p - a, "left": 0} for p, a, b in xs]) for lo, hi, xs in have]
            yield pd.DataFrame(out, columns=["doc_id", "base", "text", "hits"])

    return run


def _digests(found: list[bytes | None]) -> tuple[pd.Series, pd.Series]:
    """96 bits of each digest as a LONG and an INT column, null where there is none."""
    raw = np.frombuffer(b"".join(x or bytes(16) for x in found), np.int64).reshape(-1, 2)
    none = np.array([x is None for x in found], bool)
    return pd.Series(raw[:, 0]).astype("Int64").mask(none), pd.Series(raw[:, 1].astype(np.int32)).astype("Int32").mask(none)


def _digest(buffer: memoryview, start: int, stop: int) -> bytes | None:
    """Digest of the characters from start to stop of a UTF-32 text; None where it doesn't reach so far."""
    return xxhash.xxh3_128_digest(buffer[4 * start : 4 * stop]) if start >= 0 and 4 * stop <= len(buffer) else None


def _grown(size: int):
    """A mapInPandas function: regions -> hashes of windows of `size` that a repeated window of half that is extended to.

    `left` is the number of characters of the window before its seed.
    """
    half = size // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, digests = [], []
            for doc, base, text, hits in zip(batch["doc_id"], batch["base"], batch["text"], batch["hits"], strict=True):
                buffer = memoryview(text.encode("utf-32-le", "surrogatepass"))
                for p, lo, hi, left in sorted({(x["p"], x["lo"], x["hi"], left) for x in hits for left in (x["left"], x["left"] + half)}):
                    if (digest := _digest(buffer, p - left, p - left + size)) is not None:
                        digests.append(digest)
                        rows.append((doc, base, p, lo, hi, left))
            out = pd.DataFrame(rows, columns=["doc_id", "base", "p", "lo", "hi", "left"]).astype("int64")
            out["h1"], out["h2"] = _digests(digests)
            yield out[["h1", "h2", "doc_id", "base", "p", "lo", "hi", "left"]]

    return run


def _celled(size: int, length: int, seed: int):
    """A mapInPandas function: regions -> the cells of `size` that the starts of their hits are cut into.

    lo and hi are a cell's least and greatest distance of a start before the seed. `all1, all2` hash what the cell's
    windows cover together (null beyond the text's ends), `core1, core2` what they have in common (null if size is 1).
    """
    reach = length - seed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, alls, cores = [], [], []
            for doc, base, text, hits in zip(batch["doc_id"], batch["base"], batch["text"], batch["hits"], strict=True):
                buffer = memoryview(text.encode("utf-32-le", "surrogatepass"))
                for p, lo in sorted({(x["p"], lo) for x in hits for lo in range(x["lo"] // size * size, x["hi"] + 1, size)}):
                    hi = min(lo + size - 1, reach)
                    every = _digest(buffer, p - hi, p - lo + length)
                    core = _digest(buffer, p - lo, p - hi + length) if size > 1 else None
                    if every is not None or core is not None:
                        rows.append((doc, base, p, lo, hi))
                        alls.append(every)
                        cores.append(core)
            out = pd.DataFrame(rows, columns=["doc_id", "base", "p", "lo", "hi"]).astype("int64")
            (out["all1"], out["all2"]), (out["core1"], out["core2"]) = _digests(alls), _digests(cores)
            yield out

    return run


def shared_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, span_start, span_end): maximal runs of characters that lie in a stretch of at least `length` characters
    occurring identically in another document. Positions count characters from 0, span_end is exclusive.

    Level by level: every window of `length` is looked up by one seed window of an eighth of that length, chosen by
    its content. Seeds that occur in a second document alone are extended to twice their length on either side, then
    again, while an extension must lie inside the window. The starts that the surviving seeds stand for are then
    resolved in cells: if all that a cell's windows cover occurs elsewhere, all of them do; if not even what they have in
    common does, none does; the rest is looked at in smaller cells down to single windows, until no candidate survives.
    A level is one hash aggregation over candidates, so work follows the repeated text, not the pairs of documents,
    and a group of any number of copies is never gathered or paired. Windows are compared by 96 bits of a 128-bit hash.

    Null ids or texts and texts shorter than `length` share nothing. Rows repeated under one id are one document.
    """
    seed = -(-length // 8)
    source = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    seeds = cut(source.mapInPandas(_anchor_rows(length, seed), "doc_id bigint, p bigint, a bigint, b bigint, seed_hash bigint"))
    twice = F.col("first_doc") != F.col("last_doc")
    found = _with_class(seeds, ["seed_hash"], seeds.count()).where(twice).groupBy("doc_id").agg(F.collect_set(F.struct("p", "a", "b")).alias("found"))
    regions = cut(source.join(found, "doc_id").mapInPandas(_regions(length, seed), "doc_id bigint, base bigint, text string, hits array<struct<p:bigint,lo:bigint,hi:bigint,left:bigint>>"))
    drop_cut(seeds)

    state, size, spent = regions, seed, None
    while 3 * size <= length:
        size *= 2
        windows = cut(state.mapInPandas(_grown(size), "h1 bigint, h2 int, doc_id bigint, base bigint, p bigint, lo bigint, hi bigint, left bigint"))
        if spent is not None:
            drop_cut(spent)
        spent = windows
        hits = _with_class(windows, ["h1", "h2"], windows.count()).where(twice).groupBy("doc_id", "base").agg(F.collect_set(F.struct("p", "lo", "hi", "left")).alias("hits"))
        state = regions.drop("hits").join(hits, ["doc_id", "base"])

    shared = []
    for size in CELLS:
        cells = cut(state.mapInPandas(_celled(size, length, seed), "doc_id bigint, base bigint, p bigint, lo bigint, hi bigint, all1 bigint, all2 int, core1 bigint, core2 int"))
        if spent is not None:
            drop_cut(spent)
            spent = None
        total = cells.count()
        whole = _with_class(cells.where("all1 IS NOT NULL"), ["all1", "all2"], total).drop("all1", "all2")
        whole = whole.unionByName(cells.where("all1 IS NULL").drop("all1", "all2"), allowMissingColumns=True)
        judged = cut(whole.withColumn("done", F.coalesce(twice, F.lit(False))).withColumn("stands", F.col("doc_id").isin(F.col("first_doc"), F.col("last_doc"))).drop("first_doc", "last_doc"))
        drop_cut(cells)
        shared.append(judged.where("done").select("doc_id", (F.col("base") + F.col("p") - F.col("hi")).alias("s"), (F.col("base") + F.col("p") - F.col("lo") + length).alias("e")))
        # What is open goes on, and of the cells that are done those of two documents of each kind: one of them is another
        # document than that of an open cell, even where this has a cell of the kind itself.
        going = judged.where("core1 IS NOT NULL AND (NOT done OR stands)").select("core1", "core2", "doc_id", "base", "p", "lo", "hi", "done")
        going = _with_class(going, ["core1", "core2"], total, still_open=F.max(~F.col("done"))).where(twice & F.col("still_open"))
        state = regions.drop("hits").join(going.groupBy("doc_id", "base").agg(F.collect_set(F.struct("p", "lo", "hi")).alias("hits")), ["doc_id", "base"])

    spans = shared[0]
    for more in shared[1:]:
        spans = spans.unionByName(more)
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.distinct().withColumn("new", (before.isNull() | (F.col("s") > before)).cast("int"))
    numbered = numbered.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("doc_id", "run").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("run")


def shared_share(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share) for every document: how much of it is shared elsewhere."""
    spans = shared_spans(docs, doc, text, length).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    whole = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.coalesce(F.length(f"`{text}`"), F.lit(0)).cast("bigint").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    share = F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0))
    return whole.join(spans, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), share.alias("share"))
