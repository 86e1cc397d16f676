"""Filling fixed-capacity containers with whole items: bounded-space online packing."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.session import cut

#: Tokens per container, windows that one task keeps open, and windows open in the merge of leftovers.
CAPACITY = 2048
OPEN_WINDOWS = 512
MERGE_WINDOWS = 4096
#: Items of a part are read in blocks of about so many per open window, largest first within a block.
ITEMS_PER_WINDOW = 2
#: A packing task gets about this many items, a merging task about this many leftover windows.
ITEMS_PER_TASK = 25_000
LEFTOVERS_PER_TASK = 100_000
#: Public vocabulary used by default, by the name under which the tokenizer package finds its file.
VOCABULARY = "byte_bpe_50k.tiktoken"

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """The public byte-level encoder for this vocabulary file (a name of the tokenizer package, or a path); kept per worker."""
    if vocabulary not in _ENCODERS:
        import base64
        import os

        import public_tokenizers
        import tiktoken

        path = vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def token_counts(rows: DataFrame, item: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(item, n_tokens) for every row; null texts count 0 tokens. Texts are measured whole, whatever their length."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [0 if t is None else len(encode(t)) for t in batch["text"]]
            yield pd.DataFrame({"item": batch["item"], "n_tokens": sizes})

    return rows.select(F.col(f"`{item}`").cast("bigint").alias("item"), F.col(f"`{text}`").alias("text")).mapInPandas(count, "item bigint, n_tokens bigint")


class Windows:
    """A fixed number of open windows, searched by their free room."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.free: list[tuple[int, int]] = []  # (room, window), sorted
        self.made = 0

    def place(self, size: int) -> tuple[int, int | None, bool]:
        """Window for an item of this size, the window that was closed for it, if any, and whether the item's is now full.

        Best fit: the window with the least room that is enough. If none fits and all windows are in use,
        the fullest one is closed and a new one opened.
        """
        closed = None
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                closed = self.free.pop(0)[1]
            room, window = self.capacity, self.made
            self.made += 1
        if room > size:
            bisect.insort(self.free, (room - size, window))
        return window, closed, room == size


def _packer(capacity: int, most: int, key: str) -> Callable:
    """A mapInPandas function: (item, piece, first, size, part) -> the same with its window, and whether it was left open."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows: Windows | None = None
        part, waiting = None, {}

        def leave() -> list[tuple]:
            return [(*row, window, True) for window in sorted(waiting) for row in waiting[window]]

        for batch in batches:
            out = []
            for row in batch[["item", "piece", "first", "size", key]].itertuples(index=False, name=None):
                if row[4] != part:
                    out += leave()
                    windows, waiting, part = Windows(capacity, most), {}, row[4]
                window, closed, full = windows.place(row[3])
                if closed is not None:
                    out += [(*r, closed, False) for r in waiting.pop(closed)]
                waiting.setdefault(window, []).append(row)
                if full:
                    out += [(*r, window, False) for r in waiting.pop(window)]
            yield pd.DataFrame(out, columns=["item", "piece", "first", "size", key, "window", "open"])
        yield pd.DataFrame(leave(), columns=["item", "piece", "first", "size", key, "window", "open"])

    return pack


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(item, piece, first, size): an item longer than the capacity is cut into full pieces and a rest, others stay whole.

    Items without tokens (null or empty texts) give no piece.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(capacity).cast("bigint"))
    each = sizes.where(F.col("n_tokens") > 0).select("item", "n_tokens", F.posexplode(starts).alias("piece", "first"))
    return each.select("item", "piece", "first", F.least(F.lit(capacity), F.col("n_tokens") - F.col("first")).cast("bigint").alias("size"))


def packed(sizes: DataFrame, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Pack items into containers -> (item, piece, first_token, n_tokens, container).

    sizes: (item LONG unique, n_tokens LONG), a table that is cheap to read again (written or checkpointed).
    The items are hashed into parts and within a part into blocks, which follow each other and are read largest item
    first: an order that a lost task repeats with the same result. A part keeps `open_windows` windows open, places best-fit and emits the fullest
    window when none fits. The windows still open at its end are then taken as items of their own size and merged in
    the same way, more windows being kept open. Only items above the capacity are split. Containers are numbered
    by part; a container of the merge has a negative part. Nothing is dropped: every token of every item is placed once.
    """
    total = sizes.count()
    parts = max(1, -(-total // items_per_task))
    blocks = max(1, total // parts // (ITEMS_PER_WINDOW * open_windows))
    block = F.pmod(F.xxhash64("item", F.lit(5)), F.lit(blocks))
    rows = pieces(sizes, capacity).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("bigint"))
    ready = rows.repartition(parts, "part").sortWithinPartitions("part", block, F.desc("size"), "item", "piece")
    schema = "item bigint, piece int, first bigint, size bigint, part bigint, window bigint, open boolean"
    first = cut(ready.mapInPandas(_packer(capacity, open_windows, "part"), schema))

    left = first.where("open").groupBy("part", "window").agg(F.sum("size").alias("size"))
    merge_parts = max(1, -(-parts * open_windows // LEFTOVERS_PER_TASK))
    units = left.select(F.col("window").alias("item"), F.lit(0).alias("piece"), F.col("part").alias("first"), "size", F.pmod(F.xxhash64("part", "window"), F.lit(merge_parts)).cast("bigint").alias("part"))
    merging = units.repartition(merge_parts, "part").sortWithinPartitions("part", F.desc("size"), "first", "item")
    merged = merging.mapInPandas(_packer(capacity, MERGE_WINDOWS, "part"), schema)
    homes = merged.select(F.col("first").alias("part"), F.col("item").alias("window"), F.concat_ws("-", F.lit("m"), "part", "window").alias("home"))
    placed = first.join(homes, ["part", "window"], "left")
    container = F.coalesce("home", F.concat_ws("-", F.lit("c"), "part", "window"))
    return placed.select("item", "piece", F.col("first").alias("first_token"), F.col("size").alias("n_tokens"), container.alias("container"))
