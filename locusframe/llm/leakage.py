"""Evaluation texts leaking into training text: prefix-filtered set join of word shingles with exact verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.skew import hot_keys, replicated, salted
from locusframe.session import cut

#: Words that a leaked run has at least, and words of a shingle.
RUN = 16
SHINGLE = 5
#: The sieve of evaluation shingles has so many bits a shingle, but never more than 2 ** MOST_BITS in all (4 MB).
BITS_PER_SHINGLE = 64
LEAST_BITS, MOST_BITS = 16, 25
#: Parts that the rows of a hot shingle are cut into.
SALTS = 64
#: Hashes of words that a task keeps.
KNOWN_WORDS = 1 << 18

_COMMAND = re.compile(r"\\[A-Za-z]+")
_WORD = re.compile(r"[^\W_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_HASHES: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits, commands (a backslash and letters) being blanks; none for null."""
    return [] if text is None else _WORD.findall(_COMMAND.sub(" ", text).lower()) if "İ" not in text else [w.lower() for w in _WORD.findall(_COMMAND.sub(" ", text))]


def _word_hashes(ws: list[str]) -> np.ndarray:
    """A 64-bit hash of every word, the same in every process; those of the words met last are kept."""
    if len(_HASHES) > KNOWN_WORDS:
        _HASHES.clear()
    for w in set(ws).difference(_HASHES):
        _HASHES[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))


def _shingle_hashes(ws: list[str]) -> np.ndarray:
    """Hash of every SHINGLE neighbouring words."""
    n = len(ws) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    ids, out = _word_hashes(ws), np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ (out >> np.uint64(31))) * _FACTOR + ids[i : i + n]
    return out ^ (out >> np.uint64(29))


def _sieve_cells(bits: int):
    """A mapInPandas function: word texts -> the 64-bit cells of the sieve that their shingles fall into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(np.concatenate([np.empty(0, np.uint64), *(_shingle_hashes(t.split(" ")) for t in batch["segment"])]) & np.uint64((1 << bits) - 1))
            yield pd.DataFrame({"cell": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    return run


def _sieve(texts: DataFrame) -> np.ndarray:
    """Bits of all shingles of the evaluation texts, by hash: a table of fixed size, whatever the number of texts.

    The more texts, the more chance hits pass it; the joins behind it are exact, so that costs time but no result.
    """
    shingles = texts.agg(F.sum(F.length("segment") - F.length(F.replace("segment", F.lit(" "), F.lit(""))) + 1)).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(shingles * BITS_PER_SHINGLE).bit_length()))
    table = np.zeros(1 << (bits - 6), np.int64)
    cells = texts.mapInPandas(_sieve_cells(bits), "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toPandas()
    table[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64)
    return table.view(np.uint64)


def _segments(sieve: np.ndarray):
    """A mapInPandas function: documents -> maximal word runs all of whose shingles pass the sieve."""
    mask = np.uint64(64 * len(sieve) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ws = words(text)
                bit = _shingle_hashes(ws) & mask
                at = np.flatnonzero((sieve[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                if len(at):
                    breaks = np.flatnonzero(np.diff(at) > 1)
                    for a, b in zip(at[np.concatenate(([0], breaks + 1))], at[np.concatenate((breaks, [len(at) - 1]))], strict=True):
                        out.append((doc, " ".join(ws[a : b + SHINGLE])))
            yield pd.DataFrame(out, columns=["doc_id", "segment"])

    return run


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"item_id": batch["item_id"], "segment": [" ".join(words(t)) for t in batch["item_text"]]})


def _part(parts: str, at: Column, n: int) -> Column:
    """n words of an array from place `at`, from 0, parted by blanks."""
    return F.concat_ws(" ", F.slice(parts, at + 1, n))


def _shingles(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, place, shingle, before, after): every shingle of word texts with the RUN - SHINGLE words on either side.

    A row has a bounded number of words, however long the text is.
    """
    reach = RUN - SHINGLE
    parts = rows.select(*keep, F.split("segment", " ").alias("parts")).where(F.size("parts") >= SHINGLE)
    around = F.transform(F.sequence(F.lit(0), F.size("parts") - SHINGLE), lambda i: F.struct(i.alias("place"), _part("parts", i, SHINGLE).alias("shingle"), F.slice("parts", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))).alias("before"), F.slice("parts", i + SHINGLE + 1, reach).alias("after")))
    return parts.select(*keep, F.explode(around).alias("x")).select(*keep, "x.*")


def _bare_shingles(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, shingle): every shingle of word texts."""
    parts = rows.select(*keep, F.split("segment", " ").alias("parts")).where(F.size("parts") >= SHINGLE)
    return parts.select(*keep, F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - SHINGLE), lambda i: _part("parts", i, SHINGLE))).alias("shingle"))


def leaked_items(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(doc_id, item_id), distinct: the document and the evaluation text share a run of at least RUN consecutive words.

    One pass over the corpus keeps the word runs made of shingles that pass a sieve of the evaluation side, a bit table of
    fixed size, and writes them. Over these the document frequency of every shingle is counted. The necessary prefix of a
    window of RUN words is its rarest shingle: a leaked window has all its shingles in the document, so one is enough, and a
    window with a shingle that no document has is out. Windows and runs meet by an equality join on that shingle, whose
    sides Spark chooses by size; those of hot shingles are salted. Bounds on length and place are applied, then the window is
    compared word for word. Nothing of either side is gathered but the sieve.
    Null ids, null, empty and short texts leak nothing. Repeated rows of one id are one document or one item.
    """
    source = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    wanted = items.select(F.col(f"`{item}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").alias("item_text")).where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull())
    asked = cut(wanted.mapInPandas(_item_words, "item_id bigint, segment string").distinct())
    texts = asked.select("segment").distinct()
    segments = cut(source.mapInPandas(_segments(_sieve(texts)), "doc_id bigint, segment string"))
    rarity = cut(_bare_shingles(segments, "doc_id").distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("n_docs")))

    # Windows of evaluation texts, each once, with their shingles; `offset` is the place of a shingle in its window.
    parts = texts.select(F.split("segment", " ").alias("parts")).where(F.size("parts") >= RUN)
    windows = parts.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - RUN), lambda i: _part("parts", i, RUN))).alias("window")).distinct()
    tokens = windows.select("window", F.split("window", " ").alias("parts")).select("window", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(RUN - SHINGLE)), lambda i: _part("parts", i, SHINGLE))).alias("offset", "shingle"))
    rarest = tokens.join(rarity, "shingle", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "shingle", "offset")).alias("r"))
    prefixes = rarest.where("r.n_docs > 0").select("window", "r.shingle", "r.offset")

    # Length bound: shorter runs hold no window. Positional bound: the window must lie inside the run.
    total = rarity.agg(F.sum("n_docs")).first()[0] or 0
    hot = cut(hot_keys(rarity, ["shingle"], total, "n_docs"))
    long_enough = _shingles(segments.where(F.size(F.split("segment", " ")) >= RUN), "doc_id")
    met = salted(long_enough, hot, ["shingle"], "doc_id", SALTS).join(replicated(prefixes, hot, ["shingle"], SALTS), ["shingle", "salt"])
    met = met.where((F.size("before") >= F.col("offset")) & (F.size("after") >= RUN - SHINGLE - F.col("offset")))
    start = F.slice("before", F.size("before") - F.col("offset") + 1, F.col("offset"))
    verified = met.where(F.concat_ws(" ", start, "shingle", F.slice("after", F.lit(1), RUN - SHINGLE - F.col("offset"))) == F.col("window"))

    # Windows become the items that have them.
    owners = asked.select("item_id", F.split("segment", " ").alias("parts")).where(F.size("parts") >= RUN)
    owners = owners.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - RUN), lambda i: _part("parts", i, RUN))).alias("window")).distinct()
    return verified.select("doc_id", "window").distinct().join(owners, "window").select("doc_id", "item_id").distinct()


def words_column(text: Column) -> Column:
    """The same words as an array column, for small tables."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, r"\\[A-Za-z]+", " ")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
