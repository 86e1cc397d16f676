"""Selection of annotation rows by key, pattern, number, place, size and rank. All keep file order in `rid`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.conditions import condition
from locusframe.model import attr, value, with_attr, with_position
from locusframe.operators.blocks import ranked_places, rank_upto
from locusframe.registry import operator

#: The features that the one-letter shortcuts select.
SHORTCUTS = {"transcripts": "transcript", "genes": "gene", "exons": "exon", "cds": "cds", "start_codon": "start_codon"}
#: Values above this number are matched by a join with a table of them instead of a list in the expression, and places
#: above this number by their ranks.
MOST_LITERALS = 1000
FEW_PLACES = 50


@operator("SEL-01", "SET-02", "SET-03", group="select")
def select_by_key(rows: DataFrame, key: str, values: list[str] | str, invert: bool = False, no_na: bool = True) -> DataFrame:
    """Rows whose key has one of the values (a list or comma-separated text).

    invert: with no_na rows that have the key with another value, without it all rows that don't match.
    `*` is no value. Only the first of repeated keys counts.
    """
    wanted = values.split(",") if isinstance(values, str) else list(values)
    if "*" in wanted:
        raise ValueError("'*' can't be asked for")
    if len(wanted) > MOST_LITERALS:
        listed = rows.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(wanted)], "__v string")
        return select_by_table(rows, key, listed, "__v", invert, no_na)
    v = value(key)
    if not invert:
        return rows.where(v.isin(wanted))
    return rows.where(v.isNotNull() & ~v.isin(wanted)) if no_na else rows.where(v.isNull() | ~v.isin(wanted))


def select_by_table(rows: DataFrame, key: str, values: DataFrame, column: str, invert: bool = False, no_na: bool = True) -> DataFrame:
    """As select_by_key, with the values in a column of a table of any size (semi or anti join)."""
    keyed = rows.withColumn("__k", value(key))
    listed = values.select(F.col(f"`{column}`").cast("string").alias("__k")).where("__k IS NOT NULL").distinct()
    out = keyed.join(listed, "__k", "left_anti" if invert else "left_semi")
    return (out.where("__k IS NOT NULL") if invert and no_na else out).drop("__k")


@operator("SEL-03", group="select")
def selection_log(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row: rows in, rows kept, percentage kept and how many of the values no row has."""
    v = value(key)
    hits = rows.agg(F.count(F.lit(1)).alias("n_in"), F.count(F.when(v.isin(values), 1)).alias("n_kept"), F.count_distinct(F.when(v.isin(values), v)).alias("n_met"))
    share = F.when(F.col("n_in") > 0, 100 * F.col("n_kept") / F.col("n_in"))
    return hits.select("n_in", "n_kept", share.alias("percent"), (F.lit(len(set(values))) - F.col("n_met")).alias("n_missing"))


@operator("SEL-05", "SEL-09", group="select")
def select_where(rows: DataFrame, mask: Column) -> DataFrame:
    """Rows for which the mask holds; null counts as not selected."""
    return rows.where(F.coalesce(mask, F.lit(False)))


def number(key: str) -> Column:
    """The key as a number; null where it is undefined or no number."""
    return value(key).try_cast("double")


def is_defined(key: str) -> Column:
    """The row has the key."""
    return value(key).isNotNull()


def is_set(key: str) -> Column:
    """The row has the key with a value other than '.'."""
    return F.coalesce(value(key) != ".", F.lit(False))


@operator("SEL-06", "ORD-02", group="select")
def select_by_positions(rows: DataFrame, positions: list[int]) -> DataFrame:
    """Rows at 0-based positions in file order; `at` is the place in the request, which may repeat and permute them."""
    wanted = rows.sparkSession.createDataFrame([(p, i) for i, p in enumerate(positions)], "position bigint, at bigint")
    return with_position(rows).join(F.broadcast(wanted) if len(positions) < 100_000 else wanted, "position")


@operator("SEL-07", group="select")
def select_by_regexp(rows: DataFrame, key: str, pattern: str, invert: bool = False) -> DataFrame:
    """Rows whose key holds a match of the pattern anywhere; rows without the key are never kept."""
    v = value(key)
    return rows.where(v.isNotNull() & (~v.rlike(pattern) if invert else v.rlike(pattern)))


@operator("SEL-08", group="select")
def select_by_number(rows: DataFrame, test: str, na_omit: tuple[str, ...] = (".", "?")) -> DataFrame:
    """Rows for which a numeric condition holds. Undefined keys and omitted markers skip the row; other texts are an error."""
    seen: list[str] = []

    def operand(key: str) -> Column:
        seen.append(key)
        v = value(key)
        bad = v.isNotNull() & ~v.isin(*na_omit) & v.try_cast("double").isNull()
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{key} is no number: "), v)).cast("double")).otherwise(v.try_cast("double"))

    test_column, keys = condition(test, operand)
    present = F.lit(True)
    for k in dict.fromkeys(keys):
        present = present & value(k).isNotNull() & ~F.coalesce(value(k), F.lit("")).isin(*na_omit)
    return rows.where(present & test_column)


@operator("SEL-10", group="select")
def select_by_location(rows: DataFrame, places: list[tuple[str, int, int]]) -> DataFrame:
    """Rows that overlap any of the 1-based closed places; each row as often as it is there. Rows without a valid span never do.

    A few places are tested one by one; of more, the first place that ends at or behind a row's start is looked up by rank and has
    to begin before the row's end. The result is the same.
    """
    sound = rows.where(F.col("start") <= F.col("end"))
    places = [(c, s, e) for c, s, e in places if s <= e]
    if len(places) <= FEW_PLACES:
        hit = F.lit(False)
        for chrom, start, end in places:
            hit = hit | ((F.col("seqid") == chrom) & (F.col("start") <= end) & (F.col("end") >= start))
        return sound.where(hit)
    apart: list[list] = []
    for chrom, start, end in sorted(places):
        if apart and apart[-1][0] == chrom and start <= apart[-1][2] + 1:
            apart[-1][2] = max(end, apart[-1][2])
        else:
            apart.append([chrom, start, end])
    spark = rows.sparkSession
    known = ranked_places(spark.createDataFrame(apart, "seqid string, first bigint, place bigint"), ["seqid"])
    passed = rank_upto(sound.select("seqid", (F.col("start") - 1).alias("at")), known, ["seqid"])
    following = passed.withColumn("rank", F.col("upto") + 1).join(known.select("seqid", "rank", "first"), ["seqid", "rank"])
    return sound.join(following.select("seqid", (F.col("at") + 1).alias("start"), "first"), ["seqid", "start"]).where(F.col("first") <= F.col("end")).select(*(f"`{c}`" for c in rows.columns))


@operator("SEL-11", group="select")
def select_members_by_location(rows: DataFrame, places: list[tuple[str, int, int]], feature: str = "transcript", invert: bool = False) -> DataFrame:
    """All rows of the transcripts (or genes) whose own row overlaps a place; or of all others that have the id."""
    key = f"{feature}_id"
    ids = select_by_location(rows.where(F.col("feature") == feature), places).select(attr(key).alias("id")).distinct()
    return select_by_table(rows, key, ids, "id", invert)


def _per_transcript(rows: DataFrame, *measures: Column) -> DataFrame:
    return rows.withColumn("__tx", attr("transcript_id")).where("__tx IS NOT NULL").groupBy("__tx").agg(*measures)


def _members(rows: DataFrame, transcripts: DataFrame) -> DataFrame:
    return rows.withColumn("__tx", attr("transcript_id")).join(transcripts.select("__tx"), "__tx", "left_semi").drop("__tx")



def _exon_size() -> Column:
    return F.coalesce(F.sum(F.when(F.col("feature") == "exon", F.col("end") - F.col("start") + 1)), F.lit(0))


def _exon_count() -> Column:
    return F.count(F.when(F.col("feature") == "exon", 1))


@operator("SEL-12", group="select")
def select_by_transcript_size(rows: DataFrame, least: int = 0, most: int = 1_000_000_000) -> DataFrame:
    """All rows of transcripts whose exons sum up to a length between least and most (closed)."""
    return _members(rows, _per_transcript(rows, _exon_size().alias("n")).where(F.col("n").between(least, most)))


@operator("SEL-13", group="select")
def select_by_exon_count(rows: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """All rows of transcripts with so many exons (closed range); none counts 0."""
    counted = _per_transcript(rows, _exon_count().alias("n")).where(F.col("n") >= least)
    return _members(rows, counted if most is None else counted.where(F.col("n") <= most))


def _best_per_gene(rows: DataFrame, measure: Column, descending: bool) -> DataFrame:
    """Transcripts that are first in their gene by the measure; ties go to the one met first in the file."""
    both = rows.withColumns({"__tx": attr("transcript_id"), "__gene": attr("gene_id")}).where("__tx IS NOT NULL AND __gene IS NOT NULL")
    measured = both.groupBy("__gene", "__tx").agg(measure.alias("m"), F.min("rid").alias("first")).where("m IS NOT NULL")
    order = Window.partitionBy("__gene").orderBy(F.desc("m") if descending else F.asc("m"), "first")
    return measured.withColumn("__n", F.row_number().over(order)).where("__n = 1")


@operator("SEL-14", group="select")
def select_by_max_exon_count(rows: DataFrame) -> DataFrame:
    """All rows of the transcript with most exons of each gene."""
    return _members(rows, _best_per_gene(rows, _exon_count(), True))


@operator("SEL-15", "WIN-03", group="select")
def select_by_length_rank(rows: DataFrame, longest: bool = False, keep_genes: bool = True) -> DataFrame:
    """All rows of the shortest (or longest) transcript of each gene by summed exon length, with the gene rows if wanted."""
    exons = F.sum(F.when(F.col("feature") == "exon", F.col("end") - F.col("start") + 1))
    chosen = _members(rows, _best_per_gene(rows, exons, longest))
    genes = rows.where(F.col("feature") == "gene")
    return chosen.unionByName(genes.where(attr("transcript_id").isNull())) if keep_genes else chosen


@operator("SEL-16", group="select")
def select_most_5p(rows: DataFrame, keep_genes: bool = False) -> DataFrame:
    """All rows of each gene's transcript that begins furthest 5': least exon start on +, greatest exon end on -."""
    place = F.min(F.when(F.col("feature") == "exon", F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))))
    chosen = _members(rows, _best_per_gene(rows, place, False))
    genes = rows.where(F.col("feature") == "gene")
    return chosen.unionByName(genes.where(attr("transcript_id").isNull())) if keep_genes else chosen


@operator("SEL-17", group="select")
def select_by_intron_size(rows: DataFrame, size: int, merged: bool = False, drop_monoexonic: bool = False, invert: bool = False, add_size: bool = False) -> DataFrame:
    """Rows of transcripts without an intron shorter than size (invert: without one of at least size).

    merged compares the summed intron length. Transcripts of one exon stay unless drop_monoexonic. add_size: transcript rows get
    the attribute intron_size, the lengths from left to right (merged: their sum), 0 without introns.
    """
    exons = rows.where(F.col("feature") == "exon").select(attr("transcript_id").alias("__tx"), "start", "end").where("__tx IS NOT NULL").distinct()
    order = Window.partitionBy("__tx").orderBy("start", "end")
    introns = exons.withColumn("gap", F.lead("start").over(order) - F.col("end") - 1).groupBy("__tx").agg(F.min("gap").alias("least"), F.max("gap").alias("most"), F.sum("gap").alias("whole"), F.transform(F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("start", "gap")))), lambda x: x["gap"].cast("string")).alias("sizes"))
    small, large = (F.col("whole") < size, F.col("whole") >= size) if merged else (F.col("least") < size, F.col("most") >= size)
    kept = F.coalesce(~(large if invert else small), F.lit(not drop_monoexonic))
    out = _members(rows, introns.where(kept))
    if not add_size:
        return out
    sizes = F.coalesce(F.col("whole"), F.lit(0)).cast("string") if merged else F.when(F.size("sizes") > 0, F.array_join("sizes", ",")).otherwise(F.lit("0"))
    keyed = out.withColumn("__tx", F.when(F.col("feature") == "transcript", attr("transcript_id")))
    return keyed.join(introns.select("__tx", sizes.alias("__s")), "__tx", "left").withColumn("attrs", with_attr("intron_size", F.col("__s"))).drop("__tx", "__s")


@operator("SEL-18", group="select")
def remove_duplicate_tss(rows: DataFrame) -> DataFrame:
    """Transcripts of a gene that share their start site: the one of least id stays with its rows; gene rows go."""
    tx = rows.where(F.col("feature") == "transcript").select(attr("gene_id").alias("g"), attr("transcript_id").alias("__tx"), F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")).alias("tss"))
    kept = tx.where("__tx IS NOT NULL AND g IS NOT NULL").groupBy("g", "tss").agg(F.min("__tx").alias("__tx"))
    return _members(rows.where(F.col("feature") != "gene"), kept.select("__tx").distinct())


def _drawn(column: str, seed: int) -> Column:
    """Order of a seeded hash, which other engines know as well."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column)))


@operator("SEL-19", group="select")
def random_members(rows: DataFrame, n: int, feature: str = "transcript", seed: int = 1) -> DataFrame:
    """All rows of n distinct transcripts (or genes), drawn by a seeded hash: repeatable on any partitioning."""
    key = f"{feature}_id"
    ids = rows.select(attr(key).alias("id")).where("id IS NOT NULL").distinct().orderBy(_drawn("id", seed), "id").limit(n)
    return select_by_table(rows, key, ids, "id")


@operator("SEL-20", group="select")
def random_transcripts(rows: DataFrame, most: int = 1, seed: int = 1) -> DataFrame:
    """Rows of at most so many transcripts of each gene, drawn by a seeded hash; gene rows go.

    A rank with a bound: each task cuts its share of a gene to `most` transcripts before they meet.
    """
    tx = rows.select(attr("gene_id").alias("g"), attr("transcript_id").alias("__tx")).where("g IS NOT NULL AND __tx IS NOT NULL").distinct()
    order = Window.partitionBy("g").orderBy(_drawn("__tx", seed), "__tx")
    return _members(rows.where(F.col("feature") != "gene"), tx.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most))


@operator("SEL-21", group="select")
def select_by_term(rows: DataFrame, terms: DataFrame, term: str, invert: bool = False) -> DataFrame:
    """Rows of genes that a table (term, gene_id) lists under the term; or of all other genes."""
    return select_by_table(rows, "gene_id", terms.where(F.col("term") == term), "gene_id", invert)


@operator("SEL-22", "ORD-01", group="select")
def head(rows: DataFrame, n: int = 6) -> DataFrame:
    """The first rows in file order."""
    return rows.orderBy("rid").limit(n)


def tail(rows: DataFrame, n: int = 6) -> DataFrame:
    """The last rows in file order."""
    return rows.orderBy(F.desc("rid")).limit(n).orderBy("rid")


@operator("ORD-06", group="order")
def sorted_by(table: DataFrame, by: str, descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """A table in the order of one column, its other columns going along; ties by further columns."""
    return table.orderBy(F.desc(f"`{by}`") if descending else F.asc(f"`{by}`"), *(f"`{t}`" for t in ties))


@operator("SET-04", group="set")
def without_keys(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is not among the keys of another table; rows with a null key stay."""
    return table.join(keys.select(F.col(f"`{column}`")).where(F.col(f"`{column}`").isNotNull()).distinct(), column, "left_anti").select(*(f"`{c}`" for c in table.columns))


@operator("SET-05", group="set")
def concatenated(tables: list[DataFrame]) -> DataFrame:
    """All rows of several tables below each other; columns that a table lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
