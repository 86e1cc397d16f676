"""Sequences of annotation rows from a genome kept in chunks (chrom, chunk, bases)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.model import attr, value
from locusframe.registry import operator

#: Bases per chunk: a chromosome is never one row, and a feature reads the chunks it touches only.
CHUNK = 16_384


def chunked(chromosomes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chrom, sequence) -> (chrom, chunk, bases)."""
    count = F.ceil(F.length("sequence") / chunk).cast("int")
    each = chromosomes.where(F.length("sequence") > 0).select("chrom", "sequence", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    return each.select("chrom", F.col("chunk").cast("bigint").alias("chunk"), F.substring("sequence", F.col("chunk") * chunk + 1, chunk).alias("bases"))


def reverse_complement(bases: Column) -> Column:
    """The opposite strand from its own 5' end; letters other than A, C, G and T stay as they are."""
    return F.translate(F.reverse(bases), "ACGTacgt", "TGCAtgca")


def _parts(intervals: DataFrame, genome: DataFrame, keep: list[str], chunk: int) -> DataFrame:
    """The kept columns of intervals, chunk and `part`, the bases there, for every chunk that an interval touches.

    The join is merged: Spark takes bases for far shorter than they are and would broadcast a genome.
    """
    first, last = F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk)
    asked = intervals.where(F.col("start") < F.col("end")).select(*dict.fromkeys([*keep, "chrom", "start", "end"]), F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("chunk"))
    at = F.greatest(F.col("start") - F.col("chunk") * chunk, F.lit(0))
    upto = F.least(F.col("end") - F.col("chunk") * chunk, F.lit(chunk))
    return asked.join(genome.hint("merge"), ["chrom", "chunk"]).select(*keep, "chunk", F.substring("bases", (at + 1).cast("int"), (upto - at).cast("int")).alias("part"))


def _joined(*order: str) -> Column:
    """The parts of a group in this order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "part"))), lambda x: x["part"]), "")


@operator("IV-08", "SEQ-04", "SRC-09", group="sequences")
def fetch(intervals: DataFrame, genome: DataFrame, stranded: bool = True, chunk: int = CHUNK) -> DataFrame:
    """0-based intervals with a unique rid -> their columns and `bases`; reverse-complemented on - if stranded.

    Intervals are joined to the chunks they touch. Those that reach beyond the genome get what there is of it,
    those on unknown chromosomes drop out. The bases are merged to their intervals, not broadcast.
    """
    whole = _parts(intervals, genome, ["rid"], chunk).groupBy("rid").agg(_joined("chunk").alias("bases"))
    out = intervals.join(whole.hint("merge"), "rid")
    return out.withColumn("bases", F.when(F.lit(stranded) & (F.col("strand") == "-"), reverse_complement(F.col("bases"))).otherwise(F.col("bases")))


@operator("SEQ-01", group="sequences")
def transcript_sequences(rows: DataFrame, genome: DataFrame, with_introns: bool = False, rev_comp: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(transcript_id, gene_id, chrom, strand, sequence): spliced exons (or the whole span) of every transcript, 5' to 3'.

    The parts of all exons of a transcript are put together at once, so bases are shuffled once.
    """
    exons = rows.where(F.col("feature") == "exon").select("rid", F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("start"), "end", "strand", attr("transcript_id").alias("transcript_id"), attr("gene_id").alias("gene_id")).where("transcript_id IS NOT NULL")
    keys = ["transcript_id", "gene_id", "chrom", "strand"]
    if with_introns:
        exons = exons.groupBy(*keys).agg(F.min("rid").alias("rid"), F.min("start").alias("start"), F.max("end").alias("end"))
    spliced = _parts(exons, genome, [*keys, "start", "end", "rid"], chunk).groupBy(*keys).agg(_joined("start", "end", "rid", "chunk").alias("s"))
    return spliced.select(*keys, F.when(F.lit(rev_comp) & (F.col("strand") == "-"), reverse_complement(F.col("s"))).otherwise(F.col("s")).alias("sequence"))


@operator("SEQ-02", group="sequences")
def exon_offsets(rows: DataFrame) -> DataFrame:
    """(transcript_id, rid, first, last): 1-based place of every exon in its spliced transcript, 5' to 3'."""
    exons = rows.where(F.col("feature") == "exon").withColumn("transcript_id", attr("transcript_id")).where("transcript_id IS NOT NULL")
    order = Window.partitionBy("transcript_id").orderBy(F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start")), "rid")
    last = F.sum(F.col("end") - F.col("start") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return exons.select("transcript_id", "rid", (last - (F.col("end") - F.col("start"))).alias("first"), last.alias("last"))


def fasta_lines(sequences: DataFrame, header: list[str], sequence: str = "sequence", sep: str = "|", width: int = 60) -> DataFrame:
    """One text column per record: a header of the given columns and the sequence in lines of `width`."""
    body = F.regexp_replace(F.col(sequence), f"(.{{{width}}})(?=.)", "$1\n")
    return sequences.select(F.concat(F.lit(">"), F.concat_ws(sep, *header), F.lit("\n"), body).alias("value"))


@operator("SEQ-03", group="sequences")
def sequence_headers(sequences: DataFrame, rows: DataFrame, labels: list[str], sep: str = "|", explicit: bool = False, no_version: bool = False, no_chr: bool = False, sleuth: bool = False) -> DataFrame:
    """Transcript sequences with their FASTA `header`: the labels of the transcript's row, '?' where it lacks one.

    explicit writes `label=value`; no_version cuts a final dot and digits off ids; no_chr cuts `chr` off sequence names;
    sleuth gives the header `transcript gene:gene_id` of that tool instead. Of several rows of a transcript the first counts.
    """
    def shown(name: str) -> Column:
        text = F.coalesce(value(name), F.lit("?"))
        text = F.regexp_replace(text, r"\.[0-9]+\z", "") if no_version and name in ("gene_id", "transcript_id") else text
        return F.regexp_replace(text, r"\Achr", "") if no_chr and name in ("chrom", "seqid") else text

    if sleuth:
        header = F.concat(shown("transcript_id"), F.lit(" gene:"), shown("gene_id"))
    else:
        header = F.concat_ws(sep, *(F.concat(F.lit(f"{n}=" if explicit else ""), shown(n)) for n in labels))
    own = rows.where(F.col("feature") == "transcript").select("rid", attr("transcript_id").alias("transcript_id"), header.alias("header")).where("transcript_id IS NOT NULL")
    first = own.groupBy("transcript_id").agg(F.min_by("header", "rid").alias("header"))
    return sequences.join(first, "transcript_id", "left").withColumn("header", F.coalesce("header", "transcript_id"))
