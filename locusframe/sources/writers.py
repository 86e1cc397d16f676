"""Writers of annotation, interval, table and sequence text. Files come out in parts unless one is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.model import FIXED, bed
from locusframe.operators.enrichment import statistics_columns
from locusframe.operators.intervals import ends
from locusframe.registry import operator


def annotation_line(add_chr: bool = False) -> Column:
    """An annotation row as its nine-column line; null fields are written as '.'."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in FIXED]
    text[0] = F.concat(F.lit("chr"), text[0]) if add_chr else text[0]
    attributes = F.array_join(F.transform("attrs", lambda a: F.concat(a["key"], F.lit(' "'), F.coalesce(a["value"], F.lit("")), F.lit('";'))), " ")
    return F.concat_ws("\t", *text, attributes)


def _written(lines: DataFrame, path: str, one_file: bool) -> None:
    """Lines are range-sorted by rid, so part files follow each other in file order."""
    ordered = lines.coalesce(1).sortWithinPartitions("rid") if one_file else lines.orderBy("rid")
    ordered.select("value").write.text(path)


@operator("SNK-01", "SNK-10", group="sinks")
def write_annotation(rows: DataFrame, path: str, add_chr: bool = False, one_file: bool = False) -> None:
    """Annotation text in file order."""
    _written(rows.select("rid", annotation_line(add_chr).alias("value")), path, one_file)


@operator("SNK-02", "SNK-03", "SNK-05", group="sinks")
def write_bed(rows: DataFrame, path: str, name: list[str] = ("gene_id",), sep: str = "|", more: list[str] = (), columns: int = 6, missing: str = "?", one_file: bool = False) -> None:
    """Annotation rows as interval text of 3 or 6 columns; missing attributes in names are '?' (or '.')."""
    shown = bed(rows, name, sep, more, missing)
    fields = ["chrom", "start", "end", "name", "score", "strand"][:columns]
    _written(shown.select("rid", F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in fields)).alias("value")), path, one_file)


@operator("SNK-04", group="sinks")
def write_ends(rows: DataFrame, path: str, feature: str = "transcript", three_prime: bool = False, name: tuple[str, ...] = ("transcript_id",), sep: str = "|", one_file: bool = False) -> None:
    """One-base intervals at the 5' (or 3') ends of a feature's rows as text of 6 columns; missing attributes are '.'."""
    shown = ends(rows, feature, three_prime, name, sep, missing=".")
    _written(shown.select("rid", F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("chrom", "start", "end", "name", "score", "strand"))).alias("value")), path, one_file)


@operator("SNK-08", group="sinks")
def write_statistics(stats: DataFrame, path: str, label: str = "feature_type") -> None:
    """Enrichment statistics as delimited text: the label, then both measures; further columns are left out. One small row per set."""
    stats.select(label, *(c for c in statistics_columns() if c in stats.columns)).coalesce(1).write.option("sep", "\t").option("header", True).csv(path)


@operator("SNK-06", group="sinks")
def write_table(table: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    """Any table of plain columns as delimited text."""
    table.write.option("sep", sep).option("header", header).option("quote", "").csv(path)


@operator("SNK-07", group="sinks")
def write_fasta(sequences: DataFrame, path: str, header: list[str], sep: str = "|", compression: str = "none") -> None:
    """Sequences in lines of 60 under a header of the given columns; compression: gzip writes .gz files, which are read back as they are."""
    from locusframe.operators.sequences import fasta_lines

    fasta_lines(sequences, header, sep=sep).write.option("compression", compression).text(path)


@operator("SNK-09", group="sinks")
def plot_table(stats: DataFrame, label: str = "feature_type") -> DataFrame:
    """Long form of enrichment statistics for plotting: (label, measure, true, expected, deviation)."""
    parts = []
    for m in ("nb_intersections", "summed_bp_overlaps"):
        parts.append(F.struct(F.lit(m).alias("measure"), F.col(f"{m}_true").cast("double").alias("true"), F.col(f"{m}_expectation_shuffled").cast("double").alias("expected"), F.sqrt(F.col(f"{m}_variance_shuffled").cast("double")).alias("deviation")))
    return stats.select(label, F.explode(F.array(*parts)).alias("x")).select(label, "x.*")
