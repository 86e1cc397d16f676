"""Queries of the interval algebra over the annotation table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.labels import label
from locusframe.model import annotation, attr, bed
from locusframe.operators import intervals as I
from locusframe.operators.aggregate import add_exon_number
from locusframe.operators.project import columns_of
from locusframe.plans.annotation import BASE
from locusframe.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SIZES = "z AS (SELECT lower(trim(chrom)) AS chrom, chrom_size AS size FROM seq_size)"
#: Transcripts, exons and genes as intervals.
SETS = """t AS (SELECT rid, seqid AS chrom, s - 1 AS b, e, coalesce(tx, '?') AS name, gene, strand FROM f WHERE feature = 'transcript'),
x AS (SELECT rid, seqid AS chrom, s - 1 AS b, e, coalesce(tx, '?') AS name, gene, strand FROM f WHERE feature = 'exon'),
g AS (SELECT rid, seqid AS chrom, s - 1 AS b, e, gene AS name, strand FROM f WHERE feature = 'gene' AND gene IS NOT NULL)"""


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(chrom, size) of the sequences."""
    return table(spark, folder, "seq_size").select(label(F.col("chrom")).alias("chrom"), F.col("chrom_size").alias("size"))


def query(name: str, sql: str | None) -> Callable:
    """Register a function (annotation table, sizes) under a name, with SQL that follows the definitions above."""

    def register(function: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: function(annotation(spark, folder), sizes(spark, folder))
        if sql is not None:
            ORACLE[name] = f"WITH {BASE}, {SIZES}, {SETS}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return function

    return register


def _tx(r: DataFrame) -> DataFrame:
    return bed(r.where("feature = 'transcript'"), ["transcript_id"])


def _exons(r: DataFrame) -> DataFrame:
    return bed(r.where("feature = 'exon'"), ["transcript_id"])


def _stranded(r: DataFrame) -> DataFrame:
    """Rows that have a strand, for operators to which a row without one is an error."""
    return r.where(F.col("strand").isin("+", "-"))


def _merged_sql(source: str, name: str, keys: str = "chrom") -> str:
    return f"""{name}_o AS (SELECT {keys}, b, e, max(e) OVER (PARTITION BY {keys} ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM (SELECT DISTINCT {keys}, b, e FROM {source} WHERE b < e)),
{name}_i AS (SELECT *, sum(CASE WHEN far IS NULL OR b > far THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS n FROM {name}_o),
{name} AS (SELECT {keys}, min(b) AS b, max(e) AS e FROM {name}_i GROUP BY {keys}, n)"""


_SLOP = "SELECT rid, chrom, greatest(b - CASE WHEN strand = '-' THEN {r} ELSE {l} END, 0) AS b, least(e + CASE WHEN strand = '-' THEN {l} ELSE {r} END, size) AS e, name, strand{more} FROM {of} JOIN z USING (chrom)"

query("iv_01_slop", "SELECT rid, b AS start, e AS end FROM (" + _SLOP.format(l=300, r=50, of="t", more="") + ") WHERE b < e")(lambda r, z: I.slop(_tx(r), z, 300, 50).select("rid", "start", "end"))
query("iv_02_flank", "SELECT rid, CASE WHEN strand = '-' THEN 'down' ELSE 'up' END AS side, greatest(b - CASE WHEN strand = '-' THEN 50 ELSE 300 END, 0) AS start, b AS end FROM t JOIN z USING (chrom) WHERE b > 0 UNION ALL SELECT rid, CASE WHEN strand = '-' THEN 'up' ELSE 'down' END, e, least(e + CASE WHEN strand = '-' THEN 300 ELSE 50 END, size) FROM t JOIN z USING (chrom) WHERE e < size")(
    lambda r, z: I.flank(_tx(r), z, 300, 50).select("rid", "side", "start", "end")
)
query("iv_03_overlap", "SELECT t.rid, x.rid AS rid_b, greatest(t.b, x.b) AS ov_start, least(t.e, x.e) AS ov_end FROM t JOIN x ON t.chrom = x.chrom AND t.b < x.e AND x.b < t.e")(
    lambda r, z: I.overlap_join(_tx(r), _exons(r)).select("rid", "rid_b", "ov_start", "ov_end")
)
query("iv_03_opposite", "SELECT t.rid, x.rid AS rid_b FROM t JOIN x ON t.chrom = x.chrom AND t.b < x.e AND x.b < t.e AND t.strand <> x.strand AND t.strand IN ('+', '-') AND x.strand IN ('+', '-')")(
    lambda r, z: I.overlap_join(_tx(r), _exons(r), strand="opposite").select("rid", "rid_b")
)
query("iv_04_subtract", ", " + _merged_sql("x", "m") + ", h AS (SELECT t.rid, greatest(t.b, m.b) AS b, least(t.e, m.e) AS e, t.b AS tb, t.e AS te FROM t JOIN m ON t.chrom = m.chrom AND t.b < m.e AND m.b < t.e), p AS (SELECT rid, coalesce(lag(e) OVER w, tb) AS b, b AS e FROM h WINDOW w AS (PARTITION BY rid ORDER BY b) UNION ALL SELECT rid, max(e), max(te) FROM h GROUP BY rid UNION ALL SELECT rid, b, e FROM t WHERE rid NOT IN (SELECT rid FROM h)) SELECT rid, b AS start, e AS end FROM p WHERE b < e")(
    lambda r, z: I.subtract(_tx(r), _exons(r)).select("rid", "start", "end")
)
query("iv_05_merge", ", " + _merged_sql("t", "m") + " SELECT chrom, b AS start, e AS end FROM m")(lambda r, z: I.merge(_tx(r)))
_DIST = "CASE WHEN a.b < c.e AND c.b < a.e THEN 0 WHEN c.e <= a.b THEN a.b - c.e + 1 ELSE c.b - a.e + 1 END"
query("iv_06_closest", f", p AS (SELECT a.rid, c.rid AS rid_b, {_DIST} AS distance FROM g a JOIN g c ON a.chrom = c.chrom AND a.name <> c.name), q AS (SELECT *, rank() OVER (PARTITION BY rid ORDER BY distance) AS r FROM p) SELECT rid, rid_b, distance FROM q WHERE r <= 3")(
    lambda r, z: I.closest(bed(r.where("feature = 'gene'")).where("name <> '?'"), bed(r.where("feature = 'gene'")).where("name <> '?'"), 3).select("rid", "rid_b", "distance")
)
_SITE = "(SELECT rid, chrom, CASE WHEN strand = '-' THEN e - 1 ELSE b END AS b, CASE WHEN strand = '-' THEN e ELSE b + 1 END AS e, name, strand FROM g)"
query("iv_20_closest_genes", f", c AS {_SITE}, p AS (SELECT a.rid, a.name AS gene, c.name AS neighbour, {_DIST} AS distance FROM c a JOIN c ON a.chrom = c.chrom AND a.name <> c.name AND a.strand = c.strand AND a.strand IN ('+', '-')), q AS (SELECT *, rank() OVER (PARTITION BY rid ORDER BY distance) AS r FROM p) SELECT gene, neighbour, distance FROM q WHERE r <= 2")(
    lambda r, z: I.closest_genes(r, 2, strand="same")
)


def _events_sql(parts: list[tuple[str, int]]) -> str:
    rows = " UNION ALL ".join(f"SELECT chrom, b AS p, {i} AS k, 1 AS d FROM {s} WHERE b < e UNION ALL SELECT chrom, e, {i}, -1 FROM {s} WHERE b < e" for s, i in parts)
    sums = ", ".join(f"sum(CASE WHEN k = {i} THEN d ELSE 0 END) AS d{i}" for _, i in parts)
    runs = ", ".join(f"sum(d{i}) OVER (PARTITION BY chrom ORDER BY p ROWS UNBOUNDED PRECEDING) AS n{i}" for _, i in parts)
    return f"ev AS ({rows}), ps AS (SELECT chrom, p, {sums} FROM ev GROUP BY ALL), sg AS (SELECT chrom, p AS start, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS end, {runs} FROM ps)"


query("iv_10_sweep", ", " + _events_sql([("t", 0), ("x", 1), ("g", 2)]) + " SELECT chrom, start, \"end\", CAST(n0 AS INT) AS n0, CAST(n1 AS INT) AS n1, CAST(n2 AS INT) AS n2 FROM sg WHERE \"end\" IS NOT NULL AND n0 + n1 + n2 >= 2")(
    lambda r, z: I.sweep([_tx(r), _exons(r), bed(r.where("feature = 'gene'")).where("name <> '?'")]).select("chrom", "start", "end", *(F.col("flags")[i].alias(f"n{i}") for i in range(3)))
)
query("iv_11_introns_merged", ", " + _merged_sql("x", "m") + ", h AS (SELECT t.rid, t.chrom, greatest(t.b, m.b) AS b, least(t.e, m.e) AS e, t.b AS tb, t.e AS te FROM t JOIN m ON t.chrom = m.chrom AND t.b < m.e AND m.b < t.e), p AS (SELECT chrom, coalesce(lag(e) OVER w, tb) AS b, b AS e FROM h WINDOW w AS (PARTITION BY rid ORDER BY b) UNION ALL SELECT chrom, max(e), max(te) FROM h GROUP BY rid, chrom UNION ALL SELECT chrom, b, e FROM t WHERE rid NOT IN (SELECT rid FROM h)), " + _merged_sql("p", "r") + " SELECT chrom, b AS start, e AS end FROM r")(
    lambda r, z: I.introns(r, by_transcript=False)
)
query("iv_11_introns", ", l AS (SELECT seqid AS chrom, strand, gene AS gene_id, tx AS transcript_id, list_sort(list(s)) AS ss, list_sort(list(e)) AS es, count(*) AS n FROM f WHERE feature = 'exon' AND tx IS NOT NULL AND strand IN ('+', '-') GROUP BY ALL HAVING count(*) > 1), i AS (SELECT *, unnest(range(1, n)) AS k FROM l) SELECT chrom, strand, gene_id, transcript_id, es[k] AS start, ss[k + 1] - 1 AS end, CAST(CASE WHEN strand = '+' THEN k ELSE n - k END AS INT) AS number FROM i")(
    lambda r, z: I.introns(r)
)
query("iv_12_intergenic", ", o AS (" + _SLOP.format(l=100, r=40, of="t", more="") + "), " + _merged_sql("o", "m") + ", q AS (SELECT chrom, b, e FROM m UNION ALL SELECT chrom, size, size FROM z UNION ALL SELECT chrom, 0, 0 FROM z), w AS (SELECT chrom, b, max(e) OVER (PARTITION BY chrom ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM q) SELECT chrom, a AS start, b AS end FROM w WHERE a < b")(
    lambda r, z: I.intergenic(r, z, 100, 40)
)
query("iv_13_tss", "SELECT rid, CASE WHEN strand = '+' THEN b + 10 ELSE e - 1 - 10 END AS start, CASE WHEN strand = '+' THEN b + 11 ELSE e - 10 END AS end, 'transcript_id=' || name AS name FROM t WHERE strand IN ('+', '-')")(
    lambda r, z: I.ends(_stranded(r), transpose=10, explicit=True).select("rid", "start", "end", "name")
)
query("iv_13_tts", "SELECT rid, CASE WHEN strand = '+' THEN e - 1 ELSE b END AS start, name FROM t WHERE strand IN ('+', '-')")(lambda r, z: I.ends(_stranded(r), three_prime=True).select("rid", "start", "name"))
query("iv_14_midpoints", "SELECT rid, b + (e - b) // 2 - CASE WHEN (e - b) % 2 = 1 THEN 0 ELSE 1 END AS start, b + (e - b) // 2 + 1 AS end FROM x")(lambda r, z: I.midpoints(_exons(r)).select("rid", "start", "end"))
query("iv_15_shift", ", y AS (SELECT rid, s + CASE WHEN strand = '-' THEN -900 ELSE 900 END AS a, e + CASE WHEN strand = '-' THEN -900 ELSE 900 END AS c, size FROM f JOIN z ON chrom = seqid) SELECT rid, greatest(least(a, size - (c - a)), 1) AS start, greatest(least(a, size - (c - a)), 1) + c - a AS end FROM y")(
    lambda r, z: I.shift(r, z, 900, stranded=True).select("rid", "start", "end")
)
query("iv_15_shift_outside", "SELECT rid, greatest(s - 60000, 1) AS start, least(e - 60000, size) AS end FROM f JOIN z ON chrom = seqid WHERE greatest(s - 60000, 1) <= least(e - 60000, size)")(
    lambda r, z: I.shift(r, z, -60_000, allow_outside=True).select("rid", "start", "end")
)
query("iv_16_splicing", ", n AS (SELECT rid, seqid AS chrom, tx, s, e, strand, row_number() OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '+' THEN s ELSE -e END, rid) AS k, count(*) OVER (PARTITION BY tx) AS l FROM f WHERE feature = 'exon' AND tx IS NOT NULL) SELECT rid, 'acceptor' AS site, CASE WHEN strand = '+' THEN s - 3 ELSE e END AS start, CASE WHEN strand = '+' THEN s - 1 ELSE e + 2 END AS end FROM n WHERE k > 1 AND strand IN ('+', '-') UNION ALL SELECT rid, 'donor', CASE WHEN strand = '+' THEN e ELSE s - 3 END, CASE WHEN strand = '+' THEN e + 2 ELSE s - 1 END FROM n WHERE k < l AND strand IN ('+', '-')")(
    lambda r, z: I.splicing_sites(add_exon_number(r)).select("rid", "site", "start", "end")
)


def _ends_sql(three_prime: bool) -> str:
    sign = "<>" if three_prime else "="
    return f"SELECT rid, chrom, CASE WHEN strand {sign} '-' THEN e - 1 ELSE b END AS b, CASE WHEN strand {sign} '-' THEN e ELSE b + 1 END AS e, name, gene, strand FROM t WHERE gene IS NOT NULL AND name <> '?'"


def _paired_sql(three_prime: bool) -> str:
    around = _SLOP.format(l=1500, r=1500, of="n", more=", gene, n.b AS site")
    return f", n AS ({_ends_sql(three_prime)}), o AS ({around}), p AS (SELECT o.name, n.name AS other, abs(o.site - n.b) AS dist FROM o JOIN n ON o.chrom = n.chrom AND o.b < n.e AND n.b < o.e AND o.strand <> n.strand AND o.strand IN ('+', '-') AND n.strand IN ('+', '-') AND o.gene <> n.gene), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dist, other) AS r FROM p) SELECT name, other, dist FROM k WHERE r = 1"


query("iv_17_divergent", _paired_sql(False))(lambda r, z: I.paired_ends(r, z))
query("iv_18_convergent", _paired_sql(True))(lambda r, z: I.paired_ends(r, z, convergent=True))
query("iv_19_overlapping", f", n AS ({_ends_sql(False)}), o AS ({_SLOP.format(l=1000, r=200, of='n', more=', gene')}), p AS (SELECT DISTINCT o.name, t.name AS other FROM o JOIN t ON o.chrom = t.chrom AND o.b < t.e AND t.b < o.e AND o.gene <> t.gene AND t.name <> '?') SELECT name AS transcript_id, string_agg(other, ',' ORDER BY other) AS others FROM p GROUP BY name")(
    lambda r, z: I.overlapping_transcripts(r, z, "promoter", 1000, 200).withColumn("others", F.array_join("others", ","))
)
query("iv_07_upstream", "SELECT a.rid, coalesce(a.b + 1 - max(c.e) FILTER (WHERE a.strand <> '-'), min(c.b) FILTER (WHERE a.strand = '-') - a.e + 1, -1) AS distance FROM g a LEFT JOIN g c ON a.chrom = c.chrom AND CASE WHEN a.strand = '-' THEN c.b >= a.e ELSE c.e <= a.b END GROUP BY a.rid, a.b, a.e, a.strand")(
    lambda r, z: I.next_beside(bed(r.where("feature = 'gene'")).where("name <> '?'"), bed(r.where("feature = 'gene'")).where("name <> '?'")).select("rid", "distance")
)
query("iv_19_annotated", f", n AS ({_ends_sql(True)}), o AS ({_SLOP.format(l=500, r=500, of='n', more=', gene')}), p AS (SELECT DISTINCT o.name FROM o JOIN t ON o.chrom = t.chrom AND o.b < t.e AND t.b < o.e AND o.gene <> t.gene AND t.name <> '?') SELECT rid, CASE WHEN feature = 'transcript' AND tx IS NOT NULL THEN CASE WHEN tx IN (SELECT name FROM p) THEN '1' ELSE '0' END END AS mark FROM f")(
    lambda r, z: I.annotate_overlapping(r, I.overlapping_transcripts(r, z, "tts", 500, 500), "mark", as_flag=True).select("rid", attr("mark").alias("mark"))
)
query("iv_20_collapsed", f", c AS {_SITE}, p AS (SELECT a.rid, a.name AS gene, c.name AS neighbour, {_DIST} AS distance FROM c a JOIN c ON a.chrom = c.chrom AND a.name <> c.name), q AS (SELECT *, rank() OVER (PARTITION BY rid ORDER BY distance) AS r FROM p), d AS (SELECT DISTINCT gene, neighbour, distance FROM q WHERE r <= 2) SELECT gene, string_agg(neighbour, ',' ORDER BY distance, neighbour) AS neighbours, string_agg(CAST(distance AS VARCHAR), ',' ORDER BY distance, neighbour) AS distances FROM d GROUP BY gene")(
    lambda r, z: I.collapsed_neighbours(I.closest_genes(r, 2))
)
query("iv_21_regulatory", f", c AS {_SITE}, d AS ({_SLOP.format(l=5000, r=1000, of='c', more=', size')}), m AS (SELECT d.*, (SELECT max(e) FROM d l WHERE l.chrom = d.chrom AND l.e <= d.b) AS le, (SELECT min(b) FROM d l WHERE l.chrom = d.chrom AND l.b >= d.e) AS rs FROM d WHERE b < e) SELECT DISTINCT chrom, greatest(coalesce(le, 0), b - 100000, 0) AS start, least(coalesce(rs, size), e + 100000, size) AS end, name, strand FROM m")(
    lambda r, z: I.regulatory_domains(r, z, distal=100_000)
)
query("iv_22_exclude", ", " + _merged_sql("g", "m") + ", k AS (SELECT x.rid, x.b - coalesce(sum(least(m.e, x.b) - m.b) FILTER (WHERE m.b <= x.b), 0) AS b, x.e - coalesce(sum(least(m.e, x.e) - m.b) FILTER (WHERE m.b <= x.e), 0) AS e FROM x LEFT JOIN m ON m.chrom = x.chrom AND m.b <= x.e GROUP BY x.rid, x.b, x.e) SELECT rid, CAST(b AS BIGINT) AS start, CAST(e AS BIGINT) AS end FROM k WHERE b < e")(
    lambda r, z: I.exclude_concatenate(_exons(r), bed(r.where("feature = 'gene'")).where("name <> '?'")).select("rid", "start", "end")
)
query("iv_23_exclude_sizes", ", " + _merged_sql("g", "m") + " SELECT chrom, CAST(size - coalesce((SELECT sum(e - b) FROM m WHERE m.chrom = z.chrom), 0) AS BIGINT) AS size FROM z")(lambda r, z: I.exclude_sizes(z, bed(r.where("feature = 'gene'")).where("name <> '?'")))
query("iv_24_gaps", ", " + _merged_sql("x", "m") + ", y AS (SELECT chrom, b, e FROM m UNION ALL SELECT chrom, size, NULL FROM z WHERE chrom IN (SELECT chrom FROM m)) SELECT chrom, row_number() OVER w AS number, e - b AS length, greatest(b - coalesce(lag(e) OVER w, 0), 0) AS gap FROM y WINDOW w AS (PARTITION BY chrom ORDER BY e IS NULL, b, e)")(
    lambda r, z: I.lengths_and_gaps(I.merge(_exons(r)), z)
)
query("src_07_chromosomes", "SELECT chrom, 0 AS start, size AS end, chrom AS name, '0' AS score, '.' AS strand FROM z")(lambda r, z: I.chromosomes(z))
query("snk_05_bed3", "SELECT seqid AS chrom, s - 1 AS start, e AS end FROM f")(lambda r, z: bed(r).select("chrom", "start", "end"))
query("iv_09_cut", "SELECT seqid AS chrom, coalesce(gene, '?') AS gene_id FROM f")(lambda r, z: columns_of(bed(r).withColumnRenamed("name", "gene_id"), ["chrom", "gene_id"]))
