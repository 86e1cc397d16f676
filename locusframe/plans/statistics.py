"""Queries of signal, sequences, enrichment and mining, and the SQL of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.labels import label
from locusframe.model import annotation, attr, bed
from locusframe.operators import enrichment as O
from locusframe.operators import mining as M
from locusframe.operators import sequences as Q
from locusframe.operators import signal as G
from locusframe.operators.intervals import merge, sweep
from locusframe.plans.annotation import BASE
from locusframe.plans.intervals import SETS, SIZES, _events_sql, _merged_sql, sizes
from locusframe.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Scores of exon rows as a track per strand.
SIGNAL = "v AS (SELECT CASE WHEN strand = '-' THEN 'minus' ELSE 'plus' END AS track, seqid AS chrom, s - 1 AS b, e, CAST(score AS DOUBLE) AS val FROM f WHERE feature = 'exon' AND score NOT IN ('.', '?'))"
TRACKS = ["minus", "plus"]
#: The made-up genome's letters: base at position p, from 1, is letter (7 p + p // 3) % 8, the same again PERIOD further on.
LETTERS, PERIOD = "acgtacca", 24


def query(name: str, sql: str | None) -> Callable:
    """Register a function (annotation table, sizes) under a name, with SQL that follows the definitions."""

    def register(function: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: function(annotation(spark, folder), sizes(spark, folder))
        if sql is not None:
            ORACLE[name] = f"WITH {BASE}, {SIZES}, {SETS}, {SIGNAL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return function

    return register


def signal(rows: DataFrame) -> DataFrame:
    """Scores of exons as a track per strand."""
    exons = rows.where((F.col("feature") == "exon") & ~F.col("score").isin(".", "?"))
    return exons.select(F.when(F.col("strand") == "-", "minus").otherwise("plus").alias("track"), F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("start"), "end", F.col("score").try_cast("double").alias("value"))


def genome(intervals: DataFrame) -> DataFrame:
    """A made-up genome in the chunks that intervals touch: every letter follows from its position, so no file is needed."""
    first, last = F.floor(F.col("start") / Q.CHUNK), F.floor((F.col("end") - 1) / Q.CHUNK)
    touched = intervals.select("chrom", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("chunk")).distinct()
    unit = "".join(LETTERS[(p * 7 + p // 3) % 8] for p in range(PERIOD))
    at = (F.col("chunk") * Q.CHUNK + 1) % PERIOD
    return touched.withColumn("bases", F.substring(F.lit(unit * (Q.CHUNK // PERIOD + 2)), (at + 1).cast("int"), F.lit(Q.CHUNK)))


def _genes(r: DataFrame) -> DataFrame:
    return bed(r.where("feature = 'gene'")).where("name <> '?'")


def _tx(r: DataFrame) -> DataFrame:
    return bed(r.where("feature = 'transcript'"), ["transcript_id"])


def _exons(r: DataFrame) -> DataFrame:
    return bed(r.where("feature = 'exon'"), ["transcript_id"])


def _cds(r: DataFrame) -> DataFrame:
    return bed(r.where("feature = 'cds'"))


# --- Signal ----------------------------------------------------------------------------------------------------------

_BINS = "w AS (SELECT rid, chrom, strand, b, e, (e - b) // {n} AS w FROM g WHERE (e - b) // {n} > 0), c AS (SELECT rid, chrom, strand, k, b + k * w AS b, CASE WHEN k = {n} - 1 THEN e ELSE b + (k + 1) * w END AS e FROM (SELECT *, unnest(range({n})) AS k FROM w)), y AS (SELECT c.rid, c.k, v.track, sum(v.val * (least(v.e, c.e) - greatest(v.b, c.b))) AS t FROM c JOIN v ON v.chrom = c.chrom AND v.b < c.e AND c.b < v.e GROUP BY ALL), o AS (SELECT c.*, x.track, round(coalesce(t, 0) / (e - b), 6) AS val FROM c CROSS JOIN (VALUES ('minus'), ('plus')) AS x(track) LEFT JOIN y USING (rid, k, track))"
query("sig_01_coverage", ", " + _BINS.format(n=5) + ", n AS (SELECT *, row_number() OVER (PARTITION BY rid, track ORDER BY val DESC) AS r FROM o) SELECT g.rid, x.track, round(coalesce(avg(val) FILTER (WHERE r <= 2), 0) + 1, 2) AS cov FROM g CROSS JOIN (VALUES ('minus'), ('plus')) AS x(track) LEFT JOIN n USING (rid, track) GROUP BY g.rid, x.track")(
    lambda r, z: G.coverage(_genes(r), signal(r), TRACKS, 5, n_highest=2).select("rid", "track", F.round("cov", 2).alias("cov"))
)
query("sig_02_matrix", ", " + _BINS.format(n=1) + " SELECT rid, round(max(val) FILTER (WHERE track = 'minus') + 1, 4) AS minus, round(max(val) FILTER (WHERE track = 'plus') + 1, 4) AS plus FROM o GROUP BY rid")(
    lambda r, z: G.coverage_matrix(G.coverage(_genes(r), signal(r), TRACKS), TRACKS).select("rid", *(F.round(t, 4).alias(t) for t in TRACKS))
)
query("sig_03_profile", ", " + _BINS.format(n=8) + " SELECT rid, track, CAST(CASE WHEN strand = '-' THEN 7 - k ELSE k END AS INT) AS bin, val AS value FROM o")(lambda r, z: G.binned_signal(_genes(r), signal(r), TRACKS, 8, stranded=True))
_SIDES = "s AS (SELECT rid, chrom, strand, 'up' AS side, CASE WHEN strand = '-' THEN e ELSE greatest(b - 1000, 0) END AS b, CASE WHEN strand = '-' THEN least(e + 1000, size) ELSE b END AS e FROM g JOIN z USING (chrom) UNION ALL SELECT rid, chrom, strand, 'down', CASE WHEN strand = '-' THEN greatest(b - 1000, 0) ELSE e END, CASE WHEN strand = '-' THEN b ELSE least(e + 1000, size) END FROM g JOIN z USING (chrom))"


def _parts_sql() -> str:
    """Bins of regions and of both flanks, each from _BINS with names of its own."""
    parts, shown = [f", {_SIDES}"], []
    for part, n in (("main", 10), ("up", 2), ("down", 2)):
        own = f", h{part} AS ({'SELECT * FROM g' if part == 'main' else f"SELECT rid, chrom, strand, b, e FROM s WHERE side = '{part}'"}), " + _BINS.format(n=n)
        for x in ("w", "c", "y", "o"):
            own = re.sub(rf"(?<![.\w]){x}(?= AS \(| JOIN|\.)|(?<=FROM ){x}(?=\W)", f"{x}{part}", own)
        parts.append(re.sub(r"(?<=FROM )g(?= WHERE)", f"h{part}", own).replace(f"FROM y{part} USING", "USING").replace("LEFT JOIN y USING", f"LEFT JOIN y{part} USING").replace("JOIN y ", f"JOIN y{part} "))
        shown.append(f"SELECT '{part}' AS part, rid, track, CAST(CASE WHEN strand = '-' THEN {n - 1} - k ELSE k END AS INT) AS bin, val AS value FROM o{part}")
    return "".join(parts) + " " + " UNION ALL ".join(shown)


query("sig_04_parts", _parts_sql())(lambda r, z: G.signal_matrix(_genes(r), signal(r), z, TRACKS, bins=10, around=0.2))
query("sig_05_normalized", ", d AS (SELECT DISTINCT track, val FROM v), q AS (SELECT track, quantile_cont(val, 0.95) AS t FROM d GROUP BY track), u AS (SELECT track, chrom, b, e, least(val, t) AS val FROM v JOIN q USING (track)), m AS (SELECT track, min(val) AS l, max(val) AS h FROM u GROUP BY track) SELECT track, chrom, b AS start, e AS end, round(100 * (val - l) / (h - l), 4) AS value FROM u JOIN m USING (track)")(
    lambda r, z: G.normalized(signal(r), ranging=True).select("track", "chrom", "start", "end", F.round("value", 4).alias("value"))
)
query("sig_06_runs", ", h AS (SELECT DISTINCT track AS t, chrom, b, e FROM v WHERE val > 20 AND (val < 80 OR val == 960)), ho AS (SELECT *, max(e) OVER (PARTITION BY t, chrom ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM h), hi AS (SELECT *, sum(CASE WHEN far IS NULL OR b > far THEN 1 ELSE 0 END) OVER (PARTITION BY t, chrom ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS n FROM ho) SELECT t AS track, chrom, min(b) AS start, max(e) AS end FROM hi GROUP BY t, chrom, n")(
    lambda r, z: G.signal_runs(signal(r).distinct(), "s > 20 and (s < 80 or s == 960)")
)


def _controls(spark: SparkSession, folder: str) -> DataFrame:
    genes = table(spark, folder, "coding_pot").where("mrna_size IS NOT NULL").select(F.lit("all").alias("group"), F.concat_ws("-", label(F.col("transcript_id")), "cp_id").alias("gene"), F.col("mrna_size").alias("expression"), (F.col("cp_id") % 20 == 0).alias("is_reference"))
    return G.matched_controls(genes)


QUERIES["sig_07_controls"] = _controls

# --- Sequences -------------------------------------------------------------------------------------------------------

_BASES = f"(SELECT string_agg(substr('{LETTERS}', CAST((p * 7 + p // 3) % 8 + 1 AS BIGINT), 1), '' ORDER BY p) FROM (SELECT unnest(range(m.s, m.e + 1)) AS p))"
_RC = "CASE WHEN strand = '-' THEN translate(reverse({0}), 'acgt', 'tgca') ELSE {0} END"
query("iv_08_fetch", f", m AS (SELECT rid, s, e, strand FROM f WHERE feature = 'cds'), y AS (SELECT rid, strand, {_BASES} AS q FROM m) SELECT rid, {_RC.format('q')} AS bases FROM y")(
    lambda r, z: Q.fetch(_cds(r), genome(_cds(r))).select("rid", "bases")
)
query("seq_01_spliced", f", m AS (SELECT rid, tx, gene, seqid, s, e, strand FROM f WHERE feature = 'exon' AND tx IS NOT NULL), y AS (SELECT *, {_BASES} AS q FROM m), j AS (SELECT tx, gene, seqid, strand, string_agg(q, '' ORDER BY s, e, rid) AS q FROM y GROUP BY ALL) SELECT tx AS transcript_id, gene AS gene_id, seqid AS chrom, strand, {_RC.format('q')} AS sequence FROM j")(
    lambda r, z: Q.transcript_sequences(r, genome(_exons(r)))
)
query("seq_02_offsets", ", m AS (SELECT tx AS transcript_id, rid, e - s + 1 AS n, sum(e - s + 1) OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '-' THEN -e ELSE s END, rid ROWS UNBOUNDED PRECEDING) AS l FROM f WHERE feature = 'exon' AND tx IS NOT NULL) SELECT transcript_id, rid, CAST(l - n + 1 AS BIGINT) AS first, CAST(l AS BIGINT) AS last FROM m")(
    lambda r, z: Q.exon_offsets(r)
)

# --- Enrichment and mining -------------------------------------------------------------------------------------------

_TRUE = ", " + _merged_sql("g", "mg") + ", " + _merged_sql("x", "mx") + ", " + _events_sql([("mg", 0), ("mx", 1)]) + ", ov AS (SELECT * FROM sg WHERE \"end\" IS NOT NULL AND n0 > 0 AND n1 > 0), nw AS (SELECT *, CASE WHEN start = lag(\"end\") OVER (PARTITION BY chrom ORDER BY start) THEN 0 ELSE 1 END AS k FROM ov)"
query("olo_06_true", _TRUE + " SELECT CAST(sum(k) AS BIGINT) AS n, CAST(sum(\"end\" - start) AS BIGINT) AS s FROM nw")(lambda r, z: O.true_overlap(_genes(r), _exons(r)))
query("olo_03_shuffled", ", " + _merged_sql("g", "mg") + f", q AS (SELECT unnest(range({O.SHUFFLES})) AS k) SELECT CAST(k AS INT) AS shuffle, chrom, count(*) AS n, CAST(sum(e - b) AS BIGINT) AS bases, CAST(sum((e - b) * (e - b)) AS BIGINT) AS squares FROM mg JOIN z USING (chrom), q GROUP BY ALL")(
    lambda r, z: O.shuffled(merge(_genes(r)), z).groupBy("shuffle", "chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.sum((F.col("end") - F.col("start")) * (F.col("end") - F.col("start"))).alias("squares"))
)


def _many(regions: DataFrame) -> DataFrame:
    """Merged regions of the chromosomes that have the 3 that a Markov model needs."""
    merged = merge(regions)
    return merged.join(merged.groupBy("chrom").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("chrom"), "chrom", "left_semi")


query("olo_04_markov", None)(lambda r, z: O.markov_shuffled(_many(_genes(r)), z).groupBy("shuffle", "chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases")))
query("olo_05_shuffle_overlaps", None)(lambda r, z: O.shuffle_overlaps(_genes(r), _exons(r), z))


def _enriched(r: DataFrame, z: DataFrame) -> DataFrame:
    """Coding regions against all features, the derived regions and both strands of the annotation."""
    return O.annotation_enrichment(_cds(r), r, z, more_keys=("strand",))


query("olo_01_enrichment", None)(_enriched)


def _segments(r: DataFrame) -> DataFrame:
    """Segments of four merged sets, written once: every query of combinations reads them several times."""
    sets = [_genes(r), _exons(r), _tx(r), bed(r.where("feature = 'cds'"))]
    return cut(sweep([cut(merge(x)) for x in sets], least=1))


_FOUR = ", d AS (SELECT rid, seqid AS chrom, s - 1 AS b, e FROM f WHERE feature = 'cds'), " + ", ".join(_merged_sql(a, b) for a, b in (("g", "m0"), ("x", "m1"), ("t", "m2"), ("d", "m3"))) + ", " + _events_sql([(f"m{i}", i) for i in range(4)]) + ", ov AS (SELECT * FROM sg WHERE \"end\" IS NOT NULL AND n0 + n1 + n2 + n3 > 0)"
_LABELS = ["Query", "Exon", "Transcript", "CDS"]
query("olo_11_combinations", _FOUR + ", op AS (SELECT * FROM ov WHERE n0 > 0 AND n1 + n2 + n3 > 0), ask AS (SELECT DISTINCT n1 AS a1, n2 AS a2, n3 AS a3 FROM op), hit AS (SELECT *, CASE WHEN start = lag(\"end\") OVER (PARTITION BY a1, a2, a3, chrom ORDER BY start) THEN 0 ELSE 1 END AS k FROM op JOIN ask ON n1 >= a1 AND n2 >= a2 AND n3 >= a3) SELECT '[Query' || CASE WHEN a1 = 1 THEN ' + Exon' ELSE '' END || CASE WHEN a2 = 1 THEN ' + Transcript' ELSE '' END || CASE WHEN a3 = 1 THEN ' + CDS' ELSE '' END || ' + ... ]' AS combination, CAST(1 + a1 + a2 + a3 AS INT) AS combination_order, CAST(sum(k) AS BIGINT) AS n, CAST(sum(\"end\" - start) AS BIGINT) AS s FROM hit GROUP BY a1, a2, a3")(
    lambda r, z: O.combination_overlaps(_segments(r), _LABELS)
)
query("olo_12_exact", _FOUR + ", op AS (SELECT *, CASE WHEN start = lag(\"end\") OVER (PARTITION BY n1, n2, n3, chrom ORDER BY start) THEN 0 ELSE 1 END AS k FROM ov WHERE n0 > 0 AND n1 + n2 + n3 > 0) SELECT '[Query' || CASE WHEN n1 = 1 THEN ' + Exon' ELSE '' END || CASE WHEN n2 = 1 THEN ' + Transcript' ELSE '' END || CASE WHEN n3 = 1 THEN ' + CDS' ELSE '' END || ']' AS combination, CAST(1 + n1 + n2 + n3 AS INT) AS combination_order, CAST(sum(k) AS BIGINT) AS n, CAST(sum(\"end\" - start) AS BIGINT) AS s FROM op GROUP BY n1, n2, n3")(
    lambda r, z: O.combination_overlaps(_segments(r), _LABELS, exact=True)
)


def _merged(r: DataFrame) -> DataFrame:
    length = (F.col("end") - F.col("start") + 1).cast("double")
    runs = r.groupBy("feature", (F.col("rid") % 3).alias("run")).agg(F.count(F.lit(1)).alias("n_shuffles"), F.avg(length).alias("m"), F.coalesce(F.var_samp(length), F.lit(0.0)).alias("v"))
    for long in O.MEASURES.values():
        runs = runs.withColumns({f"{long}_expectation_shuffled": F.col("m"), f"{long}_variance_shuffled": F.col("v"), f"{long}_true": F.lit(10)})
    merged = O.merged_runs(runs, ["feature"])
    return merged.select("feature", "n_shuffles", F.round("nb_intersections_expectation_shuffled", 3).alias("mean"), F.round("nb_intersections_variance_shuffled", 2).alias("var")).where("n_shuffles > 1")


query("olo_14_merged_runs", ", c AS (SELECT feature, CAST(e - s + 1 AS DOUBLE) AS l FROM f) SELECT feature, count(*) AS n_shuffles, round(avg(l), 3) AS mean, round(var_samp(l), 2) AS var FROM c GROUP BY feature HAVING count(*) > 1")(lambda r, z: _merged(r))


def _stacked(r: DataFrame, z: DataFrame) -> DataFrame:
    run = cut(_enriched(r, z))
    return O.stacked_runs({"first": run, "second": run})


query("olo_15_stacked", None)(lambda r, z: _stacked(r, z).select("run", "feature_type", "summed_bp_overlaps_true", "minus_log10_pvalue"))


def _tree(r: DataFrame, z: DataFrame) -> DataFrame:
    found = O.combination_overlaps(_segments(r), _LABELS)
    sets = F.array_sort(F.split(F.regexp_replace("combination", r"\[| \+ \.\.\. \]", ""), r" \+ "))
    tree = O.combination_tree(found.select(sets.alias("sets"), "s"))
    return tree.select(F.array_join("parent", "+").alias("parent"), F.array_join("child", "+").alias("child"), F.round("inheritance", 6).alias("inheritance"))


query("olo_16_tree", _FOUR + ", op AS (SELECT * FROM ov WHERE n0 > 0 AND n1 + n2 + n3 > 0), ask AS (SELECT DISTINCT n1 AS a1, n2 AS a2, n3 AS a3 FROM op), co AS (SELECT a1, a2, a3, sum(\"end\" - start) AS s, CASE WHEN a3 = 1 THEN 'CDS+' ELSE '' END || CASE WHEN a1 = 1 THEN 'Exon+' ELSE '' END || 'Query' || CASE WHEN a2 = 1 THEN '+Transcript' ELSE '' END AS label FROM op JOIN ask ON n1 >= a1 AND n2 >= a2 AND n3 >= a3 GROUP BY a1, a2, a3), pr AS (SELECT p.label AS parent, c.label AS child, round(c.s / p.s, 6) AS inheritance, rank() OVER (PARTITION BY c.label ORDER BY c.a1 + c.a2 + c.a3 - p.a1 - p.a2 - p.a3) AS r FROM co p JOIN co c ON p.a1 <= c.a1 AND p.a2 <= c.a2 AND p.a3 <= c.a3 AND p.label <> c.label) SELECT parent, child, inheritance FROM pr WHERE r = 1 UNION ALL SELECT 'Query', label, NULL FROM co WHERE label NOT IN (SELECT child FROM pr)")(_tree)
query("olo_17_complement", ", " + _merged_sql("g", "mg") + ", q AS (SELECT chrom, b, e FROM mg UNION ALL SELECT chrom, size, size FROM z UNION ALL SELECT chrom, 0, 0 FROM z), w AS (SELECT chrom, b, max(e) OVER (PARTITION BY chrom ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM q) SELECT chrom, a AS start, b AS end FROM w WHERE a < b")(
    lambda r, z: O.complement(_genes(r), z)
)
query("mod_01_squished", _FOUR + ", p AS (SELECT CAST(n0 AS INT) || ',' || CAST(n1 AS INT) || ',' || CAST(n2 AS INT) || ',' || CAST(n3 AS INT) AS pattern, count(*) AS n FROM ov GROUP BY ALL) SELECT pattern, n, CAST(ceil(sqrt(n) / sqrt(greatest((SELECT min(n) FROM p), 0.0001 * (SELECT sum(n) FROM p)))) AS BIGINT) AS weight FROM p")(
    lambda r, z: M.squished(_segments(r)).withColumn("pattern", F.array_join("pattern", ","))
)


def _words(r: DataFrame, z: DataFrame) -> DataFrame:
    patterns = M.squished(_segments(r))
    found = M.best_dictionary(patterns, [w for w, _ in M.candidate_words(patterns, 4)], 4)
    return r.sparkSession.createDataFrame([(",".join(map(str, w)), e) for w, e in found], "word string, error double")


query("mod_04_dictionary", None)(_words)
query("mod_06_frequent", _FOUR + ", i AS (SELECT list_filter([CASE WHEN n0 > 0 THEN 'Query' END, CASE WHEN n1 > 0 THEN 'Exon' END, CASE WHEN n2 > 0 THEN 'Transcript' END, CASE WHEN n3 > 0 THEN 'CDS' END], lambda x: x IS NOT NULL) AS l FROM ov), c AS (SELECT unnest(['CDS', 'Exon', 'Query', 'Transcript', 'CDS+Exon', 'CDS+Query', 'CDS+Transcript', 'Exon+Query', 'Exon+Transcript', 'Query+Transcript', 'CDS+Exon+Query', 'CDS+Exon+Transcript', 'CDS+Query+Transcript', 'Exon+Query+Transcript', 'CDS+Exon+Query+Transcript']) AS items), h AS (SELECT items, count(*) AS freq FROM c JOIN i ON list_has_all(l, string_split(items, '+')) GROUP BY items) SELECT items, freq FROM h WHERE freq >= 0.05 * (SELECT count(*) FROM i)")(
    lambda r, z: M.frequent_combinations(_segments(r), _LABELS).withColumn("items", F.array_join("items", "+"))
)
query("seq_03_header", "SELECT tx AS transcript_id, any_value('transcript_id=' || tx || '|gene_id=' || coalesce(gene, '?') || '|strand=' || strand) AS header FROM (SELECT tx, arg_min(gene, rid) AS gene, arg_min(strand, rid) AS strand FROM f WHERE feature = 'transcript' AND tx IS NOT NULL GROUP BY tx) JOIN (SELECT DISTINCT tx FROM f WHERE feature = 'exon') USING (tx) GROUP BY tx UNION ALL SELECT DISTINCT tx, tx FROM f WHERE feature = 'exon' AND tx IS NOT NULL AND tx NOT IN (SELECT tx FROM f WHERE feature = 'transcript' AND tx IS NOT NULL)")(
    lambda r, z: Q.sequence_headers(_exons(r).where("name <> '?'").select(F.col("name").alias("transcript_id")).distinct(), r, ["transcript_id", "gene_id", "strand"], explicit=True, no_version=True)
)
