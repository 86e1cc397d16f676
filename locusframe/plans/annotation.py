"""Queries of selection, projection, editing, aggregation and numbering over the annotation table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.labels import identifier, refers
from locusframe.model import annotation, attr, bed, value, with_position
from locusframe.operators import aggregate as A
from locusframe.operators import edit as E
from locusframe.operators import project as P
from locusframe.operators import select as S
from locusframe.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The annotation table in SQL: f, with s and e for start and end, and ids gene and tx.
BASE = r"""f AS (SELECT rid, lower(trim(seqid)) AS seqid, source, lower(trim(feature)) AS feature, start_pos AS s, end_pos AS e, score, strand, phase,
  CASE WHEN trim(gene_id) NOT IN ('', '.', '?') THEN regexp_replace(lower(trim(gene_id)), '\.[0-9]+$', '') END AS gene,
  CASE WHEN trim(transcript_id) NOT IN ('', '.', '?') THEN regexp_replace(lower(trim(transcript_id)), '\.[0-9]+$', '') END AS tx
  FROM features WHERE trim(seqid) NOT IN ('', '.', '?') AND trim(feature) NOT IN ('', '.', '?') AND start_pos >= 1 AND start_pos <= end_pos)"""
LONG = """a AS (SELECT DISTINCT rid, pos, lower(trim(attr_key)) AS k, trim(attr_value) AS v FROM gtf_attribute
  WHERE attr_key IS NOT NULL AND attr_value IS NOT NULL AND lower(trim(attr_key)) NOT IN ('gene_id', 'transcript_id') AND rid IN (SELECT rid FROM f))"""
#: First attribute of a row with this key.
FIRST = "(SELECT v FROM a WHERE a.rid = f.rid AND k = '{}' ORDER BY pos, v LIMIT 1)"


def query(name: str, sql: str | None, attributes: bool = False) -> Callable:
    """Register a function of the annotation table under a name, with SQL that follows BASE."""

    def register(function: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: function(annotation(spark, folder, attributes))
        if sql is not None:
            ORACLE[name] = f"WITH {BASE}{', ' + LONG if attributes else ''}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return function

    return register


def _rids(rows: DataFrame) -> DataFrame:
    return rows.select("rid")


# --- Selection -------------------------------------------------------------------------------------------------------

query("sel_01_key", "SELECT rid FROM f WHERE feature = 'exon'")(lambda r: _rids(S.select_by_key(r, "feature", "exon")))
query("sel_01_invert", "SELECT rid FROM f WHERE tx IS NOT NULL AND tx NOT IN ('gxt00000000002', 'gxt00000000013')")(lambda r: _rids(S.select_by_key(r, "transcript_id", ["gxt00000000002", "gxt00000000013"], invert=True)))
query("sel_01_invert_na", "SELECT rid FROM f WHERE tx IS NULL OR tx NOT IN ('gxt00000000002')")(lambda r: _rids(S.select_by_key(r, "transcript_id", ["gxt00000000002"], invert=True, no_na=False)))
query("sel_02_shortcut", "SELECT rid FROM f WHERE feature = 'cds'")(lambda r: _rids(S.select_by_key(r, "feature", S.SHORTCUTS["cds"])))
query("sel_03_log", "SELECT count(*) AS n_in, count(*) FILTER (WHERE feature IN ('exon', 'gene')) AS n_kept, 100 * (count(*) FILTER (WHERE feature IN ('exon', 'gene'))) / count(*) AS percent, 3 - count(DISTINCT feature) FILTER (WHERE feature IN ('exon', 'gene')) AS n_missing FROM f")(
    lambda r: S.selection_log(r, "feature", ["exon", "gene", "nothing"])
)
query("sel_04_bed", "SELECT seqid AS chrom, s - 1 AS start, e AS end, coalesce(gene, '?') || '|' || coalesce(tx, '?') AS name, score, strand FROM f WHERE feature = 'transcript'")(
    lambda r: bed(S.select_by_key(r, "feature", "transcript"), ["gene_id", "transcript_id"]).drop("rid")
)
query("sel_05_mask", "SELECT rid FROM f WHERE e - s > 500")(lambda r: _rids(S.select_where(r, S.number("end") - S.number("start") > 500)))
query("sel_06_positions", "SELECT rid, w.at FROM (SELECT rid, row_number() OVER (ORDER BY rid) - 1 AS p FROM f) JOIN (SELECT unnest([7, 0, 7, 1200]) AS p, unnest([0, 1, 2, 3]) AS at) w USING (p)")(
    lambda r: S.select_by_positions(r, [7, 0, 7, 1200]).select("rid", "at")
)
query("sel_07_regexp", "SELECT rid FROM f WHERE regexp_matches(gene, '0{3}[0-9]*7$')")(lambda r: _rids(S.select_by_regexp(r, "gene_id", "0{3}[0-9]*7$")))
query("sel_08_numeric", "SELECT rid FROM f WHERE score NOT IN ('.', '?') AND ((CAST(score AS DOUBLE) > 50 AND s < 400000) OR CAST(score AS DOUBLE) == 0)")(
    lambda r: _rids(S.select_by_number(r, "(score > 50 and start < 400000) or 0 == score"))
)
query("sel_10_location", "SELECT rid FROM f WHERE (seqid = 'scf000001' AND s <= 400000 AND e >= 200000) OR (seqid = 'scf000002' AND s <= 90000 AND e >= 50000)")(
    lambda r: _rids(S.select_by_location(r, [("scf000001", 200_000, 400_000), ("scf000002", 50_000, 90_000)]))
)
query("sel_11_location_members", "SELECT rid FROM f WHERE tx IN (SELECT tx FROM f WHERE feature = 'transcript' AND seqid = 'scf000001' AND s <= 400000 AND e >= 200000)")(
    lambda r: _rids(S.select_members_by_location(r, [("scf000001", 200_000, 400_000)]))
)
query("sel_12_tx_size", ", t AS (SELECT tx, coalesce(sum(e - s + 1) FILTER (WHERE feature = 'exon'), 0) AS n FROM f WHERE tx IS NOT NULL GROUP BY tx) SELECT rid FROM f WHERE tx IN (SELECT tx FROM t WHERE n BETWEEN 300 AND 900)")(
    lambda r: _rids(S.select_by_transcript_size(r, 300, 900))
)
query("sel_13_exon_count", ", t AS (SELECT tx, count(*) FILTER (WHERE feature = 'exon') AS n FROM f WHERE tx IS NOT NULL GROUP BY tx) SELECT rid FROM f WHERE tx IN (SELECT tx FROM t WHERE n BETWEEN 2 AND 4)")(
    lambda r: _rids(S.select_by_exon_count(r, 2, 4))
)


def _ranked_sql(measure: str, order: str, genes: bool = False) -> str:
    more = " UNION ALL SELECT rid FROM f WHERE feature = 'gene' AND tx IS NULL" if genes else ""
    return f", t AS (SELECT gene, tx, {measure} AS m, min(rid) AS r FROM f WHERE gene IS NOT NULL AND tx IS NOT NULL GROUP BY ALL), k AS (SELECT tx, row_number() OVER (PARTITION BY gene ORDER BY m {order}, r) AS n FROM t WHERE m IS NOT NULL) SELECT rid FROM f WHERE tx IN (SELECT tx FROM k WHERE n = 1){more}"


query("sel_14_max_exons", _ranked_sql("count(*) FILTER (WHERE feature = 'exon')", "DESC"))(lambda r: _rids(S.select_by_max_exon_count(r)))
query("sel_15_shortest", _ranked_sql("sum(e - s + 1) FILTER (WHERE feature = 'exon')", "", True))(lambda r: _rids(S.select_by_length_rank(r)))
query("sel_15_longest", _ranked_sql("sum(e - s + 1) FILTER (WHERE feature = 'exon')", "DESC"))(lambda r: _rids(S.select_by_length_rank(r, longest=True, keep_genes=False)))
query("sel_16_most_5p", _ranked_sql("min(CASE WHEN strand = '-' THEN -e ELSE s END) FILTER (WHERE feature = 'exon')", ""))(lambda r: _rids(S.select_most_5p(r)))
_INTRONS = ", x AS (SELECT DISTINCT tx, s, e FROM f WHERE feature = 'exon' AND tx IS NOT NULL), i AS (SELECT tx, lead(s) OVER (PARTITION BY tx ORDER BY s, e) - e - 1 AS g FROM x)"
query("sel_17_intron_size", _INTRONS + " SELECT rid FROM f WHERE tx IN (SELECT tx FROM i GROUP BY tx HAVING coalesce(min(g) >= 100, true))")(lambda r: _rids(S.select_by_intron_size(r, 100)))
query("sel_17_merged", _INTRONS + " SELECT rid FROM f WHERE tx IN (SELECT tx FROM i GROUP BY tx HAVING coalesce(sum(g) >= 600, false))")(lambda r: _rids(S.select_by_intron_size(r, 600, merged=True, drop_monoexonic=True)))
query("sel_18_dup_tss", ", t AS (SELECT DISTINCT gene, tx, CASE WHEN strand = '-' THEN e ELSE s END AS p FROM f WHERE feature = 'transcript' AND gene IS NOT NULL AND tx IS NOT NULL), k AS (SELECT tx, row_number() OVER (PARTITION BY gene, p ORDER BY tx) AS n FROM t) SELECT rid FROM f WHERE feature <> 'gene' AND tx IN (SELECT tx FROM k WHERE n = 1)")(
    lambda r: _rids(S.remove_duplicate_tss(r))
)
query("sel_19_random_list", "SELECT rid FROM f WHERE tx IN (SELECT tx FROM f WHERE tx IS NOT NULL GROUP BY tx ORDER BY md5('3:' || tx), tx LIMIT 20)")(lambda r: _rids(S.random_members(r, 20, seed=3)))
query("sel_20_random_tx", ", d AS (SELECT DISTINCT gene, tx FROM f WHERE gene IS NOT NULL AND tx IS NOT NULL), k AS (SELECT tx, row_number() OVER (PARTITION BY gene ORDER BY md5('3:' || tx), tx) AS n FROM d) SELECT rid FROM f WHERE feature <> 'gene' AND tx IN (SELECT tx FROM k WHERE n <= 2)")(lambda r: _rids(S.random_transcripts(r, 2, seed=3)))
query("sel_22_head", "SELECT rid FROM f ORDER BY rid LIMIT 25")(lambda r: _rids(S.head(r, 25)))
query("sel_22_tail", "SELECT rid FROM f ORDER BY rid DESC LIMIT 25")(lambda r: _rids(S.tail(r, 25)))


def _by_term(spark: SparkSession, folder: str) -> DataFrame:
    """Genes of one biotype in the registry, in place of a list of genes per term."""
    terms = table(spark, folder, "gene_ref").select(F.col("gene_biotype").alias("term"), F.lower("gene_id").alias("gene_id"))
    return _rids(S.select_by_term(annotation(spark, folder), terms, "lncRNA"))


QUERIES["sel_21_term"] = _by_term
ORACLE["sel_21_term"] = f"WITH {BASE} SELECT rid FROM f WHERE gene IN (SELECT lower(gene_id) FROM gene_ref WHERE gene_biotype = 'lncRNA')"

# --- Projection ------------------------------------------------------------------------------------------------------

query("prj_01_extract", "SELECT rid, seqid, CAST(s - 1 AS VARCHAR) AS start, coalesce(gene, '?') AS gene_id, coalesce(tx, '?') AS transcript_id, '?' AS nothing FROM f")(
    lambda r: P.extract(r, ["seqid", "start", "gene_id", "transcript_id", "nothing"], zero_based=True)
)
query("prj_01_distinct", "SELECT min(rid) AS rid, seqid, coalesce(gene, '?') AS gene_id FROM f WHERE gene IS NOT NULL GROUP BY seqid, gene")(lambda r: P.extract(r, ["seqid", "gene_id"], distinct=True, no_undefined=True))
query("prj_02_first", "SELECT tx AS key, arg_min(score, rid) AS value FROM f WHERE tx IS NOT NULL AND score IS NOT NULL GROUP BY tx")(lambda r: P.first_values(r, "transcript_id", "score"))
query("prj_02_last", "SELECT tx AS key, arg_max(feature, rid) AS feature, CAST(arg_max(e, rid) AS VARCHAR) AS end FROM f WHERE tx IS NOT NULL GROUP BY tx")(lambda r: P.last_values(r, "transcript_id", ["feature", "end"]))
query("prj_02_merged", ", d AS (SELECT gene AS key, feature AS v, min(rid) AS r FROM f WHERE gene IS NOT NULL GROUP BY ALL) SELECT key, string_agg(v, ',' ORDER BY r) AS values FROM d GROUP BY key")(
    lambda r: P.merged_values(r, "gene_id", "feature").withColumn("values", F.array_join("values", ","))
)
query("prj_04_names", "SELECT k AS key, min(rid) AS first_rid FROM (SELECT k, rid FROM a UNION ALL SELECT 'gene_id', rid FROM f WHERE gene IS NOT NULL UNION ALL SELECT 'transcript_id', rid FROM f WHERE tx IS NOT NULL) GROUP BY k", True)(
    lambda r: P.attribute_names(r).drop("first_pos")
)
query("prj_05_values", "SELECT gene AS value, count(*) AS n FROM f WHERE gene IS NOT NULL GROUP BY gene")(lambda r: P.attribute_values(r, "gene_id"))
query("prj_06_distinct", "SELECT feature AS value, min(rid) AS first_rid FROM f GROUP BY feature")(lambda r: P.distinct_keys(r, "feature"))
query("prj_07_gene_of", "SELECT tx AS key, arg_min(gene, rid) AS value FROM f WHERE tx IS NOT NULL AND gene IS NOT NULL GROUP BY tx")(P.gene_of_transcript)
query("prj_07_strand", "SELECT gene AS key, arg_min(strand, rid) AS value FROM f WHERE feature = 'gene' AND gene IS NOT NULL GROUP BY gene")(P.strand_of)
_TSS = ", t AS (SELECT DISTINCT gene, tx, CASE WHEN strand = '-' THEN e ELSE s END AS tss, CASE WHEN strand = '-' THEN -e ELSE s END AS way FROM f WHERE feature = 'transcript' AND gene IS NOT NULL AND tx IS NOT NULL), q AS (SELECT gene AS gene_id, tx AS transcript_id, tss, dense_rank() OVER (PARTITION BY gene ORDER BY way) AS tss_rank FROM t)"
query("prj_08_tss_rank", _TSS + " SELECT * FROM q")(P.transcripts_by_tss)
query("prj_09_tabulate", "SELECT min(rid) AS rid, seqid, feature, score FROM f WHERE score <> '.' AND score <> '?' GROUP BY seqid, feature, score")(
    lambda r: P.extract(r, ["seqid", "feature", "score"], distinct=True, no_unset=True, no_undefined=True)
)
query("prj_10_columns", "SELECT DISTINCT feature, strand, 'x' AS note FROM f")(lambda r: P.columns_of(r, ["feature", "strand"], distinct=True, more={"note": "x"}))
query("prj_11_accessor", "SELECT rid, coalesce(tx, '.') AS tx FROM f")(lambda r: r.select("rid", P.attribute("transcript_id", "set_na").alias("tx")))
query("prj_12_types", "SELECT * FROM (VALUES ('start', 'integer'), ('strand', 'char'), ('feature', 'string'), ('score', 'float')) AS t(key, type)")(lambda r: P.inferred_types(r, ["start", "strand", "feature", "score"]))
query("snk_03_bed", "SELECT seqid AS chrom, s - 1 AS start, e AS end, coalesce(tx, '?') || '|x|' || feature AS name, score, strand FROM f")(lambda r: bed(r, ["transcript_id"], more=["x"], add_feature=True).drop("rid"))
query("ord_01_position", "SELECT rid, row_number() OVER (ORDER BY rid) - 1 AS position FROM f")(lambda r: with_position(r).select("rid", "position"))

# --- Editing ---------------------------------------------------------------------------------------------------------


def _shown(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select("rid", *(value(k).alias(k) for k in keys))


query("att_01_prefix", "SELECT rid, 'chr' || seqid AS seqid, CASE WHEN feature IN ('exon', 'cds') THEN gene || '_x' ELSE gene END AS gene_id FROM f")(
    lambda r: _shown(E.add_prefix(E.add_prefix(r, "chrom", "chr"), "gene_id", "_x", suffix=True, features="exon,cds"), "seqid", "gene_id")
)
query("att_02_delete", "SELECT rid, gene AS gene_id, CAST(NULL AS VARCHAR) AS level, " + FIRST.format("gene_name") + " AS gene_name FROM f", True)(lambda r: _shown(E.delete_attributes(r, ["level", "gene_id"]), "gene_id", "level", "gene_name"))
query("att_02_regexp", "SELECT rid, count(*) AS n FROM (SELECT rid FROM a WHERE regexp_matches(k, '^gene_') UNION ALL SELECT rid FROM f WHERE gene IS NOT NULL UNION ALL SELECT rid FROM f WHERE tx IS NOT NULL) GROUP BY rid", True)(
    lambda r: E.delete_attributes(r, "^gene_", regexp=True, invert=True).select("rid", F.size("attrs").cast("bigint").alias("n")).where("n > 0")
)
query("att_03_merge", "SELECT rid, CASE WHEN feature = 'exon' THEN coalesce(gene, '.') || '|' || coalesce(tx, '.') || '|' || strand END AS both FROM f")(
    lambda r: _shown(E.merge_attributes(r, ["gene_id", "transcript_id", "strand"], "both", features="exon"), "both")
)


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "coding_pot").where(refers(F.col("transcript_id"))).select(identifier(F.col("transcript_id")).alias("key"), F.col("mrna_size").alias("value"))
    return _shown(E.join_attribute(annotation(spark, folder), pairs, "transcript_id", "mrna_size", features="transcript,exon"), "mrna_size").where("mrna_size IS NOT NULL")


QUERIES["att_04_join"] = _joined
ORACLE["att_04_join"] = f"WITH {BASE}, p AS (SELECT regexp_replace(lower(trim(transcript_id)), '\\.[0-9]+$', '') AS tx, string_agg(CAST(mrna_size AS VARCHAR), '|' ORDER BY CAST(mrna_size AS VARCHAR)) AS m FROM coding_pot WHERE mrna_size IS NOT NULL AND trim(transcript_id) NOT IN ('', '.', '?') GROUP BY 1) SELECT rid, m AS mrna_size FROM f JOIN p USING (tx) WHERE feature IN ('transcript', 'exon')"


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    matrix = table(spark, folder, "gene_ref").select(F.lower("gene_id").alias("gene"), "gene_name", "gene_biotype")
    return _shown(E.join_matrix(annotation(spark, folder), matrix, "gene_id", "gene", features="gene"), "gene_name", "gene_biotype").where("gene_biotype IS NOT NULL")


QUERIES["att_05_matrix"] = _matrix
ORACLE["att_05_matrix"] = f"WITH {BASE}, m AS (SELECT lower(gene_id) AS gene, gene_name, gene_biotype, row_number() OVER (PARTITION BY lower(gene_id) ORDER BY gene_name NULLS FIRST, gene_biotype NULLS FIRST) AS n FROM gene_ref) SELECT rid, gene_name, gene_biotype FROM f JOIN m USING (gene) WHERE n = 1 AND feature = 'gene' AND gene_biotype IS NOT NULL"


def _positioned(spark: SparkSession, folder: str) -> DataFrame:
    values = table(spark, folder, "coding_pot").select((F.col("cp_id") * 3).alias("position"), F.when(F.col("mrna_size") > 300, F.col("mrna_size").cast("string")).otherwise("?").alias("value"))
    return _shown(E.join_by_position(annotation(spark, folder), values, "size"), "size").where("size IS NOT NULL")


QUERIES["att_09_position"] = _positioned
ORACLE["att_09_position"] = f"WITH {BASE}, n AS (SELECT rid, row_number() OVER (ORDER BY rid) - 1 AS p FROM f) SELECT rid, CAST(mrna_size AS VARCHAR) AS size FROM n JOIN coding_pot ON p = cp_id * 3 WHERE mrna_size > 300"
query("att_10_discretize", f", v AS (SELECT f.rid, TRY_CAST({FIRST.format('gc_content')} AS DOUBLE) AS x FROM f), b AS (SELECT quantile_cont(x, 0.5) AS m FROM v) SELECT rid, CASE WHEN x <= m THEN 'low' ELSE 'high' END AS gc FROM v, b WHERE x IS NOT NULL", True)(
    lambda r: _shown(E.discretize(r, "gc_content", "gc", 2, labels=["low", "high"], percentiles=True), "gc").where("gc IS NOT NULL")
)
query("att_10_equal_width", f", v AS (SELECT f.rid, TRY_CAST({FIRST.format('mean_signal')} AS DOUBLE) AS x FROM f), b AS (SELECT min(x) AS l, max(x) AS h FROM v) SELECT rid, CASE WHEN x <= l + (h - l) * 1 / 4 THEN 'a' WHEN x <= l + (h - l) * 2 / 4 THEN 'b' WHEN x <= l + (h - l) * 3 / 4 THEN 'c' ELSE 'd' END AS g FROM v, b WHERE x IS NOT NULL", True)(
    lambda r: _shown(E.discretize(r, "mean_signal", "g", 4, labels=["a", "b", "c", "d"]), "g").where("g IS NOT NULL")
)
query("att_11_ensembl", ", m AS (SELECT * FROM f WHERE feature = 'exon'), t AS (SELECT min(rid) - 0.25 AS rid, 'transcript' AS feature, min(s) AS start, max(e) AS end, arg_min(strand, rid) AS strand, tx AS id FROM m WHERE tx IS NOT NULL GROUP BY tx) SELECT CAST(rid AS DOUBLE) AS rid, feature, start, \"end\", strand, id FROM t UNION ALL SELECT rid, feature, s, e, strand, tx FROM m")(
    lambda r: E.to_ensembl(E.delete_attributes(r.where("feature = 'exon'"), ["gene_id"], force=True)).select("rid", "feature", "start", "end", "strand", attr("transcript_id").alias("id"))
)
query("att_12_bed_to_rows", "SELECT rid, seqid, 'exon' AS feature, s AS start, e AS end, coalesce(tx, '?') AS exon_id FROM f")(
    lambda r: E.bed_to_annotation(bed(r, ["transcript_id"]), "exon").select("rid", "seqid", "feature", "start", "end", attr("exon_id").alias("exon_id"))
)

# --- Aggregation and numbering ---------------------------------------------------------------------------------------

query("agg_01_count", "SELECT feature, count(*) AS n, min(rid) AS first_rid FROM f GROUP BY feature")(A.count_features)
query("agg_02_key_values", "SELECT k AS key, count(DISTINCT v) AS n FROM (SELECT k, v FROM a UNION ALL SELECT 'gene_id', gene FROM f UNION ALL SELECT 'transcript_id', tx FROM f) WHERE v IS NOT NULL GROUP BY k", True)(
    lambda r: A.count_key_values(r, distinct=True)
)
query("agg_03_exons", "SELECT tx AS transcript_id, count(*) FILTER (WHERE feature = 'exon') AS nb_exons FROM f WHERE tx IS NOT NULL GROUP BY tx")(A.exon_counts)
query("agg_04_transcripts", "SELECT gene AS gene_id, count(DISTINCT tx) AS nb_tx FROM f WHERE gene IS NOT NULL GROUP BY gene")(A.transcript_counts)
query("agg_05_tx_size", "SELECT tx AS transcript_id, CAST(sum(e - s + 1) AS BIGINT) AS size FROM f WHERE feature = 'exon' AND tx IS NOT NULL GROUP BY tx")(A.transcript_sizes)
query("agg_05_tx_span", "SELECT tx AS transcript_id, max(e) - min(s) + 1 AS size FROM f WHERE feature = 'exon' AND tx IS NOT NULL GROUP BY tx")(lambda r: A.transcript_sizes(r, with_introns=True))
query("agg_06_feat_size", "SELECT rid, e - s + 1 AS size FROM f WHERE feature = 'cds'")(lambda r: A.feature_sizes(r, "cds"))
query("agg_06_exon_sizes", "SELECT tx AS transcript_id, string_agg(CAST(e - s + 1 AS VARCHAR), ',' ORDER BY rid) AS exon_sizes FROM f WHERE feature = 'exon' AND tx IS NOT NULL GROUP BY tx")(A.exon_size_lists)
query("agg_06_intron_sizes", ", x AS (SELECT tx, s, e, min(strand) AS strand FROM f WHERE feature = 'exon' AND tx IS NOT NULL GROUP BY tx, s, e), i AS (SELECT *, lead(s) OVER (PARTITION BY tx ORDER BY s, e) - e - 1 AS g FROM x), m AS (SELECT tx, min(strand) AS strand, string_agg(CAST(g AS VARCHAR), ',' ORDER BY s, e) FILTER (WHERE g IS NOT NULL) AS up, string_agg(CAST(g AS VARCHAR), ',' ORDER BY s DESC, e DESC) FILTER (WHERE g IS NOT NULL) AS down FROM i GROUP BY tx) SELECT tx AS transcript_id, coalesce(CASE WHEN strand = '-' THEN down ELSE up END, '0') AS intron_sizes FROM m")(
    A.intron_size_lists
)
query("agg_07_tss_dist", _TSS + ", r AS (SELECT gene_id, tss_rank, min(tss) AS site, count(*) AS n FROM q GROUP BY ALL) SELECT q.gene_id, transcript_id, tss, q.tss_rank, abs(tss - (SELECT site FROM r WHERE r.gene_id = q.gene_id AND r.tss_rank = q.tss_rank - 1)) AS dist, abs(tss - (SELECT min(tss) FROM q p WHERE p.gene_id = q.gene_id AND p.tss_rank = 1)) AS from_first, CAST(coalesce((SELECT sum(n) FROM r WHERE r.gene_id = q.gene_id AND r.tss_rank > q.tss_rank), 0) AS BIGINT) AS n_further FROM q")(
    A.tss_ladder
)
query("agg_07_tss_pairs", _TSS + ", k AS (SELECT DISTINCT gene AS gene_id, tx AS transcript_id FROM f WHERE feature = 'transcript' AND rid % 20 = 0) SELECT a.gene_id, a.transcript_id AS tx_1, b.transcript_id AS tx_2, abs(a.tss - b.tss) AS dist, a.tss_rank AS rank_1, b.tss_rank AS rank_2 FROM q a JOIN q b ON a.gene_id = b.gene_id AND (a.tss_rank < b.tss_rank OR (a.tss_rank = b.tss_rank AND a.transcript_id < b.transcript_id)) WHERE (a.gene_id, a.transcript_id) IN (SELECT * FROM k) OR (b.gene_id, b.transcript_id) IN (SELECT * FROM k)")(
    lambda r: A.tss_distances(r, F.col("rid") % 20 == 0)
)
_SIZES = ", z AS (SELECT seqid, feature, CAST(e - s + 1 AS DOUBLE) AS v FROM f)"
query("agg_08_profile", _SIZES + ", m AS (SELECT feature, avg(v) AS a FROM z GROUP BY feature) SELECT feature, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max, sum(v) AS sum, count(*) AS n, round(avg(abs(v - a)), 4) AS mad FROM z JOIN m USING (feature) GROUP BY feature")(
    lambda r: A.profile_statistics(r.select("feature", (F.col("end") - F.col("start") + 1).cast("double").alias("value")), ["feature"]).select("feature", *(F.round(c, 4).alias(c) for c in ("mean", "median", "std")), "min", "max", "sum", "n", F.round("mad", 4).alias("mad"))
)
query("agg_09_moments", _SIZES + ", m AS (SELECT feature, avg(v) AS a FROM z GROUP BY feature), c AS (SELECT feature, count(*) AS n, avg(v) AS mean, avg((v - a) ^ 2) AS m2, avg((v - a) ^ 3) AS m3, avg((v - a) ^ 4) AS m4 FROM z JOIN m USING (feature) GROUP BY feature) SELECT feature, n, round(mean, 3) AS mean, round(m2, 3) AS var, round(m3 / m2 ^ 1.5, 3) AS skew, round(m4 / m2 ^ 2 - 3, 3) AS kurt FROM c")(
    lambda r: A.moments(r.select("feature", (F.col("end") - F.col("start") + 1).cast("double").alias("v")), ["feature"], "v").select("feature", "n", *(F.round(c, 3).alias(c) for c in ("mean", "var", "skew", "kurt")))
)
query("agg_10_merged", _SIZES + " SELECT feature, count(*) AS n, round(avg(v), 3) AS mean, round(var_pop(v), 2) AS var FROM z GROUP BY feature")(
    lambda r: A.merged_moments(A.moments(r.select("seqid", "feature", (F.col("end") - F.col("start") + 1).cast("double").alias("v")), ["seqid", "feature"], "v"), ["feature"]).select("feature", "n", F.round("mean", 3).alias("mean"), F.round("var", 2).alias("var"))
)
query("win_01_exon_number", "SELECT rid, row_number() OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '+' THEN s ELSE -e END, rid) AS n FROM f WHERE feature = 'exon' AND tx IS NOT NULL")(
    lambda r: A.add_exon_number(r).select("rid", attr("exon_nbr").cast("bigint").alias("n")).where("n IS NOT NULL")
)
query("win_02_tss_number", _TSS + " SELECT gene_id, transcript_id, tss_rank AS tss_number, abs(tss - first_value(tss) OVER (PARTITION BY gene_id ORDER BY tss_rank)) AS dist_to_first_tss, max(tss_rank) OVER (PARTITION BY gene_id) AS nb_tss FROM q")(A.tss_numbering)
query("ord_04_top", "SELECT rid, e - s + 1 AS size FROM f ORDER BY size DESC, rid LIMIT 40")(lambda r: A.top_rows(A.feature_sizes(r), "size", 40, ["rid"]))
query("set_01_distinct", "SELECT DISTINCT seqid, feature, s AS start, e AS end FROM f")(lambda r: P.columns_of(r, ["seqid", "feature", "start", "end"], distinct=True))
query("set_03_complement", "SELECT rid FROM f WHERE feature NOT IN ('exon', 'cds')")(lambda r: _rids(r).exceptAll(_rids(S.select_by_key(r, "feature", "exon,cds"))))
query("set_05_concat", "SELECT rid FROM f WHERE feature = 'gene' UNION ALL SELECT rid FROM f WHERE feature = 'exon'")(lambda r: S.concatenated([_rids(S.select_by_key(r, "feature", x)) for x in ("gene", "exon")]))
