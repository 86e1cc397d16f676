"""Queries p1_, p3_, p4_, p5_ and p6_ over the data folder, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.labels import identifier, label, refers
from locusframe.operators.eav import cell_issues, declared, eav_cells, wide
from locusframe.operators.orphans import orphan_references
from locusframe.operators.packed import unpacked
from locusframe.operators.periods import periods_and_gaps
from locusframe.operators.quarantine import loaded, rejected
from locusframe.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Failing lines with the first reason that applies."""
    return rejected(table(spark, folder, "gtf_lines")).select("line_id", "reason")


def p1_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Sound lines with typed fields."""
    return loaded(table(spark, folder, "gtf_lines")).select("line_id", "seqid", "source", "feature", "start_pos", "end_pos", "score", "strand", "phase", "attributes")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Failing lines per uploaded file and reason."""
    return rejected(table(spark, folder, "gtf_lines")).groupBy("src_file", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def _cells(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple[str, str, bool]]]:
    types = declared(table(spark, folder, "attr_types"))
    return eav_cells(table(spark, folder, "gtf_attribute"), types), types


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells that cannot be filled or are contradictory."""
    return cell_issues(*_cells(spark, folder)).where(F.col("issue").isNotNull())


def p3_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per rid with a typed column per declared attribute; lists as text joined by '|'."""
    cells, types = _cells(spark, folder)
    return wide(cells, types).withColumns({k: F.array_join(f"`{k}`", "|") for k, _, many in types if many})


def _references(spark: SparkSession, folder: str) -> DataFrame:
    def refs(rows: DataFrame, name: str, row_id: str, fields: dict[str, str]) -> DataFrame:
        one = [F.struct(F.lit(reg).alias("registry"), F.lit(name).alias("table_name"), F.lit(f).alias("ref_field"), F.when(refers(F.col(f)), identifier(F.col(f))).alias("id")) for f, reg in fields.items()]
        each = rows.select(F.col(row_id).alias("row_id"), F.col("loaded_at").alias("at"), F.explode(F.array(*one)).alias("r"))
        return each.select("r.*", "at", "row_id").where(refers(F.col("id")))

    features = refs(table(spark, folder, "features"), "features", "rid", {"gene_id": "gene", "transcript_id": "transcript"})
    potential = refs(table(spark, folder, "coding_pot"), "coding_pot", "cp_id", {"transcript_id": "transcript"})
    return features.unionByName(potential)


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    def rows(name: str, field: str, registry: str) -> DataFrame:
        return table(spark, folder, name).where(refers(F.col(field))).select(F.lit(registry).alias("registry"), identifier(F.col(field)).alias("id"), "added_at", "withdrawn_at")

    return rows("gene_ref", "gene_id", "gene").unionByName(rows("transcript_ref", "transcript_id", "transcript"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """References without a registry row in force at loading."""
    most = 2 * table(spark, folder, "features").count() + table(spark, folder, "coding_pot").count()
    found = orphan_references(_references(spark, folder), _registry(spark, folder), most)
    return found.select("table_name", "ref_field", "row_id", F.date_format("at", "yyyy-MM").alias("load_month"), "kind")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, field, month and kind."""
    return p4_found(spark, folder).groupBy("table_name", "ref_field", "load_month", "kind").agg(F.count(F.lit(1)).alias("n_refs"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods and gaps per sequence and feature."""
    rows = table(spark, folder, "features").select(label(F.col("seqid")).alias("seqid"), label(F.col("feature")).alias("feature"), "start_pos", "end_pos")
    return periods_and_gaps(rows.where(refers(F.col("seqid"))), ["seqid", "feature"])


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Number and total length of periods and gaps per sequence and feature."""
    length = F.sum(F.col("end_pos") - F.col("start_pos") + 1).cast("bigint")
    return p5_found(spark, folder).groupBy("seqid", "feature", "kind").agg(F.count(F.lit(1)).alias("n"), length.alias("bases"))


def _unpacked(spark: SparkSession, folder: str) -> DataFrame:
    lists = [k for k, _, many in declared(table(spark, folder, "attr_types")) if many]
    return unpacked(table(spark, folder, "gtf_rows"), "attributes", lists, ["row_id"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every single value of the packed field with its position."""
    return _unpacked(spark, folder)


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Values and distinct values per key."""
    return _unpacked(spark, folder).groupBy("attr_key").agg(F.count(F.lit(1)).alias("n_values"), F.count_distinct("attr_value").alias("n_distinct"), F.max("item_no").alias("longest_list"))


QUERIES = {q.__name__: q for q in (p1_found, p1_loaded, p1_report, p3_found, p3_wide, p4_found, p4_report, p5_found, p5_report, p6_found, p6_report)}


# --- The same in SQL -------------------------------------------------------------------------------------------------

_ATTRIBUTES = r"""([ ]*([A-Za-z_][A-Za-z0-9_.\-]*[ ]+("([^"\\]|\\.)*"|[^ ";]+)[ ]*)?;)*[ ]*([A-Za-z_][A-Za-z0-9_.\-]*[ ]+("([^"\\]|\\.)*"|[^ ";]+)[ ]*)?"""
_PAIR = r"""([A-Za-z_][A-Za-z0-9_.\-]*)[ ]+("(?:[^"\\]|\\.)*"|[^ ";]+)"""
_NUMBER = r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"


def _attribute_sql(key: str) -> str:
    at = f"list_position(list_transform(regexp_extract_all(x[9], '{_PAIR}', 1), lambda k: lower(k)), '{key}')"
    value = f"regexp_extract_all(x[9], '{_PAIR}', 2)[{at}]"
    return f"coalesce(trim(regexp_replace(regexp_replace({value}, '^\"(.*)\"$', '\\1', 's'), '\\\\(.)', '\\1', 'g')) NOT IN ('', '.', '?'), false)"


_LINES = f"""
WITH lines AS (SELECT *, regexp_replace(raw_line, '\\r$', '') AS line FROM gtf_lines),
records AS (SELECT *, string_split(line, chr(9)) AS x FROM lines WHERE line IS NOT NULL AND NOT regexp_full_match(line, '[ \\t]*') AND NOT regexp_matches(line, '^[ \\t]*#')),
placed AS (SELECT *, CASE WHEN regexp_full_match(x[4], '[0-9]{{1,18}}') THEN CAST(x[4] AS BIGINT) END AS s, CASE WHEN regexp_full_match(x[5], '[0-9]{{1,18}}') THEN CAST(x[5] AS BIGINT) END AS e FROM records),
judged AS (SELECT *, CASE
  WHEN len(x) <> 9 THEN 'columns'
  WHEN NOT (trim(x[9]) IN ('', '.') OR regexp_full_match(x[9], '{_ATTRIBUTES}')) THEN 'quoting'
  WHEN x[1] = '' OR x[2] = '' OR x[3] = '' OR regexp_matches(x[1], '\\s') OR regexp_matches(x[2], '\\s') OR regexp_matches(x[3], '\\s')
    OR NOT coalesce(s >= 1 AND s <= e, false) OR NOT (x[6] = '.' OR regexp_full_match(x[6], '{_NUMBER}'))
    OR x[7] NOT IN ('+', '-', '.') OR x[8] NOT IN ('.', '0', '1', '2', '-1')
    OR NOT {_attribute_sql("gene_id")} OR (lower(x[3]) <> 'gene' AND NOT {_attribute_sql("transcript_id")}) THEN 'value'
  END AS reason FROM placed)
"""

_VALUES = """
WITH given AS (
  SELECT a.rid, t.attr_key, t.type_name, a.pos, t.is_list, trim(a.attr_value) AS v
  FROM gtf_attribute a JOIN attr_types t ON lower(trim(a.attr_key)) = lower(trim(t.attr_key))),
fit AS (SELECT *, CASE type_name
    WHEN 'string' THEN v
    WHEN 'long' THEN CASE WHEN regexp_full_match(v, '[+-]?[0-9]{1,18}') THEN CAST(CAST(v AS BIGINT) AS VARCHAR) END
    WHEN 'double' THEN CASE WHEN regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN CAST(CAST(v AS DOUBLE) + 0.0 AS VARCHAR) END
    ELSE CASE WHEN lower(v) IN ('true', 't', 'yes', '1') THEN 'true' WHEN lower(v) IN ('false', 'f', 'no', '0') THEN 'false' END END AS typed
  FROM given WHERE v NOT IN ('', '.', '?'))
"""


def _wide_sql() -> str:
    """One scalar column per declared key of the fixed table attr_types; keys and types are stated here as text."""
    strings = ("gene_id", "transcript_id", "exon_id", "ccds_id", "gene_name", "gene_biotype", "transcript_biotype", "note")
    kinds = {**dict.fromkeys(strings, "VARCHAR"), "level": "BIGINT", "nb_exons": "BIGINT", "exon_number": "BIGINT", "feature_size": "BIGINT", "gc_content": "DOUBLE", "mean_signal": "DOUBLE", "is_canonical": "BOOLEAN", "is_coding": "BOOLEAN"}
    one = [f"CAST(max_by(typed, struct_pack(p := pos, t := TRY_CAST(typed AS {kind}))) FILTER (WHERE attr_key = '{k}' AND typed IS NOT NULL) AS {kind}) AS {k}" for k, kind in kinds.items()]
    many = [f"coalesce(string_agg(DISTINCT typed, '|') FILTER (WHERE false), (SELECT string_agg(u.typed, '|' ORDER BY u.pos, u.typed) FROM (SELECT DISTINCT pos, typed FROM fit f WHERE f.rid = a.rid AND f.attr_key = '{k}' AND f.typed IS NOT NULL) u)) AS {k}" for k in ("tag", "ont", "db_xref")]
    return _VALUES + ", kept AS (SELECT DISTINCT rid FROM given WHERE rid IS NOT NULL) SELECT a.rid, " + ", ".join(one + many) + " FROM kept a LEFT JOIN fit USING (rid) GROUP BY a.rid"


def _id_sql(c: str) -> str:
    return f"regexp_replace(lower(trim({c})), '\\.[0-9]+$', '')"


def _refs_sql(name: str, row_id: str, field: str, registry: str, key: str) -> str:
    return f"""SELECT '{name}' AS table_name, '{field}' AS ref_field, {row_id} AS row_id, strftime(loaded_at, '%Y-%m') AS load_month,
  CASE WHEN NOT EXISTS (SELECT 1 FROM {registry} g WHERE {_id_sql("g." + key)} = r.id) THEN 'missing'
       WHEN EXISTS (SELECT 1 FROM {registry} g WHERE {_id_sql("g." + key)} = r.id AND g.added_at > r.loaded_at) THEN 'late' ELSE 'withdrawn' END AS kind
FROM (SELECT {row_id}, loaded_at, {_id_sql(field)} AS id FROM {name} WHERE trim({field}) NOT IN ('', '.', '?')) r
WHERE NOT EXISTS (SELECT 1 FROM {registry} g WHERE {_id_sql("g." + key)} = r.id AND g.added_at <= r.loaded_at AND (g.withdrawn_at IS NULL OR g.withdrawn_at > r.loaded_at))"""


_ORPHANS = " UNION ALL ".join(_refs_sql(*x) for x in (("features", "rid", "gene_id", "gene_ref", "gene_id"), ("features", "rid", "transcript_id", "transcript_ref", "transcript_id"), ("coding_pot", "cp_id", "transcript_id", "transcript_ref", "transcript_id")))

_PERIODS = """
WITH spans AS (SELECT DISTINCT lower(trim(seqid)) AS seqid, lower(trim(feature)) AS feature, start_pos AS s, end_pos AS e FROM features
  WHERE trim(seqid) NOT IN ('', '.', '?') AND feature IS NOT NULL AND start_pos >= 1 AND start_pos <= end_pos),
reach AS (SELECT *, max(e) OVER (PARTITION BY seqid, feature ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM spans),
islands AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seqid, feature ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach),
periods AS (SELECT seqid, feature, min(s) AS s, max(e) AS e FROM islands GROUP BY seqid, feature, island),
gaps AS (SELECT seqid, feature, lag(e) OVER (PARTITION BY seqid, feature ORDER BY s) + 1 AS s, s - 1 AS e FROM periods),
found AS (SELECT seqid, feature, 'period' AS kind, s AS start_pos, e AS end_pos FROM periods UNION ALL SELECT seqid, feature, 'gap', s, e FROM gaps WHERE s IS NOT NULL)
"""

_UNPACKED = r"""
WITH entries AS (SELECT row_id, unnest(list_zip(range(1, len(e) + 1), e)) AS z FROM (SELECT row_id, list_filter(
    regexp_extract_all(attributes, '(?:[\s=:]"(?:[^"\\]|\\.)*"|[\s=:]''(?:[^''\\]|\\.)*''|[^;,|])+'), lambda x: trim(x) <> '') AS e FROM gtf_rows WHERE attributes IS NOT NULL)),
parted AS (SELECT row_id, CAST(z[1] AS BIGINT) AS pos, lower(regexp_extract(z[2], '^\s*([A-Za-z0-9_]+)', 1)) AS attr_key,
    trim(regexp_extract(z[2], '^\s*[A-Za-z0-9_]+(?:\s*[=:]|\s)\s*(.*)$', 1, 's')) AS v FROM entries),
inner_text AS (SELECT row_id, pos, attr_key, v, regexp_full_match(v, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''', 's') AS quoted FROM parted),
texts AS (SELECT row_id, pos, attr_key, CASE WHEN quoted THEN v[2:len(v) - 1] ELSE v END AS t, quoted, attr_key IN (SELECT attr_key FROM attr_types WHERE is_list) AS many FROM inner_text),
lists AS (SELECT row_id, pos, attr_key, CASE WHEN many THEN regexp_split_to_array(t, '[,;|]') ELSE [CASE WHEN quoted THEN regexp_replace(t, '\\(.)', '\1', 'g') ELSE t END] END AS l FROM texts),
items AS (SELECT row_id, pos, attr_key, unnest(list_zip(range(1, len(l) + 1), l)) AS z FROM lists),
found AS (SELECT row_id, pos, CAST(z[1] AS BIGINT) AS item_no, attr_key, trim(z[2]) AS attr_value FROM items WHERE trim(z[2]) <> '' AND attr_key <> '')
"""

ORACLE = {
    "p1_found": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_loaded": _LINES + "SELECT line_id, x[1] AS seqid, x[2] AS source, x[3] AS feature, s AS start_pos, e AS end_pos, x[6] AS score, x[7] AS strand, x[8] AS phase, x[9] AS attributes FROM judged WHERE reason IS NULL",
    "p1_report": _LINES + "SELECT src_file, reason, count(*) AS n_lines FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_found": _VALUES + "SELECT rid, attr_key, CASE WHEN count(typed) = 0 THEN 'untypable' ELSE 'conflict' END AS issue FROM fit WHERE NOT is_list GROUP BY rid, attr_key HAVING count(typed) = 0 OR count(DISTINCT typed) > 1",
    "p3_wide": _wide_sql(),
    "p4_found": _ORPHANS,
    "p4_report": f"SELECT table_name, ref_field, load_month, kind, count(*) AS n_refs FROM ({_ORPHANS}) GROUP BY ALL",
    "p5_found": _PERIODS + "SELECT * FROM found",
    "p5_report": _PERIODS + "SELECT seqid, feature, kind, count(*) AS n, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS bases FROM found GROUP BY ALL",
    "p6_found": _UNPACKED + "SELECT * FROM found",
    "p6_report": _UNPACKED + "SELECT attr_key, count(*) AS n_values, count(DISTINCT attr_value) AS n_distinct, max(item_no) AS longest_list FROM found GROUP BY ALL",
}
