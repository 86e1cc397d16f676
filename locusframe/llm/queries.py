"""Queries p2_, p7_, p8_ and p9_ over the data folder, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.labels import identifier, label, refers, valid_span
from locusframe.llm.leakage import leaked_items
from locusframe.llm.packing import CAPACITY, packed, token_counts
from locusframe.llm.spans import shared_share, shared_spans
from locusframe.llm.topn import best_scores, top_n
from locusframe.session import cut, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three transcripts of every gene whose exons start furthest along the sequence."""
    rows = table(spark, folder, "features").where((label(F.col("feature")) == "exon") & valid_span(F.col("start_pos"), F.col("end_pos")) & refers(F.col("gene_id")) & refers(F.col("transcript_id")))
    ids = rows.select(identifier(F.col("gene_id")).alias("gene_id"), identifier(F.col("transcript_id")).alias("transcript_id"), "start_pos").where(refers(F.col("gene_id")) & refers(F.col("transcript_id")))
    scored = best_scores(ids, ["gene_id"], "transcript_id", "start_pos")
    return top_n(scored, ["gene_id"], [F.desc("start_pos")], ["transcript_id"], 3).select("gene_id", "transcript_id", F.col("rank_no").cast("bigint").alias("rank_no"))


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in a container of 2,048 tokens."""
    sizes = cut(token_counts(table(spark, folder, "documents"), "doc_id", "text"))
    return packed(sizes, CAPACITY).withColumnRenamed("item", "doc_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of room that is used."""
    filled = p7_packing(spark, folder).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return filled.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * CAPACITY)).alias("fill"))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of a packing: every item with tokens is placed, all its tokens, no container overfull, no item split without need."""
    sizes = cut(token_counts(table(spark, folder, "documents"), "doc_id", "text"))
    places = cut(packed(sizes, CAPACITY))
    found = places.groupBy("item").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.min("first_token").alias("first"))
    items = sizes.where("n_tokens > 0").join(found, "item", "left")
    needed = F.ceil(F.col("n_tokens") / CAPACITY)
    bad = {"n_incomplete": F.coalesce(F.col("placed"), F.lit(0)) != F.col("n_tokens"), "n_split": F.coalesce(F.col("pieces"), F.lit(0)) != needed}
    counts = items.agg(F.count(F.lit(1)).alias("n_items"), *(F.count(F.when(v, 1)).alias(k) for k, v in bad.items()))
    full = places.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(F.count(F.when(F.col("used") > CAPACITY, 1)).alias("n_overfull"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("n")) for c in ("n_items", *bad)))).alias("x")).select("x.*").unionByName(full.select(F.lit("n_overfull").alias("measure"), F.col("n_overfull").alias("n")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a passage of an evaluation item."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Number of documents that each leaked item is in."""
    return p8_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of each document that are shared word for word with another one."""
    return shared_spans(table(spark, folder, "documents"))


def p9_share(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    return shared_share(table(spark, folder, "documents"))


QUERIES = {q.__name__: q for q in (p2_found, p7_packing, p7_report, p7_check, p8_found, p8_report, p9_found, p9_share)}

_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '\\[A-Za-z]+', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(item_text, '\\[A-Za-z]+', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 14), lambda k: array_to_string(w[k:k + 15], ' '))) AS g FROM d WHERE len(w) >= 16),
iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 14), lambda k: array_to_string(w[k:k + 15], ' '))) AS g FROM i WHERE len(w) >= 16),
found AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g))
"""

#: Every window of 500 characters, so far too slow beyond the small scales.
_SPANS = """
WITH w AS (SELECT doc_id, s, hash(substr(text, s + 1, 500)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 499)) AS s FROM documents WHERE length(text) >= 500)),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, s FROM w SEMI JOIN r USING (h)),
marked AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 500 THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM marked),
found AS (SELECT doc_id, min(s) AS span_start, max(s) + 500 AS span_end FROM runs GROUP BY doc_id, run)
"""

ORACLE = {
    "p2_found": r"""
WITH x AS (SELECT regexp_replace(lower(trim(gene_id)), '\.[0-9]+$', '') AS gene_id, regexp_replace(lower(trim(transcript_id)), '\.[0-9]+$', '') AS transcript_id, max(start_pos) AS score
  FROM features WHERE lower(trim(feature)) = 'exon' AND start_pos >= 1 AND start_pos <= end_pos AND trim(gene_id) NOT IN ('', '.', '?') AND trim(transcript_id) NOT IN ('', '.', '?') GROUP BY 1, 2),
r AS (SELECT gene_id, transcript_id, row_number() OVER (PARTITION BY gene_id ORDER BY score DESC, transcript_id) AS rank_no FROM x)
SELECT * FROM r WHERE rank_no <= 3""",
    "p8_found": _LEAKS + "SELECT * FROM found",
    "p8_report": _LEAKS + "SELECT item_id, count(*) AS n_docs FROM found GROUP BY ALL",
    "p7_check": "SELECT 'n_items' AS measure, count(*) AS n FROM documents WHERE length(text) > 0 UNION ALL SELECT unnest(['n_incomplete', 'n_split', 'n_overfull']), 0",
    "p9_found": _SPANS + "SELECT * FROM found",
    "p9_share": _SPANS + "SELECT doc_id, coalesce(length(text), 0) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) ELSE 0 END AS share FROM documents LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS n FROM found GROUP BY doc_id) USING (doc_id)",
}
