"""Rows that fail to parse: load the sound annotation lines, set the others apart with the first reason that applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.labels import DECIMAL, trimmed
from locusframe.registry import operator

#: Explicit schema of the permissive read; the last column keeps the raw text of rows that don't fit it.
SCHEMA = "seqid STRING, source STRING, feature STRING, start_pos BIGINT, end_pos BIGINT, score STRING, strand STRING, phase STRING, attributes STRING, corrupt_text STRING"
FIELDS = ("seqid", "source", "feature", "start_pos", "end_pos", "score", "strand", "phase", "attributes")
#: Reasons in the order in which they are tried, and the values allowed in two fields.
REASONS = ("columns", "quoting", "value")
STRANDS = ("+", "-", ".")
PHASES = (".", "0", "1", "2", "-1")
#: Lines with more fields than this are known to be broken and spare the tokenizer (which has a limit on columns).
MOST_FIELDS = 1000

_KEY = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_VALUE = '"[^"]*+"|[^ \\t";\\x02]++'
_ENTRY = rf"\G[ \t]*+(?:{_KEY}[ \t]++(?:{_VALUE})[ \t]*+)?+(?:;|\z)"
_PAIR = rf"({_KEY})[ \t]++({_VALUE})"


def _escapes_hidden(text: Column) -> Column:
    """Attribute text in which an escaped quote is the character 2 and an escaped backslash two plain characters.

    Afterwards a quoted value ends at the next bare double quote, so no pattern needs a nested repetition
    (which would overflow the stack on very long texts). Characters 1 and 2 of the input become '!' first.
    """
    plain = F.translate(text, "\x01\x02", "!!")
    marked = F.regexp_replace(plain, r'\\([\\"])', "\x01$1")
    hidden = F.replace(F.replace(marked, F.lit("\x01\\"), F.lit("!!")), F.lit('\x01"'), F.lit("\x02"))
    return F.when(text.rlike("[\\\\\x01\x02]"), hidden).otherwise(text)


def attribute_list_sound(text: Column, hidden: Column) -> Column:
    """True if the text is blank, '.', or a list of `key value` entries each closed by ';' or the end.

    `hidden` is the text with its escapes hidden.
    """
    return trimmed(text).isin("", ".") | (F.regexp_replace(hidden, _ENTRY, "") == "")


def first_attribute(keys: Column, values: Column, key: str) -> Column:
    """Value of the first entry with this key, ignoring its case, in the entries of a sound list; null if there is none."""
    at = F.array_position(keys, F.lit(key.lower())).cast("int")
    value = F.get(values, at - 1)
    bare = F.when(value.startswith('"'), F.regexp_replace(value.substr(F.lit(2), F.length(value) - 2), r"\\(.)", "$1")).otherwise(value)
    return F.when(at > 0, trimmed(bare))


def _names_something(value: Column) -> Column:
    return F.coalesce(~value.isin("", ".", "?"), F.lit(False))


@operator("SRC-01", "SRC-02", group="sources")
def classify_lines(lines: DataFrame, raw: str = "raw_line") -> DataFrame:
    """Raw nine-field annotation lines -> the input with typed fields, `corrupt_text`, `is_record` and `reason`.

    The line is read permissively under SCHEMA (from_csv, PERMISSIVE, the raw text of rows that don't fit is kept);
    then every record is classified again from its raw text: field count, quoting of the attribute list, values.
    `reason` is null for sound rows and for lines that are no records (null, blank, comments), which have
    is_record = false. One trailing carriage return is dropped. All rows of the input come out, repeated ones too.
    Input columns are kept; those named like an output column are replaced.
    """
    kept = [c for c in lines.columns if c.lower() not in {*FIELDS, "corrupt_text", "is_record", "reason"} or c == raw]
    own = [f"__c{i}" for i in range(len(kept))]
    line = F.when(F.col(raw).endswith("\r"), F.col(raw).substr(F.lit(1), F.length(raw) - 1)).otherwise(F.col(raw))
    tabs = F.length("__line") - F.length(F.replace(F.col("__line"), F.lit("\t"), F.lit("")))
    plain = F.when((F.col("__tabs") < MOST_FIELDS) & ~F.col("__line").rlike("[\\x00\\x03\r\n]"), F.col("__line"))
    options = {"sep": "\t", "quote": "", "escape": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_text", "lineSep": "\x03"}
    # One step per expression that later ones use more than once, so that none is computed twice.
    read = lines.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(kept, own, strict=True)), line.alias("__line")).withColumn("__tabs", tabs)
    read = read.withColumns({"__read": F.from_csv(plain, SCHEMA, options), "__part": F.split("__line", "\t", -1)})
    blank = F.col("__line").isNull() | F.col("__line").rlike(r"\A[ \t]*\z")
    misfit = F.when(F.col("__read").isNull(), F.col("__line")).otherwise(F.col("__read.corrupt_text"))
    read = read.withColumns({"is_record": ~blank & ~F.col("__line").rlike(r"\A[ \t]*#"), "__misfit": misfit, "__hidden": _escapes_hidden(F.get("__part", 8))})
    read = read.withColumns({"__keys": F.transform(F.regexp_extract_all("__hidden", F.lit(_PAIR), F.lit(1)), F.lower), "__values": F.regexp_extract_all("__hidden", F.lit(_PAIR), F.lit(2))})

    field = {name: F.get("__part", i) for i, name in enumerate(FIELDS)}
    worded = [(field[n] == "") | field[n].rlike(r"(?U)\s") for n in ("seqid", "source", "feature")]
    start, end = (F.when(field[n].rlike(r"\A[0-9]{1,18}\z"), F.coalesce(F.col(f"__read.{n}"), field[n].try_cast("bigint"))) for n in ("start_pos", "end_pos"))
    placed = F.coalesce((start >= 1) & (start <= end), F.lit(False))
    scored = (field["score"] == ".") | field["score"].rlike(DECIMAL)
    gene, transcript = (_names_something(first_attribute(F.col("__keys"), F.col("__values"), k)) for k in ("gene_id", "transcript_id"))
    value_fails = worded[0] | worded[1] | worded[2] | ~placed | ~scored | ~field["strand"].isin(*STRANDS) | ~field["phase"].isin(*PHASES) | ~gene | (~transcript & (F.lower(field["feature"]) != "gene"))
    # What the reader took has nine fields; what it refused is told apart by count first.
    counted = F.col("__misfit").isNotNull() & (F.col("__tabs") != len(FIELDS) - 1)
    reason = F.when(~F.col("is_record"), F.lit(None)).when(counted, REASONS[0]).when(~attribute_list_sound(field["attributes"], F.col("__hidden")), REASONS[1]).when(value_fails, REASONS[2])

    typed = [F.coalesce(F.col(f"__read.{n}"), (start if n == "start_pos" else end if n == "end_pos" else field[n])).alias(n) for n in FIELDS]
    return read.select(*(F.col(o).alias(c) for c, o in zip(kept, own, strict=True)), *typed, F.when(F.col("is_record"), F.col("__misfit")).alias("corrupt_text"), "is_record", reason.alias("reason"))


def rejected(lines: DataFrame, raw: str = "raw_line") -> DataFrame:
    """The failing rows of classify_lines: input columns, the raw text and the reason."""
    return classify_lines(lines, raw).where(F.col("reason").isNotNull())


def loaded(lines: DataFrame, raw: str = "raw_line") -> DataFrame:
    """The sound rows of classify_lines with typed fields."""
    return classify_lines(lines, raw).where(F.col("is_record") & F.col("reason").isNull()).drop("corrupt_text", "is_record", "reason")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files -> raw_line and src_file, one row per line; gzip files are read as they are."""
    return spark.read.text(path).select(F.col("value").alias("raw_line"), F.input_file_name().alias("src_file"))
