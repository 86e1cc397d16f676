"""Several values packed in one field: quoted spans become indexed placeholders, the rest is split, spans are restored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.labels import label, trimmed
from locusframe.registry import operator

#: Stand-ins are MARK and a letter; placeholders are a number between two BOUNDs. Marks in the text become stand-ins
#: themselves before anything else, so neither can collide with the text.
MARK, BOUND = "\x01", "\x02"
STAND_INS = {MARK: "o", BOUND: "c", "\\": "b", '"': "d", "'": "s", ",": "p", ";": "m", "|": "v"}
#: A quoted span stands where a value stands: after a blank or separator, before a delimiter or the end.
SPAN = r"""(?<=[ \t=:])(?:"[^"]*+"|'[^']*+')(?=[ \t]*+(?:[;,|]|\z))"""
ENTRY = r"(?s)\A[ \t]*([\p{L}\p{Nd}_]+)(?:[ \t]*[=:]|[ \t])[ \t]*(.*)\z"


def _hide(text: Column, escaped: str) -> Column:
    """A backslash with one of these characters becomes that character's stand-in, from left to right."""
    out = F.regexp_replace(text, rf"\\([{escaped}])", BOUND + "$1")
    for c in escaped.replace("\\\\", "\\"):
        out = F.replace(out, F.lit(BOUND + c), F.lit(MARK + STAND_INS[c]))
    return out


def _show(text: Column, backslash: str) -> Column:
    """Stand-ins become characters again, escaped ones with this before them."""
    for c in ("\\", '"', "'", ",", ";", "|"):
        text = F.replace(text, F.lit(MARK + STAND_INS[c]), F.lit(backslash + c))
    return F.replace(F.replace(text, F.lit(MARK + STAND_INS[BOUND]), F.lit(BOUND)), F.lit(MARK + STAND_INS[MARK]), F.lit(MARK))


@operator("UNPACK", group="reshape")
def unpacked(rows: DataFrame, packed: str, lists: list[str], keep: list[str]) -> DataFrame:
    """One row per single value of a packed attribute field: (keep, pos, item_no, attr_key, attr_value).

    Outside quotes `;`, `,` and `|` end an entry; empty entries do not count and `pos` numbers the others from 1.
    An entry is a key, blanks and/or one `=` or `:`, and a value in double quotes, in single quotes or bare.
    In quotes a backslash makes the next character literal. Values of keys in `lists` are split again at the
    three delimiters and numbered in item_no. Values lose surrounding blanks; an empty one gives no row but keeps
    its number. Keys come out as labels. Null and blank fields give nothing; an entry without a key keeps its
    number and gives nothing. A quote that is never closed is an ordinary character. Repeated rows come out
    as often as they are there. Nothing is shuffled: every row is taken apart where it was read.
    """
    safe = F.replace(F.replace(F.col(f"`{packed}`"), F.lit(MARK), F.lit(MARK + STAND_INS[MARK])), F.lit(BOUND), F.lit(MARK + STAND_INS[BOUND]))
    base = rows.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keep)), _hide(safe, "\\\\\"'").alias("__text"))
    base = base.where(F.col("__text").isNotNull())
    kept = [f"__k{i}" for i in range(len(keep))]
    spans = base.select(*kept, F.regexp_extract_all("__text", F.lit(SPAN), F.lit(0)).alias("spans"), F.split("__text", SPAN, -1).alias("pieces"))
    masked = F.array_join(F.transform("pieces", lambda x, i: F.when(i < F.size("spans"), F.concat(x, F.lit(BOUND), i.cast("string"), F.lit(BOUND))).otherwise(x)), "")
    entries = F.filter(F.split(masked, "[;,|]", -1), lambda e: trimmed(e) != "")
    each = spans.select(*kept, "spans", F.posexplode(entries).alias("at", "entry"))
    parted = each.select(*kept, "spans", (F.col("at") + 1).cast("bigint").alias("pos"), label(F.regexp_extract("entry", ENTRY, 1)).alias("attr_key"), F.regexp_extract("entry", ENTRY, 2).alias("rest"))
    parted = parted.where(F.col("attr_key") != "")

    index = F.regexp_extract("rest", rf"\A{BOUND}([0-9]+){BOUND}[ \t]*\z", 1)
    span = F.when(index != "", F.get("spans", index.try_cast("int")))
    inner = span.substr(F.lit(2), F.length(span) - 2)
    many = F.col("attr_key").isin(*lists) if lists else F.lit(False)
    quoted = F.transform(F.when(many, F.split(_hide(inner, ",;|"), "[,;|]", -1)).otherwise(F.array(inner)), lambda x: _show(F.regexp_replace(x, r"(?s)\\(.)", "$1"), ""))
    bare = F.array(_show(F.col("rest"), "\\"))
    values = F.transform(F.when(span.isNotNull(), quoted).otherwise(bare), trimmed)
    items = parted.select(*kept, "pos", "attr_key", F.posexplode(values).alias("n", "attr_value")).where(F.col("attr_value") != "")
    return items.select(*(F.col(f"__k{i}").alias(k) for i, k in enumerate(keep)), "pos", (F.col("n") + 1).cast("bigint").alias("item_no"), "attr_key", "attr_value")
