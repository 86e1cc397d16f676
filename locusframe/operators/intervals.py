"""Interval algebra on 0-based half-open intervals (chrom, start, end, name, score, strand)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.model import attr, bed, value, with_attr
from locusframe.operators.blocks import block_of, carried, ranked_places, rank_upto, summed_before
from locusframe.operators.periods import periods_and_gaps
from locusframe.registry import operator
from locusframe.session import cut, drop_cut

#: Width of the bins in which intervals meet; about the length of the usual interval or a small multiple.
BIN = 1 << 14


@operator("IV-01", group="intervals")
def slop(a: DataFrame, sizes: DataFrame, left: int, right: int, stranded: bool = True) -> DataFrame:
    """Extend (negative: shrink) intervals and clip them to their chromosome; stranded: left is upstream.

    sizes (chrom, size): chromosomes not in it drop out, and so does what has no length left.
    """
    turned = (F.col("strand") == "-") & F.lit(stranded)
    l, r = F.when(turned, right).otherwise(left), F.when(turned, left).otherwise(right)
    moved = a.join(sizes.select("chrom", "size"), "chrom").withColumns({"start": F.greatest(F.col("start") - l, F.lit(0)), "end": F.least(F.col("end") + r, F.col("size"))})
    return moved.where(F.col("start") < F.col("end")).drop("size")


@operator("IV-02", group="intervals")
def flank(a: DataFrame, sizes: DataFrame, left: int, right: int, stranded: bool = True) -> DataFrame:
    """The regions adjacent to intervals, clipped to the chromosome; `side` tells which. Empty ones drop out."""
    turned = (F.col("strand") == "-") & F.lit(stranded)
    l, r = F.when(turned, right).otherwise(left), F.when(turned, left).otherwise(right)
    sides = F.array(
        F.struct(F.when(turned, "down").otherwise("up").alias("side"), F.greatest(F.col("start") - l, F.lit(0)).alias("s"), F.col("start").alias("e")),
        F.struct(F.when(turned, "up").otherwise("down").alias("side"), F.col("end").alias("s"), F.least(F.col("end") + r, F.col("size")).alias("e")),
    )
    out = a.join(sizes.select("chrom", "size"), "chrom").withColumn("__x", F.explode(sides)).where("__x.s < __x.e")
    return out.withColumns({"start": F.col("__x.s"), "end": F.col("__x.e"), "side": F.col("__x.side")}).drop("__x", "size")


def _binned(rows: DataFrame, width: int) -> DataFrame:
    first, last = F.floor(F.col("start") / width).cast("bigint"), F.floor((F.greatest("end", F.col("start") + 1) - 1) / width).cast("bigint")
    return rows.withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(first, last)))


@operator("IV-03", group="intervals")
def overlap_join(a: DataFrame, b: DataFrame, strand: str = "any", width: int = BIN, suffix: str = "_b", pad: int = 0) -> DataFrame:
    """All overlapping pairs: the columns of a, those of b with a suffix, and the overlap (ov_start, ov_end).

    Both sides are repeated for every bin they touch and joined on (chrom, bin), an equality that Spark can shuffle and
    split; a pair is kept only in the first bin the two have in common. strand: any, same or opposite.
    pad widens a for the search only. Empty intervals overlap nothing. Without a strand nothing is on the same or the opposite one.
    """
    left = _binned(a.where(F.col("start") < F.col("end")).withColumns({"__s": F.col("start"), "__e": F.col("end"), "start": F.col("start") - pad, "end": F.col("end") + pad}), width)
    right = _binned(b.where(F.col("start") < F.col("end")), width)
    right = right.select(F.col("chrom"), F.col("__bin"), F.col("__first").alias("__first_b"), *(F.col(f"`{c}`").alias(c + suffix) for c in b.columns if c != "chrom"))
    met = left.join(right, ["chrom", "__bin"]).where((F.col("__bin") == F.greatest("__first", "__first_b")) & (F.col("start") < F.col("end" + suffix)) & (F.col("start" + suffix) < F.col("end")))
    if strand != "any":
        same = F.col("strand") == F.col("strand" + suffix)
        met = met.where(F.col("strand").isin("+", "-") & F.col("strand" + suffix).isin("+", "-") & (same if strand == "same" else ~same))
    return met.withColumns({"start": F.col("__s"), "end": F.col("__e"), "ov_start": F.greatest("__s", "start" + suffix), "ov_end": F.least("__e", "end" + suffix)}).drop("__s", "__e", "__bin", "__first", "__first_b")


@operator("IV-05", group="intervals")
def merge(a: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Union of overlapping or book-ended intervals, within each value of the keys: keys, chrom, start, end."""
    closed = a.where(F.col("start") < F.col("end")).select(*keys, "chrom", (F.col("start") + 1).alias("s"), F.col("end").alias("e"))
    runs = periods_and_gaps(closed, [*keys, "chrom"], "s", "e").where("kind = 'period'")
    return runs.select(*keys, "chrom", (F.col("s") - 1).alias("start"), F.col("e").alias("end"))


@operator("IV-04", group="intervals")
def subtract(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """What of each interval of a no interval of b covers; an interval may fall apart. Columns of a are kept.

    a must have a unique `rid`. Only the stretches of merged b that an interval meets are looked at. Joins are merged: either
    side grows with the input, and Spark takes it for smaller than it is.
    """
    holes = overlap_join(a.select("rid", "chrom", "start", "end"), merge(b).hint("merge"), width=width)
    cut = holes.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("ov_start", "ov_end"))).alias("holes"))
    joined = a.join(cut.hint("merge"), "rid", "left")
    none = F.array().cast("array<struct<ov_start:bigint,ov_end:bigint>>")
    h = F.coalesce("holes", none)
    begins = F.concat(F.array(F.col("start")), F.transform(h, lambda x: x["ov_end"]))
    ends = F.concat(F.transform(h, lambda x: x["ov_start"]), F.array(F.col("end")))
    pieces = joined.withColumn("__x", F.explode(F.arrays_zip(begins.alias("s"), ends.alias("e")))).where("__x.s < __x.e")
    return pieces.withColumns({"start": F.col("__x.s"), "end": F.col("__x.e")}).drop("__x", "holes")


def _sides(rows: DataFrame, lane: Column, of_b: bool, *keep: str) -> DataFrame:
    """Every interval once per side, (chrom, lane, at, keep): on either side what lies beyond has lower places.

    Left: an interval of b lies at its end, one of a looks back from its start. Right: coordinates are turned round.
    """
    left, right = (F.col("end"), -F.col("start")) if of_b else (F.col("start"), -F.col("end"))
    sides = F.array(*(F.struct(F.concat(lane, F.lit(s)).alias("lane"), v.alias("at")) for s, v in (("<", left), (">", right))))
    return rows.select("chrom", *(f"`{k}`" for k in keep), F.explode(sides).alias("x")).select("chrom", "x.lane", "x.at", *(f"`{k}`" for k in keep))


def _beside(a: DataFrame, b: DataFrame, k: int, other_name: bool) -> DataFrame:
    """(rid, chrom, lane, place) for the k nearest places of b at or below `at` of a (rid, chrom, lane, at, name).

    b: chrom, lane, at, name. Places are numbered, so the next ones are found by equality joins. With other_name a place
    that only has intervals of a's own name is passed over, however many of these there are: they are numbered as well, and
    the j-th other place has the rank j plus the number of own ones before it.
    """
    line = ["chrom", "lane"]
    places = b.groupBy(*line, F.col("at").alias("place")).agg(F.min("name").alias("low"), F.max("name").alias("high"))
    ranked = cut(ranked_places(places.select(*line, "place", F.when(F.col("low") == F.col("high"), F.col("low")).alias("name")), line))
    found = a.join(rank_upto(a, ranked, line), [*line, "at"])
    down = F.when(F.col("upto") > 0, F.sequence(F.greatest(F.col("upto") - (k - 1), F.lit(1)), F.col("upto")))
    if not other_name:
        return found.withColumn("rank", F.explode(down)).join(ranked.drop("name"), [*line, "rank"]).select("rid", *line, "place")
    named = [*line, "name"]
    own = cut(ranked_places(ranked.where("name IS NOT NULL").select(*named, F.col("rank").alias("place")), named))
    probes = found.select("rid", *named, F.col("upto").alias("at"))
    others = probes.join(rank_upto(probes, own, named), [*named, "at"]).withColumn("upto", F.col("at") - F.col("upto")).drop("at")
    each = others.withColumn("j", F.explode(down)).withColumn("at", F.col("j") - 1)
    passed = rank_upto(each, own.withColumn("place", F.col("place") - F.col("rank")), named)
    return each.drop("upto").join(passed, [*named, "at"]).withColumn("rank", F.col("j") + F.col("upto")).select("rid", *line, "rank").join(ranked.drop("name"), [*line, "rank"]).select("rid", *line, "place")


@operator("IV-06", "ORD-03", group="intervals")
def closest(a: DataFrame, b: DataFrame, k: int = 1, strand: str = "any", other_name: bool = True, width: int = BIN) -> DataFrame:
    """The k nearest intervals of b of each interval of a, ties included: columns of a, of b with `_b`, and distance.

    Distance is 0 on overlap, else the gap plus 1. other_name leaves out those of the same name and those without one; names may
    repeat on either side. strand: any, same or opposite; without a strand nothing is on the same or the opposite one.
    Candidates are the overlapping ones and those at the k nearest places on either side, found by rank: no pair further apart is
    ever made. Repeated rows of b are neighbours of their own. a needs a unique rid.
    """
    if strand != "any":
        a, b = (x.where(F.col("strand").isin("+", "-")) for x in (a, b))
    if other_name:
        a, b = (x.where(F.col("name").isNotNull()) for x in (a, b))
    own = F.lit("") if strand == "any" else F.col("strand")
    met = F.lit("") if strand == "any" else F.col("strand") if strand == "same" else F.translate("strand", "+-", "-+")
    name = ["name"] if other_name else []
    looking, lying = ((x if other_name else x.withColumn("name", F.lit(None).cast("string"))) for x in (a, b))
    places = _beside(_sides(looking, own, False, "rid", "name"), _sides(lying, met, True, "name"), k, other_name)
    rest = [F.col(f"`{c}`").alias(c + "_b") for c in b.columns if c != "chrom"]
    whole = b.withColumn("__b", F.struct(*rest))
    there = _sides(whole, met, True, "__b").withColumnRenamed("at", "place")
    beside = places.join(there, ["chrom", "lane", "place"]).select("rid", "lane", "place", "__b.*").withColumn("__left", F.col("lane").endswith("<")).drop("lane")
    beside = a.join(beside, "rid").withColumn("distance", F.when(F.col("__left"), F.col("start") - F.col("place")).otherwise(-F.col("end") - F.col("place")) + 1).drop("place", "__left")
    found = overlap_join(a, b, strand, width).drop("ov_start", "ov_end").withColumn("distance", F.lit(0).cast("bigint")).unionByName(beside)
    found = found.where(F.col("name") != F.col("name_b")) if name else found
    order = Window.partitionBy("rid").orderBy("distance")
    return found.withColumn("__r", F.rank().over(order)).where(F.col("__r") <= k).drop("__r")


@operator("IV-07", group="intervals")
def next_beside(a: DataFrame, b: DataFrame, downstream: bool = False, k: int = 1) -> DataFrame:
    """The k next places of b that do not overlap, upstream or downstream along a's strand: columns of a, of b with `_b`, distance.

    Of intervals at one place the first by (start, end, name) stands for all. The distance is the gap plus 1, -1 and nulls in b's
    columns where there is none. Without a strand an interval is read like one on +. a needs a unique rid.
    """
    turned = (F.col("strand") == "-") != F.lit(downstream)
    side = F.when(turned, ">").otherwise("<")
    looking = _sides(a.withColumns({"__side": side, "name": F.lit(None).cast("string")}), F.lit(""), False, "rid", "name", "__side").where(F.col("lane") == F.col("__side")).drop("__side")
    rest = F.struct(*(F.col(f"`{c}`").alias(c + "_b") for c in ["start", "end", "name", *(x for x in b.columns if x not in ("chrom", "start", "end", "name"))]))
    first = _sides(b.withColumn("__b", rest), F.lit(""), True, "__b").groupBy("chrom", "lane", F.col("at").alias("place")).agg(F.min("__b").alias("__b"))
    places = _beside(looking, _sides(b, F.lit(""), True, "name"), k, False)
    met = places.join(first, ["chrom", "lane", "place"]).select("rid", "lane", "place", "__b.*")
    gap = F.when(F.col("lane") == "<", F.col("start") - F.col("place")).otherwise(-F.col("end") - F.col("place")) + 1
    return a.join(met, "rid", "left").withColumn("distance", F.coalesce(gap, F.lit(-1))).drop("lane", "place")


@operator("IV-10", group="intervals")
def sweep(sets: list[DataFrame], shuffle_keys: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """Segments where at least so many intervals of all sets together are open: chrom, start, end, flags (open per set), before.

    `before` has what was open just before the segment, so adjacent segments can be told without ordering them.

    Every interval is an opening and a closing event; counts per place are summed first, then run along the chromosome
    with the block sums carried over, so that no task sees more than one block of places.
    """
    n, keys = len(sets), [*shuffle_keys, "chrom"]
    events = None
    for i, s in enumerate(sets):
        marks = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))
        e = s.where(F.col("start") < F.col("end")).select(*keys, F.explode(marks).alias("x")).select(*keys, "x.pos", F.lit(i).alias("set"), "x.d")
        events = e if events is None else events.unionByName(e)
    places = events.groupBy(*keys, "pos").agg(*(F.sum(F.when(F.col("set") == i, F.col("d")).otherwise(0)).alias(f"d{i}") for i in range(n))).withColumn("block", block_of(F.col("pos")))
    sums = places.groupBy(*keys, "block").agg(*(F.sum(f"d{i}").alias(f"b{i}") for i in range(n)), F.min("pos").alias("first_pos"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nearby = Window.partitionBy(*keys).orderBy("block")
    carried = sums.select(*keys, "block", *(F.coalesce(F.sum(f"b{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in range(n)), F.lead("first_pos").over(nearby).alias("next_pos"))
    inside = Window.partitionBy(*keys, "block").orderBy("pos")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = [F.col(f"c{i}") + F.col(f"o{i}") for i in range(n)]
    open_now, before = F.array(*(x.cast("int") for x in opened)), F.array(*((x - F.col(f"d{i}")).cast("int") for i, x in enumerate(opened)))
    # Run first and joined after: rows are in the order of their blocks then, and merging costs nothing.
    run = places.select("*", *(F.sum(f"d{i}").over(running).alias(f"o{i}") for i in range(n)), F.lead("pos").over(inside).alias("__next"))
    segments = run.join(carried.hint("merge"), [*keys, "block"]).select(*keys, F.col("pos").alias("start"), F.coalesce("__next", "next_pos").alias("end"), open_now.alias("flags"), before.alias("before"))
    return segments.where(F.col("end").isNotNull() & (F.aggregate("flags", F.lit(0), lambda x, y: x + y) >= least))


@operator("IV-11", group="intervals")
def introns(rows: DataFrame, by_transcript: bool = True) -> DataFrame:
    """Introns as intervals. By transcript: with gene_id, transcript_id, strand and number from 5' to 3'; unstranded ones are skipped.

    Otherwise what no exon covers of the transcripts, merged: chrom, start, end.
    """
    if not by_transcript:
        tx = bed(rows.where(F.col("feature") == "transcript"), ["transcript_id"])
        exons = bed(rows.where(F.col("feature") == "exon"), ["transcript_id"])
        return merge(subtract(tx, exons))
    exons = rows.where((F.col("feature") == "exon") & F.col("strand").isin("+", "-")).select(F.col("seqid").alias("chrom"), "start", "end", "strand", attr("gene_id").alias("gene_id"), attr("transcript_id").alias("transcript_id")).where("transcript_id IS NOT NULL")
    keys = ["chrom", "strand", "gene_id", "transcript_id"]
    starts = F.array_sort(F.collect_list("start"))
    ends = F.array_sort(F.collect_list("end"))
    lists = exons.groupBy(*keys).agg(starts.alias("s"), ends.alias("e"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = F.transform(F.sequence(F.lit(1), F.col("n").cast("int") - 1), lambda i: F.struct(i.alias("i"), F.get("e", i - 1).alias("start"), (F.get("s", i) - 1).alias("end")))
    each = lists.select(*keys, "n", F.explode(pairs).alias("x"))
    number = F.when(F.col("strand") == "+", F.col("x.i")).otherwise(F.col("n") - F.col("x.i"))
    return each.select(*keys, F.col("x.start").alias("start"), F.col("x.end").alias("end"), number.cast("int").alias("number"))


def uncovered(a: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, start, end): what no interval covers of the chromosomes, whole chromosomes without any too."""
    # Two marks of one base, before the first and behind the last one, make the stretches at both ends gaps like others.
    inside = a.where(F.col("start") < F.col("end")).join(sizes.select("chrom", "size"), "chrom").select("chrom", (F.col("start") + 2).alias("s"), (F.least("end", "size") + 1).alias("e"))
    marks = sizes.select("chrom", F.explode(F.array(F.lit(1).cast("bigint"), F.col("size") + 2)).alias("s")).withColumn("e", F.col("s"))
    gaps = periods_and_gaps(inside.unionByName(marks), ["chrom"], "s", "e").where("kind = 'gap'")
    return gaps.select("chrom", (F.col("s") - 2).alias("start"), (F.col("e") - 1).alias("end"))


@operator("SRC-07", group="sources")
def chromosomes(sizes: DataFrame) -> DataFrame:
    """One interval (chrom, start, end, name, score, strand) per chromosome, from its size."""
    return sizes.select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"), F.col("chrom").alias("name"), F.lit("0").alias("score"), F.lit(".").alias("strand"))


@operator("IV-12", group="intervals")
def intergenic(rows: DataFrame, sizes: DataFrame, upstream: int = 0, downstream: int = 0) -> DataFrame:
    """What no (extended) transcript covers of the chromosomes: chrom, start, end."""
    return uncovered(slop(bed(rows.where(F.col("feature") == "transcript"), ["transcript_id"]), sizes, upstream, downstream), sizes)


@operator("IV-13", group="intervals")
def ends(rows: DataFrame, feature: str = "transcript", three_prime: bool = False, name: tuple[str, ...] = ("transcript_id",), sep: str = "|", transpose: int = 0, explicit: bool = False, missing: str = "?") -> DataFrame:
    """One-base intervals at the 5' (or 3') end of a feature's rows, moved along the strand; unstranded rows are an error."""
    plus = F.col("end") if three_prime else F.col("start")
    minus = F.col("start") if three_prime else F.col("end")
    place = F.when(F.col("strand") == "+", plus + transpose).when(F.col("strand") == "-", minus - transpose).otherwise(F.raise_error(F.lit("a feature without strand has no 5' end")).cast("bigint"))
    shown = [F.concat(F.lit(f"{n}=" if explicit else ""), F.coalesce(value(n), F.lit(missing))) for n in name]
    return rows.where(F.col("feature") == feature).select("rid", F.col("seqid").alias("chrom"), (place - 1).alias("start"), place.alias("end"), F.concat_ws(sep, *shown).alias("name"), "score", "strand")


@operator("IV-14", group="intervals")
def midpoints(a: DataFrame) -> DataFrame:
    """The middle base of intervals of odd length, the middle two of even ones."""
    size = F.col("end") - F.col("start")
    half, odd = F.floor(size / 2).cast("bigint"), size % 2 == 1
    return a.withColumns({"start": F.col("start") + half - F.when(odd, 0).otherwise(1), "end": F.col("start") + half + 1})


@operator("IV-15", group="intervals")
def shift(rows: DataFrame, sizes: DataFrame, by: int, stranded: bool = False, allow_outside: bool = False) -> DataFrame:
    """Move annotation rows. Rows that would leave the chromosome stop at its end, keeping their size.

    allow_outside: they are cut off instead, and vanish if nothing is left inside.
    """
    way = F.when(F.lit(stranded) & (F.col("strand") == "-"), -by).otherwise(by)
    moved = rows.join(sizes.select(F.col("chrom").alias("seqid"), "size"), "seqid").withColumns({"__s": F.col("start") + way, "__e": F.col("end") + way})
    if allow_outside:
        out = moved.withColumns({"start": F.greatest("__s", F.lit(1)), "end": F.least("__e", "size")}).where(F.col("start") <= F.col("end"))
    else:
        length = F.col("__e") - F.col("__s")
        first = F.greatest(F.least(F.col("__s"), F.col("size") - length), F.lit(1))
        out = moved.withColumns({"start": first, "end": first + length})
    return out.drop("__s", "__e", "size")


@operator("IV-16", group="intervals")
def splicing_sites(rows: DataFrame, number_key: str = "exon_nbr") -> DataFrame:
    """Two-base intervals next to exons: acceptor before every exon but the first, donor after every one but the last.

    Exons without strand count as members of their transcript, but have no sites.
    """
    exons = rows.where(F.col("feature") == "exon").withColumns({"__tx": attr("transcript_id"), "__n": value(number_key).try_cast("int")}).where("__tx IS NOT NULL AND __n IS NOT NULL")
    counted = exons.withColumn("__last", F.count(F.lit(1)).over(Window.partitionBy("__tx")))
    plus = F.col("strand") == "+"
    before = F.struct((F.col("start") - 3).alias("s"), (F.col("start") - 1).alias("e"))
    after = F.struct(F.col("end").alias("s"), (F.col("end") + 2).alias("e"))
    acceptor = F.when(F.col("__n") > 1, F.struct(F.lit("acceptor").alias("site"), F.when(plus, before).otherwise(after).alias("at")))
    donor = F.when(F.col("__n") < F.col("__last"), F.struct(F.lit("donor").alias("site"), F.when(plus, after).otherwise(before).alias("at")))
    each = counted.where(F.col("strand").isin("+", "-")).withColumn("__x", F.explode(F.array(acceptor, donor))).where("__x IS NOT NULL")
    return each.select("rid", F.col("seqid").alias("chrom"), F.col("__x.at.s").alias("start"), F.col("__x.at.e").alias("end"), F.col("__tx").alias("transcript_id"), F.col("__n").alias("exon_number"), F.col("__x.site").alias("site"), "strand")


def _named_ends(rows: DataFrame, three_prime: bool) -> DataFrame:
    tx = rows.where(F.col("feature") == "transcript").withColumns({"gene_id": attr("gene_id"), "tx": attr("transcript_id")}).where("gene_id IS NOT NULL AND tx IS NOT NULL")
    place = F.when((F.col("strand") == "-") != F.lit(three_prime), F.col("end")).otherwise(F.col("start"))
    return tx.select("rid", F.col("seqid").alias("chrom"), (place - 1).alias("start"), place.alias("end"), F.col("tx").alias("name"), "gene_id", "strand")


@operator("IV-17", "IV-18", group="intervals")
def paired_ends(rows: DataFrame, sizes: DataFrame, upstream: int = 1500, downstream: int = 1500, convergent: bool = False, stranded: bool = True) -> DataFrame:
    """(name, other, dist): per transcript the nearest end of another gene's transcript around its own.

    divergent: start sites around the promoter; convergent: end sites around the terminator, always on the other
    strand. Ties go to the least name.
    """
    sites = _named_ends(rows, convergent)
    around = slop(sites.withColumn("site", F.col("start")), sizes, upstream, downstream)
    met = overlap_join(around, sites, strand="opposite" if convergent or stranded else "any").where("gene_id <> gene_id_b")
    dist = F.abs(F.col("site") - F.col("start_b"))
    return met.select("name", F.col("name_b").alias("other"), dist.alias("dist")).groupBy("name").agg(F.min(F.struct("dist", "other")).alias("x")).select("name", "x.other", "x.dist")


@operator("IV-19", group="intervals")
def overlapping_transcripts(rows: DataFrame, sizes: DataFrame, region: str = "transcript", upstream: int = 0, downstream: int = 0, strand: str = "any") -> DataFrame:
    """(transcript_id, others): transcripts of other genes that a transcript, its promoter or its end (extended) overlaps."""
    tx = rows.where(F.col("feature") == "transcript").withColumns({"gene_id": attr("gene_id"), "name": attr("transcript_id")}).where("gene_id IS NOT NULL AND name IS NOT NULL")
    whole = tx.select("rid", F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("start"), "end", "name", "gene_id", "strand")
    asked = whole if region == "transcript" else _named_ends(rows, region == "tts")
    met = overlap_join(slop(asked, sizes, upstream, downstream), whole, strand=strand).where("gene_id <> gene_id_b")
    return met.groupBy(F.col("name").alias("transcript_id")).agg(F.array_sort(F.collect_set("name_b")).alias("others"))


def select_overlapping(rows: DataFrame, overlaps: DataFrame, invert: bool = False) -> DataFrame:
    """All rows of the transcripts that overlap others; invert: of all other transcripts."""
    keyed = rows.withColumn("__tx", attr("transcript_id")).where("__tx IS NOT NULL")
    return keyed.join(overlaps.select(F.col("transcript_id").alias("__tx")), "__tx", "left_anti" if invert else "left_semi").drop("__tx")


def annotate_overlapping(rows: DataFrame, overlaps: DataFrame, key: str = "overlapping", as_flag: bool = False, every_feature: bool = False, sep: str = ",") -> DataFrame:
    """Transcript rows (or all rows of a transcript) with an attribute: the transcripts that overlap, or 1 and 0."""
    shown = F.col("feature").isin("transcript") | F.lit(every_feature)
    keyed = rows.withColumn("__tx", F.when(shown, attr("transcript_id"))).join(overlaps.select(F.col("transcript_id").alias("__tx"), F.array_join("others", sep).alias("__o")), "__tx", "left")
    value_of = F.when(F.col("__o").isNotNull(), "1").when(F.col("__tx").isNotNull(), "0") if as_flag else F.col("__o")
    return keyed.withColumn("attrs", with_attr(key, value_of)).drop("__tx", "__o")


@operator("IV-20", group="intervals")
def closest_genes(rows: DataFrame, k: int = 1, origin: str = "tss", target: str = "tss", strand: str = "any") -> DataFrame:
    """(gene, neighbour, distance): the k nearest genes of every gene between tss, tts or gene regions, ties included."""

    def region(kind: str) -> DataFrame:
        genes = rows.where(F.col("feature") == "gene").withColumn("name", attr("gene_id")).where("name IS NOT NULL")
        site = F.when((F.col("strand") == "-") != F.lit(kind == "tts"), F.col("end")).otherwise(F.col("start"))
        s, e = (F.col("start") - 1, F.col("end")) if kind == "gene" else (site - 1, site)
        return genes.select("rid", F.col("seqid").alias("chrom"), s.alias("start"), e.alias("end"), "name", "strand")

    found = closest(region(origin), region(target), k, strand)
    return found.select(F.col("name").alias("gene"), F.col("name_b").alias("neighbour"), "distance")


def collapsed_neighbours(neighbours: DataFrame, sep: str = ",") -> DataFrame:
    """(gene, neighbours, distances): the neighbours of each gene in one row, nearest first, ties by name."""
    near = F.array_sort(F.collect_set(F.struct("distance", "neighbour")))
    lists = neighbours.groupBy("gene").agg(near.alias("n"))
    return lists.select("gene", F.array_join(F.transform("n", lambda x: x["neighbour"]), sep).alias("neighbours"), F.array_join(F.transform("n", lambda x: x["distance"].cast("string")), sep).alias("distances"))


def with_neighbours(rows: DataFrame, neighbours: DataFrame, key: str = "closest_gene", sep: str = ",") -> DataFrame:
    """Gene rows with an attribute that lists their neighbours; other rows as they are."""
    named = collapsed_neighbours(neighbours, sep).select(F.col("gene").alias("__g"), "neighbours")
    keyed = rows.withColumn("__g", F.when(F.col("feature") == "gene", attr("gene_id")))
    return keyed.join(named, "__g", "left").withColumn("attrs", with_attr(key, F.col("neighbours"))).drop("__g", "neighbours")


@operator("IV-21", group="intervals")
def regulatory_domains(rows: DataFrame, sizes: DataFrame, upstream: int = 5000, downstream: int = 1000, distal: int = 1_000_000, genes: DataFrame | None = None) -> DataFrame:
    """(chrom, start, end, name, strand): each gene's basal domain, extended to the neighbours' basal domains, at most by distal.

    Neighbours are the nearest basal domains that end before (start after) it without overlap, found by rank. genes: a
    table gene_id (of one term, say); only domains of these genes come out, but all genes are neighbours.
    """
    named = rows.where(F.col("feature") == "gene").withColumn("name", attr("gene_id")).where("name IS NOT NULL")
    site = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))
    basal = slop(named.select("rid", F.col("seqid").alias("chrom"), (site - 1).alias("start"), site.alias("end"), "name", "strand"), sizes, upstream, downstream)
    line = ["chrom"]

    def place_before(places: Column, at: Column, name: str) -> DataFrame:
        ranked = ranked_places(basal.select("chrom", places.alias("place")).distinct(), line)
        return rank_upto(basal.select("chrom", at.alias("at")), ranked, line).join(ranked.select("chrom", F.col("rank").alias("upto"), F.col("place").alias(name)), ["chrom", "upto"]).drop("upto")

    left = place_before(F.col("end"), F.col("start"), "left_end").withColumnRenamed("at", "start")
    right = place_before(-F.col("start"), -F.col("end"), "turned").select("chrom", (-F.col("at")).alias("end"), (-F.col("turned")).alias("right_start"))
    both = basal.join(left, ["chrom", "start"], "left").join(right, ["chrom", "end"], "left").join(sizes.select("chrom", "size"), "chrom")
    start = F.greatest(F.coalesce(F.greatest("left_end", F.col("start") - distal), F.col("start") - distal), F.lit(0))
    end = F.least(F.coalesce(F.least("right_start", F.col("end") + distal), F.col("end") + distal), F.col("size"))
    out = both.select("chrom", start.alias("start"), end.alias("end"), "name", "strand").distinct()
    return out if genes is None else out.join(genes.select(F.col("gene_id").alias("name")).distinct(), "name", "left_semi").select(*out.columns)


@operator("IV-22", group="intervals")
def exclude_concatenate(a: DataFrame, excluded: DataFrame) -> DataFrame:
    """Cut excluded stretches out of the chromosomes and close up: intervals are clipped, moved left, and dropped if inside.

    Places are moved by the length of merged exclusions before them, found by rank. Chromosomes without exclusion stay as
    they are. All columns of a are kept. The merged exclusions are written once, being read twice for either end.
    """
    holes = cut(merge(excluded))
    length = F.col("end") - F.col("start")
    known = cut(ranked_places(summed_before(holes, ["chrom"], "start", "before", length).withColumnRenamed("start", "place"), ["chrom"]))
    drop_cut(holes)

    def moved(rows: DataFrame, column: str) -> DataFrame:
        at = rank_upto(rows.select("chrom", F.col(column).alias("at")), known, ["chrom"])
        at = at.join(known.select("chrom", F.col("rank").alias("upto"), F.col("place").alias("h_start"), F.col("end").alias("h_end"), "before"), ["chrom", "upto"], "left")
        removed = F.coalesce(F.col("before") + F.least("at", "h_end") - F.col("h_start"), F.lit(0))
        return rows.join(at.select("chrom", F.col("at").alias(column), (F.col("at") - removed).alias("__" + column)), ["chrom", column])

    out = moved(moved(a, "start"), "end").withColumns({"start": F.col("__start"), "end": F.col("__end")}).drop("__start", "__end")
    return out.where(F.col("start") < F.col("end"))


@operator("IV-23", group="intervals")
def exclude_sizes(sizes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Chromosome sizes less the length of merged exclusions."""
    lost = merge(excluded).groupBy("chrom").agg(F.sum(F.col("end") - F.col("start")).alias("lost"))
    return sizes.join(lost, "chrom", "left").select("chrom", (F.col("size") - F.coalesce("lost", F.lit(0))).cast("bigint").alias("size"))


@operator("IV-24", group="intervals")
def lengths_and_gaps(a: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, chrom, number, length, gap): merged intervals in order with the gap before each; the last row has the gap to the
    chromosome's end and no length. Gaps below zero count 0. Chromosomes without size have no last row.

    Starts are distinct, as those of merged intervals are, so a task orders at most one block of them. The intervals are
    written once, being read twice.
    """
    by = [*keys, "chrom"]
    tail = a.select(*by).distinct().join(sizes.select("chrom", "size"), "chrom").select(*by, F.col("size").alias("start"), F.lit(None).cast("bigint").alias("end"))
    every = a.select(*by, "start", "end").unionByName(tail)
    # The end of a chromosome comes last, whatever starts there or beyond.
    every = cut(every.withColumn("__block", F.when(F.col("end").isNotNull(), block_of(F.col("start"))).otherwise(F.lit(1 << 50))))
    blocks = every.groupBy(*by, "__block").agg(F.count(F.lit(1)).alias("n"), F.max_by("end", "start").alias("e"))
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, "__block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__rows"), F.last("e", ignorenulls=True).over(earlier).alias("__reach"))
    inside = Window.partitionBy(*by, "__block").orderBy("start", "end")
    near = every.withColumns({"__row": F.row_number().over(inside), "__lag": F.lag("end").over(inside)}).join(blocks.hint("merge"), [*by, "__block"])
    gap = F.greatest(F.col("start") - F.coalesce("__lag", "__reach", F.lit(0)), F.lit(0))
    return near.select(*by, (F.col("__rows") + F.col("__row")).alias("number"), (F.col("end") - F.col("start")).alias("length"), gap.alias("gap"))


def region_name(prefix: str, number: Column) -> Column:
    """`prefix_number` names for intervals without one."""
    return F.concat(F.lit(prefix + "_"), number.cast("string"))


