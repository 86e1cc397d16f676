"""Monte-Carlo enrichment of overlaps between region sets: null model, sweep over all shuffles at once, statistics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.statistics import beta_pvalue, negbin_columns, negbin_fit_quality, negbin_log10_pvalue
from locusframe.model import bed, value
from locusframe.operators.blocks import BLOCK, block_of, carried
from locusframe.operators.intervals import ends, exclude_concatenate, exclude_sizes, intergenic, introns, lengths_and_gaps, merge, slop, sweep, uncovered
from locusframe.registry import operator
from locusframe.session import cut

#: Shuffles of one analysis.
SHUFFLES = 200
#: Width of a step of the Markov model, tasks that the shuffles of a chromosome are spread over, and steps of a chain
#: after which it starts anew.
MARKOV_STEP = 1000
MARKOV_SLICES = 16
MARKOV_CHAIN = 1 << 16
#: Parts of a permutation are ranked in hash blocks of about so many.
PERMUTED = 1 << 17
#: A chromosome is shuffled and compared within tasks if no set has more intervals there than WITHIN; a task draws about
#: DRAWN of them.
WITHIN = 1 << 22
DRAWN = 1 << 23
#: Slices that a chromosome's blocks are dealt to where each of its intervals is repeated for every set.
SLICES = 16


def _permuted(parts: DataFrame, by: list[str], seed: int) -> DataFrame:
    """Parts with `place`, from 0: their rank in the order of a seeded hash, within `by`; `many` is the group's number of parts.

    A group is cut by its hashes into blocks of about PERMUTED parts: no task orders more than that. Joins of what grows
    with the shuffles are merged: Spark's estimates don't see the rows that the shuffles add, so it would broadcast them.
    """
    wide = 1 << 53
    drawn = F.pmod(F.xxhash64("shuffle", "number", F.lit(seed)), F.lit(wide))
    block = F.floor(F.col("__u") / wide * F.ceil(F.col("many") / PERMUTED)).cast("bigint")
    cut_up = parts.withColumn("__u", drawn).withColumn("__block", block)
    offsets = carried(cut_up, by, "__block", __before=F.lit(1))
    rank = F.row_number().over(Window.partitionBy(*by, "__block").orderBy("__u", "number"))
    return cut_up.withColumn("__rank", rank).join(offsets.hint("merge"), [*by, "__block"]).withColumn("place", F.col("__before") + F.col("__rank") - 1).drop("__u", "__block", "__before", "__rank")


@operator("OLO-03", group="enrichment")
def shuffled(a: DataFrame, sizes: DataFrame, shuffles: int = SHUFFLES, seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, shuffle, chrom, start, end): the merged intervals of a, lengths and gaps permuted apart per chromosome and shuffle.

    The permutations are orders by a seeded hash, the same on any partitioning; positions are running sums. Neither the
    orders nor the sums put a whole chromosome in one task. The gap to the chromosome's end takes part in the permutation.
    """
    own = cut(lengths_and_gaps(a, sizes, keys))
    many = own.groupBy(*keys, "chrom").agg(F.count(F.lit(1)).alias("many"))
    parts = own.join(many, [*keys, "chrom"]).withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    by = [*keys, "shuffle", "chrom"]
    lengths = _permuted(parts.where("length IS NOT NULL").select(*by, "number", "many", "length"), by, seed)
    gaps = _permuted(parts.select(*by, "number", "many", "gap"), by, seed + 1)
    placed = lengths.select(*by, "place", "length").join(gaps.select(*by, "place", "gap").hint("merge"), [*by, "place"])
    block = placed.withColumn("__block", F.floor(F.col("place") / BLOCK).cast("bigint"))
    inside = Window.partitionBy(*by, "__block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = block.withColumn("__own", F.sum(F.col("length") + F.col("gap")).over(inside)).join(carried(block, by, "__block", __before=F.col("length") + F.col("gap")).hint("merge"), [*by, "__block"])
    end = F.col("__before") + F.col("__own")
    return summed.select(*by, (end - F.col("length")).alias("start"), end.alias("end"))


@operator("OLO-04", group="enrichment")
def markov_shuffled(a: DataFrame, sizes: DataFrame, shuffles: int = SHUFFLES, seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """As shuffled, with lengths and gaps drawn from a second-order Markov model of those of the chromosome.

    Lengths are rounded up to a step, the next one is drawn by the two before it, uniform noise undoes the rounding (but
    for the first two). The model of a chromosome is sent to MARKOV_SLICES tasks, which share its shuffles; a chain
    starts anew after MARKOV_CHAIN steps. A chromosome of fewer than 3 intervals has no model and is an error.
    """
    parts = lengths_and_gaps(a, sizes, keys)
    listed = F.array_sort(F.collect_list(F.struct("number", "length", "gap")))
    gathered = parts.groupBy(*keys, "chrom").agg(listed.alias("p"))
    few = F.when(F.size("p") < 4, F.raise_error(F.concat(F.lit("fewer than 3 intervals on "), F.col("chrom"))).cast("bigint"))
    model = gathered.select(*keys, "chrom", F.filter(F.transform("p", lambda x: F.coalesce(few, x["length"])), lambda n: n.isNotNull()).alias("lengths"), F.transform("p", lambda x: x["gap"]).alias("gaps"))
    tasks = model.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(min(MARKOV_SLICES, shuffles) - 1)))).repartition(*keys, "chrom", "slice")

    def fitted(values: np.ndarray) -> tuple[np.ndarray, dict]:
        states = -(-values // MARKOV_STEP)
        following: dict[tuple[int, int], list[int]] = {}
        for x, y, z in zip(states.tolist(), states[1:].tolist(), states[2:].tolist(), strict=False):
            following.setdefault((x, y), []).append(z)
        return states, following

    def chain(model: tuple[np.ndarray, dict], n: int, rng: np.random.Generator) -> np.ndarray:
        states, following = model
        out: list[int] = []
        for begun in range(0, n, MARKOV_CHAIN):
            x, y = rng.choice(states, 2).tolist()
            one = [x, y]
            for u in rng.random(max(0, min(MARKOV_CHAIN, n - begun) - 2)):
                options = following.get((x, y), states)
                x, y = y, int(options[int(u * len(options))])
                one.append(y)
            out += one[: n - begun]
        noise = np.around(rng.random(n) * (MARKOV_STEP - 1)).astype(np.int64)
        noise[:2] = 0
        return np.maximum(np.array(out, np.int64) * MARKOV_STEP - noise, 0)

    def run(batches):
        for batch in batches:
            for *own, chrom, part, lengths, gaps in batch[[*keys, "chrom", "slice", "lengths", "gaps"]].itertuples(index=False, name=None):
                of_lengths, of_gaps = fitted(np.asarray(lengths, np.int64)), fitted(np.asarray(gaps, np.int64))
                for shuffle in range(part, shuffles, MARKOV_SLICES):
                    rng = np.random.default_rng([seed, shuffle, *map(ord, "|".join([*map(str, own), chrom]))])
                    new = np.maximum(chain(of_lengths, len(lengths), rng), 1)
                    stops = np.cumsum(chain(of_gaps, len(lengths), rng) + new)
                    yield pd.DataFrame(dict(zip(keys, own, strict=True)) | {"shuffle": shuffle, "chrom": chrom, "start": stops - new, "end": stops})

    fields = [f"{k} {a.schema[k].dataType.simpleString()}" for k in keys]
    return tasks.mapInPandas(run, ", ".join([*fields, "shuffle int, chrom string, start bigint, end bigint"]))


@operator("WIN-05", group="enrichment")
def merged_overlaps(segments: DataFrame, keys: list[str], now: Column, earlier: Column, **measures: Column) -> DataFrame:
    """(keys, n, s): merged overlaps and overlapping bases of a sweep's segments; adjacent segments of one place count once.

    `now` tells whether a segment counts, `earlier` whether what lies just before it did: an overlap begins where only the
    first holds, so nothing has to be ordered. Without keys one row comes out, with 0 where there is none.
    """
    n, s = F.count(F.when(now & ~earlier, 1)), F.sum(F.when(now, F.col("end") - F.col("start")))
    return segments.groupBy(*keys).agg(n.alias("n"), F.coalesce(s, F.lit(0)).cast("bigint").alias("s"), *(v.alias(k) for k, v in measures.items()))


def _overlapping(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Merged overlaps of a sweep of two sets."""
    now, earlier = ((F.col(c)[0] > 0) & (F.col(c)[1] > 0) for c in ("flags", "before"))
    return merged_overlaps(segments.where(now), keys, now, earlier)


def _for_each_set(a: DataFrame, sets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """a once for every set, on the chromosomes that the set has. Slices of a chromosome are merged: a is not broadcast, and no
    task repeats a whole chromosome."""
    asked = sets.select(*keys, "chrom").distinct().withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SLICES - 1).cast("bigint"))))
    return a.withColumn("__slice", F.pmod(block_of(F.col("start")), F.lit(SLICES))).join(asked.hint("merge"), ["chrom", "__slice"]).drop("__slice")


@operator("OLO-06", group="enrichment")
def true_overlap(a: DataFrame, sets: DataFrame, keys: tuple[str, ...] = (), merged: bool = False) -> DataFrame:
    """(keys, n, s): number of merged overlaps of a with each set, and their bases; both are merged first and written.

    merged: they are already, and cheap to read again.

    With keys, sets without any overlap come out with 0.
    """
    left, right = (a, sets) if merged else (cut(merge(a)), cut(merge(sets, keys)))
    found = _overlapping(sweep([_for_each_set(left, right, keys), right], keys), list(keys))
    if not keys:
        return found
    every = sets.select(*keys).distinct().join(found, list(keys), "left")
    return every.select(*keys, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("s", F.lit(0)).cast("bigint").alias("s"))


def _drawn(lengths: np.ndarray, gaps: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of intervals whose lengths and gaps are permuted; those that touch are one."""
    length = rng.permutation(lengths)
    end = np.cumsum(length + rng.permutation(gaps)[: len(length)])
    start = end - length
    apart = start[1:] != end[:-1]
    return start[np.append(True, apart)], end[np.append(apart, True)]


def _met(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Number and bases of the overlaps of two sets of ordered intervals of which no two of a set touch."""
    (start, end), (s, e) = a, b
    first, last = np.searchsorted(end, s, "right"), np.searchsorted(start, e, "left")
    covered = np.append(0, np.cumsum(end - start))
    upto = covered[last] - np.maximum(np.append(0, end)[last] - e, 0)
    below = covered[first] + np.maximum(s - np.append(start, np.iinfo(np.int64).max)[first], 0)
    return int((last - first).sum()), int((upto - below).sum())


def _met_within(a: DataFrame, sets: DataFrame, sizes: DataFrame, shuffles: int, seed: int, keys: tuple[str, ...], partitions: int) -> DataFrame:
    """(keys, shuffle, n, s), summed over chromosomes: what shuffle_overlaps counts, drawn and counted within tasks.

    The lengths and gaps of a chromosome are sent to as many tasks as its shuffles take; shuffled intervals are never written.
    """
    def gathered(x: DataFrame, own: tuple[str, ...]) -> DataFrame:
        lists = (F.sort_array(F.collect_list(c)).alias(f"{c}s") for c in ("length", "gap"))
        return lengths_and_gaps(x, sizes, own).groupBy(*own, "chrom").agg(*lists)

    kinds = {k: sets.schema[k].dataType for k in keys}
    query = gathered(a, ()).select(F.lit(0).alias("of_set"), "chrom", *(F.lit(None).cast(v).alias(k) for k, v in kinds.items()), "lengths", "gaps")
    every = cut(query.unionByName(gathered(sets, keys).select(F.lit(1).alias("of_set"), "chrom", *keys, "lengths", "gaps")))
    pieces = F.least(F.lit(shuffles), F.ceil(F.sum(F.size("lengths").cast("bigint")) * shuffles / DRAWN)).cast("int")
    each = every.join(every.groupBy("chrom").agg(pieces.alias("pieces")), "chrom").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    tasks = each.repartition(partitions, "chrom", "piece").sortWithinPartitions("chrom", "piece", "of_set")

    def run(batches):
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            out: list[tuple] = []
            for of_set, chrom, piece, many, lengths, gaps, *own in batch[["of_set", "chrom", "piece", "pieces", "lengths", "gaps", *keys]].itertuples(index=False, name=None):
                numbers = range(piece, shuffles, many)
                name = "|".join([*map(str, own), chrom]) if of_set else chrom
                rng = np.random.default_rng([seed + 1000 * of_set, piece, *map(ord, name)])
                if of_set:
                    out += [(*own, k, *_met(one, _drawn(lengths, gaps, rng))) for k, one in zip(numbers, drawn, strict=True)]
                else:
                    drawn = [_drawn(lengths, gaps, rng) for _ in numbers]
            yield pd.DataFrame(out, columns=[*keys, "shuffle", "n", "s"])

    fields = [f"{k} {v.simpleString()}" for k, v in kinds.items()]
    return tasks.mapInPandas(run, ", ".join([*fields, "shuffle int, n bigint, s bigint"]))


def _met_swept(a: DataFrame, sets: DataFrame, sizes: DataFrame, shuffles: int, seed: int, markov: bool, keys: tuple[str, ...]) -> DataFrame:
    """As _met_within, by one sweep of all sets and shuffles over chromosomes of any size."""
    model: Callable = markov_shuffled if markov else shuffled
    one, two = cut(model(a, sizes, shuffles, seed)), cut(model(sets, sizes, shuffles, seed + 1000, keys))
    by = [*keys, "shuffle"]
    return _overlapping(sweep([_for_each_set(one, two, keys), two], tuple(by)), by)


@operator("OLO-05", group="enrichment")
def shuffle_overlaps(a: DataFrame, sets: DataFrame, sizes: DataFrame, shuffles: int = SHUFFLES, seed: int = 42, markov: bool = False, keys: tuple[str, ...] = (), merged: bool = False) -> DataFrame:
    """(keys, shuffle, n, s): overlaps of independently shuffled a and sets, on chromosomes that both have; 0 where there is none.

    Chromosomes of at most WITHIN intervals a set are drawn and counted within tasks, from sorted lengths and gaps. Larger ones, and
    those of the Markov model, go through one sweep keyed by sets and shuffles: the shuffled sets are written to the shared
    folder then, as the sweep reads each of them several times.
    """
    left, right = (a, sets) if merged else (cut(merge(a)), cut(merge(sets, keys)))
    own, others = left.join(right.select("chrom").distinct(), "chrom", "left_semi"), right.join(left.select("chrom").distinct(), "chrom", "left_semi")
    by = [*keys, "shuffle"]
    if markov:
        found = _met_swept(own, others, sizes, shuffles, seed, True, keys)
    else:
        counts = own.groupBy("chrom").count().unionByName(others.groupBy(*keys, "chrom").count().select("chrom", "count"))
        counts = cut(counts.groupBy("chrom").agg(F.sum("count").alias("many"), F.max("count").alias("most")))
        far = counts.where(F.col("most") > WITHIN).select("chrom")
        seen = counts.agg(F.sum(F.when(F.col("most") <= WITHIN, F.col("many"))), F.max("most")).first()
        partitions = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * -(-(seen[0] or 0) * shuffles // DRAWN))
        near = [x.join(far, "chrom", "left_anti") for x in (own, others)]
        found = _met_within(*near, sizes, shuffles, seed, keys, partitions)
        if (seen[1] or 0) > WITHIN:
            found = found.unionByName(_met_swept(*(x.join(far, "chrom", "left_semi") for x in (own, others)), sizes, shuffles, seed, False, keys).select(*found.columns))
        found = found.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("shuffle")
    every = (right.select(*keys).distinct() if keys else a.sparkSession.range(1)).select(*keys, numbers)
    return every.join(found, by, "left").select(*by, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("s", F.lit(0)).cast("bigint").alias("s"))


#: Statistics of one measure, in the order of the result table.
MEASURES = {"n": "nb_intersections", "s": "summed_bp_overlaps"}


def statistics_columns() -> list[str]:
    """Columns of the result table, after its keys."""
    names = [f"{long}_{x}" for long in MEASURES.values() for x in ("expectation_shuffled", "variance_shuffled", "negbinom_fit_quality", "log2_fold_change", "true", "pvalue", "log10_pvalue", "empirical_pvalue")]
    return [*names, "beta_summed_bp_overlaps_pvalue"]


@operator("OLO-07", "OLO-08", "OLO-09", "OLO-10", group="enrichment")
def enrichment(per_shuffle: DataFrame, true: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics per set: expectation, variance, fit quality, log2 fold change, true value, p-values of both measures.

    per_shuffle: keys, shuffle, n, s; true: keys, n, s. The fold change is the true value's where the expectation is 0,
    and 0 stays 0. P-values are the smaller tail of a negative binomial (also as log10), the share of shuffles as
    extreme, and that of a fitted Beta distribution; -1 where nothing can be fitted. A set has one row per shuffle,
    gathered for the fit.
    """
    gathered = per_shuffle.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("shuffle", "n", "s"))).alias("runs"))
    joined = true.select(*keys, F.col("n").alias("n_true"), F.col("s").alias("s_true")).join(gathered, keys, "left")
    names = statistics_columns()

    def row(n_true: int, s_true: int, runs) -> list[float]:
        out: list[float] = []
        for m, true_value in (("n", n_true), ("s", s_true)):
            seen = np.array([r[m] for r in runs] if runs is not None else [], float)
            mean, var = (float(seen.mean()), float(seen.var())) if len(seen) else (0.0, 0.0)
            quality = negbin_fit_quality(list(seen), mean, var) if mean else -1.0
            change = true_value / mean if mean else float(true_value)
            log10 = negbin_log10_pvalue(true_value, mean, var) if quality != -1 else float("nan")
            above = float((seen > true_value).sum())
            empirical = min(above, len(seen) - above) / len(seen) if len(seen) else float("nan")
            out += [mean, var, quality, float(np.log2(change)) if change else 0.0, float(true_value), 10**log10 if quality != -1 else -1.0, log10, empirical]
        centred = seen - seen.mean() if len(seen) else seen
        spread = centred.std() if len(seen) else 0.0
        out.append(beta_pvalue(s_true, seen.mean(), seen.var(ddof=1), float((centred**3).mean() / spread**3), float((centred**4).mean() / spread**4 - 3)) if len(seen) > 3 and spread else -1.0)
        return out

    def run(batches):
        for batch in batches:
            stats = [row(int(a), int(b), r) for a, b, r in zip(batch["n_true"], batch["s_true"], batch["runs"], strict=True)]
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(stats, columns=names, dtype=float)], axis=1)

    schema = ", ".join(f"{k} {joined.schema[k].dataType.simpleString()}" for k in keys) + ", " + ", ".join(f"{n} double" for n in names)
    return joined.mapInPandas(run, schema)


@operator("OLO-02", group="enrichment")
def compared_with(query: DataFrame, sets: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ("feature_type",), shuffles: int = SHUFFLES, seed: int = 42, markov: bool = False, excluded: DataFrame | None = None, included: DataFrame | None = None) -> DataFrame:
    """Statistics of the overlaps of a query with every set (keys, chrom, start, end), against shuffled ones.

    What is on chromosomes without size drops out. excluded regions (or all but the included ones) are cut out of the
    query, the sets and the chromosomes, which close up. With fewer than 2 regions in the query nothing can be shuffled:
    all statistics are 0 and all p-values and fit qualities -1.
    """
    if included is not None:
        if excluded is not None:
            raise ValueError("regions can be excluded or included, not both")
        excluded = complement(included, sizes)
    known = sizes.select("chrom")
    query, sets = (x.join(known, "chrom", "left_semi") for x in (query.select("chrom", "start", "end"), sets.select(*keys, "chrom", "start", "end")))
    if excluded is not None:
        holes = cut(merge(excluded))
        query, sets, sizes = exclude_concatenate(merge(query), holes), exclude_concatenate(merge(sets, keys), holes), exclude_sizes(sizes, holes)
    query, sets = cut(merge(query)), cut(merge(sets, keys))
    if query.limit(2).count() < 2:
        nothing = {n: F.lit(-1.0 if n.endswith(("pvalue", "quality")) and "log10" not in n else float("nan") if "log10" in n else 0.0) for n in statistics_columns()}
        return sets.select(*keys).distinct().select(*keys, *(v.alias(n) for n, v in nothing.items()))
    return enrichment(shuffle_overlaps(query, sets, sizes, shuffles, seed, markov, keys, merged=True), true_overlap(query, sets, keys, merged=True), list(keys))


def annotation_sets(rows: DataFrame, sizes: DataFrame, upstream: int = 1000, downstream: int = 1000, features: bool = True, more_keys: tuple[str, ...] = ()) -> DataFrame:
    """(feature_type, chrom, start, end): the region sets of an annotation table, on chromosomes that have a size.

    features: one set per feature; if there are gene and transcript rows, also Intergenic, Introns, Promoters and
    Terminator (the ends of stranded transcripts, extended). more_keys: one set `key:value` per value of these keys.
    """
    own = rows.join(sizes.select(F.col("chrom").alias("seqid")), "seqid", "left_semi")
    span = ["chrom", "start", "end"]
    keyed = F.array(*([F.col("feature")] if features else []), *(F.when(value(k).isNotNull() & ~value(k).isin(".", "?"), F.concat(F.lit(f"{k}:"), value(k))) for k in more_keys))
    each = own.select(F.explode(keyed).alias("feature_type"), F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("start"), "end").where("feature_type IS NOT NULL")
    if not features or own.where("feature = 'gene'").isEmpty() or own.where("feature = 'transcript'").isEmpty():
        return each
    stranded = own.where(F.col("strand").isin("+", "-"))
    derived = {"Intergenic": intergenic(own, sizes), "Introns": introns(own, by_transcript=False), "Promoters": slop(ends(stranded), sizes, upstream, downstream), "Terminator": slop(ends(stranded, three_prime=True), sizes, upstream, downstream)}
    for name, regions in derived.items():
        each = each.unionByName(regions.select(F.lit(name).alias("feature_type"), *span))
    return each


@operator("OLO-01", group="enrichment")
def annotation_enrichment(query: DataFrame, rows: DataFrame | None, sizes: DataFrame, upstream: int = 1000, downstream: int = 1000, features: bool = True, more_keys: tuple[str, ...] = (), more_sets: dict[str, DataFrame] | None = None, **options) -> DataFrame:
    """Where a query's regions lie in an annotation: statistics per region set of annotation_sets and of one's own sets.

    more_sets: further sets by name. options: shuffles, seed, markov, excluded, included, as in compared_with.
    """
    sets = None if rows is None else annotation_sets(rows, sizes, upstream, downstream, features, more_keys)
    for name, regions in (more_sets or {}).items():
        one = regions.select(F.lit(name).alias("feature_type"), "chrom", "start", "end")
        sets = one if sets is None else sets.unionByName(one)
    if sets is None:
        raise ValueError("an annotation or sets of one's own are needed")
    return compared_with(query, sets, sizes, **options)


@operator("OLO-17", group="enrichment")
def complement(included: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, start, end): what inclusion regions leave out of the chromosomes, to be excluded."""
    return uncovered(included, sizes)


def _matches(asked: str, opened: str, exact: bool) -> Column:
    """A flag vector holds a combination: just its sets, or at least these."""
    return F.col(asked) == F.col(opened) if exact else F.forall(F.zip_with(asked, opened, lambda q, c: (q == 0) | (c == 1)), lambda x: x)


@operator("OLO-11", "OLO-12", "OLO-13", group="enrichment")
def combination_overlaps(segments: DataFrame, labels: list[str], keys: list[str] | None = None, exact: bool = False, most: int | None = None, combinations: list[tuple[int, ...]] | None = None) -> DataFrame:
    """(keys, combination, combination_order, n, s) of an N-way sweep: the first set is the query and always open.

    Segments are first summed up by the sets that are open in them and just before them, so combinations are compared with
    distinct flag vectors, not with segments. Inexact combinations count every segment where at least their sets are
    open, and are labelled `+ ...`; exact ones need just these. Asked for are the combinations that occur, of `most` sets
    at most, or those given as 0/1 vectors (the query counts as open), which come out even if they never occur.
    """
    by = list(keys or [])
    bits = {c: F.transform(f, lambda x: (x > 0).cast("int")) for c, f in (("open", "flags"), ("earlier", "before"))}
    summed = segments.select(*by, (F.col("end") - F.col("start")).alias("length"), *(v.alias(c) for c, v in bits.items())).groupBy(*by, "open", "earlier").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("s"))
    summed = summed.where((F.col("open")[0] == 1) & (F.aggregate("open", F.lit(0), lambda a, x: a + x) > 1))
    size = F.aggregate("asked", F.lit(0), lambda a, x: a + x)
    if combinations is None:
        asked = summed.select(F.col("open").alias("asked")).distinct()
        asked = asked if most is None else asked.where(size <= most)
    else:
        asked = segments.sparkSession.createDataFrame([([1, *map(int, c[1:])],) for c in dict.fromkeys(map(tuple, combinations))], "asked array<int>").distinct()
    # Flag vectors meet combinations by an equality on the last set of the combination, which the vector must have open.
    opened = summed.select("open").distinct().select("open", F.explode(F.filter(F.transform("open", lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())).alias("last"))
    pairs = asked.withColumn("last", F.array_max(F.transform("asked", lambda x, i: F.when(x == 1, i)))).join(opened, "last").where(_matches("asked", "open", exact)).drop("last")
    counted = summed.join(pairs, "open").groupBy(*by, "asked").agg(F.coalesce(F.sum(F.when(~_matches("asked", "earlier", exact), F.col("n"))), F.lit(0)).alias("n"), F.sum("s").alias("s"))
    if combinations is not None:
        every = segments.select(*by, F.explode(F.array(*[F.array(*[F.lit(int(x)) for x in [1, *c[1:]]]) for c in dict.fromkeys(map(tuple, combinations))])).alias("asked")).distinct() if by else asked
        counted = every.join(counted, [*by, "asked"], "left").select(*by, "asked", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "s")))
    names = F.array(*[F.lit(x) for x in labels])
    shown = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda i: F.when(F.get("asked", i) == 1, F.get(names, i))), lambda x: x.isNotNull())
    label = F.concat(F.lit("["), F.array_join(shown, " + "), F.lit("]" if exact else " + ... ]"))
    return counted.select(*by, label.alias("combination"), size.alias("combination_order"), F.col("n").cast("bigint").alias("n"), F.col("s").cast("bigint").alias("s"))


def combination_enrichment(query: DataFrame, sets: dict[str, DataFrame], sizes: DataFrame, shuffles: int = SHUFFLES, seed: int = 42, exact: bool = False, most: int | None = None, combinations: list[tuple[int, ...]] | None = None, markov: bool = False) -> DataFrame:
    """Statistics per combination of sets that overlap the query together, against independently shuffled query and sets.

    combinations: those to be tested, for example the words of a learned dictionary (operators.mining); else all that
    occur in the data. The shuffled sets are written to the shared folder.
    """
    model: Callable = markov_shuffled if markov else shuffled
    merged = [cut(merge(x.join(sizes.select("chrom"), "chrom", "left_semi"))) for x in (query, *sets.values())]
    labels = ["Query", *sets]
    true = cut(combination_overlaps(sweep(merged, least=1), labels, exact=exact, most=most, combinations=combinations))
    drawn = [cut(model(x, sizes, shuffles, seed + 1000 * i)) for i, x in enumerate(merged)]
    asked = combinations or [tuple(int(n in ("Query", *r["combination"].strip("[]").replace(" + ... ", "").split(" + "))) for n in labels) for r in true.select("combination").collect()]
    if not asked:
        return enrichment(true.select("combination", F.lit(0).alias("shuffle"), "n", "s"), true, ["combination"]).withColumn("combination_order", F.lit(0))
    runs = combination_overlaps(sweep(drawn, ("shuffle",), least=1), labels, ["shuffle"], exact, None, asked)
    stats = enrichment(runs, true, ["combination"])
    return stats.join(true.select("combination", "combination_order"), "combination")


@operator("OLO-14", group="enrichment")
def merged_runs(runs: DataFrame, keys: list[str], shuffles: str = "n_shuffles") -> DataFrame:
    """Combine runs of one analysis: moments weighted by each run's shuffles, fold changes and p-values computed again.

    runs: keys, n_shuffles and, per measure, expectation_shuffled, variance_shuffled and true; empirical and Beta p-values,
    if there are any, are averaged by shuffles. Fit qualities of merged runs are -1. Order-free.
    """
    n = F.col(shuffles)
    total = F.sum(n)
    kept = [c for c in runs.columns if c.endswith("empirical_pvalue") or c.startswith("beta_")]
    columns = [total.alias(shuffles), *((F.sum(n * F.col(c)) / total).alias(c) for c in kept)]
    for long in MEASURES.values():
        mean, var = F.col(f"{long}_expectation_shuffled"), F.col(f"{long}_variance_shuffled")
        columns += [(F.sum(n * mean) / total).alias(f"{long}_expectation_shuffled"), F.sum((n - 1) * var + n * mean * mean).alias(f"__{long}"), F.max(f"{long}_true").alias(f"{long}_true")]
    out = runs.groupBy(*keys).agg(*columns)
    for long in MEASURES.values():
        mean, true = F.col(f"{long}_expectation_shuffled"), F.col(f"{long}_true").cast("double")
        out = out.withColumn(f"{long}_variance_shuffled", (F.col(f"__{long}") - F.col(shuffles) * mean * mean) / (F.col(shuffles) - 1)).drop(f"__{long}")
        change = F.when(mean == 0, true).otherwise(true / mean)
        p, log10 = negbin_columns(true, mean, F.col(f"{long}_variance_shuffled"))
        out = out.withColumns({f"{long}_log2_fold_change": F.when(change == 0, 0.0).otherwise(F.log2(change)), f"{long}_pvalue": p, f"{long}_log10_pvalue": log10, f"{long}_negbinom_fit_quality": F.lit(-1.0)})
    return out


#: Fixed value: -log10 of what a p-value of 0 is shown as.
LEAST_SHOWN = 320.0


@operator("OLO-15", group="enrichment")
def stacked_runs(runs: dict[str, DataFrame], pvalue: str = "summed_bp_overlaps_pvalue") -> DataFrame:
    """Runs below each other with their label and -log10 of the p-value; -1 becomes null, 0 is shown as 1e-320.

    1e-320 is no normal double: the column `minus_log10_pvalue` is exact, the p-value itself the nearest double.
    """
    out = None
    for name, run in runs.items():
        part = run.withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    p = F.col(pvalue)
    shown = F.when(p == -1, None).when(p == 0, F.lit(LEAST_SHOWN)).otherwise(-F.log10(p))
    return out.withColumns({"minus_log10_pvalue": shown, pvalue: F.when(p == -1, None).when(p == 0, F.lit("1e-320").cast("double")).otherwise(p)})


@operator("OLO-16", group="enrichment")
def combination_tree(combinations: DataFrame, top: int | None = None, least_inheritance: float | None = None) -> DataFrame:
    """(parent, child, inheritance): each combination below the nearest combinations that it contains.

    combinations: sets ARRAY<STRING>, s. Only a few dozen combinations are worth drawing; `top` keeps those of most bases.
    Combinations that contain no other hang below the root `Query`, without inheritance, unless they are that themselves. Those that have
    less than least_inheritance of a parent's bases leave it.
    """
    own = combinations if top is None else combinations.orderBy(F.desc("s"), F.array_join("sets", "+")).limit(top)
    up, down = own.select(F.col("sets").alias("parent"), F.col("s").alias("s_parent")), own.select(F.col("sets").alias("child"), F.col("s").alias("s_child"))
    # Containing combinations share each of their sets: joined on the parent's rarest set, which the child must have.
    spread = own.select(F.explode("sets").alias("one")).groupBy("one").agg(F.count(F.lit(1)).alias("often"))
    rarest = up.select("parent", F.explode("parent").alias("one")).join(spread, "one").groupBy("parent").agg(F.min_by("one", F.struct("often", "one")).alias("one"))
    met = up.join(rarest, "parent").join(down.withColumn("one", F.explode("child")), "one").drop("one")
    inside = met.where((F.size("parent") < F.size("child")) & (F.size(F.array_except("parent", "child")) == 0))
    ratio = F.when(F.col("s_parent") > 0, F.col("s_child") / F.col("s_parent"))
    nearest = F.rank().over(Window.partitionBy("child").orderBy(F.size("child") - F.size("parent")))
    found = inside.withColumns({"inheritance": ratio, "r": nearest}).where("r = 1").select("parent", "child", "inheritance")
    root = F.array(F.lit("Query"))
    loose = own.select(F.col("sets").alias("child")).where(F.col("child") != root).join(found.select("child"), "child", "left_anti")
    found = found if least_inheritance is None else found.where(F.col("inheritance") >= least_inheritance)
    return found.unionByName(loose.select(root.alias("parent"), "child", F.lit(None).cast("double").alias("inheritance")))
