"""Interval arithmetic on DataFrames (chr, start, end), 1-based and closed, without a task that grows with the data.

Rows are first reduced to one per (chr, start), so a bucket of ``WIDTH`` positions never holds more than ``WIDTH`` rows.
Running maxima are taken within buckets and carried over from bucket to bucket by a table of at most 2^31 / WIDTH rows
per chromosome; sets counted to at most ``SMALL`` rows need no buckets. Each step cuts its lineage, as the algebra nests
steps. Null bounds are open ends, kept as sentinels meanwhile.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.genome import LAST
from ..scale import at_most, cut

WIDTH = 1 << 18  #: positions in a bucket
SMALL = 500_000  #: intervals that one window per chromosome may sort
FEW = 5_000  #: intervals that the plan itself may hold
BIN = 1 << 20  #: positions in a bin of an overlap join


def held(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a literal of the plan, in one partition: what follows needs neither shuffles nor Python."""
    names = [x.split()[0] for x in schema.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f'`{n}`: {x.split()[1]}' for n, x in zip(names, schema.split(',')))}>>")))


def closed(df: DataFrame) -> DataFrame:
    """Open bounds as sentinels."""
    return df.select(F.coalesce("chr", F.lit("")).alias("chr"), F.coalesce(F.col("start").cast("long"), F.lit(0).cast("long")).alias("start"), F.coalesce(F.col("end").cast("long"), F.lit(LAST).cast("long")).alias("end"))


def opened(df: DataFrame) -> DataFrame:
    return df.select(F.nullif("chr", F.lit("")).alias("chr"), F.when(F.col("start") > 0, F.col("start").cast("int")).alias("start"), F.when(F.col("end") < LAST, F.col("end").cast("int")).alias("end"))


def _running_max(df: DataFrame, value: str, out: str, before: bool, few: bool) -> DataFrame:
    """df (chr, b, start, ...) with the maximum of value over all rows up to this one by start (or before it)."""
    inner = Window.partitionBy(*(["chr"] if few else ["chr", "b"])).orderBy("start").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    if few:
        return df.withColumn(out, F.max(value).over(inner))
    over = Window.partitionBy("chr").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy("chr", "b").agg(F.max(value).alias("_m")).withColumn("_m", F.max("_m").over(over))
    return df.join(carried.withColumnRenamed("_m", "_c"), ["chr", "b"]).withColumn(out, F.greatest(F.max(value).over(inner), "_c")).drop("_c")


def _by_start(df: DataFrame) -> tuple[DataFrame, bool]:
    """One row per (chr, start) with its bucket, and whether there are few of them. What is counted to at most ``FEW`` rows
    goes on as rows held by the plan (a few hundred kB), so the algebra of small sets starts no job that it has done before."""
    one = df.filter("start <= end").groupBy("chr", "start").agg(F.max("end").alias("end")).withColumn("b", F.floor(F.col("start") / WIDTH))
    got = one.limit(FEW + 1).collect()
    if len(got) <= FEW:
        return held(df.sparkSession, [tuple(r) for r in got], one.schema.simpleString()[7:-1].replace(":", " ")), True
    one = cut(one)
    return one, at_most(one, SMALL)


def merge(df: DataFrame) -> DataFrame:
    """Overlapping and adjoining intervals as one; bounds closed."""
    one, few = _by_start(df)
    d = _running_max(one, "end", "_prev", True, few)
    d = d.withColumn("_from", F.when(F.col("_prev").isNull() | (F.col("_prev") + 1 < F.col("start")), F.col("start"))).drop("_prev")
    d = _running_max(d if few else cut(d), "_from", "_at", False, few)
    return d.groupBy("chr", F.col("_at").alias("start")).agg(F.max("end").alias("end")).select("chr", "start", "end")


def gaps(merged: DataFrame, chromosomes: DataFrame, first: int = 1) -> DataFrame:
    """What merged intervals leave of the given chromosomes (chr); bounds closed."""
    m, few = _by_start(merged.join(chromosomes, "chr", "left_semi"))
    d = _running_max(m, "end", "_prev", True, few)
    inside = d.select("chr", (F.coalesce("_prev", F.lit(first - 1)) + 1).alias("start"), (F.col("start") - 1).alias("end"))
    tail = chromosomes.join(m.groupBy("chr").agg(F.max("end").alias("_e")), "chr", "left").select("chr", (F.coalesce("_e", F.lit(first - 1)) + 1).cast("long").alias("start"), F.lit(LAST).cast("long").alias("end"))
    return inside.unionByName(tail).filter("start <= end")


class Binning:
    """How closed intervals are cut into bins: the width, the number of rows that gives, and what the intervals reach; one job.

    The width is the smallest power of two for which cutting gives at most four rows per interval (or 50 000 in all), so that
    a position is compared with few intervals and open ends do not multiply."""

    def __init__(self, regions: DataFrame, start: str = "start", end: str = "end", most: int = 200) -> None:
        sizes = [1 << k for k in range(10, 32)]
        cuts = [F.sum(F.floor(F.col(end) / b) - F.floor(F.col(start) / b) + 1).alias(str(b)) for b in sizes]
        got = regions.agg(F.count(F.lit(1)).alias("n"), F.min(start).alias("s"), F.max(end).alias("e"), F.slice(F.array_sort(F.collect_set("chr")), 1, most + 1).alias("c"), *cuts).first()
        self.n, self.first, self.last = got["n"], got["s"], got["e"]
        self.chromosomes = got["c"] if len(got["c"]) <= most else None
        self.width = next((b for b in sizes if (got[str(b)] or 0) <= max(4 * got["n"], 50_000)), sizes[-1])
        self.rows = got[str(self.width)] or 0
        self.start, self.end = start, end

    def of(self, start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / self.width), F.floor(end / self.width)))

    def at(self, pos: Column) -> Column:
        return F.floor(pos / self.width)

    def cut(self, regions: DataFrame, bound: int) -> DataFrame:
        """regions with their bins (_bin); broadcast if these are at most ``bound`` rows (of some 50 bytes each)."""
        r = regions.withColumn("_bin", self.of(F.col(self.start), F.col(self.end)))
        return F.broadcast(r) if self.rows <= bound else r

    def reach(self, chrom: str, pos: str) -> Column:
        """A condition that all rows within the intervals meet and that a scan can use: chromosomes and outermost positions."""
        if not self.n:
            return F.lit(False)
        c = F.col(pos).between(self.first, self.last)
        return c & F.col(chrom).isin(self.chromosomes) if self.chromosomes is not None else c


def overlaps(left: DataFrame, right: DataFrame, bound: int = 100_000) -> DataFrame:
    """Pairs of rows of left (chr, start, end, ...) and right (chr, start2, end2, ...) that overlap, each once.

    Both sides are cut into bins and joined on (chr, bin); a pair is kept in the bin of its later start only. The bins of the
    right side are broadcast if they have been counted to at most ``bound`` rows.
    """
    b = Binning(right, "start2", "end2")
    if not b.n:
        return left.join(right.limit(0), "chr")
    hit = (F.col("start") <= F.col("end2")) & (F.col("start2") <= F.col("end"))
    l = left.filter((F.col("start") <= b.last) & (F.col("end") >= b.first))  # open ends of the left side need no bins beyond the right one
    l = l.withColumn("_bin", b.of(F.greatest("start", F.lit(b.first)), F.least("end", F.lit(b.last))))
    return l.join(b.cut(right, bound), ["chr", "_bin"]).filter(hit & (F.col("_bin") == b.at(F.greatest("start", "start2")))).drop("_bin")


def _edges(regions: DataFrame) -> DataFrame:
    return regions.select(F.col("chr").alias("_chr"), F.col("start").alias("_s"), F.col("end").alias("_e"), "_bin")


def contained(rows: DataFrame, chrom: str, pos: str, regions: DataFrame, negate: bool = False, bound: int = 500_000) -> DataFrame:
    """Rows whose position lies in one of the regions (closed bounds), or in none of them; by a join on (chr, bin)."""
    b = Binning(regions)
    hit = (F.col(chrom) == F.col("_chr")) & (b.at(F.col(pos)) == F.col("_bin")) & F.col(pos).between(F.col("_s"), F.col("_e"))
    r = _edges(b.cut(regions, bound))
    return rows.join(r, hit, "left_anti") if negate else rows.where(b.reach(chrom, pos)).join(r, hit, "left_semi")


def contained_anywhere(rows: DataFrame, pos: str, regions: DataFrame, negate: bool = False, bound: int = 500_000) -> DataFrame:
    """As contained for regions of any chromosome: a join on the bin of the position alone."""
    b = Binning(regions)
    hit = (b.at(F.col(pos)) == F.col("_bin")) & F.col(pos).between(F.col("_s"), F.col("_e"))
    return rows.join(_edges(b.cut(regions, bound)).drop("_chr"), hit, "left_anti" if negate else "left_semi")


def flagged(rows: DataFrame, chrom: str, pos: str, regions: DataFrame, flag: str, bound: int = 500_000) -> DataFrame:
    """rows with a flag: whether the position lies in one of the regions (merged, closed bounds; chr '' is any chromosome);
    null where chromosome or position is. Merged regions do not overlap, so no row is repeated."""
    b = Binning(regions)
    at = (b.at(F.col(pos)) == F.col("_bin")) & F.col(pos).between(F.col("_s"), F.col("_e"))
    here, anywhere = (_edges(b.cut(regions.filter(c), bound)) for c in ("chr <> ''", "chr = ''"))
    out = rows.join(here, (F.col(chrom) == F.col("_chr")) & at, "left").withColumn("_in1", F.col("_s").isNotNull()).drop("_chr", "_s", "_e", "_bin")
    out = out.join(anywhere.drop("_chr"), at, "left").withColumn("_in2", F.col("_s").isNotNull()).drop("_s", "_e", "_bin")
    known = F.col(chrom).isNotNull() & F.col(pos).isNotNull()
    return out.withColumn(flag, F.when(known, F.col("_in1") | F.col("_in2"))).drop("_in1", "_in2")
