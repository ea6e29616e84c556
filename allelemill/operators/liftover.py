"""Conversion of coordinates between reference builds through tables of blocks.

Chain tables: (chr, start, end, new_chr, off, rev). A point p of a forward block becomes p - off; of a reverse block
end - off - (p - start), and its alleles are reverse-complemented.

Points need no shuffle: blocks are gathered per (chr, bin) into one sorted array (a bin of 2^20 positions holds at most
so many blocks), that table is joined by hash, and first, last or all matches are picked within the row.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.builds import normalise_build
from ..functions.genome import reverse_complement
from ..scale import cut, small
from . import intervals as I
from .regions import RegionSet

BOUND = 100_000


def block_index(chain: DataFrame) -> DataFrame:
    """(_chr, _bin, _blocks): the blocks of each bin in order of start, end and offset."""
    b = chain.filter("start <= end").select("chr", "new_chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("off").cast("long").alias("off"), "rev")
    b = b.select(F.col("chr").alias("_chr"), F.explode(F.sequence(F.floor(F.col("start") / I.BIN), F.floor(F.col("end") / I.BIN))).alias("_bin"), F.struct("start", "end", "off", "new_chr", "rev").alias("b"))
    return b.groupBy("_chr", "_bin").agg(F.array_sort(F.collect_set("b")).alias("_blocks"))


def moved(block: Column, p: Column) -> Column:
    return F.when(block["rev"], block["end"] - block["off"] - (p - block["start"])).otherwise(p - block["off"]).cast("int")


def lift_points(
    df: DataFrame, chain: DataFrame, multi: str = "first", drop_unlifted: bool = True, chrom: str = "chr", pos: str = "pos", alleles: Sequence[str] = ("ref", "alt"), match_no: str | None = None
) -> DataFrame:
    """df with chrom and pos converted in place. multi: first, last or all of several matches (by start of the block).
    Rows without match are dropped, or kept with null coordinates. match_no names a further column that numbers the matches of a row from 0."""
    if multi not in MULTI:
        raise ValueError("multi must be first, last or all")
    out = df.join(small(block_index(chain), BOUND), (F.col(chrom) == F.col("_chr")) & (F.floor(F.col(pos) / I.BIN) == F.col("_bin")), "left")
    hits = F.filter("_blocks", lambda b: (b["start"] <= F.col(pos)) & (F.col(pos) <= b["end"]))
    number = F.lit(0)
    if multi == "all":
        out = out.select("*", (F.posexplode if drop_unlifted else F.posexplode_outer)(hits).alias("_k", "_b"))
        number = F.coalesce("_k", F.lit(0))
    else:
        out = out.withColumn("_b", F.try_element_at(hits, F.lit(1 if multi == "first" else -1)))
        out = out.filter("_b is not null") if drop_unlifted else out
    b, kinds = F.col("_b"), dict(df.dtypes)
    new = {chrom: b["new_chr"], pos: moved(b, F.col(pos)).cast(kinds[pos])}
    new |= {a: F.when(b["rev"], reverse_complement(F.col(a))).otherwise(F.col(a)) for a in alleles if a in df.columns}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns], *([number.alias(match_no)] if match_no else []))


MULTI = ("first", "last", "all")


def lift_ranges(df: DataFrame, chain: DataFrame, chrom: str = "chr", drop_unlifted: bool = True, multi: str = "all", alleles: Sequence[str] = (), match_no: str | None = None) -> DataFrame:
    """df with start and end converted to where the part of a range that meets a block comes to lie. multi as in lift_points;
    rows without match, or without chromosome, start or end, are dropped or kept with null coordinates."""
    if multi not in MULTI:
        raise ValueError("multi must be first, last or all")
    rest = [c for c in df.columns if c not in (chrom, "start", "end")]
    whole = multi == "all" and drop_unlifted and not match_no  # then no row needs to be known again
    rows = df if whole else cut(df.withColumn("_id", F.monotonically_increasing_id()))
    left = rows.select(F.col(f"`{chrom}`").alias("chr"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.struct(F.lit(1).alias("_one"), *[F.col(f"`{c}`") for c in rest]).alias("_rest"), *([] if whole else ["_id"]))
    right = chain.select("chr", F.col("start").cast("long").alias("start2"), F.col("end").cast("long").alias("end2"), "new_chr", F.col("off").cast("long").alias("_off"), F.col("rev").alias("_rev"))
    j = I.overlaps(left.filter("start <= end"), right, BOUND)
    s, e = F.greatest("start", "start2"), F.least("end", "end2")
    there = lambda p: F.when(F.col("_rev"), F.col("end2") - F.col("_off") - (p - F.col("start2"))).otherwise(p - F.col("_off")).cast("int")
    j = j.select("_rest", *([] if whole else ["_id"]), F.struct("start2", "end2", "_off", F.col("new_chr").alias("c"), F.least(there(s), there(e)).alias("s"), F.greatest(there(s), there(e)).alias("e"), F.col("_rev").alias("rev")).alias("_b"))
    number = F.lit(0)
    if not whole:
        if multi == "all":
            j = j.groupBy("_id").agg(F.first("_rest").alias("_rest"), F.array_sort(F.collect_list("_b")).alias("_b")).select("_id", "_rest", F.posexplode("_b").alias("_k", "_b"))  # the blocks of one range
            number = F.coalesce("_k", F.lit(0))
        else:
            j = j.groupBy("_id").agg(F.first("_rest").alias("_rest"), (F.min if multi == "first" else F.max)("_b").alias("_b"))
        if not drop_unlifted:
            lost = left.join(j.select("_id"), "_id", "left_anti").select("_id", "_rest", F.lit(None).cast(j.schema["_b"].dataType).alias("_b"))
            j = j.unionByName(lost, allowMissingColumns=True)
    b = F.col("_b")
    new = {chrom: b["c"], "start": b["s"], "end": b["e"]}
    value = lambda c: F.when(b["rev"], reverse_complement(F.col(f"_rest.`{c}`"))).otherwise(F.col(f"_rest.`{c}`")) if c in alleles else F.col(f"_rest.`{c}`")
    return j.select(*[new[c].alias(c) if c in new else value(c).alias(c) for c in df.columns], *([number.alias(match_no)] if match_no else []))


def lift_regions(regions: RegionSet, chain: DataFrame, target: str | None = None) -> RegionSet:
    """Regions converted and merged again; what has no block vanishes, regions of any chromosome go through all blocks.
    An excluded set stays excluded. A set without build comes back as it is, with a warning."""
    if regions.build is None and target is not None:
        warnings.warn("regions without a build are not lifted", stacklevel=2)
        return regions
    target = normalise_build(target)
    if target is not None and regions.build == target:
        return regions
    c = I.closed(regions.df)
    free = c.filter("chr = ''")
    if free.limit(1).count():
        every = chain.select(F.lit("").alias("chr"), F.col("chr").alias("_c")).groupBy("chr").agg(F.collect_set("_c").alias("_all"))  # the chromosomes of a genome
        c = c.join(F.broadcast(every), "chr", "left").select(F.explode(F.coalesce("_all", F.array("chr"))).alias("chr"), "start", "end")
    return RegionSet(I.opened(I.merge(lift_ranges(c, chain))), target, regions.include)


def lift_table(
    df: DataFrame, chains: dict[tuple[str, str], DataFrame], target: str, source: str, multi: str = "first", drop_unlifted: bool = True, retain_builds: bool = False, use_cache: bool = True, keep_order: bool = False
) -> DataFrame:
    """A table with chr and pos, or with start, end or both, from one build to another. A lone start or end is a point. Columns
    ``<name>_<target>`` that are there hold earlier results and are used where not null; ``retain_builds`` keeps the old and the
    new values as such columns. ``keep_order`` sorts the result by the order of the input and the matches of each row."""
    source, target = normalise_build(source, False), normalise_build(target, False)
    have = set(df.columns)
    at = [c for c in ("start", "end") if c in have]
    if "pos" in have and at:
        raise ValueError("a table to lift has both pos and start or end")
    if "chr" not in have or not ("pos" in have or at):
        raise ValueError("a table to lift needs chr and pos, start or end")
    at = at or ["pos"]
    names = ["chr", *at, *[c for c in ("ref", "alt") if c in have]]
    if retain_builds:
        for c in names:
            if f"{c}_{source}" not in df.columns:
                df = df.withColumn(f"{c}_{source}", F.col(c))
    if source == target:
        return df
    if (source, target) not in chains:
        raise ValueError(f"no chain table from {source} to {target}")
    order = ["_row", "_match"] if keep_order else []
    df = cut(df.withColumn("_row", F.monotonically_increasing_id())) if keep_order else df

    def lifted(x: DataFrame) -> DataFrame:
        no = "_match" if keep_order else None
        if len(at) == 1:
            return lift_points(x, chains[(source, target)], multi, drop_unlifted, pos=at[0], match_no=no)
        return lift_ranges(x, chains[(source, target)], drop_unlifted=drop_unlifted, multi=multi, alleles=[c for c in ("ref", "alt") if c in have], match_no=no)

    if use_cache and all(f"{c}_{target}" in have for c in ["chr", *at]):
        known = F.lit(True)
        for c in ["chr", *at]:
            known = known & F.col(f"{c}_{target}").isNotNull()
        old = df.filter(known)
        for c in names:
            if f"{c}_{target}" in have:
                old = old.withColumn(c, F.col(f"{c}_{target}"))
        out = (old.withColumn("_match", F.lit(0)) if keep_order else old).unionByName(lifted(df.filter(~known)))
    else:
        out = lifted(df)
    if retain_builds:
        for c in names:
            out = out.withColumn(f"{c}_{target}", F.col(c))
    return out.orderBy(*order).drop(*order) if keep_order else out
