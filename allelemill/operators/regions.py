"""Sets of genomic regions and their algebra.

A set is a lazy DataFrame (chr, start, end) with 1-based closed intervals; null chr means any chromosome, null start or
end an open end. ``include=False`` means everything but these regions. Such sets stay symbolic through the algebra, so no
domain of chromosomes is needed until one is to be written out (``expand``) or a region of any chromosome loses part of
one.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.builds import normalise_build
from ..functions.genome import AUTOSOMES, with_chr
from . import intervals as I

SCHEMA = "chr string, start int, end int"
FEW = 8  #: up to so many regions a filter is one Boolean expression that reaches the scan; with more, one hash lookup is cheaper


def _column(v: object, n: int) -> list:
    x = list(v) if isinstance(v, (list, tuple, range)) else [v]
    if len(x) == 1:
        return x * n
    if len(x) != n:
        raise ValueError("chr, start and end must have one length")
    return x


@dataclass(frozen=True)
class RegionSet:
    df: DataFrame
    build: str | None = None
    include: bool = True
    chains: dict = field(default_factory=dict, compare=False)  # (from, to) -> chain table, used where builds differ
    done: bool = field(default=False, compare=False)  # the rows are known to be merged

    # ---- making

    @staticmethod
    def of(spark: SparkSession, chr: object = None, start: object = None, end: object = None, build: str | None = None, include: bool = True, merge: bool = True, prefix: str = "chr") -> RegionSet:
        """From values or equally long lists; single values are repeated, a missing axis is unconstrained."""
        n = max((len(v) for v in (chr, start, end) if isinstance(v, (list, tuple, range))), default=1)
        rows = []
        for c, s, e in zip(_column(chr, n), _column(start, n), _column(end, n)):
            if s is not None and e is not None and e < s:
                raise ValueError(f"end {e} lies before start {s}")
            c = None if c is None else str(c) if str(c).startswith(prefix) else prefix + str(c)
            rows.append((c, None if s is None else int(s), None if e is None else int(e)))
        out = RegionSet(I.held(spark, rows, SCHEMA) if n <= I.FEW else spark.createDataFrame(rows, SCHEMA), normalise_build(build), include, done=n == 1)
        return out.merged() if merge else out

    @staticmethod
    def from_df(df: DataFrame, build: str | None = None, include: bool = True, merge: bool = True) -> RegionSet:
        missing = {"chr", "start", "end"} - set(df.columns)
        if missing:
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
        d = df.select(with_chr(F.col("chr").cast("string")).alias("chr"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
        out = RegionSet(d, normalise_build(build), include)
        return out.merged() if merge else out

    @staticmethod
    def empty(spark: SparkSession, build: str | None = None) -> RegionSet:
        return RegionSet(I.held(spark, [], SCHEMA), normalise_build(build), done=True)

    @staticmethod
    def full(spark: SparkSession, build: str | None = None) -> RegionSet:
        return RegionSet(I.held(spark, [(None, None, None)], SCHEMA), normalise_build(build), done=True)

    def _with(self, closed: DataFrame, include: bool = True) -> RegionSet:
        return RegionSet(I.opened(closed), self.build, include, self.chains, True)

    # ---- looking

    def rows(self, limit: int = 1000) -> list[tuple]:
        """Up to limit regions in order, for reports and tests."""
        order = [F.col("chr").asc_nulls_first(), F.coalesce("start", F.lit(0))]
        return [tuple(r) for r in self.df.orderBy(*order).limit(limit).collect()]

    def is_full(self) -> bool:
        return self.include and self.df.filter("chr is null and start is null and end is null").limit(1).count() == 1

    def __str__(self) -> str:
        def one(c: str | None, s: int | None, e: int | None) -> str:
            at = "" if s is None and e is None else f":{'*' if s is None else s}-{'*' if e is None else e}"
            return f"{c or '*'}{at}"

        return ("" if self.include else "!") + "{" + ", ".join(one(*r) for r in self.rows(20)) + "}"

    def __repr__(self) -> str:
        return f"{'Included' if self.include else 'Excluded'} regions {self} (build {self.build})"

    def where(self, condition: Column | str) -> RegionSet:
        """A subset of the rows; build and include stay."""
        return RegionSet(self.df.where(condition), self.build, self.include, self.chains, self.done)

    # ---- algebra

    def merged(self) -> RegionSet:
        return self if self.done else self._with(I.merge(I.closed(self.df)), self.include)

    def _merged_rows(self) -> DataFrame:
        """The rows merged, with closed bounds."""
        return I.closed(self.df) if self.done else I.merge(I.closed(self.df))

    def __invert__(self) -> RegionSet:
        return RegionSet(self.df, self.build, not self.include, self.chains, self.done)

    __neg__ = __invert__

    def _aligned(self, other: RegionSet) -> RegionSet:
        """other in the build of this set: lifted with a warning if there is a chain table for it."""
        if not self.build or not other.build or self.build == other.build:
            return other
        chain = {**other.chains, **self.chains}.get((other.build, self.build))
        if chain is None:
            raise ValueError(f"builds differ: {self.build} and {other.build}; lift one of them first")
        from .liftover import lift_regions

        warnings.warn(f"regions in {other.build} are lifted to {self.build}", stacklevel=3)
        return lift_regions(other, chain, self.build)

    def _chromosomes(self, bound: int = 10_000) -> list[str]:
        return [c for c in self._names(bound) if c]

    def _names(self, bound: int = 10_000) -> list[str]:
        """The chromosomes of the rows, with '' for any."""
        got = [r[0] for r in self.df.select(F.coalesce("chr", F.lit(""))).distinct().limit(bound + 1).collect()]
        if len(got) > bound:
            raise ValueError(f"more than {bound} chromosomes")
        return sorted(got)

    def __or__(self, other: RegionSet) -> RegionSet:
        other = self._aligned(other)
        if self.include and other.include:
            return self._with(I.merge(I.closed(self.df).unionByName(I.closed(other.df))))
        if not self.include and not other.include:
            return ~(~self & ~other)
        plain, left_out = (self, other) if self.include else (other, self)
        return ~((~left_out) - plain)

    __add__ = __or__

    def __and__(self, other: RegionSet) -> RegionSet:
        other = self._aligned(other)
        if not self.include and not other.include:
            return ~(~self | ~other)
        if not self.include:
            return other - ~self
        if not other.include:
            return self - ~other
        mine, theirs = self._names(), other._names()
        plain = "" not in mine and "" not in theirs  # then what merged sets share is merged, too
        a = self._merged_rows() if plain else I.merge(_spread(self, [c for c in theirs if c]))
        b = other._merged_rows() if plain else I.merge(_spread(other, [c for c in mine if c]))
        both = I.overlaps(a, b.select("chr", F.col("start").alias("start2"), F.col("end").alias("end2")))
        both = both.select("chr", F.greatest("start", "start2").alias("start"), F.least("end", "end2").alias("end"))
        return self._with(both if plain else I.merge(both))

    def __sub__(self, other: RegionSet, domain: Sequence[str] = AUTOSOMES) -> RegionSet:
        other = self._aligned(other)
        if not other.include:
            return self & ~other
        if not self.include:
            return ~(~self | other)
        mine, theirs = self._chromosomes(), other._chromosomes()
        a = I.closed(self.df)
        if theirs:  # a region of any chromosome that loses part of one must be written out
            every = F.array(*[F.lit(c) for c in sorted({*mine, *theirs, *domain})])
            a = a.select(F.explode(F.when(F.col("chr") == "", every).otherwise(F.array("chr"))).alias("chr"), "start", "end")
        a = I.merge(a)
        names = sorted({*mine, *theirs, *domain})
        b = I.merge(_spread(other, names))
        left = I.gaps(b, a.select("chr").distinct(), first=0).select("chr", F.col("start").alias("start2"), F.col("end").alias("end2"))
        kept = I.overlaps(a, left).select("chr", F.greatest("start", "start2").alias("start"), F.least("end", "end2").alias("end"))
        return self._with(I.merge(kept))

    def expand(self, domain: Sequence[str] = AUTOSOMES) -> RegionSet:
        """The same set written out as included regions of the chromosomes of the domain."""
        if self.include:
            return self
        spark = self.df.sparkSession
        chromosomes = I.held(spark, [(c,) for c in domain], "chr string")
        return self._with(I.gaps(I.merge(_spread(RegionSet(self.df), list(domain))), chromosomes)).__tidy()

    def __tidy(self) -> RegionSet:
        whole = (F.coalesce("start", F.lit(1)) <= 1) & F.col("end").isNull()
        return RegionSet(self.df.withColumn("start", F.when(whole, F.lit(None)).otherwise(F.col("start")).cast("int")), self.build, self.include, self.chains, True)

    def equals(self, other: RegionSet, domain: Sequence[str] = AUTOSOMES) -> bool:
        def plain(x: RegionSet) -> DataFrame:
            names = sorted({*domain, *self._chromosomes(), *other._chromosomes()})
            d = I.merge(_spread(x.expand(names), names)).filter("chr <> ''")
            return d.withColumn("start", F.greatest("start", F.lit(1)))

        a, b = plain(self), plain(other)
        return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0

    def compact(self, domain: Sequence[str] = AUTOSOMES) -> RegionSet:
        """Whichever of the equivalent forms has fewest rows: this one, written out, or the written-out complement left out."""
        forms = [self, self.expand(domain), ~(~self).expand(domain)]
        return min(forms, key=lambda r: r.df.count())

    @staticmethod
    def concat(sets: Iterable[RegionSet], merge: bool = True) -> RegionSet:
        """All rows of sets of one kind and build."""
        sets = list(sets)
        if len({s.include for s in sets}) > 1:
            raise ValueError("included and excluded regions cannot be bound together")
        sets = [sets[0], *[sets[0]._aligned(s) for s in sets[1:]]]
        out = RegionSet(reduce(DataFrame.unionByName, [s.df for s in sets]), sets[0].build, sets[0].include)
        return out.merged() if merge else out

    # ---- filtering

    def filter(self, rows: DataFrame, chrom: str = "chr", pos: str = "pos") -> DataFrame:
        """Rows whose position lies in the set; null positions never do. Few regions become an expression that is pushed
        to the scan, more of them a join on chromosome and bin (broadcast if its size allows)."""
        got = self.df.limit(FEW + 1).collect()
        known = F.col(chrom).isNotNull() & F.col(pos).isNotNull()
        if len(got) <= FEW:
            cond = expression([tuple(r) for r in got], chrom, pos)
            return rows.where(cond if self.include else known & ~cond)
        m = self._merged_rows()
        keyed, here, anywhere = rows.where(known), m.filter("chr <> ''"), m.filter("chr = ''")
        if not anywhere.limit(1).count():
            return I.contained(keyed, chrom, pos, m, negate=not self.include)
        if not self.include:
            return I.contained(I.contained_anywhere(keyed, pos, anywhere, negate=True), chrom, pos, here, negate=True)
        rest = I.contained(I.contained_anywhere(keyed, pos, anywhere, negate=True), chrom, pos, here)
        return I.contained_anywhere(keyed, pos, anywhere).unionByName(rest)


def _spread(r: RegionSet, names: list[str]) -> DataFrame:
    """Closed rows; those of any chromosome also for each of the given ones."""
    every = F.array(*[F.lit(c) for c in ["", *names]])
    return I.closed(r.df).select(F.explode(F.when(F.col("chr") == "", every).otherwise(F.array("chr"))).alias("chr"), "start", "end")


def expression(regions: list[tuple], chrom: str = "chr", pos: str = "pos") -> Column:
    """Position in one of a few regions (chr, start, end). A conjunct on the chromosomes alone helps partition pruning."""
    if not regions:
        return F.lit(False)
    parts = []
    for c, s, e in regions:
        p = F.col(chrom) == c if c is not None else F.col(chrom).isNotNull()
        if s is not None:
            p = p & (F.col(pos) >= s)
        if e is not None:
            p = p & (F.col(pos) <= e)
        parts.append(p)
    cond = reduce(lambda a, b: a | b, parts)
    names = {c for c, _, _ in regions}
    return cond if None in names or len(names) < 2 else F.col(chrom).isin(sorted(names)) & cond
