"""Tables of variants that know in which build their coordinates are and keep those of other builds.

Columns: chr, pos, ref, alt, variant_id, defining_build and snapshots ``<column>_<build>``. The build of the coordinates
is a property of the Python object, not of the data.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.builds import BUILDS, SYNONYMS, normalise_build
from ..functions.genome import parsed_variant_id, variant_id, with_chr
from ..scale import small
from .liftover import lift_points

COORDINATES = ["chr", "pos", "ref", "alt"]


def record_build(df: DataFrame, build: str, columns: Iterable[str] = COORDINATES) -> DataFrame:
    """Snapshots ``<column>_<build>`` of the columns that have none yet."""
    for c in columns:
        if c in df.columns and f"{c}_{build}" not in df.columns:
            df = df.withColumn(f"{c}_{build}", F.col(c))
    return df


def add_variant_id(df: DataFrame, build: str, overwrite: bool = False) -> DataFrame:
    """variant_id of the coordinates; null if any of them is. One that is there is kept unless overwrite."""
    if "variant_id" in df.columns and not overwrite:
        return df
    return df.withColumn("variant_id", variant_id(F.col("chr"), F.col("pos"), F.col("ref"), F.col("alt"), F.lit(build)))


def inconsistent_ids(df: DataFrame, build: str) -> DataFrame:
    """Rows whose variant_id says other coordinates or another build than the row has."""
    p = parsed_variant_id(F.col("variant_id"))
    same = reduce(lambda a, b: a & b, [p[c].eqNullSafe(F.col(c)) for c in COORDINATES]) & p["build"].eqNullSafe(F.lit(build))
    return df.filter(F.col("variant_id").isNotNull() & ~same)


def check_variant_id(df: DataFrame, build: str) -> DataFrame:
    """df; ValueError names some rows whose variant_id does not agree with them."""
    bad = inconsistent_ids(df, build).select("variant_id").limit(5).collect()
    if bad:
        raise ValueError("variant_id disagrees with the coordinates: " + ", ".join(r[0] for r in bad))
    return df


@dataclass(frozen=True)
class Variants:
    df: DataFrame
    build: str

    @staticmethod
    def of(df: DataFrame | Variants, build: str | None = None) -> Variants:
        """From a table with chr, pos, ref and alt, or with variant_id alone (then the ids' own builds hold and, if they
        differ, ``from_ids`` is the way). Idempotent; a conflicting build is an error."""
        build = normalise_build(build)
        if isinstance(df, Variants):
            if build not in (None, df.build):
                raise ValueError(f"variants are in {df.build}, not {build}")
            return df
        if not set(COORDINATES) <= set(df.columns):
            if "variant_id" in df.columns:
                return Variants.from_ids(df, build)
            raise ValueError("variants need chr, pos, ref and alt, or variant_id")
        if build is None:
            raise ValueError("variants need a build")
        d = df.withColumns({"chr": with_chr(F.col("chr").cast("string")), "pos": F.col("pos").cast("int"), "ref": F.upper(F.col("ref").cast("string")), "alt": F.upper(F.col("alt").cast("string"))})
        if "defining_build" not in d.columns:
            d = d.withColumn("defining_build", F.lit(build))
        return Variants(record_build(add_variant_id(d, build), build), build)

    @staticmethod
    def from_ids(df: DataFrame, build: str | None = None) -> Variants:
        """Coordinates decoded from variant_id; columns that are there fill what the ids lack. Rows keep the build that
        their id names as defining_build; build (default: the newest one named) says in which the coordinates count,
        rows of other builds keep theirs as snapshots and have null coordinates until they are lifted."""
        p = parsed_variant_id(F.col("variant_id"))
        d = df.withColumn("_p", p)
        if build is None:
            named = [r[0] for r in d.select(F.col("_p.build").alias("b")).filter("b is not null").distinct().limit(100).collect()]
            build = max((normalise_build(b) for b in named), default=None)
            if build is None:
                raise ValueError("no variant_id names a build")
        canonical = F.col("_p.build")
        for b in BUILDS:
            canonical = F.when(F.col("_p.build").isin(*[x for x in _tags(b)]), F.lit(b)).otherwise(canonical)
        d = d.withColumn("defining_build", F.coalesce(canonical, F.lit(build)))
        here = F.col("defining_build") == build
        for c in COORDINATES:
            own = F.col(c).cast("int" if c == "pos" else "string") if c in df.columns else F.lit(None).cast("int" if c == "pos" else "string")
            value = F.coalesce(F.col(f"_p.{c}"), own)
            for b in BUILDS:
                if b != build:
                    d = d.withColumn(f"{c}_{b}", F.when(F.col("defining_build") == b, value))
            d = d.withColumn(c, F.when(here, value))
        return Variants(record_build(d.drop("_p"), build), build)

    def recorded(self) -> list[str]:
        """Builds of which snapshots are there."""
        return [b for b in BUILDS if f"pos_{b}" in self.df.columns]

    def lift(self, target: str, chains: dict[tuple[str, str], DataFrame], source: str = "best", multi: str = "first") -> Variants:
        """Coordinates in another build. Each row goes by its best source: coordinates recorded for the target, else its
        defining build, else the present one, else the newest other with coordinates (or by the one named). Rows without
        match are kept with null coordinates; variant_id and snapshots follow."""
        target = normalise_build(target, False)
        if target == self.build and source == "best":
            return self
        known = self.recorded()
        has = lambda b: F.col(f"pos_{b}").isNotNull()
        df = self.df
        if source == "best":
            choice = F.when(has(target), F.lit(target)) if target in known else F.when(F.lit(False), F.lit(""))
            for b in known:
                choice = choice.when((F.col("defining_build") == b) & has(b), F.lit(b))
            choice = choice.when(F.col("pos").isNotNull(), F.lit(self.build))
            for b in sorted(known, reverse=True):
                choice = choice.when(has(b), F.lit(b))
        else:
            choice = F.lit(self.build if source == "current" else normalise_build(source, False))
        df = df.withColumn("_from", choice)
        for c in COORDINATES:
            value = F.when(F.col("_from") == self.build, F.coalesce(F.col(f"{c}_{self.build}"), F.col(c)) if self.build in known else F.col(c))
            for b in known:
                if b != self.build:
                    value = value.when(F.col("_from") == b, F.col(f"{c}_{b}"))
            df = df.withColumn(f"_v_{c}", value)
        cols = [f"_v_{c}" for c in COORDINATES]
        parts = [df.filter((F.col("_from") == target) | F.col("_from").isNull())]
        for b in sorted({self.build, *known} - {target}):
            part = df.filter(F.col("_from") == b)
            if (b, target) in chains:
                parts.append(lift_points(part, chains[(b, target)], multi, False, "_v_chr", "_v_pos", ("_v_ref", "_v_alt")))
            else:
                parts.append(part.withColumns({c: F.lit(None).cast(dict(df.dtypes)[c]) for c in cols}))
        out = reduce(DataFrame.unionByName, parts)
        lost = F.col("_v_pos").isNull()
        out = out.withColumns({c: F.when(~lost, F.col(f"_v_{c}")) for c in COORDINATES})
        out = out.withColumns({f"{c}_{target}": F.col(c) for c in COORDINATES}).drop("_from", *cols)
        return Variants(add_variant_id(out, target, overwrite=True), target)

    def unique(self) -> Variants:
        """One row per chr, pos, ref and alt, whatever the snapshots say: that with the smallest variant_id and values."""
        rest = [c for c in self.df.columns if c not in COORDINATES]
        return Variants(self.df.groupBy(*COORDINATES).agg(F.min(F.struct(*rest)).alias("_r")).select(*COORDINATES, "_r.*").select(*self.df.columns), self.build)

    @staticmethod
    def concat(tables: Iterable[Variants], chains: dict | None = None, target: str | None = None, multi: str = "first") -> Variants:
        """All rows in the build of the first table (or the target), missing columns filled with null."""
        tables = list(tables)
        target = normalise_build(target) or tables[0].build
        lifted = [t if t.build == target else t.lift(target, chains or {}, multi=multi) for t in tables]
        return Variants(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.df for t in lifted]), target)

    def __repr__(self) -> str:
        return f"Variants in {self.build}: {', '.join(self.df.columns)}"


def _tags(build: str) -> list[str]:
    return [build, *[k for k, v in SYNONYMS.items() if v == build]]


# ---- filtering by identity


def locate(rows: DataFrame, variants: Variants, bound: int = 500_000) -> DataFrame:
    """Rows with the position and the two alleles of one of the variants, in either order; nothing is flipped. Variants
    that lack a part are left out. The keys are broadcast if counted to at most ``bound``, else both sides shuffle."""
    missing = set(COORDINATES) - set(rows.columns)
    if missing:
        raise ValueError(f"rows need {', '.join(sorted(missing))} to be located")
    a, b = F.upper("ref"), F.upper("alt")
    keys = variants.df.select(with_chr(F.col("chr")).alias("_c"), F.col("pos").alias("_p"), F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"), F.col("ref").alias("_r"), F.col("alt").alias("_t"))
    keys = keys.filter("_c is not null and _p is not null and _r is not null and _t is not null").select("_c", "_p", "_a", "_b").distinct()
    on = (with_chr(F.col("chr")) == F.col("_c")) & (F.col("pos") == F.col("_p")) & (F.least(a, b) == F.col("_a")) & (F.greatest(a, b) == F.col("_b"))
    return rows.filter(F.col("ref").isNotNull() & F.col("alt").isNotNull()).join(small(keys, bound), on, "left_semi")
