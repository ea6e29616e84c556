"""Summary-statistics files as lazy tables with standard columns.

    source = StatsSource.open(spark, "trait.tsv.gz", build="b37")
    source["chr == 1 & pval < 5e-8"]        source[RegionSet...]        source[Variants...]        source.head(10)

Opening reads a bounded sample on the driver, which tells the layout; if the file is longer, one aggregate over all of it tells
the types, so that every value of a column has a place in its type. Everything else is one projection over a text scan, so
Catalyst prunes the columns and places the filter. A gzip file cannot be split: stage it as Parquet for repeated use (``stage``).
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.builds import normalise_build
from ..functions.genome import effect_ordered, reference_allele, with_chr
from ..functions.statistics import complete_missing_stats
from ..operators import liftover as L
from ..operators.regions import FEW, RegionSet
from ..operators.variants import Variants, locate
from ..plans.aliases import standard_names
from ..plans.predicate import ALLELES, InRegions, Predicate, RegionTable, TableValues, conjuncts, parse, positional, with_tables
from .sniff import MISSING, ColumnSpec, Layout, layout


@dataclass(frozen=True)
class StatsSource:
    table: DataFrame  # standard columns, lazily
    layout: Layout | None = None
    path: str | None = None
    build: str | None = None
    reference: DataFrame | None = None  # rsid, chr, pos of the build, for files without coordinates
    chains: dict = field(default_factory=dict)

    # ---- opening

    @staticmethod
    def open(
        spark: SparkSession, path: str, build: str | None = "auto", extra_names: dict[str, list[str]] | None = None, names: dict[str, list[str]] | None = None, trait_vcf: bool = True,
        reference: DataFrame | None = None, references: dict[str, DataFrame] | None = None, chains: dict | None = None, sample_lines: int = 600, types: str = "file",
    ) -> StatsSource:
        """A text file: comments, trimmed header marks, separator, names, packed columns and types are detected.

        build auto infers it from ``references`` (see infer_build) where they are given; files indexed by rsid count as b38.
        types "file" looks at all values of the file; "sample" trusts the first lines and lets a later value that does not
        fit end the query with an error.
        """
        if types not in ("file", "sample"):
            raise ValueError("types must be file or sample")
        first = [r[0] for r in spark.read.text(path).limit(sample_lines).collect()]
        lay = layout([x.rstrip("\r") for x in first], standard_names(extra_names, names), trait_vcf=trait_vcf)
        for w in lay.warnings:
            warnings.warn(w, stacklevel=2)
        if len(first) == sample_lines and types == "file":
            widen_types(spark, path, lay)
        src = StatsSource(_scan(spark, path, lay, strict=types == "sample"), lay, path, None, reference, chains or {})
        if build == "auto":
            if lay.needs_rsid:
                build = "b38"
            elif references and {"chr", "pos", "ref", "alt"} <= set(src.columns):
                from ..operators.build_inference import infer_build

                build = infer_build(src.table.limit(10_000), references)
            else:
                build = None
        return replace(src, build=normalise_build(build))

    @staticmethod
    def from_table(df: DataFrame, build: str | None = None, extra_names: dict[str, list[str]] | None = None, **more: Any) -> StatsSource:
        """A table that is there already (Parquet, a view): names are standardised, chr and alleles made canonical."""
        std = standard_names(extra_names)
        seen: set[str] = set()
        out = []
        for c in df.columns:
            name = std.get(c, c)
            name = c if name in seen or (name == "rsid" and c != "rsid") else name
            seen.add(name)
            out.append(_canonical(name, F.col(f"`{c}`")).alias(name))
        return StatsSource(df.select(*out), None, None, normalise_build(build), **more)

    # ---- looking

    @property
    def columns(self) -> list[str]:
        return list(self.table.columns)

    @property
    def needs_rsid(self) -> bool:
        have = set(self.columns)
        return "rsid" in have and not {"chr", "pos"} <= have

    def __repr__(self) -> str:
        lay = self.layout
        text = f"Statistics {self.path or 'table'}\n  columns: {', '.join(self.columns)}\n  build: {self.build}\n  rsid-indexed: {self.needs_rsid}"
        if lay:
            quoted = [c.name for c in lay.columns if c.quoted]
            text += f"\n  separator: {lay.sep!r}, comments: {lay.comment!r}, trimmed: {lay.trim!r}, gzipped: {str(self.path).endswith('.gz')}, quoted: {', '.join(quoted) or 'none'}"
        return text

    # ---- reading

    def read(self) -> DataFrame:
        """All rows, with the statistics that can be derived."""
        return complete_missing_stats(self.table)

    def head(self, n: int = 1) -> DataFrame:
        return self.read().limit(n)

    def stage(self, path: str, by: Sequence[str] = ("chr",)) -> StatsSource:
        """Written as Parquet by chromosome and sorted by position, and read from there: filters then prune files and row
        groups."""
        by = [c for c in by if c in self.columns]
        df = self.table.repartition(*[F.col(c) for c in by]) if by else self.table
        (df.sortWithinPartitions(*by, "pos") if "pos" in self.columns else df).write.mode("overwrite").partitionBy(*by).parquet(path)
        return replace(self, table=self.table.sparkSession.read.parquet(path).select(*self.columns), layout=None, path=path)

    def __getitem__(self, condition: Any) -> DataFrame:
        return self.filter(condition)

    def filter(self, condition: Any = None, nlines: int | None = None, values: dict[str, Any] | None = None) -> DataFrame:
        """Rows that meet a condition: text, Predicate, Column, RegionSet or Variants; at most nlines of them."""
        out = self._filtered(condition, values or {})
        out = complete_missing_stats(out)
        return out if nlines is None else out.limit(nlines)

    def explain(self, condition: Any = None) -> str:
        """The physical plan that a filter would run."""
        return self.filter(condition)._jdf.queryExecution().explainString(self.table.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _filtered(self, condition: Any, values: dict[str, Any]) -> DataFrame:
        if condition is None:
            return self.table
        if isinstance(condition, Column):
            return self.table.where(condition)
        if isinstance(condition, RegionSet):
            wanted = self._lifted(condition)
            if not self.needs_rsid:
                return wanted.filter(self.table)
            if self.reference is None:
                return self._placed()
            from ..operators.rsid import by_regions

            return by_regions(self.table, self.reference, wanted)
        if isinstance(condition, Variants):
            if self.needs_rsid:
                raise ValueError("a file indexed by rsid has no coordinates to locate variants by")
            v = condition
            if self.build and v.build != self.build:
                v = v.lift(self.build, self.chains)
            return locate(self.table, v)
        spark = self.table.sparkSession
        if isinstance(condition, str):
            shown = {k: _embedded(k, self._lifted(v)) if isinstance(v, RegionSet) else TableValues(k, v) if isinstance(v, DataFrame) else v for k, v in values.items()}
            condition = parse(condition, [*self.columns, "chr", "pos"], shown)
        if not isinstance(condition, Predicate):
            raise ValueError(f"{condition!r} is no condition")
        condition = with_tables(condition, spark)
        table = self._placed(condition) if self.needs_rsid and condition.columns() & {"chr", "pos"} else self.table
        columns = table.columns
        whole, rest = conjuncts(condition)
        for t in whole:  # value sets that every row has to be in
            table = t.values.within(table, t.name)
        if rest is None:
            return table
        for t in rest.tables():
            table = t.joined(table)
        return table.where(rest.column(dict(table.dtypes))).select(*[f"`{c}`" for c in columns])

    def _placed(self, condition: Predicate | None = None) -> DataFrame:
        """The table with coordinates; files indexed by rsid get them from the reference entries (leading columns), which are
        cut beforehand by what the condition says of positions."""
        if not self.needs_rsid:
            return self.table
        if self.reference is None:
            raise ValueError("a positional condition on a file indexed by rsid needs reference entries")
        from ..operators.rsid import with_positions

        entries = self.reference.withColumn("chr", with_chr(F.col("chr").cast("string")))
        if condition is not None:
            entries = entries.where(positional(condition).column(dict(entries.dtypes)))
        return with_positions(self.table, entries)

    def _lifted(self, r: RegionSet) -> RegionSet:
        if r.build is None and self.build is None or r.build == self.build:
            return r
        if r.build is None or self.build is None:
            if r.df.limit(1).count() == 0:
                return r
            raise ValueError(f"regions are in build {r.build}, the file is in {self.build}")
        if (r.build, self.build) not in self.chains:
            raise ValueError(f"no chain table from {r.build} to {self.build}")
        return L.lift_regions(r, self.chains[(r.build, self.build)], self.build)


def _embedded(key: str, r: RegionSet) -> Predicate:
    """A set of regions within an expression: a few as a condition that the scan can use, more as a table that is joined."""
    rows = r.df.limit(FEW + 1).collect()
    return InRegions(tuple(tuple(x) for x in rows), r.include) if len(rows) <= FEW else RegionTable(key, r)


def _canonical(name: str, c: Column) -> Column:
    if name == "chr":
        return with_chr(c.cast("string"))
    return F.upper(c.cast("string")) if name in ALLELES else c


_WHOLE, _DECIMAL = r"^[+-]?[0-9]{1,18}$", r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[Ii]nf)$"
_YES, _NO = ["TRUE", "T", "true"], ["FALSE", "F", "false"]


def _filled(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin(sorted(MISSING)), t)


def _typed(c: Column, kind: str, strict: bool = False) -> Column:
    v = _filled(c)
    if kind == "string":
        return v
    if kind == "boolean":
        known = F.when(v.isin(_YES), True).when(v.isin(_NO), False)
        return known.when(v.isNotNull(), F.raise_error(F.concat(F.lit("not a truth value: "), v)).cast("boolean")) if strict else known
    v = F.regexp_replace(v, "^([+-]?)[Ii]nf$", "$1Infinity") if kind == "double" else v
    return v.cast(kind) if strict else v.try_cast(kind)


def widen_types(spark: SparkSession, path: str, lay: Layout) -> None:
    """Sets the type of each column to the narrowest that all values of the file have: one aggregate over the file. Columns
    that the sample shows to be text stay text."""
    plain = [p for p in lay.columns if p.derived is None and p.name not in ("chr", "rsid", "variant_id", *ALLELES) and (p.kind != "string" or p.unseen)]
    if not plain:
        return
    sums = []
    for i, p in enumerate(plain):
        v = _filled(F.col(f"`{i}`"))
        sums += [
            F.count(v).alias(f"n{i}"), F.count_if(~v.isin(_YES + _NO)).alias(f"boolean{i}"), F.count_if(v.isNotNull() & (~v.rlike(_WHOLE) | v.try_cast("int").isNull())).alias(f"int{i}"),
            F.count_if(~v.rlike(_WHOLE)).alias(f"bigint{i}"), F.count_if(~v.rlike(_DECIMAL)).alias(f"double{i}"),
        ]
    got = _rows(spark, path, lay).select(*[_raw(p).alias(str(i)) for i, p in enumerate(plain)]).agg(*sums).first()
    for i, p in enumerate(plain):
        p.kind = next((k for k in ("boolean", "int", "bigint", "double") if got[f"n{i}"] and not got[f"{k}{i}"]), "string")


def _rows(spark: SparkSession, path: str, lay: Layout) -> DataFrame:
    """(r): the data lines of a file as structs of text."""
    text = spark.read.text(path)
    line = F.regexp_replace("value", "\r$", "")
    keep = (F.trim(line) != "") & (line != lay.header_line)
    if lay.comment:
        keep = keep & ~line.startswith(lay.comment)
    if lay.trim:
        line = F.when(line.startswith(lay.trim), F.substr(line, F.lit(len(lay.trim) + 1))).otherwise(line)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(lay.names))])
    return text.where(keep).select(F.from_csv(line, schema.simpleString()[7:-1].replace(":", " "), {"sep": lay.sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": ""}).alias("r"))


def _raw(p: ColumnSpec) -> Column:
    c = F.col(f"r.c{p.index}")
    return c if p.part is None else F.try_element_at(F.split(c, p.split), F.lit(p.part + 1))


def _scan(spark: SparkSession, path: str, lay: Layout, strict: bool = False) -> DataFrame:
    value = {p.name: p for p in lay.columns}

    def column(p: ColumnSpec) -> Column:
        if p.derived in ("ref_of_pair", "alt_of_pair"):
            whole = F.split(F.col(f"r.c{p.index}"), "/")
            eff = next(x for x in lay.columns if x.part is None and x.index >= 0 and x is not value[p.name] and standard_names().get(x.input_name) == "alt")
            ref, alt = effect_ordered(F.try_element_at(whole, F.lit(1)), F.try_element_at(whole, F.lit(2)), F.trim(F.col(f"r.c{eff.index}")))
            return ref if p.derived == "ref_of_pair" else alt
        if p.derived == "ref_of_alleles":
            a, b, alt = (F.upper(_typed(_raw(value[n]), "string")) for n in ("allele1", "allele2", "alt"))
            return reference_allele(a, b, alt)
        return _canonical(p.name, _typed(_raw(p), p.kind, strict))

    return _rows(spark, path, lay).select(*[column(p).alias(p.name) for p in lay.columns])
