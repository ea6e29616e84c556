"""Queries of the engine's own operators over views of the test tables, each with its SQL.

The views give the star-schema tables the shape of summary statistics, regions, chain blocks and reference entries; their
definitions are valid in Spark and DuckDB alike.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics as S
from ..functions.genome import AUTOSOMES, effect_ordered, parsed_variant_id, reference_allele, reverse_complement, variant_id
from ..operators import build_inference, liftover, rsid, variants
from ..operators.regions import RegionSet
from ..operators.variants import Variants
from ..plans.predicate import col, parse
from ..scale import checkpoint_dir
from ..sources import reference as ref_store
from ..sources.chain import SCHEMA as CHAIN_SCHEMA
from ..sources.chain import blocks
from ..sources.stats_source import StatsSource
from ..tables import table

# ---- views

V_STATS = [
    "'chr' || cast(l_partkey % 22 + 1 AS string) AS chr",
    "cast((l_orderkey * 7 + l_linenumber) % 1000000 + 1 AS int) AS pos",
    "substr('ACGT', cast(l_suppkey % 4 + 1 AS int), 1) AS ref",
    "substr('ACGT', cast((l_suppkey + 1 + l_linenumber % 3) % 4 + 1 AS int), 1) AS alt",
    "round(l_discount - 0.05, 4) AS effect",
    "round(l_tax + 0.01, 4) AS effect_se",
    "round((l_quantity + 1) / 100, 4) AS pval",
    "'rs' || cast(l_partkey AS string) AS rsid",
]
V_REGIONS = [
    "'chr' || cast(s_suppkey % 22 + 1 AS string) AS chr",
    "cast((s_suppkey * 3571) % 90000 + 1 AS int) AS start",
    "cast((s_suppkey * 3571) % 90000 + (s_suppkey % 7) * 5000 + 1000 AS int) AS `end`",
]
V_CHAIN = [
    "'chr' || cast(n_nationkey % 22 + 1 AS string) AS chr",
    "cast((n_regionkey + r_regionkey) * 15000 + 1 AS int) AS start",
    "cast((n_regionkey + r_regionkey) * 15000 + 20000 AS int) AS `end`",
    "'chr' || cast(n_nationkey % 22 + 1 AS string) AS new_chr",
    "cast(n_nationkey * 13 + r_regionkey * 7 - 100 AS int) AS off",
    "((n_nationkey + r_regionkey) % 5 = 0) AS rev",
]
V_REFERENCE = [
    "'rs' || cast(p_partkey AS string) AS rsid",
    "'chr' || cast(p_partkey % 22 + 1 AS string) AS chr",
    "cast((p_partkey * 37) % 100000 + 1 AS int) AS pos",
    "substr('ACGT', cast(p_partkey % 4 + 1 AS int), 1) AS ref",
    "substr('ACGT', cast((p_partkey + 1 + p_size % 3) % 4 + 1 AS int), 1) AS alt",
]
V_MARKER = [
    "'b37-c' || cast(l_partkey % 22 + 1 AS string) || ':' || cast((l_orderkey * 7 + l_linenumber) % 1000000 + 1 AS string) || '-123' AS MarkerName",
    "lower(substr('ACGT', cast(l_suppkey % 4 + 1 AS int), 1)) || '/' || substr('ACGT', cast((l_suppkey + 2) % 4 + 1 AS int), 1) AS SNPAlleles",
    "round(l_discount - 0.05, 4) AS beta",
]


def _sql(cols: list[str]) -> str:
    return ", ".join(cols).replace("`end`", "end_pos").replace("AS start", "AS start_pos")


WITH = (
    f"WITH v AS (SELECT {_sql(V_STATS)} FROM lineitem), r AS (SELECT {_sql(V_REGIONS)} FROM supplier), "
    f"c AS (SELECT {_sql(V_CHAIN)} FROM nation CROSS JOIN region), e AS (SELECT {_sql(V_REFERENCE)} FROM part), k AS (SELECT {_sql(V_MARKER)} FROM lineitem) "
)


def stats(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").selectExpr(*V_STATS)


def source(s: SparkSession, d: str, build: str | None = "b37") -> StatsSource:
    return StatsSource.from_table(stats(s, d), build)


def regions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").selectExpr(*V_REGIONS)


def region_set(s: SparkSession, d: str, merge: bool = False) -> RegionSet:
    return RegionSet.from_df(regions(s, d), "b37", merge=merge)


def chain(s: SparkSession, d: str) -> DataFrame:
    n, r = table(s, d, "nation"), table(s, d, "region").select("r_regionkey")
    keys = [x[0] for x in r.limit(100).collect()]  # the five regions
    return n.withColumn("r_regionkey", F.explode(F.array(*[F.lit(x) for x in keys]))).selectExpr(*V_CHAIN)


def reference(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").selectExpr(*V_REFERENCE)


def markers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").selectExpr(*V_MARKER)


def as_text(df: DataFrame) -> StatsSource:
    """df staged as tab-separated text with a header, in the folder that executors share, and opened from there."""
    path = f"{checkpoint_dir(df.sparkSession)}/text-{uuid.uuid4().hex}"
    df.write.option("sep", "\t").option("header", True).csv(path)
    return StatsSource.open(df.sparkSession, path, build=None)


def as_commented_text(df: DataFrame, names: list[str], comment: str = "## made for reading") -> StatsSource:
    """df staged as tab-separated text: each part has comment lines, a header with a mark before its first name, the rows
    with quoted first values, and a comment at its end."""
    spark, path, kinds = df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/text-{uuid.uuid4().hex}", df.columns

    def run(batches):  # type: ignore[no-untyped-def]
        import pandas as pd

        yield pd.DataFrame({"value": [comment, "#" + "\t".join(names)]})
        for pdf in batches:
            cells = [pdf[c].astype(str) for c in kinds]
            cells[0] = '"' + cells[0] + '"'
            yield pd.DataFrame({"value": cells[0].str.cat(cells[1:], sep="\t")})
        yield pd.DataFrame({"value": [comment, ""]})

    df.selectExpr(*[f"coalesce(cast({c} AS string), 'NA') AS {c}" for c in kinds]).mapInPandas(run, "value string").write.text(path)
    return StatsSource.open(spark, path, build=None)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = WITH + sql
        return f

    return keep


# ---- predicates


@query("SELECT * FROM v WHERE ((chr = 'chr5' AND pos >= 1200 AND pos < 15000) OR (chr = 'chr17' AND pos <= 7700)) AND pval <= 0.2")
def flagship_region_pval(s: SparkSession, d: str) -> DataFrame:
    return source(s, d)["((chr == 5 & pos >= 1200 & pos < 15000) | (chr == 17 & pos <= 7700)) & pval <= 0.2"]


@query("SELECT chr, count(*) AS n, round(min(pval), 6) AS best FROM v WHERE pval < 0.25 AND EXISTS (SELECT 1 FROM r WHERE r.chr = v.chr AND v.pos BETWEEN start_pos AND end_pos) GROUP BY chr")
def filter_regions_significant(s: SparkSession, d: str) -> DataFrame:
    hits = region_set(s, d, True).filter(source(s, d)[col("pval") < 0.25])
    return hits.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("pval"), 6).alias("best"))


for _name, _op, _text, _sqltext in (
    ("filter_lt", "<", "pval < 0.05", "pval < 0.05"), ("filter_le", "<=", "pval <= 0.05", "pval <= 0.05"), ("filter_gt", ">", "pval > 0.45", "pval > 0.45"), ("filter_ge", ">=", "0.5 <= pval", "pval >= 0.5"),
    ("filter_eq", "==", 'ref == "a" & chr == "2"', "ref = 'A' AND chr = 'chr2'"), ("filter_neq", "!=", "effect != 0 & chr == 7", "effect <> 0 AND chr = 'chr7'"),
    ("filter_col_vs_col", "<", "effect < effect_se & chr == 4", "effect < effect_se AND chr = 'chr4'"),
    ("filter_in_small", "%in%", 'rsid %in% c("rs1", "rs5", "rs77")', "rsid IN ('rs1', 'rs5', 'rs77')"),
    ("filter_grepl", "grepl", 'grepl("^rs[[:digit:]]7$", rsid)', "regexp_matches(rsid, '^rs[0-9]7$')"), ("filter_like", "%like%", 'rsid %like% "99$"', "regexp_matches(rsid, '99$')"),
    ("filter_or_mixed", "|", "(chr == 1 & pos < 3000) | pval < 0.03", "(chr = 'chr1' AND pos < 3000) OR pval < 0.03"),
    ("filter_not_pos", "!=", "chr == 1 & pos != 1001 & pos < 5000", "chr = 'chr1' AND pos <> 1001 AND pos < 5000"), ("filter_not_chr", "!=", "chr != 1 & pos < 500", "chr <> 'chr1' AND pos < 500"),
    ("filter_chr_range", "<", "chr < 4 & pos <= 2000 | 20 < chr & pos <= 1000", "(cast(substr(chr, 4) AS int) < 4 AND pos <= 2000) OR (cast(substr(chr, 4) AS int) > 20 AND pos <= 1000)"),
    ("filter_contradiction", "&", "chr == 1 & chr != 1", "chr = 'chr1' AND chr <> 'chr1'"), ("filter_tautology", "|", "(chr == 1 | chr != 1) & pos < 300", "pos < 300"),
    ("filter_grouped", "()", "!(pval < 0.4) & (pos < 2000 | pos > 999000)", "NOT pval < 0.4 AND (pos < 2000 OR pos > 999000)"),
):

    def _run(s: SparkSession, d: str, text: str = _text) -> DataFrame:
        return source(s, d)[text]

    query(f"SELECT * FROM v WHERE {_sqltext}", _name)(_run)


@query("SELECT v.* FROM v WHERE rsid IN (SELECT 'rs' || cast(s_suppkey AS string) FROM supplier)")
def filter_in_large(s: SparkSession, d: str) -> DataFrame:
    """A value set from a table, which is joined."""
    wanted = table(s, d, "supplier").selectExpr("'rs' || cast(s_suppkey AS string) AS rsid")
    return source(s, d).filter("rsid %in% wanted", values={"wanted": wanted})


def _sorted(s: SparkSession, d: str) -> StatsSource:
    """The rows in a fixed order, so that the first ones are the same each time."""
    v = stats(s, d)
    return StatsSource.from_table(v.orderBy(*v.columns), "b37")


@query("SELECT * FROM v ORDER BY chr, pos, ref, alt, effect, effect_se, pval, rsid LIMIT 25")
def head_n(s: SparkSession, d: str) -> DataFrame:
    return _sorted(s, d).head(25)


@query("SELECT * FROM v WHERE pval < 0.1 ORDER BY chr, pos, ref, alt, effect, effect_se, pval, rsid LIMIT 40")
def nlines_filter(s: SparkSession, d: str) -> DataFrame:
    return _sorted(s, d).filter("pval < 0.1", nlines=40)


@query("SELECT * FROM v WHERE cast(substr(rsid, 3) AS int) <= 3000 AND NOT rsid IN (SELECT 'rs' || cast(s_suppkey AS string) FROM supplier) AND pval < 0.3")
def filter_in_list_large(s: SparkSession, d: str) -> DataFrame:
    """A literal list too long for an expression is joined as a table, beside a negated lookup in another table."""
    known = table(s, d, "supplier").selectExpr("'rs' || cast(s_suppkey AS string) AS rsid")
    return source(s, d).filter("rsid %in% wanted & !(rsid %in% known) & pval < 0.3", values={"wanted": [f"rs{i}" for i in range(3001)], "known": known})


@query("SELECT v.* FROM v WHERE pval < 0.02 OR (effect > 0 AND EXISTS (SELECT 1 FROM r WHERE r.chr = v.chr AND v.pos BETWEEN start_pos AND end_pos))")
def filter_regions_in_expression(s: SparkSession, d: str) -> DataFrame:
    return source(s, d).filter("pval < 0.02 | (effect > 0 & mine)", values={"mine": region_set(s, d, True)})


# ---- columns


@query("SELECT chr, pos, count(*) AS n, round(sum(effect), 6) AS effect FROM v GROUP BY chr, pos")
def standardise_names(s: SparkSession, d: str) -> DataFrame:
    named = stats(s, d).selectExpr("substr(chr, 4) AS SNPChr", "pos AS SNPPos", "effect AS MetaBeta")
    return StatsSource.from_table(named).table.groupBy("chr", "pos").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("effect"), 6).alias("effect"))


@query("SELECT split_part(split_part(MarkerName, '-c', 2), ':', 1) AS chr, cast(split_part(split_part(MarkerName, ':', 2), '-', 1) AS int) AS pos, split_part(MarkerName, '-c', 1) AS build, beta FROM k")
def decode_marker_build(s: SparkSession, d: str) -> DataFrame:
    t = as_text(markers(s, d)).read()
    return t.select(F.regexp_replace("chr", "^chr", "").alias("chr"), "pos", "build", F.col("effect").alias("beta"))


_TEXT_SQL = "SELECT chr, pos, ref, alt, effect, CASE WHEN pos % 7 > 0 THEN effect_se END AS effect_se, pval, CASE WHEN pos > 500000 THEN pos + 0.5e0 ELSE cast(pos AS double) END AS score, rsid FROM v"


def _text(s: SparkSession, d: str) -> StatsSource:
    """A text file with comments, header marks, quoted values, missing values, alleles in lower case, chromosomes without
    prefix, and a column that holds whole numbers in its first lines only."""
    v = stats(s, d).selectExpr("substr(chr, 4) AS chr", "pos", "lower(ref) AS ref", "alt", "effect", "CASE WHEN pos % 7 > 0 THEN effect_se END AS se", "pval", "CASE WHEN pos > 500000 THEN cast(pos + 0.5D AS string) ELSE cast(pos AS string) END AS score", "rsid")
    return as_commented_text(v, ["CHROM", "POS", "REF", "ALT", "BETA", "SE", "P", "score", "rsid"])


@query(_TEXT_SQL)
def text_scan(s: SparkSession, d: str) -> DataFrame:
    return _text(s, d).read().withColumn("score", F.col("score").cast("double"))


@query(f"SELECT chr, count(*) AS n, round(sum(effect), 6) AS effect FROM ({_TEXT_SQL}) WHERE pval < 0.05 AND (chr = 'chr3' OR pos < 40000) GROUP BY chr")
def text_filter(s: SparkSession, d: str) -> DataFrame:
    return _text(s, d)["pval < 0.05 & (chr == 3 | pos < 40000)"].groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("effect"), 6).alias("effect"))


@query("SELECT upper(split_part(SNPAlleles, '/', 1)) AS ref, upper(split_part(SNPAlleles, '/', 2)) AS alt, count(*) AS n FROM k GROUP BY 1, 2")
def decode_snpalleles(s: SparkSession, d: str) -> DataFrame:
    return as_text(markers(s, d)).read().groupBy("ref", "alt").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT chr, pos, CASE WHEN ref < alt AND ref = alt THEN alt ELSE ref END AS ref, alt FROM v")
def ref_from_a1_a2(s: SparkSession, d: str) -> DataFrame:
    """allele1 and allele2 in alphabetical order; the reference allele is the one that is not alt."""
    a1, a2 = F.least("ref", "alt"), F.greatest("ref", "alt")
    return stats(s, d).select("chr", "pos", reference_allele(a1, a2, F.col("alt")).alias("ref"), "alt")


@query("SELECT chr, pos, ref, alt FROM v")
def effect_allele_pair(s: SparkSession, d: str) -> DataFrame:
    """Packed alleles in alphabetical order beside the effect allele: alt comes out as the effect allele."""
    ref, alt = effect_ordered(F.lower(F.least("ref", "alt")), F.lower(F.greatest("ref", "alt")), F.col("alt"))
    return stats(s, d).select("chr", "pos", ref.alias("ref"), alt.alias("alt"))


@query("SELECT upper(lower(ref)) AS ref, alt, chr, count(*) AS n FROM v GROUP BY 1, 2, 3")
def allele_upper_chr_prefix(s: SparkSession, d: str) -> DataFrame:
    raw = stats(s, d).selectExpr("lower(ref) AS NEA", "lower(alt) AS EA", "substr(chr, 4) AS CHROM")
    return StatsSource.from_table(raw).table.groupBy("ref", "alt", "chr").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT cast(split_part(x, ':', 1) AS double) AS effect, cast(split_part(x, ':', 2) AS double) AS effect_se, cast(split_part(x, ':', 3) AS double) AS log10p FROM (SELECT cast(effect AS string) || ':' || cast(effect_se AS string) || ':2.5' AS x FROM v)")
def trait_vcf_decode(s: SparkSession, d: str) -> DataFrame:
    """Values packed by a FORMAT of ES:SE:LP."""
    packed = F.concat_ws(":", F.col("effect").cast("string"), F.col("effect_se").cast("string"), F.lit("2.5"))
    fixed = {"QUAL": ".", "FILTER": "PASS", "INFO": ".", "FORMAT": "ES:SE:LP"}
    vcf = stats(s, d).select(F.col("chr").alias("CHROM"), F.col("pos").alias("POS"), F.col("rsid").alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), *[F.lit(v).alias(k) for k, v in fixed.items()], packed.alias("trait1"))
    return as_text(vcf).read().select("effect", "effect_se", "log10p")


# ---- regions

_MERGED = """m0 AS (SELECT chr, start_pos, end_pos, CASE WHEN max(end_pos) OVER w + 1 < start_pos OR max(end_pos) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM r
 WINDOW w AS (PARTITION BY chr ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 m1 AS (SELECT *, sum(n) OVER (PARTITION BY chr ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM m0),
 m AS (SELECT chr, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM m1 GROUP BY chr, g)"""


def _shown(r: RegionSet) -> DataFrame:
    return r.df.select("chr", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query(f", {_MERGED} SELECT * FROM m")
def region_merge(s: SparkSession, d: str) -> DataFrame:
    return _shown(region_set(s, d).merged())


_SHIFT = "(SELECT chr, start_pos + 30000 AS start_pos, end_pos + 30000 AS end_pos FROM r WHERE end_pos < 60000)"


def _second(s: SparkSession, d: str) -> RegionSet:
    return RegionSet.from_df(regions(s, d).filter("`end` < 60000").selectExpr("chr", "start + 30000 AS start", "`end` + 30000 AS `end`"), "b37")


@query(", r2 AS (SELECT * FROM r UNION ALL SELECT * FROM " + _SHIFT + "), " + _MERGED.replace("FROM r\n", "FROM r2\n") + " SELECT * FROM m")
def region_union(s: SparkSession, d: str) -> DataFrame:
    return _shown(region_set(s, d) | _second(s, d))


_SECOND = re.sub(r"\bm([01]?)\b", r"s\1", _MERGED).replace("FROM r\n", f"FROM {_SHIFT} q\n")



_GAPS = """{name} AS (SELECT chr, coalesce(lag(end_pos) OVER (PARTITION BY chr ORDER BY start_pos), {first} - 1) + 1 AS start_pos, start_pos - 1 AS end_pos FROM {of}
 UNION ALL SELECT chr, max(end_pos) + 1, 2147483647 FROM {of} GROUP BY chr)"""
_CUT = "SELECT a.chr, greatest(a.start_pos, b.start_pos) AS start_pos, least(a.end_pos, b.end_pos) AS end_pos FROM {0} a JOIN {1} b ON a.chr = b.chr AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos AND b.start_pos <= b.end_pos"
_REST = " UNION ALL SELECT chr, start_pos, end_pos FROM {0} WHERE chr NOT IN (SELECT chr FROM {1})"


@query(f", {_MERGED}, {_SECOND} " + _CUT.format("m", "s"))
def region_intersect(s: SparkSession, d: str) -> DataFrame:
    return _shown(region_set(s, d) & _second(s, d))


@query(f", {_MERGED}, {_SECOND}, g AS (SELECT * FROM ({'WITH ' + _GAPS.format(name='g0', of='s', first=0)} SELECT * FROM g0)) " + _CUT.format("m", "g") + _REST.format("m", "s"))
def region_difference(s: SparkSession, d: str) -> DataFrame:
    return _shown(region_set(s, d) - _second(s, d))


@query(
    f", {_MERGED}, d AS (SELECT 'chr' || cast(i AS string) AS chr FROM range(1, 23) t(i)), g AS (SELECT * FROM ({'WITH ' + _GAPS.format(name='g0', of='m', first=1)} SELECT * FROM g0) WHERE start_pos <= end_pos)"
    " SELECT chr, start_pos, CASE WHEN end_pos < 2147483647 THEN end_pos END AS end_pos FROM g UNION ALL SELECT chr, NULL, NULL FROM d WHERE chr NOT IN (SELECT chr FROM m)"
)
def region_complement(s: SparkSession, d: str) -> DataFrame:
    return _shown((~region_set(s, d)).expand())


@query(f", {_MERGED}, {_SECOND}, g AS (SELECT * FROM ({'WITH ' + _GAPS.format(name='g0', of='m', first=0)} SELECT * FROM g0)), x AS (" + _CUT.format("s", "g") + _REST.format("s", "m") + ") SELECT *, false AS include FROM x")
def region_union_mixed(s: SparkSession, d: str) -> DataFrame:
    """Regions or what lies outside of others: comes out as regions left out."""
    u = region_set(s, d) | ~_second(s, d)
    return _shown(u).withColumn("include", F.lit(u.include))


@query(f", b AS (SELECT chr, start_pos, end_pos FROM r UNION ALL SELECT 'chrX', 5, 90 UNION ALL SELECT 'chrX', 91, 100 UNION ALL SELECT * FROM r WHERE end_pos < 30000), {_MERGED.replace('FROM r' + chr(10), 'FROM b' + chr(10))} SELECT * FROM m WHERE start_pos < 80000")
def region_concat_subset(s: SparkSession, d: str) -> DataFrame:
    a = region_set(s, d)
    more = RegionSet.of(s, chr="X", start=[5, 91], end=[90, 100], build="b37", merge=False)
    return _shown(RegionSet.concat([a, more, a.where("`end` < 30000")]).where("start < 80000"))


@query("SELECT v.* FROM v WHERE EXISTS (SELECT 1 FROM r WHERE v.pos BETWEEN start_pos AND start_pos + 40) OR (v.chr = 'chr2' AND v.pos BETWEEN 500 AND 90000)")
def region_filter_any_chromosome(s: SparkSession, d: str) -> DataFrame:
    """Many regions of any chromosome beside one of a single chromosome."""
    a = RegionSet.from_df(regions(s, d).selectExpr("cast(NULL AS string) AS chr", "start", "start + 40 AS `end`"), "b37")
    return source(s, d)[a | RegionSet.of(s, chr=2, start=500, end=90000, build="b37")]


_CONDITIONS = [
    ("chr < 4 & pos > 100", [(f"chr{i}", 101, None) for i in (1, 2, 3)]),
    ("20 < chr", [("chr21", None, None), ("chr22", None, None)]),
    ("pos < 1000", [(None, None, 999)]),
    ("pos >= 50 & pos <= 70", [(None, 50, 70)]),
    ("(chr == 1 | chr == \"X\") & 123 <= pos & pos <= 234", [("chr1", 123, 234), ("chrX", 123, 234)]),
    ("chr %in% c(1, 7) & pos %in% c(5, 6, 9)", [(c, s, e) for c in ("chr1", "chr7") for s, e in ((5, 6), (9, 9))]),
    ("pos == 7 | pval < 0.1", [(None, None, None)]),
    ("chr == 2 & pval < 0.1", [("chr2", None, None)]),
    ("chr == 1 & chr == 2", []),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({', '.join('NULL' if x is None else repr(x) for x in (i, *row))})" for i, (_, rows) in enumerate(_CONDITIONS) for row in rows) + ") t(condition_no, chr, start_pos, end_pos)")
def predicate_regions(s: SparkSession, d: str) -> DataFrame:
    """The regions that conditions can hold in."""
    each = [_shown(parse(text).regions(s)).select(F.lit(i).alias("condition_no"), "chr", "start_pos", "end_pos") for i, (text, _) in enumerate(_CONDITIONS)]
    return reduce(DataFrame.unionByName, each)


@query(
    f", {_MERGED}, {_SECOND}, d AS (SELECT 'chr' || cast(i AS string) AS chr FROM range(1, 23) t(i)),"
    " o AS (SELECT d.chr, CASE WHEN count(m.chr) = 0 THEN 1 WHEN min(m.start_pos) > 1 THEN count(*) + 1 ELSE count(*) END AS n FROM d LEFT JOIN m ON m.chr = d.chr GROUP BY d.chr)"
    " SELECT NOT EXISTS (SELECT * FROM m EXCEPT SELECT * FROM s) AND NOT EXISTS (SELECT * FROM s EXCEPT SELECT * FROM m) AS equal_second,"
    " NOT EXISTS (SELECT * FROM m EXCEPT SELECT * FROM m) AS equal_self, cast(least((SELECT count(*) FROM m), (SELECT sum(n) FROM o)) AS bigint) AS n_compact"
)
def region_equality_compact(s: SparkSession, d: str) -> DataFrame:
    """Equality of sets, also of a set with the written-out complement left out, and the size of the compact form."""
    a, b = region_set(s, d, True), _second(s, d)
    return s.createDataFrame([(a.equals(b), a.equals(~((~a).expand())), a.compact().df.count())], "equal_second boolean, equal_self boolean, n_compact long")


@query("SELECT v.* FROM v WHERE EXISTS (SELECT 1 FROM r WHERE r.chr = v.chr AND v.pos BETWEEN start_pos AND end_pos)")
def region_filter_include(s: SparkSession, d: str) -> DataFrame:
    return source(s, d)[region_set(s, d, True)]


@query("SELECT v.* FROM v WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.chr = v.chr AND v.pos BETWEEN start_pos AND end_pos)")
def region_filter_exclude(s: SparkSession, d: str) -> DataFrame:
    return source(s, d)[~region_set(s, d, True)]


# ---- liftover

_MATCH = """, x AS (SELECT v.chr, v.pos, v.ref, v.alt, v.rsid, v.effect, v.effect_se, v.pval, c.new_chr, c.start_pos AS b, c.end_pos AS z, c.off, c.rev,
 CASE WHEN c.rev THEN c.end_pos - c.off - (v.pos - c.start_pos) ELSE v.pos - c.off END AS new_pos FROM (SELECT *, row_number() OVER () AS id FROM v) v {join} JOIN c ON v.chr = c.chr AND v.pos BETWEEN c.start_pos AND c.end_pos {pick})"""
_COMP = "translate(reverse({0}), 'ACGT', 'TGCA')"
_LIFTED = f"SELECT new_chr AS chr, cast(new_pos AS int) AS pos, CASE WHEN rev THEN {_COMP.format('ref')} ELSE ref END AS ref, CASE WHEN rev THEN {_COMP.format('alt')} ELSE alt END AS alt, effect, effect_se, pval, rsid FROM x"


def _pick(order: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY {order}) = 1"


@query(_MATCH.format(join="", pick="") + _LIFTED)
def liftover_points_all(s: SparkSession, d: str) -> DataFrame:
    return liftover.lift_points(stats(s, d), chain(s, d), "all")


@query(_MATCH.format(join="", pick=_pick("c.start_pos, c.end_pos, c.off")) + _LIFTED)
def liftover_points_first(s: SparkSession, d: str) -> DataFrame:
    return liftover.lift_points(stats(s, d), chain(s, d), "first")


@query(_MATCH.format(join="", pick=_pick("c.start_pos DESC, c.end_pos DESC, c.off DESC")) + _LIFTED)
def liftover_points_last(s: SparkSession, d: str) -> DataFrame:
    return liftover.lift_points(stats(s, d), chain(s, d), "last")


@query(_MATCH.format(join="LEFT", pick=_pick("c.start_pos, c.end_pos, c.off")) + _LIFTED)
def liftover_keep_unlifted(s: SparkSession, d: str) -> DataFrame:
    return liftover.lift_points(stats(s, d), chain(s, d), "first", drop_unlifted=False)


@query(
    """ SELECT c.new_chr AS chr, cast(CASE WHEN rev THEN c.end_pos - off - (least(r.end_pos, c.end_pos) - c.start_pos) ELSE greatest(r.start_pos, c.start_pos) - off END AS int) AS start_pos,
 cast(CASE WHEN rev THEN c.end_pos - off - (greatest(r.start_pos, c.start_pos) - c.start_pos) ELSE least(r.end_pos, c.end_pos) - off END AS int) AS end_pos
 FROM r JOIN c ON r.chr = c.chr AND r.start_pos <= c.end_pos AND c.start_pos <= r.end_pos"""
)
def liftover_ranges(s: SparkSession, d: str) -> DataFrame:
    return liftover.lift_ranges(regions(s, d), chain(s, d)).select("chr", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query(
    """, o AS (SELECT row_number() OVER () AS id, * FROM r) SELECT c.new_chr AS chr, cast(CASE WHEN rev THEN c.end_pos - off - (least(o.end_pos, c.end_pos) - c.start_pos) ELSE greatest(o.start_pos, c.start_pos) - off END AS int) AS start_pos,
 cast(CASE WHEN rev THEN c.end_pos - off - (greatest(o.start_pos, c.start_pos) - c.start_pos) ELSE least(o.end_pos, c.end_pos) - off END AS int) AS end_pos
 FROM o LEFT JOIN c ON o.chr = c.chr AND o.start_pos <= c.end_pos AND c.start_pos <= o.end_pos QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY c.start_pos, c.end_pos, c.off) = 1"""
)
def liftover_ranges_first(s: SparkSession, d: str) -> DataFrame:
    """One match a range; ranges without any are kept."""
    t = liftover.lift_table(regions(s, d), {("b37", "b38"): chain(s, d)}, "b38", "b37", drop_unlifted=False)
    return t.select("chr", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query(_MATCH.format(join="", pick=_pick("c.start_pos, c.end_pos, c.off")).replace("c.new_chr,", "c.new_chr, v.chr AS chr_b37, v.pos AS pos_b37,", 1) + "SELECT rsid, new_chr AS chr, cast(new_pos AS int) AS pos, chr_b37, pos_b37, new_chr AS chr_b38, cast(new_pos AS int) AS pos_b38 FROM x")
def liftover_table_retained(s: SparkSession, d: str) -> DataFrame:
    """A table whose coordinates in both builds are kept; a second lift back takes the recorded ones."""
    chains = {("b37", "b38"): chain(s, d), ("b38", "b37"): chain(s, d)}
    t = liftover.lift_table(stats(s, d).select("rsid", "chr", "pos"), chains, "b38", "b37", retain_builds=True)
    back = liftover.lift_table(t, chains, "b37", "b38", retain_builds=True)
    return back.select("rsid", F.col("chr_b38").alias("chr"), F.col("pos_b38").alias("pos"), F.col("chr").alias("chr_b37"), F.col("pos").alias("pos_b37"), "chr_b38", "pos_b38")


@query(
    "SELECT 'chr' || cast(n_nationkey % 22 + 1 AS string) AS chr, cast(n_nationkey * 1000 + 1 AS int) AS start_pos, cast(n_nationkey * 1000 + 50 + n_regionkey AS int) AS end_pos, cast(50 + n_regionkey AS int) AS width,"
    " 'chr' || cast(n_regionkey + 1 AS string) AS new_chr, cast(CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey * 1000 + 50 + n_regionkey - (1000000 - n_nationkey * 10) ELSE n_nationkey * 990 END AS int) AS off, n_nationkey % 2 = 1 AS rev FROM nation"
)
def chain_file(s: SparkSession, d: str) -> DataFrame:
    """The text of a chain file of one chain a nation, read as blocks."""
    lines = []
    for r in table(s, d, "nation").select("n_nationkey", "n_regionkey").collect():  # a few chains, as in any chain file
        n, width = r["n_nationkey"], 50 + r["n_regionkey"]
        lines += [f"chain 1 chr{n % 22 + 1} 1000000 + {n * 1000} {n * 1000 + width} chr{r['n_regionkey'] + 1} 1000000 {'-' if n % 2 else '+'} {n * 10} {n * 10 + width} {n}", str(width), ""]
    return s.createDataFrame(list(blocks(lines)), CHAIN_SCHEMA).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


_LIFTED_REGIONS = SQL["liftover_ranges"][len(WITH) :]


@query(", r3 AS (" + _LIFTED_REGIONS + "), " + _MERGED.replace("FROM r\n", "FROM r3\n") + " SELECT chr, CASE WHEN start_pos > 0 THEN start_pos END AS start_pos, end_pos FROM m")
def liftover_regions(s: SparkSession, d: str) -> DataFrame:
    return _shown(liftover.lift_regions(region_set(s, d), chain(s, d), "b38"))


@query(f"SELECT ref || alt AS a, {_COMP.format('ref || alt')} AS b, count(*) AS n FROM v GROUP BY 1, 2", "reverse_complement")
def _reverse_complement(s: SparkSession, d: str) -> DataFrame:
    a = F.concat("ref", "alt")
    return stats(s, d).select(a.alias("a"), reverse_complement(F.lower(a)).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


# ---- variants


def _variants(s: SparkSession, d: str) -> Variants:
    return Variants.of(reference(s, d).select("chr", "pos", "ref", "alt", "rsid"), "b37")


@query(
    _MATCH.replace("v.rsid, v.effect, v.effect_se, v.pval", "v.rsid").replace("FROM v) v", "FROM e) v").format(join="LEFT", pick=_pick("c.start_pos, c.end_pos, c.off"))
    + f", y AS (SELECT rsid, chr AS chr_b37, pos AS pos_b37, new_chr AS chr, cast(new_pos AS int) AS pos, CASE WHEN new_chr IS NULL THEN NULL WHEN rev THEN {_COMP.format('ref')} ELSE ref END AS ref, CASE WHEN new_chr IS NULL THEN NULL WHEN rev THEN {_COMP.format('alt')} ELSE alt END AS alt FROM x)"
    " SELECT *, chr || '_' || cast(pos AS string) || '_' || ref || '_' || alt || '_b38' AS variant_id, 'b37' AS defining_build FROM y"
)
def variants_best_source(s: SparkSession, d: str) -> DataFrame:
    v = _variants(s, d).lift("b38", {("b37", "b38"): chain(s, d)})
    return v.df.select("rsid", "chr_b37", "pos_b37", "chr", "pos", "ref", "alt", "variant_id", "defining_build")


@query("SELECT *, chr AS chr_b37, pos AS pos_b37, ref AS ref_b37, alt AS alt_b37 FROM e")
def variants_record_build(s: SparkSession, d: str) -> DataFrame:
    return variants.record_build(reference(s, d), "b37")


@query("SELECT chr || '_' || cast(pos AS string) || '_' || ref || '_' || alt || '_b37' AS variant_id FROM v")
def variant_id_format(s: SparkSession, d: str) -> DataFrame:
    return stats(s, d).select(variant_id(F.col("chr"), F.col("pos"), F.col("ref"), F.col("alt"), F.lit("b37")).alias("variant_id"))


_ID_OK = "regexp_full_match(variant_id, 'chr[^_]+_[0-9]+_[A-Za-z]+_[A-Za-z]+_[A-Za-z0-9]+')"


@query(
    f"SELECT row_id, CASE WHEN {_ID_OK} THEN split_part(variant_id, '_', 1) END AS chr, CASE WHEN {_ID_OK} THEN cast(split_part(variant_id, '_', 2) AS int) END AS pos, "
    f"CASE WHEN {_ID_OK} THEN split_part(variant_id, '_', 3) END AS ref, CASE WHEN {_ID_OK} THEN split_part(variant_id, '_', 4) END AS alt, CASE WHEN {_ID_OK} THEN split_part(variant_id, '_', 5) END AS build FROM sumstats"
)
def variant_id_parse(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sumstats").select("row_id", parsed_variant_id(F.col("variant_id")).alias("p")).select("row_id", "p.*")


@query(f"SELECT count(*) AS n FROM sumstats WHERE variant_id IS NOT NULL AND NOT coalesce({_ID_OK} AND split_part(variant_id, '_', 1) = chr AND cast(split_part(variant_id, '_', 2) AS int) = pos AND split_part(variant_id, '_', 3) = ref AND split_part(variant_id, '_', 4) = alt AND split_part(variant_id, '_', 5) = 'b37', false)")
def variant_id_check(s: SparkSession, d: str) -> DataFrame:
    return variants.inconsistent_ids(table(s, d, "sumstats"), "b37").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'chr' || substr(chr, 4) AS chr, pos, ref, alt, rsid, 'b37' AS defining_build FROM v")
def variants_from_ids(s: SparkSession, d: str) -> DataFrame:
    """Coordinates decoded from ids."""
    ids = stats(s, d).select("rsid", variant_id(F.col("chr"), F.col("pos"), F.col("ref"), F.col("alt"), F.lit("hg19")).alias("variant_id"))
    return Variants.of(Variants.of(ids)).df.select("chr", "pos", "ref", "alt", "rsid", "defining_build")


@query("SELECT DISTINCT chr, pos, ref, alt FROM v")
def variants_unique(s: SparkSession, d: str) -> DataFrame:
    return Variants.of(stats(s, d), "b37").unique().df.select("chr", "pos", "ref", "alt")


@query("SELECT chr, pos, ref, alt, rsid, cast(NULL AS double) AS effect FROM e UNION ALL SELECT chr, pos, ref, alt, NULL, effect FROM v")
def variants_concat(s: SparkSession, d: str) -> DataFrame:
    a, b = _variants(s, d), Variants.of(stats(s, d).select("chr", "pos", "ref", "alt", "effect"), "b37")
    return Variants.concat([a, b]).df.select("chr", "pos", "ref", "alt", "rsid", "effect")


@query("SELECT v.* FROM v WHERE EXISTS (SELECT 1 FROM v w WHERE w.pval < 0.05 AND w.chr = v.chr AND w.pos = v.pos AND least(w.ref, w.alt) = least(v.ref, v.alt) AND greatest(w.ref, w.alt) = greatest(v.ref, v.alt))")
def variant_locate(s: SparkSession, d: str) -> DataFrame:
    wanted = stats(s, d).filter("pval < 0.05").select("chr", "pos", F.col("alt").alias("ref"), F.col("ref").alias("alt"))
    return source(s, d)[Variants.of(wanted, "b37")]


# ---- rsid and builds


@query("SELECT e.chr, e.pos, v.effect, v.pval, v.rsid FROM v JOIN e ON v.rsid = e.rsid WHERE (e.chr = 'chr1' AND e.pos < 50000) OR (e.chr = 'chr2' AND v.pval < 0.1)")
def rsid_position_filter(s: SparkSession, d: str) -> DataFrame:
    t = StatsSource.from_table(stats(s, d).select("effect", "pval", "rsid"), "b37", reference=reference(s, d))
    return t["(chr == 1 & pos < 50000) | (chr == 2 & pval < 0.1)"].select("chr", "pos", "effect", "pval", "rsid")


@query("SELECT e.chr, e.pos, v.effect, v.rsid FROM v JOIN e ON v.rsid = e.rsid WHERE EXISTS (SELECT 1 FROM r WHERE r.chr = e.chr AND e.pos BETWEEN start_pos AND end_pos)")
def rsid_regions(s: SparkSession, d: str) -> DataFrame:
    return rsid.by_regions(stats(s, d).select("effect", "rsid"), reference(s, d), region_set(s, d, True))


@query("SELECT rsid, chr, pos, ref, alt FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.chr = e.chr AND e.pos BETWEEN start_pos AND end_pos)")
def reference_store(s: SparkSession, d: str) -> DataFrame:
    """Entries put into the store from the text of a VCF and read by regions."""
    base = f"{checkpoint_dir(s)}/reference-{uuid.uuid4().hex}"
    cells = [F.expr("substr(chr, 4)"), F.col("pos").cast("string"), "rsid", "ref", "alt", F.lit("."), F.lit("."), F.lit(".")]
    lines = reference(s, d).select(F.concat_ws("\t", *cells).alias("value"))
    lines.write.text(f"{base}/vcf")
    ref_store.ingest(s, f"{base}/vcf", f"{base}/store", "hg19")
    return ref_store.entries(s, f"{base}/store", "b37", region_set(s, d, True)).select("rsid", "chr", "pos", "ref", "alt")


@query("SELECT * FROM v WHERE chr = 'chr6' AND pos > 9000 AND pval < 0.3")
def staged_filter(s: SparkSession, d: str) -> DataFrame:
    """A source written as Parquet by chromosome and sorted by position, filtered from there."""
    return source(s, d).stage(f"{checkpoint_dir(s)}/staged-{uuid.uuid4().hex}")["chr == 6 & pos > 9000 & pval < 0.3"].select(*stats(s, d).columns)


@query("SELECT effect, pval, rsid FROM v WHERE pval < 0.05")
def rsid_plain_filter(s: SparkSession, d: str) -> DataFrame:
    return StatsSource.from_table(stats(s, d).select("effect", "pval", "rsid"), "b37", reference=reference(s, d))["pval < 0.05"].select("effect", "pval", "rsid")


_BUILDS = """, q AS (SELECT DISTINCT chr, CASE WHEN pos % 3 = 0 THEN pos + 1 ELSE pos END AS pos, ref, alt FROM e), o AS (SELECT chr, pos + 5 AS pos, ref, alt FROM e), b AS (
 SELECT 'b37' AS build, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM e WHERE e.chr = q.chr AND e.pos = q.pos AND ((e.ref = q.ref AND e.alt = q.alt) OR (e.ref = q.alt AND e.alt = q.ref)))) AS n_match, count(*) AS n FROM q
 UNION ALL SELECT 'b38', count(*) FILTER (WHERE EXISTS (SELECT 1 FROM o WHERE o.chr = q.chr AND o.pos = q.pos AND ((o.ref = q.ref AND o.alt = q.alt) OR (o.ref = q.alt AND o.alt = q.ref)))), count(*) FROM q)"""


def _builds(s: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All entries with their alleles exchanged, a third of them beside their place, and two references."""
    e = reference(s, d)
    mine = e.select("chr", F.when(F.col("pos") % 3 == 0, F.col("pos") + 1).otherwise(F.col("pos")).alias("pos"), F.col("alt").alias("ref"), F.col("ref").alias("alt"))
    return mine, {"b37": e, "b38": e.withColumn("pos", F.col("pos") + 5)}


@query(_BUILDS + " SELECT * FROM b")
def infer_build_counts(s: SparkSession, d: str) -> DataFrame:
    return build_inference.build_counts(*_builds(s, d))


@query(_BUILDS + ", w AS (SELECT build, n_match FROM b UNION ALL SELECT 'b36', max(n) - sum(n_match) FROM b) SELECT build FROM w ORDER BY n_match DESC, build LIMIT 1")
def infer_build(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(build_inference.infer_build(*_builds(s, d)),)], "build string")


# ---- statistics


@query(f"SELECT pval, effect, round(-abs(effect) / ({S.quantile_sql('pval / 2e0')}), 9) AS effect_se FROM v")
def stats_se_from_p(s: SparkSession, d: str) -> DataFrame:
    return S.complete_missing_stats(stats(s, d).select("pval", "effect")).select("pval", "effect", F.round("effect_se", 9).alias("effect_se"))


@query(f"SELECT effect, effect_se, round({S.two_sided_p_sql('(effect / effect_se)')}, 9) AS pval FROM v")
def stats_p_from_se(s: SparkSession, d: str) -> DataFrame:
    return S.complete_missing_stats(stats(s, d).select("effect", "effect_se")).select("effect", "effect_se", F.round("pval", 9).alias("pval"))


@query(f"SELECT pval, odds_ratio, round(ln(odds_ratio) * {S.LOGISTIC!r}, 9) AS effect, round(-(ln(odds_ratio) * {S.LOGISTIC!r}) / ({S.quantile_sql('pval / 2e0')}), 9) AS effect_se FROM (SELECT pval, round(1 + effect, 4) AS odds_ratio FROM v)")
def stats_from_or(s: SparkSession, d: str) -> DataFrame:
    t = S.complete_missing_stats(stats(s, d).select("pval", F.round(1 + F.col("effect"), 4).alias("odds_ratio")))
    return t.select("pval", "odds_ratio", F.round("effect", 9).alias("effect"), F.round("effect_se", 9).alias("effect_se"))


@query("SELECT z, af, n, round(z / sqrt((n + z * z) * 2 * af * (1 - af)), 9) AS effect, round(1 / sqrt((n + z * z) * 2 * af * (1 - af)), 9) AS effect_se FROM (SELECT effect / effect_se AS z, pval AS af, cast(pos AS double) AS n FROM v)")
def effect_from_zscore(s: SparkSession, d: str) -> DataFrame:
    v = stats(s, d).selectExpr("effect / effect_se AS z", "pval AS af", "cast(pos AS double) AS n")
    e, se = S.effect_from_zscore(F.col("z"), F.col("af"), F.col("n"))
    return v.select("z", "af", "n", F.round(e, 9).alias("effect"), F.round(se, 9).alias("effect_se"))


@query("SELECT cast(date_trunc('hour', ts) AS timestamp) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(s: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming aggregate: the same function on a static table."""
    from ..streaming.stateless import windowed_counts

    return windowed_counts(table(s, d, "events"), "ts", ["event_type"]).select(F.col("window.start").alias("hour"), "event_type", "n")


def _streamed(s: SparkSession, d: str, mode: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream over the events, run until they are all read; each batch replaces (complete) or extends (append) the result."""
    base, path = f"{checkpoint_dir(s)}/stream-{uuid.uuid4().hex}", f"{d}/events.parquet"
    at = s._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = s.readStream.schema(s.read.parquet(path).schema)
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(d)  # a stream reads folders
    keep = lambda batch, no: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")
    work(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out")


@query("SELECT cast(date_trunc('hour', ts) AS timestamp) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(s: SparkSession, d: str) -> DataFrame:
    """Windowed counts of a stream."""
    from ..streaming.stateless import windowed_counts

    t = _streamed(s, d, "complete", lambda x: windowed_counts(x.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"]))
    return t.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE value > 50 AND event_type <> 'click'")
def stream_filter(s: SparkSession, d: str) -> DataFrame:
    """A condition on a stream."""
    from ..streaming.stateless import filtered

    work = lambda x: filtered(x.select("event_id", "user_id", "event_type", "value"), 'value > 50 & event_type != "click"')
    return _streamed(s, d, "append", work)
