"""Which reference build the coordinates of a table are in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genome import with_chr


def build_counts(stats: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """(build, n_match, n): distinct variants of stats that each build's entries hold at the position, with ref or alt as
    the reference allele and the other one among the alternatives."""
    keys = stats.select(with_chr(F.col("chr").cast("string")).alias("chr"), F.col("pos").cast("int").alias("pos"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt")).dropna().distinct()
    out = None
    for build, entries in references.items():
        e = entries.select(with_chr(F.col("chr").cast("string")).alias("chr"), F.col("pos").cast("int").alias("pos"), F.upper("ref").alias("_r"), F.split(F.upper("alt"), ",").alias("_a"))
        j = keys.join(e, ["chr", "pos"], "left")
        hit = ((F.col("_r") == F.col("ref")) & F.array_contains("_a", F.col("alt"))) | ((F.col("_r") == F.col("alt")) & F.array_contains("_a", F.col("ref")))
        one = j.groupBy("chr", "pos", "ref", "alt").agg(F.max(F.coalesce(hit, F.lit(False))).alias("hit"))
        one = one.agg(F.count_if("hit").alias("n_match"), F.count(F.lit(1)).alias("n")).select(F.lit(build).alias("build"), "n_match", "n")
        out = one if out is None else out.unionByName(one)
    return out


def build_match(stats: DataFrame, references: dict[str, DataFrame], other: str = "b36") -> dict[str, float]:
    """Share of the variants that match each build; what matches none is counted for ``other``."""
    got = build_counts(stats, references).collect()
    n = max((r["n"] for r in got), default=0)
    if not n:
        return {}
    share = {r["build"]: r["n_match"] / n for r in got}
    return share | {other: max(0.0, 1 - sum(share.values()))}


def infer_build(stats: DataFrame, references: dict[str, DataFrame]) -> str | None:
    """The build with the largest share; None without any variant."""
    share = build_match(stats, references)
    return max(sorted(share, reverse=True), key=share.get) if share else None
