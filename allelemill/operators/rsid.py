"""Coordinates for rows that only name an rsid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genome import with_chr
from ..scale import at_most
from .regions import RegionSet


def with_positions(rows: DataFrame, reference: DataFrame, bound: int = 500_000) -> DataFrame:
    """rows joined to (chr, pos) by rsid; chr and pos lead. Rows without an entry are left out, exact copies of entries
    count once. The entries are broadcast if counted to at most ``bound``, else both sides shuffle (AQE splits hot ids)."""
    e = reference.filter("rsid is not null").select(F.col("rsid").alias("_rsid"), with_chr(F.col("chr").cast("string")).alias("chr"), F.col("pos").cast("int").alias("pos"))
    e = F.broadcast(e.distinct()) if at_most(e, bound) else e.distinct()  # counted before anything is shuffled
    rest = [c for c in rows.columns if c not in ("chr", "pos")]
    return rows.select(*[F.col(f"`{c}`") for c in rest]).join(e, F.col("rsid") == F.col("_rsid")).select("chr", "pos", *[F.col(f"`{c}`") for c in rest])


def by_regions(rows: DataFrame, reference: DataFrame, regions: RegionSet) -> DataFrame:
    """Rows whose rsid lies in the regions: the entries are cut to the regions first, so the join stays small."""
    return with_positions(rows, regions.filter(reference.withColumn("chr", with_chr(F.col("chr").cast("string")))))
