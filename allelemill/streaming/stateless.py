"""The row operators on streams. Filters, projections and joins with static tables keep no state, so the same functions
run on a streaming DataFrame; aggregates over event time need a watermark."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.statistics import complete_missing_stats
from ..operators.liftover import lift_points
from ..operators.regions import RegionSet
from ..operators.variants import Variants, locate
from ..plans.predicate import Predicate, parse


def filtered(stream: DataFrame, condition: Any) -> DataFrame:
    """Rows of a stream that meet a text, a Predicate, a RegionSet or Variants (the latter two static)."""
    if isinstance(condition, RegionSet):
        return condition.filter(stream)
    if isinstance(condition, Variants):
        return locate(stream, condition)
    p = condition if isinstance(condition, Predicate) else parse(condition, stream.columns)
    return stream.where(p.column(dict(stream.dtypes)))


def lifted(stream: DataFrame, chain: DataFrame, multi: str = "first") -> DataFrame:
    return lift_points(stream, chain, multi)


def completed(stream: DataFrame) -> DataFrame:
    return complete_missing_stats(stream)


def windowed_counts(stream: DataFrame, at: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows per key and window of event time; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All available rows once, exactly once, into Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
