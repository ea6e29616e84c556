"""Queries of the problems on texts and linkage over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import linkage as L
from . import mixing as M
from . import packing as P
from . import reading as R


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return L.matches(table(spark, d, "meta_stats"), table(spark, d, "biobank_stats"), "meta_id", "bio_id").select("meta_id", "bio_id")


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of exact copies, each with a confidence."""
    return L.class_matches(table(spark, d, "meta_stats"), table(spark, d, "biobank_stats"), "meta_id", "bio_id")


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the classes that p6_matches names."""
    m = L.members(table(spark, d, "meta_stats"), "meta_id").withColumn("tbl", F.lit("meta_stats"))
    return m.unionByName(L.members(table(spark, d, "biobank_stats"), "bio_id").withColumn("tbl", F.lit("biobank_stats")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return P.fill_containers(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return P.fill_report(p7_containers(spark, d))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return M.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.mixture_report(p8_selection(spark, d), table(spark, d, "mix_targets"))


def p8_marginals(spark: SparkSession, d: str) -> DataFrame:
    return M.marginals(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return R.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_samples")).select("doc_id", "grade")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return R.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_samples"))


QUERIES = {f.__name__: f for f in (p6_found, p6_matches, p6_members, p7_containers, p7_report, p8_selection, p8_shares, p8_marginals, p9_found, p9_levels)}
SQL: dict[str, str] = {}
