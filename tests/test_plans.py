"""The physical plans are the intended ones: what is not shuffled, what is pushed down, what stays in the JVM."""

import re

import pytest
from pyspark.sql import functions as F

from allelemill.operators import error_parse, packed
from allelemill.operators import liftover as L
from allelemill.operators.regions import RegionSet
from allelemill.operators.variants import Variants, locate
from allelemill.sources.stats_source import StatsSource


@pytest.fixture(scope="module")
def stats(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("p") / "s")
    df = spark.range(2000).select(F.concat(F.lit("chr"), F.col("id") % 3 + 1).alias("chr"), (F.col("id") * 7).cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), (F.col("id") / 2000).alias("pval"), F.lit("x").alias("wide"))
    df.write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def in_python(text):
    return re.findall(r"EvalPython|MapInPandas|MapInArrow|PythonUDF", text)


def exchanges(text):
    return re.findall(r"^\(\d+\) (Exchange|ShuffleExchange\w*|Sort|CartesianProduct|BroadcastNestedLoopJoin)\b", text, re.M)


def test_expression_filters_reach_the_scan(stats):
    src = StatsSource.from_table(stats.select("chr", "pos", "pval"), "b37")
    text = plan(src["pos > 100 & pval < 0.1"])
    assert "GreaterThan(pos,100)" in text and "LessThan(pval,0.1)" in text and "wide" not in re.findall(r"ReadSchema.*", text)[0] and not exchanges(text)


def test_region_filter_is_one_broadcast_probe(spark, stats):
    many = RegionSet.from_df(spark.range(500).select(F.lit("chr1").alias("chr"), (F.col("id") * 20 + 1).alias("start"), (F.col("id") * 20 + 5).alias("end")), "b37")
    text = plan(many.filter(stats))
    assert "LeftSemi" in text and "BroadcastHashJoin" in text and "GreaterThanOrEqual(pos,1)" in text and not in_python(text)
    assert " Exchange (" not in text.split("BroadcastExchange")[0]


def test_points_are_lifted_without_shuffle_of_the_data(spark, stats):
    chain = spark.createDataFrame([("chr1", 1, 5000, "chr1", 5, False)], "chr string, start int, end int, new_chr string, off int, rev boolean")
    for multi in ("first", "all"):
        text = plan(L.lift_points(stats, chain, multi))
        assert "BroadcastHashJoin" in text and not in_python(text)
        assert " Exchange (" not in text.split("BroadcastExchange")[0]


def test_locating_is_a_semi_join(spark, stats):
    v = Variants.of(stats.select("chr", "pos", "ref", "alt").limit(5), "b37")
    assert "LeftSemi" in plan(locate(stats, v)) and "LeftSemi" in plan(locate(stats, v, bound=0))


def test_plain_cells_never_reach_python(spark, tmp_path):
    df = spark.createDataFrame([(1, "chr1_5_A_C_b37"), (2, "a;b")], "row_id long, variant_id string")
    text = plan(packed.split_variant_ids(df, "row_id", "variant_id", "f"))
    assert text.index("MapInPandas") < text.index("RLIKE") and not exchanges(text)


def test_lines_load_in_the_jvm(spark):
    raw = spark.createDataFrame([(1, 1, 1, "chr,pos,pval"), (2, 1, 2, "1,5,0.5")], "line_id long, file_id long, line_no int, raw_text string")
    files = spark.createDataFrame([(1, ",")], "file_id long, sep string")
    info = spark.createDataFrame([(1, 1, 1, "chr", "chr", None, None)], "ci_id long, file_id long, col_index int, input_name string, standard_name string, class_name string, recorded_at timestamp")
    alias = spark.createDataFrame([("pos", "pos")], "standard_name string, input_name string")
    out = error_parse.loaded(error_parse.data_lines(raw, files, info, alias, layout=True))
    assert not in_python(plan(out)) and [(r["chr"], r["pos"], r["pval"], r["further"]) for r in out.collect()] == [("chr1", 5, 0.5, {})]
