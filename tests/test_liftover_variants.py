import pytest
from pyspark.sql import functions as F

from allelemill.operators import liftover as L
from allelemill.operators.regions import RegionSet
from allelemill.operators.variants import Variants, add_variant_id, check_variant_id, locate, record_build
from allelemill.streaming.stateless import filtered, lifted, to_parquet, windowed_counts

CHAIN = "chr string, start int, end int, new_chr string, off int, rev boolean"
VAR = "chr string, pos int, ref string, alt string"


def chain(spark, *rows):
    return spark.createDataFrame(list(rows), CHAIN)


def table(spark, *rows, cols=VAR):
    return spark.createDataFrame(list(rows), cols)


def test_points(spark):
    two = chain(spark, ("chr1", 100, 200, "chr1", 50, False), ("chr1", 120, 180, "chr1", 30, False))
    df = table(spark, ("chr1", 150, "A", "C"))
    pos = lambda m: sorted(r["pos"] for r in L.lift_points(df, two, m).collect())
    assert (pos("all"), pos("first"), pos("last")) == ([100, 120], [100], [120])
    with pytest.raises(ValueError):
        pos("any")
    df = table(spark, ("chr1", 150, "A", "C"), ("chr1", 5000, "A", "C"), ("chr1", None, "A", "C"), (None, 5, "A", "C"))
    kept = L.lift_points(df, two.limit(1), "first", drop_unlifted=False)
    assert sorted(str(r["pos"]) for r in kept.collect()) == ["100", "None", "None", "None"] and L.lift_points(df, two.limit(1)).count() == 1
    assert L.lift_points(df, two.limit(1), "all", drop_unlifted=False).count() == 4


def test_reverse_block(spark):
    rev = chain(spark, ("chr1", 100, 200, "chr9", 20, True))
    got = L.lift_points(table(spark, ("chr1", 100, "A", "CG"), ("chr1", 200, "a", "n")), rev).collect()
    assert {tuple(r) for r in got} == {("chr9", 180, "T", "CG"), ("chr9", 80, "T", "N")}
    r = L.lift_regions(RegionSet.of(spark, 1, 150, 250, build="b37"), rev, "b38")
    assert r.rows() == [("chr9", 80, 130)] and r.build == "b38"


def test_regions(spark):
    c = chain(spark, ("chr1", 1, 100, "chr1", -10, False), ("chr1", 101, 200, "chr2", 50, False))
    r = RegionSet.of(spark, 1, 50, 150, build="b37")
    assert L.lift_regions(r, c, "b38").rows() == [("chr1", 60, 110), ("chr2", 51, 100)]
    assert not L.lift_regions(~r, c, "b38").include
    assert L.lift_regions(RegionSet.of(spark, None, 190, None, build="b37"), c, "b38").rows() == [("chr2", 140, 150)]
    assert L.lift_regions(r, c, "hg19") is r
    with pytest.warns(UserWarning, match="without a build"):
        L.lift_regions(RegionSet.of(spark, 1), c, "b38")
    same = table(spark, ("chr1", 50, 150, "x"), cols="chr string, start int, end int, label string")
    assert [L.lift_table(same, {("b37", "b38"): c}, "b38", "b37", multi=m).count() for m in ("all", "first")] == [2, 1]


def test_algebra_over_builds(spark):
    c = chain(spark, ("chr1", 1, 1000, "chr1", -10, False))
    a = RegionSet(RegionSet.of(spark, 1, 100, 200).df, "b38", True, {("b37", "b38"): c})
    b = RegionSet.of(spark, 1, 140, 300, build="b37")
    with pytest.warns(UserWarning, match="lifted to b38"):
        got = a & b
    assert got.rows() == [("chr1", 150, 200)] and got.build == "b38"
    with pytest.warns(UserWarning, match="lifted"):
        assert RegionSet.concat([a, b]).rows() == [("chr1", 100, 310)]


def test_table_cache_and_retained(spark):
    c = {("b37", "b38"): chain(spark, ("chr1", 1, 100, "chr1", -10, False))}
    df = table(spark, ("chr1", 5, "A", "C"), ("chr1", 6, "A", "C"))
    out = L.lift_table(df, c, "b38", "hg19", retain_builds=True)
    assert {(r["pos"], r["pos_b37"], r["pos_b38"]) for r in out.collect()} == {(15, 5, 15), (16, 6, 16)}
    old = df.withColumns({"chr_b38": F.col("chr"), "pos_b38": F.when(F.col("pos") == 5, 999)})
    assert sorted(r["pos"] for r in L.lift_table(old, c, "b38", "b37").collect()) == [16, 999]
    assert L.lift_table(df, c, "b37", "b37") is df
    for bad in (lambda: L.lift_table(df, c, "b36", "b37"), lambda: L.lift_table(df, c, "x", "b37"), lambda: L.lift_table(df.drop("pos"), c, "b38", "b37")):
        with pytest.raises(ValueError):
            bad()


def test_variants_basics(spark):
    v = Variants.of(table(spark, ("1", 100, "a", "g"), ("1", 100, "A", "G"), ("2", None, "A", "G")), "hg19")
    assert v.build == "b37" and Variants.of(v) is v
    ids = [r["variant_id"] for r in v.df.collect()]
    assert ids == ["chr1_100_A_G_b37", "chr1_100_A_G_b37", None] and v.unique().df.count() == 2
    assert {"chr_b37", "pos_b37", "ref_b37", "alt_b37", "defining_build"} <= set(v.df.columns)
    for bad in (lambda: Variants.of(v, "b38"), lambda: Variants.of(v.df), lambda: Variants.of(v.df.select("chr"), "b37")):
        with pytest.raises(ValueError):
            bad()
    assert check_variant_id(v.df, "b37") is v.df
    with pytest.raises(ValueError, match="disagrees"):
        check_variant_id(v.df, "b38")
    assert add_variant_id(v.df, "b99").first()["variant_id"].endswith("b37") and add_variant_id(v.df, "b99", True).first()["variant_id"].endswith("b99")
    assert record_build(v.df, "b37").columns == v.df.columns


def test_variants_from_ids(spark):
    df = table(spark, ("chr1_5_A_C_b37",), ("chr2_7_G_T_GRCh38",), ("nonsense",), (None,), cols="variant_id string")
    v = Variants.of(df)
    assert v.build == "b38"
    rows = {r["variant_id"]: r for r in v.df.collect()}
    assert rows["chr2_7_G_T_GRCh38"]["pos"] == 7 and rows["chr1_5_A_C_b37"]["pos"] is None and rows["chr1_5_A_C_b37"]["pos_b37"] == 5
    out = v.lift("b38", {}).df.count()
    assert out == 4


def test_best_source(spark):
    c = {("b37", "b36"): chain(spark, ("chr1", 1, 10**6, "chr1", 10, False)), ("b38", "b36"): chain(spark, ("chr1", 1, 10**6, "chr1", 1000, False))}
    v = Variants.of(table(spark, ("1", 100, "A", "C")), "b37")
    v = Variants(v.df.withColumns({"chr_b38": F.lit("chr1"), "pos_b38": F.lit(5000), "ref_b38": F.lit("A"), "alt_b38": F.lit("C"), "pos": F.lit(5000)}), "b38")
    pos = lambda s: v.lift("b36", c, source=s).df.first()["pos"]
    assert (pos("best"), pos("b37"), pos("b38"), pos("current")) == (90, 90, 4000, 4000)
    got = v.lift("b36", c).df.first()
    assert got["variant_id"] == "chr1_90_A_C_b36" and got["pos_b36"] == 90 and got["pos_b37"] == 100
    assert v.lift("b36", {}).df.first()["pos"] is None


def test_concat(spark):
    a, b = Variants.of(table(spark, ("1", 1, "A", "C")), "b37"), Variants.of(table(spark, ("1", 2, "A", "C")).withColumn("extra", F.lit(1)), "b38")
    c = {("b38", "b37"): chain(spark, ("chr1", 1, 100, "chr1", -5, False))}
    out = Variants.concat([a, b], c)
    assert out.build == "b37" and sorted((r["pos"], r["extra"]) for r in out.df.collect()) == [(1, None), (7, 1)]


def test_locate(spark):
    rows = table(spark, ("chr1", 5, "A", "C"), ("1", 5, "c", "a"), ("chr1", 5, "A", "G"), ("chr1", 6, "A", "C"), ("chr1", 5, None, "C"))
    v = Variants.of(table(spark, ("1", 5, "A", "C"), ("1", 5, "C", "A"), ("1", None, "A", "G")), "b37")
    assert locate(rows, v).count() == 2 and locate(rows, v, bound=0).count() == 2
    with pytest.raises(ValueError, match="need"):
        locate(rows.drop("ref"), v)


def test_streams(spark, tmp_path):
    df = table(spark, *[("chr1", i, "A", "C") for i in range(20)])
    df.withColumn("ts", F.timestamp_seconds(F.col("pos") * 1000)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(VAR + ", ts timestamp").parquet(str(tmp_path / "in"))
    c = chain(spark, ("chr1", 1, 100, "chr1", -10, False))
    out = lifted(filtered(filtered(stream, "pos > 3 & pos < 15"), RegionSet.of(spark, 1, 5, 9, build="b37")), c)
    to_parquet(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["pos"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [15, 16, 17, 18, 19]
    q = windowed_counts(stream, "ts", ["chr"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r["n"] for r in spark.sql("select * from w").collect()) == 20


def test_ranges_of_a_table(spark):
    two = chain(spark, ("chr1", 100, 200, "chr1", 50, False), ("chr1", 120, 180, "chr9", 30, True))
    chains = {("b37", "b38"): two}
    df = spark.createDataFrame([("chr1", 150, 160, "A", 1), ("chr1", 5000, 6000, "C", 2), ("chr1", None, 7, "G", 3), ("chr1", 90, 110, "T", 4)], "chr string, start int, end int, ref string, id int")
    lift = lambda t, **k: [tuple(r) for r in L.lift_table(t, chains, "b38", "b37", keep_order=True, **k).collect()]
    assert lift(df) == [("chr1", 100, 110, "A", 1), ("chr1", 50, 60, "T", 4)]
    assert lift(df, multi="last") == [("chr9", 110, 120, "T", 1), ("chr1", 50, 60, "T", 4)]
    assert lift(df, multi="all", drop_unlifted=False) == [("chr1", 100, 110, "A", 1), ("chr9", 110, 120, "T", 1), (None, None, None, "C", 2), (None, None, None, "G", 3), ("chr1", 50, 60, "T", 4)]
    only = lambda c: lift(df.select("chr", F.col("start").alias(c), "id"), drop_unlifted=False)
    assert only("start") == only("end") == [("chr1", 100, 1), (None, None, 2), (None, None, 3), (None, None, 4)]
    with pytest.raises(ValueError, match="both pos and start"):
        L.lift_table(df.withColumn("pos", F.lit(1)), chains, "b38", "b37")
    with pytest.raises(ValueError, match="needs chr and pos, start or end"):
        L.lift_table(df.select("chr", "id"), chains, "b38", "b37")


def test_order_of_points(spark):
    two = chain(spark, ("chr1", 100, 200, "chr1", 50, False), ("chr1", 120, 180, "chr1", 30, False))
    df = spark.createDataFrame([("chr1", 150, "x"), ("chr1", 5000, "y"), ("chr1", 101, "z")], "chr string, pos int, id string")
    got = [(r["id"], r["pos"]) for r in L.lift_table(df, {("b37", "b38"): two}, "b38", "b37", multi="all", drop_unlifted=False, keep_order=True).collect()]
    assert got == [("x", 100), ("x", 120), ("y", None), ("z", 51)]
