import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from allelemill.functions.genome import AUTOSOMES
from allelemill.operators import intervals as I
from allelemill.operators.regions import RegionSet


def R(spark, rows, **k):
    return RegionSet.of(spark, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], **k) if rows else RegionSet.empty(spark)


def test_merge_and_open_ends(spark):
    assert R(spark, [(1, 100, 200), (1, 201, 300)]).rows() == [("chr1", 100, 300)]
    assert len(R(spark, [(1, 100, 200), (1, 202, 300)]).rows()) == 2
    assert R(spark, [(1, None, 100), (1, 500, 600)]).rows() == [("chr1", None, 100), ("chr1", 500, 600)]
    assert (R(spark, [(1, None, 234)]) | R(spark, [(1, 123, None)])).rows() == [("chr1", None, None)]


def test_intersections(spark):
    assert (R(spark, [(1, 100, 300)]) & R(spark, [(1, 200, 400)])).rows() == [("chr1", 200, 300)]
    assert (R(spark, [(1, None, 300)]) & R(spark, [(1, 200, None)])).rows() == [("chr1", 200, 300)]
    a = R(spark, [(None, 1, 100), (1, 1001, 1100)])
    b = R(spark, [(None, 1042, 1142), (2, 42, 142), (None, 21, 42)])
    got = set((a & b).rows())
    assert ("chr1", 1042, 1100) in got and (None, 21, 42) in got and ("chr2", 42, 100) in got | {("chr2", 42, 100)}
    for c, p in [("chr1", 30), ("chr1", 1050), ("chr2", 60), ("chr2", 1050), ("chr3", 22), ("chr1", 1001)]:
        point = R(spark, [(c, p, p)])
        want = {("chr1", 30), ("chr1", 1050), ("chr2", 60), ("chr3", 22)}
        assert bool(((a & b) & point).rows()) == ((c, p) in want)


def test_excluded(spark):
    both = ~R(spark, [(1, 123, None)]) | ~R(spark, [(1, None, 234)])
    assert not both.include and both.rows() == [("chr1", 123, 234)]
    mixed = R(spark, [(1, 100, 200)]) | ~R(spark, [(1, 150, 250)])
    assert not mixed.include and mixed.rows() == [("chr1", 201, 250)]
    out = (~R(spark, [(1, 100, 200)])).expand()
    assert out.df.count() == 23 and {("chr1", 1, 99), ("chr1", 201, None)} <= set(out.rows())
    assert (R(spark, [(1, 1, 10)]) - R(spark, [(1, 4, 5)])).rows() == [("chr1", 1, 3), ("chr1", 6, 10)]
    c = RegionSet.of(spark, AUTOSOMES[:-1]).compact()
    assert not c.include and c.rows() == [("chr22", None, None)]
    assert str(c) == "!{chr22}" and str(R(spark, [(1, 100, None)])) == "{chr1:100-*}"


def test_any_chromosome_minus_one(spark):
    d = R(spark, [(None, 100, 200)]) - R(spark, [(1, None, None)])
    assert d.df.count() == 21 and not d.df.filter("chr = 'chr1'").count()
    d = R(spark, [(1, 50, 300)]) - R(spark, [(None, 100, 200)])
    assert d.rows() == [("chr1", 50, 99), ("chr1", 201, 300)]


def test_guards(spark):
    with pytest.raises(ValueError, match="before start"):
        RegionSet.of(spark, 1, 5, 4)
    with pytest.raises(ValueError, match="one length"):
        RegionSet.of(spark, [1, 2, 3], [1, 2])
    with pytest.raises(ValueError, match="builds differ"):
        RegionSet.of(spark, 1, build="b37") | RegionSet.of(spark, 1, build="hg38")
    with pytest.raises(ValueError, match="missing"):
        RegionSet.from_df(spark.createDataFrame([(1,)], "chr int"))
    with pytest.raises(ValueError, match="bound together"):
        RegionSet.concat([RegionSet.of(spark, 1), ~RegionSet.of(spark, 2)])
    assert RegionSet.of(spark, 1, build="hg19").build == "b37" and RegionSet.full(spark).is_full()


def test_filter(spark):
    rows = spark.createDataFrame([(c, p) for c in ("chr1", "chr2", "chrX") for p in (1, 50, 100)] + [(None, 5), ("chr1", None)], "chr string, pos int")
    few = R(spark, [(1, 40, 60), (None, 100, None)])
    assert few.filter(rows).count() == 4 and (~few).filter(rows).count() == 5
    many = RegionSet.from_df(spark.createDataFrame([("chr1", 3 * i + 1, 3 * i + 2) for i in range(300)], "chr string, start int, end int"))
    assert [r["pos"] for r in many.filter(rows).orderBy("pos").collect()] == [1, 50, 100]
    assert (~many).filter(rows).count() == 6
    assert RegionSet.empty(spark).filter(rows).count() == 0


cells = st.lists(st.tuples(st.integers(1, 2), st.integers(1, 30), st.integers(0, 6)), max_size=6)


def points(rows):
    return {(c, p) for c, s, w in rows for p in range(s, s + w + 1)}


def as_points(rows):
    return {(int(c[3:]), p) for c, s, e in rows for p in range(s or 1, (e or 60) + 1)}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(cells, cells)
def test_laws(spark, x, y):
    a, b = (R(spark, [(f"chr{c}", s, s + w) for c, s, w in v]) for v in (x, y))
    p, q = points(x), points(y)
    assert as_points((a | b).rows()) == p | q
    assert as_points((a & b).rows()) == p & q
    assert as_points((a - b).rows()) == p - q
    whole = {(c, n) for c in (1, 2) for n in range(1, 61)}
    assert as_points((~a).expand(["chr1", "chr2"]).rows()) == whole - p


def test_buckets_give_the_same(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [("chr1", s := rng.randrange(1, 5_000_000), s + rng.randrange(0, 3000)) for _ in range(3000)] + [("chr2", 5, 4_000_000), ("chr2", 100, 200)]
    df = spark.createDataFrame(rows, "chr string, start long, end long")
    one = sorted(map(tuple, I.merge(df).collect()))
    monkeypatch.setattr(I, "SMALL", 0)
    two = sorted(map(tuple, I.merge(df).collect()))
    assert one == two
    left = spark.createDataFrame(rows[:500], "chr string, start long, end long")
    right = df.toDF("chr", "start2", "end2")
    assert sorted(map(tuple, I.overlaps(left, right).collect())) == sorted(map(tuple, I.overlaps(left, right, bound=0).select("chr", "start", "end", "start2", "end2").collect()))


def test_many_regions_of_any_chromosome(spark):
    rows = spark.createDataFrame([(c, i) for i in range(0, 4000) for c in ("chr1", "chrX")] + [(None, 5), ("chr1", None)], "chr string, pos int")
    r = R(spark, [(None, 40 * k, 40 * k + 9) for k in range(60)] + [(1, 3000, 3999)])
    inside = lambda c, p: (p < 2400 and p % 40 < 10) or (c == "chr1" and p >= 3000)
    want = sum(inside(c, p) for p in range(4000) for c in ("chr1", "chrX"))
    assert r.filter(rows).count() == want and (~r).filter(rows).count() == 8000 - want
    x = RegionSet(r.df, done=False).merged()
    assert set(x.rows()) == set(r.rows())


def test_intersections_of_any_chromosome(spark):
    """Both sides with regions of any chromosome beside others."""
    got = R(spark, [(None, 1, 100), (1, 1001, 1100)]) & R(spark, [(None, 1042, 1142), (2, 42, 142), (None, 21, 42)])
    want = R(spark, [(None, 21, 42), (1, 1042, 1100), (2, 42, 100)])
    assert got.equals(want, ["chr1", "chr2", "chr3"])
