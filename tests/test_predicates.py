import pytest

from allelemill.functions.genome import AUTOSOMES
from allelemill.plans.predicate import And, Cmp, In, Matches, Or, col, parse


def test_parse_and_print():
    p = parse("chr == 1 & (pval < 5e-8 | !(effect >= -0.5)) | rsid %in% c('rs1', \"rs2\") & grepl('^a/b', gene)")
    assert isinstance(p, Or) and isinstance(p.parts[0], And) and p.is_composite()
    assert p.columns() == {"chr", "pval", "effect", "rsid", "gene"}
    assert parse("chr %in% 1:3").values == (1, 2, 3)
    assert parse("gene %like% '^x'") == Matches("gene", "^x")
    assert parse("pval < limit", ["pval"], {"limit": 0.1}) == Cmp("<", "pval", 0.1)
    assert repr(col("pval") < 0.1) == "pval < 0.1" and repr(parse("")) == "TRUE"
    assert parse("`P value` < 1").name == "P value"


@pytest.mark.parametrize("text", ["1 < 2", "pval", "pval <", "pval < 1 )", "nope < 1", "pval ? 1", "'a'", "grepl(c('a','b'), pval)"])
def test_errors(text):
    with pytest.raises((ValueError, AttributeError)):
        parse(text, ["pval"])


def regions(spark, text):
    return parse(text).regions(spark)


def test_regions_of_predicates(spark):
    assert [r[0] for r in regions(spark, "chr < 4").rows()] == ["chr1", "chr2", "chr3"]
    assert {r[0] for r in regions(spark, "20 < chr").rows()} == {"chr21", "chr22"}
    assert regions(spark, "pos < 1000").rows() == [(None, None, 999)]
    assert regions(spark, "chr < 100").is_full()
    got = regions(spark, '(chr == 1 | chr == "X") & 123 <= pos & pos <= 234').rows()
    assert set(got) == {("chr1", 123, 234), ("chrX", 123, 234)}
    assert regions(spark, "chr == 1 & chr != 1").rows() == []
    assert regions(spark, "chr == 1 | chr != 1").expand().equals(regions(spark, "chr %in% 1:22"))
    assert regions(spark, "pos %in% c(12345, 23456) & chr == 1").rows() == [("chr1", 12345, 12345), ("chr1", 23456, 23456)]
    assert regions(spark, "pval < 0.1").is_full() and len(AUTOSOMES) == 22


def test_columns(spark):
    df = spark.createDataFrame([("chr1", 5, "A", "0.5", "b"), ("chr10", 7, "C", "NA", "/x"), ("chrX", 9, "G", "2e-3", None)], "chr string, pos int, ref string, pval string, gene string")
    n = lambda text: df.where(parse(text).column(dict(df.dtypes))).count()
    assert n("chr == '1'") == n('chr == "chr1"') == n("chr == 1") == 1
    assert n("chr < 11") == 2 and n("chr >= 10") == 1 and n("chr <= 30") == 3
    assert n("ref == 'a'") == 1 and n("ref %in% c('a', 'g')") == 2
    assert n("pval < 1") == 2 and n("pval > 0.1") == 1
    assert n("grepl('/', gene)") == 1 and n("grepl('[[:digit:]]', chr)") == 2
    assert df.where(In("pos", (5, 9)).column(dict(df.dtypes))).count() == 2
    with pytest.raises(ValueError, match="no column"):
        n("nope == 1")


def test_values_of_a_table(spark):
    from allelemill.sources.stats_source import StatsSource

    df = spark.createDataFrame([(1, "chr1", 1, "rs1", 0.5), (2, "chr2", 1, "rs2", 0.5), (3, "chr3", 1, None, 0.5), (4, "chr4", 1, "rs4", 0.01)], "k int, chr string, pos int, rsid string, pval double")
    wanted = spark.createDataFrame([("rs1",), ("rs1",), (None,)], "v string")
    src = StatsSource.from_table(df)
    ids = lambda text: sorted(r["k"] for r in src.filter(text, values={"wanted": wanted, "few": spark.createDataFrame([(2,)], "v int")}).collect())
    assert ids("rsid %in% wanted") == [1] and ids("rsid %in% wanted | pval < 0.1") == [1, 4] and ids("!(rsid %in% wanted)") == [2, 4] and ids("chr %in% few") == [2]
    assert src.filter("rsid %in% wanted", values={"wanted": wanted}).columns[:5] == df.columns
