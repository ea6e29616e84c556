import gzip
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from allelemill import config
from allelemill.functions.builds import normalise_build
from allelemill.functions.statistics import complete_missing_stats, effect_from_zscore, quantile_sql, two_sided_p_sql
from allelemill.operators.build_inference import build_match, infer_build
from allelemill.operators.regions import RegionSet
from allelemill.operators.variants import Variants
from allelemill.plans.aliases import ALIASES
from allelemill.plans.predicate import col
from allelemill.sources import reference as ref_store
from allelemill.sources.chain import ChainStore, blocks
from allelemill.sources.sniff import comment_prefix, kind, separator
from allelemill.sources.stats_source import StatsSource


def write(path, lines):
    (gzip.open if str(path).endswith(".gz") else open)(path, "wt").write("\n".join(lines) + "\n")
    return str(path)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("sep", ["\t", ",", ";", " "])
def test_round_trip_under_random_names(spark, tmp_path, seed, sep):
    rng = random.Random(seed)
    pick = {k: rng.choice([n for n in ALIASES[k] if sep not in n and "#" not in n]) for k in ("chr", "pos", "ref", "alt", "effect", "pval")}
    rows = [(rng.randint(1, 22), rng.randint(1, 10**6), *rng.sample("ACGT", 2), round(rng.gauss(0, 1), 4), round(rng.random(), 4)) for _ in range(80)]
    quoted, prefix = rng.random() < 0.5, rng.choice(["", "chr"])
    q = (lambda v: f'"{v}"') if quoted else str
    lines = ["## note", sep.join(pick.values())] + [sep.join([q(prefix + str(r[0])), str(r[1]), q(r[2].lower()), q(r[3]), str(r[4]), str(r[5])]) for r in rows]
    src = StatsSource.open(spark, write(tmp_path / ("f.txt" + rng.choice(["", ".gz"])), lines), build=None)
    assert src.columns == list(pick) and dict(src.table.dtypes)["pos"] == "int"
    key = lambda r: (f"chr{r[0]}", r[1], r[2], r[3], r[4], r[5])
    assert sorted(tuple(r)[:6] for r in src.read().collect()) == sorted(map(key, rows))
    got = src["chr < 12 & pval < 0.3 | pos > 900000"].select(*pick).collect()
    assert sorted(map(tuple, got)) == sorted(key(r) for r in rows if (r[0] < 12 and r[5] < 0.3) or r[1] > 900000)
    assert src.head(5).count() == 5 and src.filter("pval < 2", nlines=7).count() == 7 and src["chr == 1 & chr != 1"].columns == src.read().columns
    assert "separator" in repr(src) and "Scan text" in src.explain("pval < 0.1")


def test_vcf_like_and_trait_format(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ttrait-a"
    body = ["1\t5\trs1\tA\tC\t.\tPASS\t.\tES:SE:LP\t0.1:0.05:2.3", "X\t7\trs2\tG\tT\t.\tPASS\t.\tES:SE:LP\t-0.2:0.1:1.1"]
    src = StatsSource.open(spark, write(tmp_path / "a.vcf.gz", ["##fileformat=VCFv4.2", head, *body]), build="GRCh37")
    r = src.table.orderBy("pos").collect()[0]
    assert (r["chr"], r["pos"], r["rsid"], r["effect"], r["effect_se"], r["log10p"]) == ("chr1", 5, "rs1", 0.1, 0.05, 2.3) and src.build == "b37"
    assert StatsSource.open(spark, write(tmp_path / "b.vcf", [head, *body]), build=None).table.count() == 2
    with pytest.warns(UserWarning, match="FORMAT"):
        bad = StatsSource.open(spark, write(tmp_path / "c.vcf", ["##x", head, body[0].replace("ES:SE:LP", "ES:ZZ")]), build=None)
    assert "effect" not in bad.columns


def test_packed_columns(spark, tmp_path):
    src = StatsSource.open(spark, write(tmp_path / "a.tsv", ["MarkerName\tSNPAlleles\tbeta", "b37-c1:100-123\ta/G\t0.1", "b37-c22:7-9\tC/T\t0.2"]), build=None)
    assert src.columns == ["MarkerName", "build", "chr", "pos", "SNPAlleles", "ref", "alt", "effect"]
    assert [tuple(r)[1:] for r in src.table.orderBy("pos").collect()] == [("b37", "chr22", 7, "C/T", "C", "T", 0.2), ("b37", "chr1", 100, "a/G", "A", "G", 0.1)]
    src = StatsSource.open(spark, write(tmp_path / "b.tsv", ["SNPChr\tSNPPos\tSNPAlleles\tSNPEffectAllele\tMetaBeta", "1\t5\tA/G\tG\t0.1", "1\t6\tC/T\tC\t0.2"]), build=None)
    assert [(r["ref"], r["alt"], r["SNPEffectAllele"]) for r in src.table.orderBy("pos").collect()] == [("A", "G", "G"), ("T", "C", "C")]
    src = StatsSource.open(spark, write(tmp_path / "c.csv", ["chr,pos,Allele1,Allele2,EA", "1,5,A,G,G", "2,6,c,t,T"]), build=None)
    assert src.columns == ["chr", "pos", "allele1", "allele2", "alt", "ref"] and [r["ref"] for r in src.table.orderBy("pos").collect()] == ["A", "C"]
    src = StatsSource.open(spark, write(tmp_path / "d.csv", ["chr,pos,chr_colon_pos", "1,5,1:5", "2,6,2:6"]), build=None)
    assert src.columns == ["chr", "pos", "chr_colon_pos"]


def test_types_and_missing(spark, tmp_path):
    src = StatsSource.open(spark, write(tmp_path / "a.tsv", ["chr\tpos\tid\tEXTRA\tok\tp", "1\t5\tx1\t7\tTRUE\tNA", "1\tNA\tx2\t8\tFALSE\t1e-400"]), build=None)
    assert dict(src.table.dtypes) == {"chr": "string", "pos": "int", "id": "string", "EXTRA": "string", "ok": "boolean", "pval": "double"}
    assert src["pval > 0.5"].count() == 0 and src["pval == 0"].count() == 1
    assert kind(["1", "3000000000"]) == "bigint" and kind(["NA"]) == "string" and separator(["a|b|c", "1|2|3"]) == "|"
    assert comment_prefix(["#CHROM a", "1 2"]) is None and comment_prefix(["##x", "##y", "a b"]) == "##"
    with pytest.raises(ValueError, match="separator"):
        separator(["abc", "def"])


def test_rsid_files(spark, tmp_path):
    ref = spark.createDataFrame([("rs1", "1", 10), ("rs2", "chr2", 20), ("rs2", "chr2", 20)], "rsid string, chr string, pos int")
    src = StatsSource.open(spark, write(tmp_path / "a.tsv", ["rsid\tP", "rs1\t0.1", "rs2\t0.2", "rs3\t0.3"]), reference=ref)
    assert src.needs_rsid and src.build == "b38" and src["pval < 0.25"].columns == ["rsid", "pval"]
    assert [tuple(r) for r in src["chr == 2 | pos < 15 & pval < 0.05"].collect()] == [("chr2", 20, "rs2", 0.2)]
    assert [r["rsid"] for r in src[RegionSet.of(spark, 1, 5, 15, build="b38")].collect()] == ["rs1"]
    with pytest.raises(ValueError, match="located|locate"):
        src[Variants.of(spark.createDataFrame([("1", 1, "A", "C")], "chr string, pos int, ref string, alt string"), "b38")]
    with pytest.raises(ValueError, match="reference entries"):
        StatsSource.from_table(src.table, "b38")["chr == 1"]


def test_conditions(spark):
    df = spark.createDataFrame([("1", 5, "a", "C", 0.1), ("2", 6, "G", "T", 0.9)], "CHR string, BP int, NEA string, EA string, P double")
    src = StatsSource.from_table(df, "b37")
    assert src.columns == ["chr", "pos", "ref", "alt", "pval"]
    assert src[col("chr").isin(1, 3) & (col("pval") < 0.5)].count() == 1 and src[F.col("pos") == 6].count() == 1 and src.filter().count() == 2
    keep = RegionSet.of(spark, 2, 1, 10, build="b37")
    assert src.filter("keep | pval < 0.2", values={"keep": keep}).count() == 2 and src.filter("keep & pval < 0.2", values={"keep": keep}).count() == 0
    assert src[keep].count() == 1 and src[~keep].count() == 1
    with pytest.raises(ValueError, match="build"):
        src[RegionSet.of(spark, 2)]
    with pytest.raises(ValueError, match="no condition"):
        src[3.5]
    with pytest.raises(ValueError, match="no chain"):
        src[RegionSet.of(spark, 2, build="b38")]
    chain = spark.createDataFrame([("chr2", 100, 200, "chr2", 98, False)], "chr string, start int, end int, new_chr string, off int, rev boolean")
    lifted = StatsSource.from_table(df, "b37", chains={("b38", "b37"): chain})
    assert lifted[RegionSet.of(spark, 2, 100, 110, build="b38")].count() == 1


def test_stage_prunes(spark, tmp_path):
    df = spark.createDataFrame([(f"chr{1 + i % 3}", i, "A", "C", i / 100) for i in range(90)], "chr string, pos int, ref string, alt string, pval double")
    staged = StatsSource.from_table(df, "b37").stage(str(tmp_path / "s"))
    plan = staged.explain("chr == 1 & pos < 10 & pval < 0.5")
    assert "PartitionFilters: [isnotnull(chr" in plan and "LessThan(pos,10)" in plan and "Python" not in plan
    assert staged["chr == 1 & pos < 10"].count() == 4


def test_reference_store_and_inference(spark, tmp_path):
    vcf = write(tmp_path / "r.vcf", ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQ\tF\tI"] + [f"1\t{i * 10}\trs{i}\tA\tC,G\t.\t.\t." for i in range(1, 30)])
    ref_store.ingest(spark, vcf, str(tmp_path / "store"), "hg19")
    e = ref_store.entries(spark, str(tmp_path / "store"), "b37", RegionSet.of(spark, 1, 100, 150))
    assert sorted(r["pos"] for r in e.collect()) == [100, 110, 120, 130, 140, 150]
    b37 = ref_store.entries(spark, str(tmp_path / "store"), "b37")
    b38 = b37.withColumn("pos", F.col("pos") + 1)
    stats = spark.createDataFrame([("1", 10, "G", "A"), ("1", 20, "A", "C"), ("1", 20, "A", "C"), ("1", 31, "a", "c"), ("1", 45, "A", "C")], "chr string, pos int, ref string, alt string")
    assert build_match(stats, {"b37": b37, "b38": b38}) == {"b37": 0.5, "b38": 0.25, "b36": 0.25}
    assert infer_build(stats, {"b37": b37, "b38": b38}) == "b37" and infer_build(stats.limit(0), {"b37": b37}) is None
    assert ref_store.md5_matches(vcf, __import__("hashlib").md5(open(vcf, "rb").read()).hexdigest() + "  r.vcf")


def test_chains(spark, tmp_path):
    text = ["chain 1 chr1 1000 + 100 190 chr2 1000 + 40 130 1", "90", "", "chain 2 chr1 1000 + 300 420 chr1 1000 - 40 160 2", "50 10 10", "60"]
    assert list(blocks(text)) == [("chr1", 101, 190, 90, "chr2", 60, False), ("chr1", 301, 350, 50, "chr1", 350 - 960, True), ("chr1", 361, 420, 60, "chr1", 420 - 900, True)]
    with pytest.raises(ValueError, match="no chain header"):
        list(blocks(["", ""]))
    store = ChainStore(spark, str(tmp_path))
    assert store.register("hg19", "b38", write(tmp_path / "c.chain.gz", text)).count() == 3 and store.get("b37", "hg38").count() == 3
    store.clear()
    with pytest.raises(FileNotFoundError):
        store.get("b37", "b38")


def test_downloads(spark, tmp_path):
    from hashlib import md5

    from allelemill.sources import chain as chains
    from allelemill.sources.download import fetch

    base = tmp_path / "web"
    vcf = base / ref_store.BUILD_PATHS["b37"] / "00-common_all.vcf.gz"
    vcf.parent.mkdir(parents=True)
    write(vcf, ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQ\tF\tI", "1\t10\trs1\tA\tC\t.\t.\t."])
    (vcf.parent / "00-common_all.vcf.gz.md5").write_text(md5(vcf.read_bytes()).hexdigest() + "  00-common_all.vcf.gz\n")
    got = ref_store.setup(spark, "hg19", "common", str(tmp_path / "in"), str(tmp_path / "store"), base.as_uri())
    assert got.endswith("00-common_all_b37.vcf.gz") and ref_store.entries(spark, str(tmp_path / "store"), "b37").count() == 1
    (vcf.parent / "00-common_all.vcf.gz.md5").write_text("0" * 32)
    with pytest.raises(OSError, match="2 attempts.*digest"):
        fetch(vcf.as_uri(), str(tmp_path / "again.gz"), vcf.as_uri() + ".md5", attempts=2, wait=0)
    assert not (tmp_path / "again.gz").exists()
    with pytest.raises(OSError, match="1 attempts"):
        fetch((base / "none").as_uri(), str(tmp_path / "x"), attempts=1)
    with pytest.raises(ValueError, match="no rare entries"):
        ref_store.remote("b37", "rare")
    assert ref_store.remote("b38", "all").endswith("GRCh38p7/VCF/00-All.vcf.gz") and chains.remote("b37", "b38").endswith("/hg19/liftOver/hg19ToHg38.over.chain.gz")
    there = base / "hg19/liftOver/hg19ToHg38.over.chain.gz"
    there.parent.mkdir(parents=True)
    write(there, ["chain 1 chr1 1000 + 100 190 chr2 1000 + 40 130 1", "90", ""])
    assert ChainStore(spark, str(tmp_path / "chains"), download=True, base=base.as_uri()).get("b37", "b38").count() == 1


def test_config(tmp_path):
    config.reset()
    with pytest.warns(UserWarning, match="not set"):
        assert config.chain_path() is None
    assert config.set_chain_path(tmp_path) == config.chain_path() == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        config.set_reference_path(tmp_path / "none")
    assert config.set_reference_path(tmp_path) == config.reference_path() and len(config.load()) == 2
    config.reset()
    assert config.load() == {}
    assert normalise_build("GRCh38") == "b38" and normalise_build("none") is None and normalise_build("x1") == "x1"
    with pytest.raises(ValueError, match="unknown build"):
        normalise_build("x1", False)


def test_statistics(spark):
    p = [1e-300, 1e-20, 0.01, 0.3, 0.5, 0.8, 0.999999]
    got = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0]], "p double").select(F.expr(quantile_sql("p")).alias("q")).collect()
    assert [r["q"] for r in got[:7]] == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-12, abs=1e-15) and got[7]["q"] is None and got[8]["q"] is None
    z = [0.0, 0.4, -1.0, 3.0, 9.0, 30.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(F.expr(two_sided_p_sql("z")).alias("p")).collect()
    assert [r["p"] for r in got] == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], rel=1e-12)
    df = complete_missing_stats(spark.createDataFrame([(1.5, 0.01), (0.5, 0.05), (1.0, 1.0), (-1.0, 0.5)], "odds_ratio double, pval double")).collect()
    e = math.log(1.5) * math.sqrt(3) / math.pi
    assert df[0]["effect"] == pytest.approx(e) and df[0]["effect_se"] == pytest.approx(-e / NormalDist().inv_cdf(0.005)) and df[1]["effect_se"] < 0
    assert df[2]["effect_se"] is None and df[3]["effect"] is None
    df = complete_missing_stats(spark.createDataFrame([(-0.2, 0.01)], "effect double, pval double"))
    assert df.first()["effect_se"] > 0 and complete_missing_stats(df).columns == df.columns
    assert complete_missing_stats(df.drop("pval")).first()["pval"] == pytest.approx(0.01)
    b, se = spark.range(1).select(*effect_from_zscore(F.lit(2.0), F.lit(0.3), F.lit(1000.0))).first()
    assert se == pytest.approx(1 / math.sqrt(1004 * 0.42)) and b == pytest.approx(2 * se)


@pytest.mark.parametrize("at", [601, 100_000])
def test_types_hold_for_the_whole_file(spark, tmp_path, at):
    """A column that changes its type behind the sample keeps every value."""
    n = at + 500
    lines = ["chr\tpos\tbeta\tcount\tflag\tlate\tP"] + [f"1\t{i}\t{i if i < at else i + 0.5}\t{i if i < at else i * 10**9}\t{'TRUE' if i < at else 'maybe'}\t{'NA' if i < at else i}\t0.5" for i in range(n)]
    src = StatsSource.open(spark, write(tmp_path / "f.txt", lines), build=None)
    kinds = dict(src.table.dtypes)
    assert (kinds["effect"], kinds["count"], kinds["flag"], kinds["late"], kinds["pos"]) == ("double", "bigint", "string", "int", "int")
    got = src.table.agg(F.count("effect"), F.sum("effect"), F.count("count"), F.max("count"), F.count_if(F.col("flag") == "maybe"), F.count("late")).first()
    assert tuple(got) == (n, sum(i if i < at else i + 0.5 for i in range(n)), n, (n - 1) * 10**9, 500, 500)
    strict = StatsSource.open(spark, str(tmp_path / "f.txt"), build=None, types="sample")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|not a truth value"):
        strict.table.agg(F.sum("effect"), F.count_if(F.col("flag"))).collect()


def test_many_regions_in_an_expression(spark):
    df = spark.createDataFrame([(f"chr{1 + i % 3}", i, 0.5 if i % 5 else 0.01) for i in range(9000)], "chr string, pos int, pval double")
    src = StatsSource.from_table(df)
    many = RegionSet.of(spark, [1] * 2500, [3 * k for k in range(2500)], [3 * k for k in range(2500)])
    hit = lambda i: i % 3 == 0 and i < 7500
    assert src.filter("mine & pval > 0.1", values={"mine": many}).count() == sum(hit(i) and i % 5 > 0 for i in range(9000))
    assert src.filter("!mine | pval < 0.1", values={"mine": many}).count() == sum(not hit(i) or i % 5 == 0 for i in range(9000))
    assert src.filter("mine", values={"mine": ~many}).count() == sum(not hit(i) for i in range(9000))


def test_long_lists_are_joined(spark):
    df = spark.createDataFrame([(f"rs{i}", "chr1", i, str(i)) for i in range(5000)] + [(None, None, None, "x")], "rsid string, chr string, pos int, code string")
    src = StatsSource.from_table(df)
    names, numbers = [f"rs{i}" for i in range(0, 4000, 2)], list(range(0, 3000, 2))
    assert src[col("rsid").isin(names)].count() == 2000 and src[col("pos").isin(numbers) & col("rsid").isin(names)].count() == 1500
    assert src[col("code").isin(numbers)].count() == 1500 and src[~col("pos").isin(numbers)].count() == 3500
    plan = src.explain(col("rsid").isin(names))
    assert "Join" in plan and "rs3998" not in plan


def test_entries_are_cut_before_the_lookup(spark):
    ref = spark.createDataFrame([("rs1", "X", 5), ("rs2", "1", 5), ("rs3", "1", 5000), ("rs4", "Y", 7)], "rsid string, chr string, pos int")
    src = StatsSource.from_table(spark.createDataFrame([(f"rs{i}", 0.1 * i) for i in range(6)], "rsid string, pval double"), reference=ref)
    rsids = lambda c: sorted(r["rsid"] for r in src[c].collect())
    assert rsids("chr != 1 & pos < 1000") == ["rs1", "rs4"] and rsids("pos < 1000 & pval > 0.15") == ["rs2", "rs4"] and rsids("pos > 6 | pval < 0.15") == ["rs1", "rs3", "rs4"]
