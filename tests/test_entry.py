import glob
import os
import re

import pytest

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_contract():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 70
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found"} <= set(q)


def test_core_does_not_need_the_text_operators():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{here}/allelemill/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", open(path).read(), re.M), path


@needs_data
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize(
    "name",
    ["flagship_region_pval", "filter_regions_significant", "filter_chr_range", "filter_in_large", "decode_marker_build", "region_merge", "region_filter_exclude", "liftover_points_last", "liftover_keep_unlifted", "variants_best_source", "variant_id_parse", "infer_build_counts", "stats_from_or", "p1_found", "p1_orphans_by_month", "p2_found", "p2_units", "p2_conversions", "p3_changes", "p3_fields", "p3_table", "p4_found", "p5_found", "p5_loaded", "text_scan", "region_difference", "region_union_mixed", "region_filter_any_chromosome", "liftover_ranges_first", "filter_in_list_large", "filter_regions_in_expression", "stream_event_counts"],
)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def shown(v):
        return "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)

    df = e.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(e.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols and got == sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())


@needs_data
@pytest.mark.parametrize("name", ["decode_marker_build", "decode_snpalleles", "trait_vcf_decode", "filter_in_large"])
def test_named_operators_are_reached(spark, monkeypatch, name):
    from allelemill.plans import predicate
    from allelemill.sources import stats_source

    seen = []
    scan, parse = stats_source._scan, stats_source.parse
    monkeypatch.setattr(stats_source, "_scan", lambda s, p, lay: (seen.append({c.name for c in lay.columns if c.part is not None}), scan(s, p, lay))[1])
    monkeypatch.setattr(stats_source, "parse", lambda *a: (seen.append(type(p := parse(*a))), p)[1])
    test_against_sql(spark, name)
    want = {"decode_marker_build": {"build", "chr", "pos"}, "decode_snpalleles": {"ref", "alt"}, "trait_vcf_decode": {"effect", "effect_se", "log10p"}}
    assert want[name] <= seen[0] if name in want else seen == [predicate.InTable]
