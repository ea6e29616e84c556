from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from allelemill.operators import orphans as O

ENTRY = "key string, added_at timestamp, withdrawn_at timestamp, merged_into string"
t = lambda m, day=1: D(2023, m, day)


def refs(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, rsid string, loaded_at timestamp, tbl string, n int")
    return O.reference_rows(df, "x", "row_id", "rsid", "loaded_at")


def found(spark, rows, entries, **k):
    out = O.orphan_references(refs(spark, rows), spark.createDataFrame(entries, ENTRY), **k)
    return sorted(r["row_id"] for r in out.collect())


def brute(rows, entries):
    alias, own = {}, {}
    for k, a, w, m in entries:
        if k is None:
            continue
        if m:
            alias[k.strip().lower()] = m.strip().lower()
        else:
            own.setdefault(k.strip().lower(), []).append((a, w))
    out = []
    for i, k, at, *_ in rows:
        k = (k or "").strip().lower()
        if not (k.startswith("rs") and k[2:].isdigit()):
            continue
        seen = set()
        while k in alias and k not in seen:
            seen.add(k)
            k = alias[k]
        spells = [] if k in alias else own.get(k, [])
        if at is None or not any(a is not None and a <= at and (w is None or at < w) for a, w in spells):
            out.append(i)
    return sorted(out)


ENTRIES = [
    ("rs1", t(1), None, None), ("rs1", t(1), None, None), ("rs2", t(1), t(3), None), ("rs2", t(6), None, None), ("rs3", t(9), t(10), "rs4"), ("rs4", t(1), None, "RS5 "),
    ("rs5", t(2), None, None), ("rs6", t(1), None, "rs7"), ("rs7", t(1), None, "rs6"), ("rs8", t(1), None, "rs99"), ("rs9", None, None, None), (None, t(1), None, None),
]
ROWS = [
    (1, "rs1", t(2), "a", 1), (2, " RS1\t", t(2), "a", 1), (3, "rs2", t(2), "a", 1), (4, "rs2", t(3), "a", 1), (5, "rs2", t(4), "a", 1), (6, "rs2", t(6), "a", 1), (7, "rs3", t(9, 15), "a", 1),
    (8, "rs3", t(1), "a", 1), (9, "rs6", t(5), "a", 1), (10, "rs8", t(5), "a", 1), (11, "rs9", t(5), "a", 1), (12, "rs404", t(5), "a", 1), (13, None, t(5), "a", 1), (14, "", t(5), "a", 1),
    (15, "9:123", t(5), "a", 1), (16, "rs", t(5), "a", 1), (17, "rs1", None, "a", 1), (18, "rs404", t(5), "a", 1), (19, "x" * 100_000, t(5), "a", 1),
]


@pytest.mark.parametrize("share", [0.005, 0.2, 1.0])
def test_rows(spark, share):
    assert found(spark, ROWS, ENTRIES, heavy_share=share) == brute(ROWS, ENTRIES) == [4, 5, 8, 9, 10, 11, 12, 17, 18]


def test_heavy_keys_bound_broadcast(spark):
    rows = [(i, "rs2", t(1 + i % 12), "a", 1) for i in range(200)] + [(1000 + i, f"rs{i}", t(5), "a", 1) for i in range(30)]
    assert found(spark, rows, ENTRIES, heavy_share=0.1) == brute(rows, ENTRIES)
    assert found(spark, rows, ENTRIES, heavy_share=0.1, bound=0) == brute(rows, ENTRIES)


def test_counts(spark):
    rows = ROWS + [(100 + i, "rs2", t(1 + i % 12, 1 + i % 28), "a", 1) for i in range(100)]
    got = O.orphan_counts(refs(spark, rows), spark.createDataFrame(ENTRIES, ENTRY), heavy_share=0.3).collect()
    bad = brute(rows, ENTRIES)
    want = {}
    for i, k, at, *_ in rows:
        k = (k or "").strip().lower()
        if k.startswith("rs") and k[2:].isdigit():
            key = at.replace(day=1).date() if at else None
            n, o = want.get(key, (0, 0))
            want[key] = (n + 1, o + (i in bad))
    assert {r["period"]: (r["n_refs"], r["n_orphans"]) for r in got} == want


def test_empty(spark):
    assert found(spark, [], ENTRIES) == []
    assert found(spark, [(1, "rs1", t(2), "a", 1)], []) == [1]
    assert O.orphan_counts(refs(spark, []), spark.createDataFrame([], ENTRY)).count() == 0


def test_long_merge_chain(spark):
    n = 40
    entries = [(f"rs{i}", t(1), None, f"rs{i + 1}") for i in range(n)] + [(f"rs{n}", t(2), None, None)]
    ends = O.resolve_merges(spark.createDataFrame([(f"rs{i}", f"rs{i + 1}") for i in range(n)], "src string, dst string"))
    assert ends.filter(F.col("dst") == f"rs{n}").count() == n
    assert found(spark, [(1, "rs0", t(3), "a", 1), (2, "rs0", t(1), "a", 1)], entries) == [2]
