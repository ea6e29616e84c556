import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from allelemill.operators import units as U

S_COLS = "row_id long, file_id long, line_no int, effect double, effect_se double, odds_ratio double, pval double, log10p double, unit string"
F_COLS = "file_id long, pval_unit string, effect_unit string, note string"
BACK = {
    "pval": {"prob": lambda p: p, "percent": lambda p: 100 * p, "ln": math.log, "neglog10": lambda p: -math.log10(p)},
    "log10p": {"neglog10": lambda g: g, "log10": lambda g: -g, "negln": lambda g: g * math.log(10)},
    "effect": {"lnor": lambda e: e, "log10": lambda e: e / math.log(10), "log2": lambda e: e / math.log(2), "milli": lambda e: 1000 * e, "smd": lambda e: e * math.sqrt(3) / math.pi, "ratio": math.exp},
    "odds_ratio": {"ratio": math.exp, "ln": lambda e: e, "percent": lambda e: 100 * (math.exp(e) - 1)},
}


def rows(rng, fid, n, units, cut=None, fields=("effect", "odds_ratio", "pval", "log10p"), start=0):
    """n lines of one file; from line cut on in the given units, before it canonical."""
    out = []
    for i in range(n):
        e, se = rng.normal(0, 0.05), rng.uniform(0.01, 0.03)
        e, se = round(e, 5), round(se, 5)
        p = 2 * (1 - NormalDist().cdf(abs(e / se))) or 1e-16
        if p < 1e-14:
            p = 1e-14
        u = units if cut is None or i >= cut else {}
        val = {"effect": e, "odds_ratio": e, "pval": p, "log10p": -math.log10(p)}
        v = {f: BACK[f][u.get(f, U.CANONICAL[f])](val[f]) if f in fields and p > 1e-13 else None for f in val}
        v = {f: None if x is None else float(f"{x:.6g}") for f, x in v.items()}
        out.append((start + i, fid, i + 1, v["effect"], se, v["odds_ratio"], v["pval"], v["log10p"], "x"))
    return out


def test_compositions_and_cycles():
    by = {(f, u): (a1, b1, k, a2, b2) for f, u, a1, b1, k, a2, b2 in U.compose()}
    f = {"": lambda x: x, "exp": math.exp, "ln": math.log}
    for field, back in BACK.items():
        for unit, fn in back.items():
            a1, b1, k, a2, b2 = by[(field, unit)]
            x = {"pval": 0.03, "log10p": 1.5}.get(field, 0.04)
            want = x if field != "odds_ratio" else math.exp(x)
            assert a2 * f[k](a1 * fn(x) + b1) + b2 == pytest.approx(want)
    U.check_cycles([*U.EDGES, ("effect.log10", "effect.log2", "affine", math.log(10) / math.log(2), 0.0)])
    with pytest.raises(ValueError, match="disagree"):
        U.check_cycles([*U.EDGES, ("effect.log10", "effect.log2", "affine", 3.0, 0.0)])


def test_tail():
    z = np.array([0.0, 0.5, 3.0, 8.0, 30.0])
    assert U.neglog10_p(z) == pytest.approx([-math.log10(math.erfc(x / math.sqrt(2))) for x in z], abs=1e-6, rel=1e-6)


def test_files_in_one_unit_and_split(spark):
    rng = np.random.default_rng(1)
    plans = {
        1: ({}, None), 2: ({"pval": "ln"}, None), 3: ({"effect": "log10", "log10p": "negln"}, 40), 4: ({"odds_ratio": "percent"}, None), 5: ({"effect": "ratio"}, 25), 6: ({"pval": "percent", "effect": "smd"}, None),
    }
    data, want = [], set()
    for fid, (u, cut) in plans.items():
        r = rows(rng, fid, 90, u, cut, start=fid * 1000)
        data += r
        for x in r:
            for f, j in (("effect", 3), ("odds_ratio", 5), ("pval", 6), ("log10p", 7)):
                if x[j] is not None and f in u and (cut is None or x[2] > cut):
                    want.add((x[0], f))
    stats = spark.createDataFrame(data, S_COLS)
    files = spark.createDataFrame([(i, None, None, "meta of 3 cohorts") for i in plans], F_COLS)
    got = {(r["row_id"], r["field"]) for r in U.foreign_values(stats, files).collect()}
    assert len(got ^ want) <= 4  # only lines at the cuts can be in doubt
    canon = U.to_canonical(stats, files).toPandas().set_index("row_id")
    ok = canon.dropna(subset=["effect", "odds_ratio", "pval"])
    off = (np.abs(np.log(ok.odds_ratio) - ok.effect) > 1e-3).sum()
    assert off <= 4 and len(ok) > 400


def test_declared_where_nothing_speaks(spark):
    data = [(1, 7, 1, None, None, None, 50.0, None, "x"), (2, 8, 1, None, None, None, 0.5, None, "x"), (3, 9, 1, None, None, 1.2, None, None, "x"), (4, 7, None, None, None, None, 3.0, None, "x")]
    files = spark.createDataFrame([(7, "percent", None, None), (8, None, None, "x; pval = 100 * probability"), (9, None, "log2 OR", "10 log files attached")], F_COLS)
    got = {(r["row_id"], r["field"], r["unit"]) for r in U.foreign_values(spark.createDataFrame(data, S_COLS), files).collect()}
    assert got == {(1, "pval", "percent"), (4, "pval", "percent"), (2, "pval", "percent")}


def test_mixed_file_goes_by_blocks(spark):
    rng = np.random.default_rng(3)
    a = rows(rng, 1, 192, {})
    b = rows(rng, 1, 192, {"pval": "percent"})
    data = [b[i] if 64 <= i + 1 < 128 else a[i] for i in range(192)]
    files = spark.createDataFrame([(1, None, None, None)], F_COLS)
    got = {r["row_id"] for r in U.foreign_values(spark.createDataFrame(data, S_COLS), files).collect()}
    assert got == {x[0] for x in data if 64 <= x[2] < 128 and x[6] is not None}


def test_short_stretch_in_a_long_file(spark):
    rng = np.random.default_rng(11)
    data = rows(rng, 1, 12000, {"pval": "percent"}, cut=11996, fields=("effect", "pval"))
    votes = U.row_votes(pd.DataFrame([x[3:8] for x in data], columns=["effect", "effect_se", "odds_ratio", "pval", "log10p"], dtype=float))["pval"]
    want = {x[0] for x, v in zip(data, votes) if x[2] > 11996 and v == U.UNITS["pval"].index("percent")}
    files = spark.createDataFrame([(1, None, None, None)], F_COLS)
    got = {r["row_id"] for r in U.foreign_values(spark.createDataFrame(data, S_COLS), files).collect()}
    assert len(want) >= 3 and want <= got and all(x[2] > 11990 for x in data if x[0] in got)


def test_mixed_rows_vote_for_themselves(spark):
    rng = np.random.default_rng(12)
    a, b = rows(rng, 1, 400, {}, fields=("effect", "pval")), rows(rng, 1, 400, {"pval": "percent"}, fields=("effect", "pval"))
    data = [b[i] if i % 7 == 3 or 200 <= i < 203 else a[i] for i in range(400)]
    data = [(*x[:4], None, *x[5:]) if 100 <= i < 180 else x for i, x in enumerate(data)]  # over a whole block nothing speaks
    pdf = pd.DataFrame([x[3:8] for x in data], columns=["effect", "effect_se", "odds_ratio", "pval", "log10p"], dtype=float)
    masks = {f: np.full(400, 1 if f != "pval" else 1 + 2 ** U.UNITS["pval"].index("percent")) for f in U.FIELDS}
    votes = U.row_votes(pdf, masks=masks)["pval"]
    first = U.row_votes(pdf)["pval"]
    at = [i for i, v in enumerate(votes) if v >= 0]
    assert len(at) > (first >= 0).sum() and set(at) >= set(np.flatnonzero(first >= 0))  # with fewer units to choose from more rows speak
    votes = np.where(votes >= 0, votes, first)
    spoke = list(np.flatnonzero(first >= 0))
    foreign = {i for i in range(400) if U.UNITS["pval"][votes[i] if votes[i] >= 0 else first[min(spoke, key=lambda j: (abs(i - j), j))]] == "percent"}
    assert {i for i in at if i in foreign} == {i for i in at if i % 7 == 3 or 200 <= i < 203}
    files = spark.createDataFrame([(1, None, None, None)], F_COLS)
    got = {r["row_id"] for r in U.foreign_values(spark.createDataFrame(data, S_COLS), files).collect()}
    assert got == {data[i][0] for i in foreign if data[i][6] is not None}


def test_without_standard_error(spark):
    rng = np.random.default_rng(21)
    want, data = set(), []
    for fid, u in ((1, {"pval": "percent"}), (2, {"log10p": "negln"}), (3, {"effect": "milli", "odds_ratio": "percent"}), (4, {"effect": "log10"}), (5, {})):
        part = rows(rng, fid, 60, u, start=fid * 100)
        keep = (5,) if fid in (3, 4) else (6, 7)
        part = [(*x[:3], x[3] if fid in (3, 4) else None, None, *[x[j] if j in keep else None for j in (5, 6, 7)], "x") for x in part]
        data += part
        want |= {(x[0], f) for x in part for f in u if x[U.VOTING.index(f) + 3] is not None}
    files = spark.createDataFrame([(i, None, None, None) for i in range(1, 6)], F_COLS)
    got = {(r["row_id"], r["field"]) for r in U.foreign_values(spark.createDataFrame(data, S_COLS), files).collect()}
    assert got == want


def test_range_where_nothing_else_speaks(spark):
    vals = {1: ("pval", [7.3, 0.4, 12.0, 0.1]), 2: ("log10p", [-2.0, -0.3]), 3: ("pval", [-4.6, -0.2]), 4: ("pval", [55.0, 0.9, 31.0, 88.0]), 5: ("odds_ratio", [-0.1, 0.2]), 6: ("odds_ratio", [-12.0, 5.0]), 7: ("pval", [0.2] * 30 + [1.5])}
    data = [(k * 100 + i, k, i, *[x if c == f else None for c in U.VOTING], "x") for k, (f, xs) in vals.items() for i, x in enumerate(xs)]
    files = spark.createDataFrame([(i, None, None, None) for i in vals], F_COLS)
    got = {(r["row_id"], r["field"], r["unit"]) for r in U.foreign_values(spark.createDataFrame(data, S_COLS), files).collect()}
    units = {1: "neglog10", 2: "log10", 3: "ln", 4: "percent", 5: "ln", 6: "percent"}
    assert got == {(k * 100 + i, f, units[k]) for k, (f, xs) in vals.items() if k in units for i in range(len(xs))}


def test_nulls_nan_and_empty(spark):
    files = spark.createDataFrame([(1, None, None, None)], F_COLS)
    data = [(1, None, None, None, None, None, None, None, None), (2, 1, 1, float("nan"), 0.1, None, 0.5, None, "x"), (2, 1, 1, float("nan"), 0.1, None, 0.5, None, "x")]
    df = spark.createDataFrame(data, S_COLS)
    assert U.foreign_values(df, files).count() == 0
    assert U.to_canonical(df, files).count() == 3
    assert U.foreign_values(df.limit(0), files.limit(0)).count() == 0


def test_row_votes_are_silent_when_in_doubt():
    pdf = pd.DataFrame({"effect": [0.0, np.nan, 0.05], "effect_se": [0.1, 0.1, 0.0], "odds_ratio": [np.nan] * 3, "pval": [1.0, 0.5, 0.2], "log10p": [np.nan] * 3})
    v = U.row_votes(pdf)
    assert (v["effect"] == -1).all()


def test_further_columns_with_clashing_names(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(rows(rng, 1, 40, {"pval": "percent"}), S_COLS)
    for name in ("a1", "bridge", "field", "block", "n", "pval_unit"):
        df = df.withColumn(name, df["row_id"])
    files = spark.createDataFrame([(1, None, None, None)], F_COLS).withColumn("unit", F.lit("x"))
    out = U.to_canonical(df, files)
    assert out.columns == [*df.columns, "log10p_unit", "effect_unit", "odds_ratio_unit"] and out.filter("a1 = row_id").count() == 40
    assert U.foreign_values(df, files).select("field").distinct().collect() == [("pval",)]


@pytest.mark.parametrize("n", [1_000, 100_000, 1_000_000])
def test_short_stretches_at_any_size(spark, tmp_path, n):
    """A handful of values in another unit at the start, in the middle or at the end of a file are found, and no others,
    however long the file is."""
    rng = np.random.default_rng(8)
    parts, want = [], set()
    for fid, first in ((1, 0), (2, n // 2), (3, n - 15)):
        z, se = rng.uniform(0.5, 4, n), rng.uniform(0.01, 0.03, n)
        pval = np.power(10.0, -U.neglog10_p(z))
        foreign = np.zeros(n, dtype=bool)
        foreign[first : first + 15] = True
        parts.append(pd.DataFrame({"row_id": fid * 10_000_000 + np.arange(n), "file_id": fid, "line_no": np.arange(n, dtype=np.int32), "effect": z * se, "effect_se": se, "odds_ratio": np.nan, "pval": np.where(foreign, 100 * pval, pval), "log10p": np.nan}))
        want |= set(parts[-1]["row_id"][foreign])
    pd.concat(parts).to_parquet(tmp_path / "s.parquet")
    files = spark.createDataFrame([(i, None, None, None) for i in (1, 2, 3)], F_COLS)
    got = {r["row_id"] for r in U.foreign_values(spark.read.parquet(str(tmp_path / "s.parquet")), files).collect()}
    assert got == want


@pytest.mark.parametrize(
    ("text", "of", "want"),
    [
        ("p values are percentages", None, ("pval", "percent")), ("significance given as minus log10", None, ("pval", "neglog10")), ("slopes times 1000", None, ("effect", "milli")), ("estimates on a log2 scale", None, ("effect", "log2")),
        ("the LP column holds log10 of p without sign change", None, ("log10p", "log10")), ("ORs expressed as percent", None, ("odds_ratio", "percent")), ("log base 2 of the odds ratio in beta", None, ("effect", "log2")),
        ("log10 of p with the sign kept", None, ("log10p", "log10")), ("estimate = Cohen d", None, ("effect", "smd")), ("p is ln p", None, ("pval", "ln")), ("LP uses ln instead of log10", None, ("log10p", "negln")),
        ("17 log books", None, None), ("95 % call rate", None, None), ("effect on the log-odds scale", None, None), ("pval is a probability", None, None), (None, None, None), ("", "pval", None), ("x" * 10_000, None, None),
        ("per cent", "pval", ("pval", "percent")), ("-log10", "pval", ("pval", "neglog10")), ("lnOR", "effect", None), ("1e-3 lnOR", "effect", ("effect", "milli")), ("D", "effect", ("effect", "smd")),
    ],
)
def test_notes_are_read_by_grammar(text, of, want):
    assert U.read_unit(text, of) == want


def test_composition_of_found_values(spark):
    data = [(1, 7, 1, None, None, None, 50.0, None, "x"), (2, 7, 2, None, None, None, 5.0, None, "x")]
    files = spark.createDataFrame([(7, "percent", None, None)], F_COLS)
    got = {(r["row_id"], r["unit"], r["canonical"]) for r in U.foreign_values(spark.createDataFrame(data, S_COLS), files).collect()}
    assert got == {(1, "percent", 0.5), (2, "percent", 0.05)}


def test_votes_are_carried_over_stretches(spark):
    """However the blocks are cut into stretches, rows without vote find the nearest vote."""
    rng = np.random.default_rng(12)
    a, b = rows(rng, 1, 300, {}, fields=("effect", "pval")), rows(rng, 1, 300, {"pval": "percent"}, fields=("effect", "pval"))
    data = [b[i] if i % 90 > 60 else a[i] for i in range(300)]
    data = [(*x[:4], None, *x[5:]) if 100 <= i < 180 or i > 280 else x for i, x in enumerate(data)]
    stats, mixed = spark.createDataFrame(data, S_COLS), spark.createDataFrame([(1, "pval", "prob")], "file_id long, field string, unit string")
    near = lambda span: {(r["block"], str(r["pval"])) for r in U.nearest_votes(stats, mixed, 8, span).collect()}
    assert near(1) == near(3) == near(4096)
