import numpy as np
import pytest

from allelemill.llm import linkage as L

M = "meta_id long, cohort string, chr string, pos int, allele1 string, allele2 string, freq1 double, effect double, effect_se double, gene string, extra string"
B = M.replace("meta_id", "bio_id").replace("cohort", "biobank")
COMP = str.maketrans("ACGT", "TGCA")


def world(n=400, seed=0):
    """Meta rows, biobank rows and the true pairs: half of the biobank rows record a meta variant in other conventions."""
    r = np.random.default_rng(seed)
    meta, bio, true = [], [], set()
    for i in range(n):
        c, p = str(r.integers(1, 23)), int(r.integers(1, 400_000))
        a, b = r.choice(list("ACGT"), 2, replace=False)
        f, e, g = float(r.uniform(0.02, 0.98)), float(r.normal(0, 0.1)), f"GEN{p // 2000}"
        meta.append((i, "x", r.choice(["", "chr"]) + c, p, a.lower(), b, round(f, 4), round(e, 4), 0.02, g if r.random() < 0.9 else None, "q"))
        if i % 2:
            x, y, bf, be = a, b, f + r.normal(0, 0.01), e + r.normal(0, 0.01)
            if r.random() < 0.5:
                x, y, bf, be = y, x, 1 - bf, -be
            if r.random() < 0.15:
                x, y = x.translate(COMP), y.translate(COMP)
            q = p + (int(r.choice([0, -1])) if r.random() < 0.2 else 0)
            bio.append((1000 + i, "y", c.zfill(2) if r.random() < 0.97 else None, q, x, y if r.random() < 0.97 else None, round(float(bf), 3) if r.random() < 0.95 else None, round(float(be), 3), 0.02, g.lower() if r.random() < 0.8 else None, "q"))
            true.add((i, 1000 + i))
        else:  # a close neighbour with other alleles or elsewhere
            x, y = r.choice(list("ACGT"), 2, replace=False)
            bio.append((1000 + i, "y", c, p + int(r.integers(-4, 5)), x, y, round(float(r.uniform(0, 1)), 3), round(float(r.normal(0, 0.1)), 3), 0.02, g, "q"))
    return meta, bio, true


def test_precision_and_recall(spark):
    meta, bio, true = world()
    got = L.matches(spark.createDataFrame(meta, M), spark.createDataFrame(bio, B), "meta_id", "bio_id").collect()
    pairs = {(r["meta_id"], r["bio_id"]) for r in got}
    assert len(pairs & true) >= 0.93 * len(true) and len(pairs - true) <= 0.05 * len(pairs)
    assert all(0.5 <= r["confidence"] <= 1 for r in got)


def test_copies_and_missing_parts(spark):
    meta, bio, true = world(200, 1)
    again = [(10_000 + r[0], *r[1:]) for r in meta[:21]]
    no_place = [(r[0], r[1], None, *r[3:]) if r[0] == 1 else (r[0], r[1], r[2], None, *r[4:]) if r[0] == 3 else r for r in meta]
    got = L.matches(spark.createDataFrame(no_place + again, M), spark.createDataFrame(bio, B), "meta_id", "bio_id")
    pairs = {(r["meta_id"], r["bio_id"]) for r in got.collect()}
    for i, j in true:
        if i < 21 and (i, j) in pairs and i not in (1, 3):
            assert (10_000 + i, j) in pairs


def test_nulls_ties_and_empty(spark):
    none = (1, None, None, None, None, None, None, None, None, None, None)
    m = spark.createDataFrame([none, none, (2, "x", "1", 5, "", "?", float("nan"), None, None, " ", None), (None, *none[1:])], M)
    b = spark.createDataFrame([none, (2, "x", "1", 5, "A" * 5000, "-", 0.5, 0.1, None, "g" * 10_000, None)], B)
    assert L.matches(m, b, "meta_id", "bio_id").count() >= 0
    assert L.matches(m.limit(0), b, "meta_id", "bio_id").count() == 0
    assert L.matches(m.limit(0), b.limit(0), "meta_id", "bio_id").count() == 0


def test_label_model_separates_and_joins_correlated_votes():
    r = np.random.default_rng(0)
    rows: dict = {}
    for _ in range(4000):
        y = r.random() < 0.3
        f = r.choice(["1", "2"]) if y else r.choice(["1", "4", "5", "6"])
        e = f if r.random() < 0.9 else ("1" if y else "6")  # follows the frequency vote
        v = ("same" if r.random() < (0.9 if y else 0.2) else "far", "equal" if r.random() < (0.95 if y else 0.3) else "other", f, e, "equal" if r.random() < 0.8 else "na", "equal")
        n, t = rows.get(v, (0, 0))
        rows[v] = (n + 1, t + y)
    got = L.label_model([(*v, n) for v, (n, _) in rows.items()])
    p = np.array([x[-1] for x in got])
    n = np.array([a for a, _ in rows.values()])
    t = np.array([b for _, b in rows.values()])
    wrong = np.where(p >= 0.5, n - t, t).sum()
    assert wrong < 0.08 * n.sum() and ((p >= 0) & (p <= 1)).all()
    pair = L.correlated(np.array([[0, 0], [0, 0], [1, 1], [1, 1]]), np.ones(4), np.full(4, 0.5), [2, 2], [(0,), (1,)], 0.1, 2)
    assert pair == ((0,), (1,))
    assert L.correlated(np.array([[0, 0], [0, 1], [1, 0], [1, 1]]), np.ones(4), np.full(4, 0.5), [2, 2], [(0,), (1,)], 0.1, 2) is None


@pytest.mark.parametrize(
    ("a", "want"),
    [(("A", "G"), ["A/G"]), (("C", "T"), ["A/G"]), (("T", "A"), ["A/T"]), (("AC", "A"), ["long"]), (("I", "D"), ["long"]), (("C", None), ["A/C", "A/G", "C/G", "long"]), ((None, "ACC"), ["long"]), ((None, None), list(L.CLASSES))],
)
def test_allele_classes(spark, a, want):
    df = spark.createDataFrame([a], "x string, y string")
    assert df.select(L.allele_classes(df["x"], df["y"])).first()[0] == want


def test_genes_of_a_list_and_classes_of_copies(spark):
    meta = [(i, "x", "1", None, "A", "G", 0.3, 0.1, 0.02, "GEN1", "q") for i in (1, 2)] + [(3, "x", "1", 500, "A", "G", 0.3, 0.1, 0.02, "OTHER", "q")]
    bio = [(9, "y", "chr1", 100, "a", "g", 0.3, 0.1, 0.02, "gen7/gen1", "q"), (10, "y", "1", 400, "A", "G", 0.3, 0.1, 0.02, "GEN1 (near)", "q"), (11, "y", "1", 100, "A", "C", 0.3, 0.1, 0.02, "GEN1", "q")]
    m, b = spark.createDataFrame(meta, M), spark.createDataFrame(bio, B)
    (l, copies), (r, _) = L.representatives(L.prepared(m, "meta_id")), L.representatives(L.prepared(b, "bio_id"))
    assert {(x["k"], x["n"]) for x in l.collect()} == {(1, 2), (3, 1)} and {tuple(x) for x in copies.collect()} == {(1, 1), (1, 2)}
    pairs = L.votes(L.candidates(l, r)).collect()
    assert {(x["l_k"], x["r_k"], x["v_gene"]) for x in pairs} == {(1, 9, "equal"), (1, 10, "equal")}
    assert {tuple(x) for x in L.members(m, "meta_id").collect()} == {(1, 1), (1, 2), (3, 3)}
    assert {c for c in L.class_matches(m, b, "meta_id", "bio_id").columns} == {"meta_id", "bio_id", "n_left", "n_right", "confidence"}
