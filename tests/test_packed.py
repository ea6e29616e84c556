import pytest

from allelemill.operators import packed as P

IDS = P.known_ids()
V = ["chr1_100_A_G_b37", "chrX_5_ACC_T_GRCh38", "chr22_9_G_C,A_hg19"]


@pytest.mark.parametrize("sep", [",", ";", "|", " ", "\t", ", ", "; ", " | ", " / ", " & "])
@pytest.mark.parametrize("wrap", ["{}", "[{}]", "{{ {} }}", "c({})"])
def test_ids(sep, wrap):
    for quote in ("", '"', "'"):
        cell = wrap.format(sep.join(quote + v + quote for v in V))
        assert P.segment(cell, IDS) == V, cell


@pytest.mark.parametrize(
    ("cell", "want"),
    [
        (None, []), ("", []), ("  ", []), (",;", []), (V[0], V[:1]), (V[2], V[2:]), (f'"{V[2]}"', V[2:]), (f"{V[0]},,{V[1]}", V[:2]), (f"{V[0]} | | {V[1]}", V[:2]), (f"{V[0]};", V[:1]),
        (f"{V[0]};{V[1]},'{V[2]}'", V), ("rs1; rs2", ["rs1", "rs2"]), ('"a;b"', ["a;b"]), ('"a;b";"', ["a;b", '"']), ('""', []), ('"";"x"', ["x"]), (f"{V[2]} {V[0]}", [V[2], V[0]]),
    ],
)
def test_cells(cell, want):
    assert P.segment(cell, IDS) == want


def test_names_with_delimiters_inside():
    f = P.known_words(["effect", "effect (per unit, adj)", "pval", "n|cases", "af"])
    assert P.segment("effect, effect (per unit, adj), pval", f) == ["effect", "effect (per unit, adj)", "pval"]
    assert P.segment("af|n|cases", f) == ["af", "n|cases"]
    assert P.segment('c("af", "n|cases")', f) == ["af", "n|cases"]
    assert P.segment("['af','n|cases']", f) == ["af", "n|cases"]


@pytest.mark.parametrize(
    ("cell", "want"),
    [(":|-", [":", "-"]), (": , -", [":", "-"]), (": ; _", [":", "_"]), ("'/', '|'", ["/", "|"]), ('"/"|"|"', ["/", "|"]), ("-c|:|-", ["-c", ":", "-"]), ("-c , : , -", ["-c", ":", "-"]), ('";" ":" "|"', [";", ":", "|"]), (":", [":"]), ("/", ["/"]), ('":"', [":"])],
)
def test_delimiters(cell, want):
    assert P.segment(cell, P.known_words(P.DELIMITERS)) == want


def test_long_cells_end():
    assert P.segment(" " * 200_000 + "x", IDS) == ["x"]
    assert len(P.segment(";".join([V[0]] * 3000), IDS)) == 3000
    assert len(P.segment(V[0] + " " * 50_000 + V[1], IDS)) == 2
    assert P.segment("'" * 5000, IDS) is not None


def test_frames(spark):
    df = spark.createDataFrame([(1, ";".join(V[:2]), 5), (2, V[0], 5), (2, V[0], 5), (3, None, 5), (4, ";".join(V[:2]), 5), (4, ";".join(V[:2]), 5), (None, "a;b", 1)], "row_id long, variant_id string, pos_no int")
    got = sorted(tuple(r) for r in P.split_variant_ids(df, "row_id", "variant_id", "f").collect())
    assert got == sorted([("f", 1, 1, V[0]), ("f", 1, 2, V[1])] + [("f", 4, 1, V[0]), ("f", 4, 2, V[1])] * 2)
    assert P.split_variant_ids(df.limit(0), "row_id", "variant_id", "f").count() == 0
    fixed = spark.createDataFrame([("a",)], "name string")
    names = spark.createDataFrame([(1, "'a'|'b, c'"), (2, "b, c; a"), (3, "a")], "k long, v string")
    got = sorted(tuple(r)[1:] for r in P.split_names(names, "k", "v", "n", fixed).collect())
    assert got == [(1, 1, "a"), (1, 2, "b, c"), (2, 1, "b, c"), (2, 2, "a")]
    joined = sorted(tuple(r)[1:] for r in P.split_names(names, "k", "v", "n", fixed, bound=1).collect())
    assert joined == got  # a dictionary beyond the bound is joined


def test_long_runs_of_separators():
    assert P.segment("a" + ",;|" * 40 + "b", IDS) == ["a", "b"]
    f = P.known_words(["x;;;;;;;;;;;;y", "a"])
    assert P.segment("a;;;;;;;;;;;;;x;;;;;;;;;;;;y", f) == ["a", "x;;;;;;;;;;;;y"]


def test_prefilter_loses_nothing(spark):
    cells = [";".join(V[:2]), f'"{V[2]}"', f"{V[0]};", f"[{V[0]}]", '"a" "b"', "'a''b'", "a b", " a ", "{a|b}", "a/b", '"a;b"']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "k long, cell string")
    kept = {r["k"] for r in df.filter(P.may_hold_several(df["cell"])).collect()}
    assert {i for i, c in enumerate(cells) if len(P.segment(c, IDS)) > 1} <= kept
