from datetime import datetime

from allelemill.operators import drift as D

C = "ci_id long, file_id long, col_index int, input_name string, standard_name string, class_name string, recorded_at timestamp, field string"
S = "file_id long, series_id string, release_no int, name string"
A = "standard_name string, input_name string"
AT = datetime(2023, 1, 1)


def make(spark, cols, files, aliases=(("pos", "BP"), ("chr", "CHROM"))):
    data = [(i, f, k, n, s, c, AT, "clash") for i, (f, k, n, s, c) in enumerate(cols)]
    return spark.createDataFrame(data, C), spark.createDataFrame([(*f, "x") for f in files], S), spark.createDataFrame(list(aliases), A)


COLS = [
    (1, 1, ' "BP" ', "Pos", "integer"), (1, 2, "CHROM", None, "character"), (1, 3, "N.cases", None, "double"), (1, 4, "old", None, None), (1, 5, "b36x", "x", "numeric"),
    (2, 1, "BP", None, "INT"), (2, 2, "CHROM", "chr ", "varchar"), (2, 3, "n_cases", " ", "bigint"), (2, 4, "new", None, None), (2, 5, "b36x", "X", None),
    (4, 1, "BP", "pos", "integer64"), (4, 1, "BP", "pos", "integer64"), (4, 5, "b36x", "x", "float8"),
]
FILES = [(1, "s", 1), (2, "s", 3), (4, "s", 10), (3, "t", 1), (5, None, 1)]


def test_changes(spark):
    got = {(r["file_id"], r["field"], r["drift"]) for r in D.drift(*make(spark, COLS, FILES)).collect()}
    assert got == {
        (2, "ncases", "renamed"), (2, "ncases", "retyped"), (2, "old", "removed"), (2, "new", "added"),
        (4, "pos", "retyped"), (4, "chr", "removed"), (4, "ncases", "removed"), (4, "new", "removed"),
    }


def test_release_order_over_stretches(spark):
    files = [(i, "s", 7 * i) for i in range(60)] + [(100 + i, "t", i * i) for i in range(20)]
    df = spark.createDataFrame([(*f, "x") for f in files], S)
    series = [sorted((f for f in files if f[1] == name), key=lambda f: f[2]) for name in "st"]
    want = {(name, k, f[0]) for name, x in zip("st", series) for k, f in enumerate(x)}
    for width in (1, 10, 100, 10_000):
        assert {(r["series_id"], r["n"], r["file_id"]) for r in D.release_order(df, width).collect()} == want


def test_changes_over_stretches_of_releases(spark):
    """The fused schema gives the same changes however it is cut into stretches; without it there are none."""
    cols = spark.createDataFrame([(i, f"f{k}", f"n{(i // 3) % 2}", "int" if i % 4 else "double") for i in range(20) for k in range(3) if (i + k) % 5], "file_id long, field string, name string, type string")
    order = D.release_order(spark.createDataFrame([(i, "s", 3 * i, "x") for i in range(20)], S))
    rows = {(r["file_id"], r["field"]): (r["name"], r["type"]) for r in cols.collect()}
    for width in (1, 4, 1024):
        spans = D.fused(cols, order, width).collect()
        assert {(n, r["field"]): (r["name"], r["type"]) for r in spans for n in range(r["from_n"], r["to_n"] + 1)} == rows


def test_found_comes_from_the_fused_schema(spark, monkeypatch):
    fused = D.fused
    monkeypatch.setattr(D, "fused", lambda *a: fused(*a).limit(0))
    assert D.drift(*make(spark, COLS, FILES)).count() == 0


def test_typed_values(spark):
    c, f, a = make(spark, [(1, 1, "n", None, "int"), (2, 1, "n", None, "character"), (1, 2, "pos", None, "integer"), (2, 2, "pos", None, "double")], [(1, "s", 1), (2, "s", 2)])
    cells = spark.createDataFrame([(1, 1, "n", "5"), (2, 1, "n", "5x"), (3, 2, "n", "7"), (4, 1, "pos", "12"), (5, 2, "pos", "1.5"), (6, 2, "new", "TRUE"), (7, 2, None, None)], "line_id long, file_id long, field string, value string")
    got = {r["line_id"]: r for r in D.typed_values(cells, c, f, a).collect()}
    assert (got[1]["tag"], got[1]["v_int"], got[1]["canonical_type"], got[1]["as_text"]) == ("int", 5, "string", "5")
    assert (got[2]["tag"], got[2]["v_string"], got[2]["v_int"]) == ("string", "5x", None) and got[3]["tag"] == "string"
    assert (got[4]["v_int"], got[4]["as_number"], got[5]["v_double"], got[5]["as_number"], got[5]["canonical_type"]) == (12, 12.0, 1.5, 1.5, "double")
    assert got[6]["v_string"] == "TRUE" and len(got) == 7


def test_latest_row_holds(spark):
    c, f, a = make(spark, [(1, 1, "a", None, "int"), (2, 1, "a", None, "int")], [(1, "s", 1), (2, "s", 2)])
    late = spark.createDataFrame([(9, 2, 1, "a", None, "double", datetime(2024, 1, 1), "q")], C)
    assert [r["drift"] for r in D.drift(c.unionByName(late), f, a).collect()] == ["retyped"]


def test_fused_fields(spark):
    got = {r["field"]: (r["canonical_type"], r["alternatives"], r["branches"]) for r in D.fused_fields(*make(spark, COLS, FILES)).collect()}
    assert got["ncases"] == ("double", "bigint|double", "ncases__bigint|ncases__double")
    assert got["pos"] == ("bigint", "bigint|int", "pos__bigint|pos__int")
    assert got["old"] == ("string", "", "") and got["x"] == ("double", "double", "")
    new = {(r["field"], r["type"], r["release_no"]) for r in D.new_alternatives(*make(spark, COLS, FILES)).collect()}
    assert new == {("ncases", "bigint", 3), ("pos", "bigint", 10)}


def test_empty_and_nulls(spark):
    c, f, a = make(spark, [(1, 1, None, None, None), (2, None, "", " ", "x")], [(1, "s", 1), (2, "s", None)])
    assert D.drift(c, f, a).count() == 0
    assert D.drift(c.limit(0), f.limit(0), a.limit(0)).count() == 0
    assert D.fused_fields(c, f, a).count() == 0


def test_unify(spark):
    one = spark.createDataFrame([(1, "a", 2.5)], "BP int, Name string, x double")
    two = spark.createDataFrame([(10**12, "7", True)], "bp long, x string, extra boolean")
    out = D.unify({"one": one, "two": two}, {"BP": "pos"})
    assert out.columns == ["_source", "pos", "pos__int", "pos__bigint", "name", "x", "x__double", "x__string", "extra"]
    got = {r["_source"]: r.asDict() for r in out.collect()}
    assert got["one"]["pos"] == 1 and got["one"]["pos__int"] == 1 and got["one"]["x"] == "2.5" and got["one"]["extra"] is None
    assert got["two"]["pos"] == 10**12 and got["two"]["pos__int"] is None and got["two"]["x__string"] == "7"
