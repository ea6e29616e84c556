import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from allelemill.operators import error_parse as E

AT = datetime(2023, 1, 1)
HEAD = ["chr", "BP", "alt", "P", "remark"]


def frames(spark, sep, texts, declared=True, head=None):
    lines = ["## made by hand", "", sep.join(head or HEAD), *texts]
    raw = spark.createDataFrame([(i, 1, i, t, 9) for i, t in enumerate(lines)], "line_id long, file_id long, line_no int, raw_text string, sep int")
    files = spark.createDataFrame([(1, sep if declared else None, 2)], "file_id long, sep string, chr int")
    info = spark.createDataFrame([(k, 1, k, n, None, None, AT) for k, n in enumerate(HEAD)], "ci_id long, file_id long, col_index int, input_name string, standard_name string, class_name string, recorded_at timestamp")
    alias = spark.createDataFrame([("pos", "BP"), ("pval", "P"), ("chr", "chr")], "standard_name string, input_name string")
    return raw, files, info, alias


def reasons(spark, sep, texts, **k):
    got = E.failures(E.data_lines(*frames(spark, sep, texts, **k))).collect()
    return {r["line_id"] - 3: r["reason"] for r in got}


def brute(text, sep):
    """The rules of TESTDATA.md one by one."""
    blank = "".join(c for c in " \t" if c != sep)
    fields, i, n = [], 0, len(text)
    while True:  # one field per turn
        j = i
        while j < n and text[j] in blank:
            j += 1
        if j < n and text[j] == '"':
            k = j + 1
            while True:
                k = text.find('"', k)
                if k < 0:
                    return "quoting"
                if text[k : k + 2] == '""':
                    k += 2
                    continue
                break
            value, i = text[j + 1 : k].replace('""', '"'), k + 1
            while i < n and text[i] in blank:
                i += 1
            if i < n and text[i] != sep:
                return "quoting"
        else:
            k = text.find(sep, j)
            k = n if k < 0 else k
            value, i = text[j:k], k
            if '"' in value:
                return "quoting"
        fields.append(value.strip())
        if i >= n:
            break
        i += 1
    if len(fields) != 5:
        return "columns"
    c, p, _, v, _ = fields
    if not re.fullmatch(r"(?i)(chr)?([1-9]|1\d|2[0-2]|X|Y|MT?)", c, re.A):
        return "chr"
    if not re.fullmatch(r"[0-9]+", p) or not 1 <= int(p) <= 2147483647:
        return "pos"
    if v not in ("", "NA") and not (re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v, re.A) and 0 <= float(v) <= 1):
        return "pval"
    return None


CASES = [
    "1,5,A,0.5,x", "chr1,5,A,0.5,x", "CHRmt,5,A,NA,x", "M,5,A,,x", '"X","5","A","0.5","a,b"', '1,5,A,0.5,"say ""hi"""', " 1 , 5 ,A, 1e-8 , x ", '1,5,A,0.5, "q" ',
    '1,5,A,0.5,"open', '1,5,A,0.5,clo"se', '1,5,A,0.5,"a"b', '1,5,A,0.5,"a""', '1,5,"A",0."5",x', '"1,5,A,0.5,x', '1,5,A,0.5,""""',
    "1,5,A,0.5", "1,5,A,0.5,x,", ",1,5,A,0.5,x", "1,5,A,0.5,x,y,z", "1", ",".join(HEAD),
    "23,5,A,0.5,x", "chr0,5,A,0.5,x", "01,5,A,0.5,x", ",5,A,0.5,x", "chrchr1,5,A,0.5,x", "XY,5,A,0.5,x",
    "1,0,A,0.5,x", "1,-5,A,0.5,x", "1,5.0,A,0.5,x", "1,,A,0.5,x", "1,2147483647,A,0.5,x", "1,2147483648,A,0.5,x", "1,000000000005,A,0.5,x", "1,99999999999999999999,A,0.5,x", "1,NA,A,0.5,x",
    "1,5,A,1.1,x", "1,5,A,-0.1,x", "1,5,A,1e,x", "1,5,A,nan,x", "1,5,A,0.05f,x", "1,5,A,1.,x", "1,5,A,.5,x", "1,5,A,+1,x", "1,5,A,1e-400,x", "1,5,A,na,x", "1,5,A,1e5,x",
    "1,5,A,0.5," + "y" * 100_000, '1,5,A,0.5,"' + "y" * 50_000,
]


@pytest.mark.parametrize("sep", [",", ";", "|", "\t", " "])
def test_reasons(spark, sep):
    texts = [t.replace(",", sep) for t in CASES]
    if sep == " ":
        texts = [t for t in texts if not t.startswith(" ") and "  " not in t]
    want = {i: r for i, t in enumerate(texts) if t.strip() and (r := brute(t, sep))}
    assert reasons(spark, sep, texts) == want


def test_separator_found_and_comments_skipped(spark):
    texts = ["1\t5\tA\t0.5\tx", "## resumed", "   ", "1\t5\tA\t0.5", "1\t5\tA\t0.5"]
    assert reasons(spark, "\t", texts, declared=False) == {3: "columns", 4: "columns"}


def test_loaded_holds_every_column(spark):
    texts = ["1,5,A,0.5,x", "chrM,007,,NA,\"a, b\"", "1,5,A,0.5"]
    rows = {r["line_id"] - 3: r for r in E.loaded(E.data_lines(*frames(spark, ",", texts), layout=True)).collect()}
    assert set(rows) == {0, 1}
    one, two = rows[0], rows[1]
    assert (one["chr"], one["pos"], one["alt"], one["pval"], one["further"]) == ("chr1", 5, "A", 0.5, {"remark": "x"})
    assert (two["chr"], two["pos"], two["alt"], two["pval"], two["further"]) == ("chrMT", 7, None, None, {"remark": "a, b"})


@pytest.mark.parametrize(
    ("line", "n", "edits", "fixed"),
    [
        ("a,b,c", 3, [], "a,b,c"), ('a,"b,c"', 2, [], 'a,"b,c"'), ("a,b", 3, ["insert separator"], "a,b,"), ("a,b,c,d", 3, ["delete separator"], "a,b,c"), ('a,b"', 2, ["delete quote"], "a,b"),
        ('a,"b', 2, ["delete quote"], "a,b"), ('a,"b,c', 2, ["insert quote"], 'a,"b,c"'), ('"a"b",c', 2, ["double quote"], '"a""b",c'), ("", 1, [], ""), ("", 3, ["insert separator"] * 2, ",,"), ('"a"b,c', 3, ["break at quote"], '"a",b,c'),
    ],
)
def test_parse_edits(line, n, edits, fixed):
    _, got, repaired = E.parse(line, ",", n, {})
    assert got == edits and repaired == fixed
    assert E.parse(repaired, ",", n, {})[1] == []  # a repaired line is sound


def test_separators_go_where_typed_values_fit():
    at = {"chr": 1, "pos": 2, "pval": 4}
    assert E.parse("1,x,5,A,0.5,r", ",", 5, at)[1:] == (["delete separator"], "1,5,A,0.5,r")
    assert E.parse("1,7,5,A,0.5,x", ",", 5, at)[0] == "columns"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='1a", ;.', max_size=24), st.sampled_from([",", ";", " "]))
def test_edits_state_the_exact_reason(text, sep):
    if text.strip():
        assert E.parse(text, sep, 5, {"chr": 1, "pos": 2, "pval": 4})[0] == brute(text, sep)


def test_very_long_line_with_many_quotes():
    assert E.parse('"a" ' * 30_000, ",", 5, {})[0] == "quoting"


@pytest.mark.parametrize("m", [10, 4_000, 12_000])
def test_number_of_values_counts_at_any_length(m):
    edits, fixed = E.mend_quotes('1,5,"' + "a,b " * m, ",", 5)
    assert edits == ["insert quote"] and len(E.split_sound(fixed, ",")) == 5


@pytest.mark.parametrize("m", [3, 20, 3_000])
def test_numbers_far_beyond_the_header_are_told_apart(m):
    edits, fixed = E.mend_quotes("x," * m + '"b' + ",c" * 60, ",", 1)
    assert edits == ["insert quote"] and len(E.split_sound(fixed, ",")) == m + 1


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet='a", ', max_size=40), st.integers(0, 6), st.integers(1, 5))
def test_parse_does_not_depend_on_the_span(text, n, span):
    want, kept = E.mend_quotes(text, ",", n), E._SPAN
    E._SPAN = span
    try:
        assert E.mend_quotes(text, ",", n) == want
    finally:
        E._SPAN = kept


def test_repairs_of_a_long_line(spark):
    texts = ["1,5,A,0.5,x", '1,5,A,0.5,"' + "a,b " * 12_000]
    (r,) = E.failures(E.data_lines(*frames(spark, ",", texts))).collect()
    assert (r["reason"], r["cost"], r["edits"], r["repaired"]) == ("quoting", 1.0, "insert quote", texts[1] + '"')


def test_empty(spark):
    raw, files, info, alias = frames(spark, ",", ["1,5,A,0.5"])
    assert E.failures(E.data_lines(raw.limit(0), files, info, alias)).count() == 0
    only = raw.filter("raw_text is null or raw_text = ''")
    assert E.failures(E.data_lines(only, files, info, alias)).count() == 0
    assert E.failures(E.data_lines(raw, files.limit(0), info.limit(0), alias.limit(0))).count() == 1  # the header tells
    assert E.loaded(E.data_lines(only, files, info, alias, layout=True)).count() == 0
