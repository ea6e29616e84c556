"""Delimited lines that fail to parse are set apart with the reason; all others load typed.

Method: minimum-cost error parse. Lines of cost zero (sound quoting, as many values as the header, valid typed values) load;
the JVM settles these. Every other line is parsed by dynamic programming, first over its quotes, then over its separators:

* Over the tokens of the line (quotes, separators, stretches of text) the fewest edits of quotes are found that leave sound
  quoting: to insert, delete or double a quote, or to break a value at a quote by a separator. Sound quotes are never edited
  to mend the number of values, that is, one edit of a quote costs more than all edits of separators; among equally few
  edits of quotes the parse with the number of values nearest to the header's holds.
* The values are then aligned with the columns by the fewest inserted or deleted separators, and among these by those that
  leave valid values in the typed columns.

The edits alone state the reason: an edited quote means ``quoting``, an edited separator ``columns``. Without any edit the
first typed value that is invalid is the reason (``chr``, ``pos`` or ``pval``).

Header: the first line of a file that is neither comment nor blank. Its separator is that declared for the file, else
the candidate that splits the header into the known column names, else into the most values.

Defined results: null lines are blank lines. Lines of files without any header line are no data. For columns that
are not described the names of the header itself are looked up; a field that is not among them is not checked. Repeated lines are each reported. A
repeated header is a line like any other. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import cut, ship, small, trimmed
from .drift import bare, columns_of_files, squeezed

SEPARATORS = ["\t", ",", ";", "|", " "]
TYPED = ["chr", "pos", "pval"]
VALID_CHR = r"(?i)^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y|MT|M)$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _escaped(sep: Column) -> Column:
    return F.when(sep == "|", F.lit("\\|")).otherwise(sep)


def _blank(sep: Column) -> Column:
    """Blanks that may stand around a value."""
    return F.when(sep == " ", F.lit("\\t")).when(sep == "\t", F.lit(" ")).otherwise(F.lit(" \\t"))


def field_pattern(sep: Column) -> Column:
    """Matches one sound value with the separator before it; the line needs one more separator put before it."""
    b, s = _blank(sep), _escaped(sep)
    value = F.concat(F.lit("["), b, F.lit(']*+(?:"(?:[^"]++|"")*+"['), b, F.lit(']*+|[^"'), s, F.lit("]*+)"))
    return F.concat(s, F.lit("("), value, F.lit(")"))


def sound_pattern(sep: Column) -> Column:
    """Matches a whole line whose quoting is sound."""
    b, s = _blank(sep), _escaped(sep)
    value = F.concat(F.lit("(?:["), b, F.lit(']*+(?:"(?:[^"]++|"")*+"['), b, F.lit(']*+|[^"'), s, F.lit("]*+))"))
    return F.concat(F.lit("^"), value, F.lit("(?:"), s, value, F.lit(")*+$"))


def _value(raw: Column) -> Column:
    """The value itself: without blanks and quotes around it, inner quotes single."""
    t = trimmed(raw)
    return F.when(t.startswith('"'), trimmed(F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"')))).otherwise(t)


def headers(lines: DataFrame, files: DataFrame, column_info: DataFrame, comment: str = "##") -> DataFrame:
    """(file_id, head_no, head_id, sep, cols, names): the header line of each file, its separator and bare names, and the
    names that column_info has for the file in order."""
    head = _body(lines, comment).groupBy("file_id").agg(F.min(F.struct("line_no", "line_id", "raw_text")).alias("h")).select("file_id", F.col("h.line_no").alias("head_no"), F.col("h.line_id").alias("head_id"), F.col("h.raw_text").alias("head"))
    names = column_info.groupBy("file_id", "col_index").agg(F.max_by("input_name", F.struct("recorded_at", "ci_id")).alias("n")).groupBy("file_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("col_index", bare(F.col("n")).alias("n")))), lambda x: x["n"]).alias("names")
    )  # bounded by the columns of one file
    h = head.join(files.select("file_id", F.col("sep").alias("_sep")).dropDuplicates(["file_id"]), "file_id", "left").join(names, "file_id", "left")
    h = h.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))

    def parts(sep: Column) -> Column:
        return F.transform(F.regexp_extract_all(F.concat(sep, "head"), field_pattern(sep), F.lit(1)), lambda x: bare(x))

    fit = lambda s: F.struct((F.array_size(F.array_intersect(parts(F.lit(s)), "names"))).alias("a"), F.array_size(parts(F.lit(s))).alias("b"), F.lit(s).alias("sep"))
    h = h.withColumn("sep", F.when(F.length("_sep") >= 1, F.substr("_sep", F.lit(1), F.lit(1))).otherwise(F.array_max(F.array(*[fit(s) for s in SEPARATORS]))["sep"]))
    return h.select("file_id", "head_no", "head_id", "sep", parts(F.col("sep")).alias("cols"), "names")


def _body(lines: DataFrame, comment: str) -> DataFrame:
    text = F.coalesce("raw_text", F.lit(""))
    return lines.filter(~F.ltrim(text).startswith(comment) & (trimmed(text) != ""))


def places(heads: DataFrame, column_info: DataFrame, aliases: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(file_id, field, place): where each field stands in the lines of a file, from 1. The name that column_info gives the
    field is looked up in the header; else the field's place in column_info holds; else a known name in the header."""
    want = lambda df: df.filter(F.col("field").isin(only)) if only else df
    cells = heads.select("file_id", F.posexplode("cols").alias("i", "col"))
    fields = want(columns_of_files(column_info, aliases).select("file_id", "field", "name"))
    known = want(aliases.select(squeezed(F.col("input_name")).alias("_key"), F.lower(trimmed(F.col("standard_name"))).alias("field")).filter("_key <> '' and field <> ''"))
    known = known.groupBy("_key").agg(F.min("field").alias("field"))
    if only:  # a standard name is one of its own names
        known = known.unionByName(known.sparkSession.createDataFrame([(f, f) for f in only], "_key string, field string")).distinct()
    named = cells.join(fields, (cells["file_id"] == fields["file_id"]) & (cells["col"] == fields["name"])).select(cells["file_id"], "field", F.lit(1).alias("how"), (F.col("i") + 1).alias("place"))
    told = heads.select("file_id", "names").join(fields, "file_id").select("file_id", "field", F.lit(2).alias("how"), F.array_position("names", F.col("name")).cast("int").alias("place")).filter("place > 0")
    alike = cells.withColumn("_key", squeezed(F.col("col"))).join(small(known, 100_000), "_key").select("file_id", "field", F.lit(3).alias("how"), (F.col("i") + 1).alias("place"))
    best = named.unionByName(told).unionByName(alike).groupBy("file_id", "field").agg(F.min(F.struct("how", "place")).alias("b"))
    return best.select("file_id", "field", F.col("b.place").alias("place"))


def data_lines(lines: DataFrame, files: DataFrame, column_info: DataFrame, aliases: DataFrame, comment: str = "##", bound: int = 50_000, layout: bool = False) -> DataFrame:
    """(line_id, file_id, line_no, raw_text, sep, n_cols, at): the lines after the header; at maps chr, pos and pval to
    their places from 1; with ``layout`` also the fields of all places. One row per file is joined: broadcast if counted to
    at most ``bound`` rows, else shuffled."""
    heads = cut(headers(lines, files, column_info, comment))  # one row a file, used several times
    at = places(heads, column_info, aliases, None if layout else TYPED)
    h = heads.join(at.filter(F.col("field").isin(TYPED)).groupBy("file_id").pivot("field", TYPED).agg(F.first("place")), "file_id", "left")
    more = []
    if layout:
        cells = heads.select("file_id", F.posexplode("cols").alias("i", "col")).withColumn("place", F.col("i") + 1)
        of = at.groupBy("file_id", "place").agg(F.min("field").alias("field"))
        cells = cells.join(of, ["file_id", "place"], "left").withColumn("field", F.coalesce("field", F.nullif(squeezed(F.col("col")), F.lit("")), "col"))
        h = h.join(cells.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "field"))), lambda x: x["field"]).alias("fields")), "file_id", "left")
        more = ["fields"]
    h = h.select("file_id", "head_no", "head_id", "sep", F.array_size("cols").alias("n_cols"), F.struct(*TYPED).alias("at"), field_pattern(F.col("sep")).alias("_field"), sound_pattern(F.col("sep")).alias("_sound"), *more)
    out = _body(lines, comment).select("line_id", "file_id", "line_no", "raw_text").join(small(h, bound), "file_id")
    return out.filter(F.struct("line_no", "line_id") > F.struct(F.col("head_no"), F.col("head_id"))).drop("head_no", "head_id")


def judged(rows: DataFrame) -> DataFrame:
    """data_lines with (reason, chr, pos, pval): reason is null for lines that load. JVM only."""
    sound = F.expr("raw_text rlike _sound")
    cells = F.when(sound, F.expr("regexp_extract_all(concat(sep, raw_text), _field, 1)"))
    # explode over one element keeps the optimiser from copying the expensive expression into each of its uses
    r = rows.withColumn("_cells", F.explode(F.array(cells)))
    r = r.withColumn("_v", F.explode(F.array(F.struct(*[_value(F.get("_cells", F.col(f"at.{f}") - 1)).alias(f) for f in TYPED])))).select("*", "_v.*").drop("_v")
    digits = F.col("pos").rlike("^[0-9]+$")
    pos = F.when(digits, F.regexp_replace("pos", "^0+(?=[0-9])", ""))
    pos_ok = digits & (F.length(pos) <= 10) & F.col("pos").try_cast("long").between(1, 2147483647)
    p = F.col("pval").try_cast("double")
    pval_ok = (F.col("pval") == "") | (F.col("pval") == "NA") | (F.col("pval").rlike(NUMBER) & p.between(0, 1))
    has = lambda f: F.col(f"at.{f}").isNotNull()
    reason = (
        F.when(F.col("_cells").isNull(), "quoting").when(F.array_size("_cells") != F.col("n_cols"), "columns")
        .when(has("chr") & ~F.coalesce(F.col("chr").rlike(VALID_CHR), F.lit(False)), "chr")
        .when(has("pos") & ~F.coalesce(pos_ok, F.lit(False)), "pos")
        .when(has("pval") & ~F.coalesce(pval_ok, F.lit(False)), "pval")
    )
    return r.withColumn("reason", reason)


#: Standard fields that a line loads into, with their types. Fixed values.
STANDARD = {
    "variant_id": "string", "rsid": "string", "chr": "string", "pos": "int", "ref": "string", "alt": "string", "allele1": "string", "allele2": "string",
    "effect": "double", "effect_se": "double", "odds_ratio": "double", "zscore": "double", "pval": "double", "log10p": "double",
}


def _values() -> Column:
    """(field, value) of each column of a line, without empty ones and NA; of two columns of one field the first."""
    cells = F.transform("_cells", lambda c: F.nullif(F.nullif(_value(c), F.lit("")), F.lit("NA")))
    pairs = F.filter(F.arrays_zip(F.col("fields").alias("field"), cells.alias("value")), lambda x: x["value"].isNotNull())
    return F.filter(pairs, lambda x, i: i + 1 == F.array_position(F.transform(pairs, lambda y: y["field"]), x["field"]))


def cells(rows: DataFrame) -> DataFrame:
    """(line_id, file_id, field, value) of every value of the valid lines of ``data_lines(layout=True)``, as text."""
    good = judged(rows).filter("reason is null")
    return good.select("line_id", "file_id", F.explode(_values()).alias("_x")).select("line_id", "file_id", "_x.field", "_x.value")


def loaded(rows: DataFrame) -> DataFrame:
    """(line_id, file_id, line_no, the fields of STANDARD typed, further map<string, string>) of the valid lines of
    ``data_lines(layout=True)``; chr in the form chrN. ``further`` holds all other columns, and values of standard fields
    that their type cannot hold. Empty values and NA are null; of two columns of one field the first counts."""
    good = judged(rows).filter("reason is null")
    good = good.withColumn("_m", F.explode(F.array(F.map_from_entries(_values()))))  # one element: evaluated once
    c = F.concat(F.lit("chr"), F.regexp_replace(F.upper(F.regexp_replace("chr", "(?i)^chr", "")), "^M$", "MT"))
    cast = {f: F.try_element_at("_m", F.lit(f)).try_cast(t) for f, t in STANDARD.items()} | {"chr": c}
    kept = F.map_filter("_m", lambda k, v: ~k.isin(list(STANDARD)) | reduce(lambda a, b: a | b, [(k == f) & v.try_cast(t).isNull() for f, t in STANDARD.items() if t != "string"]))
    return good.select("line_id", "file_id", "line_no", *[x.alias(f) for f, x in cast.items()], kept.alias("further"))


# ---- repair by dynamic programming

_QUOTE, _SEP, _TEXT, _BLANK = range(4)
_SPAN = 1024  #: tokens whose steps are held at a time; of the others only each first one. The parse does not depend on it


def _tokens(line: str, sep: str) -> tuple[list[str], bytes]:
    """The tokens of a line and their kinds."""
    toks = [t for t in re.split('(["' + re.escape(sep) + "])", line) if t]
    return toks, bytes(_QUOTE if t == '"' else _SEP if t == sep else _TEXT if t.strip(" \t") else _BLANK for t in toks)


#: Of equal parses the edits before None come as early in the line as they can, those after it as late.
_FIRST = ["break at quote", "delete quote", None, "double quote", "insert quote"]


def _reads(s: int, kind: int) -> list[tuple[int, int, int, str | None]]:
    """(cost, values closed, next state, edit) of each way to read a token in state s."""
    if kind == _TEXT:
        return [(0, 0, max(s, 1), None)] if s < 3 else []
    if kind == _BLANK:
        return [(0, 0, s if s < 3 else 4, None)]
    if kind == _SEP:
        return [(0, 0, 2, None) if s == 2 else (0, 1, 0, None)]
    double = [(1, 0, 2, "double quote")] if s == 2 else []
    read = [(0, 0, 3 if s == 2 else 2, None)] if s in (0, 2, 3) else []
    return [*double, (1, 0, s, "delete quote"), *read]


def _moves(s: int, kind: int) -> list[tuple[int, int, int, tuple[str | None, ...]]]:
    """(cost, values closed, next state, edits) of each way past a token in state s; the last of the edits is that of the
    token itself. Before it a quote may be inserted, then a value broken. Of ways to the same the cheapest is kept."""
    before = [(0, 0, s, ()), *([(1, 0, 2 if s == 0 else 3, ("insert quote",))] if s in (0, 2) else [])]
    breaks = {_QUOTE: (1, 4), _TEXT: (3, 4)}.get(kind, ())
    before += [(c + 1, 1, 0, (*e, "break at quote")) for c, _, t, e in before if t in breaks]
    ways: dict[tuple[int, int], tuple[int, int, int, tuple[str | None, ...]]] = {}
    for c, k, t, e in before:
        for c2, k2, t2, e2 in _reads(t, kind):
            if (k + k2, t2) not in ways or c + c2 < ways[k + k2, t2][0]:
                ways[k + k2, t2] = (c + c2, k + k2, t2, (*e, e2))
    return sorted(ways.values(), key=lambda w: _FIRST.index(w[3][0]))


_MOVES = [[_moves(s, kind) for s in range(5)] for kind in range(4)]
_SOUND = [[next((t for c, _, t, _ in ways if not c), -1) for ways in of] for of in _MOVES]


def _steps(kinds: bytes, after: list[tuple[int, int, int]], top: int) -> list[list[tuple[int, int, int]]]:
    """Before each token and after the last one, by state: (fewest edits of the rest of the line, the numbers of values up
    to ``top`` that it can close with so few as bits, the least such number beyond or 0). Of those beyond the least always
    comes nearest to the header's."""
    out = [after]
    for kind in reversed(kinds):
        here = []
        for ways in _MOVES[kind]:
            cost = min([c + after[t][0] for c, _, t, _ in ways])
            bits = beyond = 0
            for c, k, t, _ in ways:
                c2, b, y = after[t]
                if c + c2 == cost:
                    if k:
                        b <<= 1
                        y += y > 0
                        if b >> top + 1:
                            b, y = b ^ (2 << top), top + 1
                    bits |= b
                    beyond = min(beyond, y) or beyond or y
            here.append((cost, bits, beyond))
        after = here
        out.append(after)
    return out[::-1]


def mend_quotes(line: str, sep: str, n_cols: int) -> tuple[list[str], str]:
    """(edits, line with sound quoting): the fewest edits of quotes; among equally few those that leave the number of values
    nearest to n_cols, of two as near the lower; of equals the one by the order of ``_FIRST``.

    States: 0 at the start of a value, 1 in a bare value, 2 in a quoted one, 3 right after its closing quote, 4 after
    blanks behind that. A sound line costs one look at each token. In any other, from its end, the fewest edits and the
    numbers of values that the rest of the line allows are found for each token and state; the parse follows them.
    """
    toks, kinds = _tokens(line, sep)
    s = 0
    for kind in kinds:
        s = _SOUND[kind][s]
        if s < 0:
            break
    if s not in (-1, 2):
        return [], line
    top, starts = max(n_cols, 1) - 1, range(0, len(toks), _SPAN)
    ends = [[(int(s == 2), 1, 0) for s in range(5)]]  # an open quote is closed at the end
    for i in reversed(starts):
        steps = _steps(kinds[i : i + _SPAN], ends[-1], top)
        ends.append(steps[0])
    _, bits, beyond = steps[0][0]
    under = bits.bit_length() - 1
    left = beyond if beyond and (not bits or beyond - top < top - under) else under
    edits, out, s = [], [], 0
    for i in starts:
        ends.pop()
        if i:
            steps = _steps(kinds[i : i + _SPAN], ends[-1], top)
        for j, kind in enumerate(kinds[i : i + _SPAN]):
            for c, k, t, done in _MOVES[kind][s]:
                c2, b, y = steps[j + 1][t]
                if c + c2 == steps[j][s][0] and left >= k and (b >> left - k & 1 if left - k <= top else y == left - k):
                    break
            s, left = t, left - k
            edits += [e for e in done if e]
            out += [{"insert quote": '"', "break at quote": sep, "double quote": '""', "delete quote": ""}.get(e, toks[i + j]) for e in done]
    return (edits + ["insert quote"], "".join(out) + '"') if s == 2 else (edits, "".join(out))


def split_sound(line: str, sep: str) -> list[str]:
    """The raw values of a line with sound quoting."""
    out, at, quoted = [], 0, False
    for i, ch in enumerate(line):
        if ch == '"':
            quoted = not quoted
        elif ch == sep and not quoted:
            out.append(line[at:i])
            at = i + 1
    return [*out, line[at:]]


def value_of(raw: str) -> str:
    """The value itself: without blanks and quotes around it, inner quotes single."""
    t = raw.strip()
    return t[1:-1].replace('""', '"').strip() if t.startswith('"') else t


_CHR, _POS, _NUMBER = re.compile(VALID_CHR), re.compile("[0-9]+"), re.compile(NUMBER)


def valid(field: str, value: str) -> bool:
    if field == "chr":
        return bool(_CHR.match(value)) and not value.endswith("\n")
    if field == "pos":
        return bool(_POS.fullmatch(value)) and 1 <= int(value.lstrip("0")[:11] or 0) <= 2147483647
    return value in ("", "NA") or (bool(_NUMBER.match(value)) and not value.endswith("\n") and 0 <= float(value) <= 1)


def align(values: list[str], n_cols: int, at: dict[str, int]) -> tuple[list[str], list[str]]:
    """(edits, values): the values brought to n_cols by the fewest inserted (empty) or deleted ones, and among these so
    that most typed columns hold valid values; of equals the edits that come last in the line."""
    m, d = len(values), abs(len(values) - n_cols)
    if not d:
        return [], values
    typed = {p - 1: f for f, p in at.items()}
    miss = lambda i, j: int(j in typed and not valid(typed[j], value_of(values[i]) if i is not None else ""))
    # layer[e]: (misfits, link) after so many steps with e edits; steps are columns if values lack, else values
    lack = m < n_cols
    layer: list[tuple[int, tuple | None] | None] = [(0, None), *[None] * d]
    for step in range(max(m, n_cols)):
        nxt: list[tuple[int, tuple | None] | None] = [None] * (d + 1)
        for e in range(max(0, step - min(m, n_cols)), min(d, step) + 1):
            if layer[e] is None:
                continue
            c, link = layer[e]
            i, j = (step - e, step) if lack else (step, step - e)
            if i < m and j < n_cols:
                x = c + miss(i, j)
                if nxt[e] is None or x < nxt[e][0]:
                    nxt[e] = (x, (0, values[i], link))
            if e < d:
                x = c + (miss(None, j) if lack else 0)
                if nxt[e + 1] is None or x <= nxt[e + 1][0]:
                    nxt[e + 1] = (x, (1, "" if lack else values[i], link))
        layer = nxt
    out, edits, link = [], [], layer[d][1]
    while link is not None:
        edit, text, link = link
        if edit:
            edits.append("insert separator" if lack else "delete separator")
        if lack or not edit:
            out.append(text)
    return edits, out[::-1]


def parse(line: str, sep: str, n_cols: int, at: dict[str, int]) -> tuple[str | None, list[str], str]:
    """(reason, edits, repaired line) of one line; without edits and with valid typed values the reason is None. A deleted
    separator takes the surplus value before or after it along."""
    edits, fixed = mend_quotes(line, sep, n_cols)
    values = split_sound(fixed, sep)
    more, values = align(values, n_cols, at)
    if edits or more:
        return ("quoting" if edits else "columns"), edits + more, sep.join(values)
    wrong = next((f for f in TYPED if f in at and not valid(f, value_of(values[at[f] - 1]) if at[f] <= len(values) else "\0")), None)
    return wrong, [], fixed


def failures(rows: DataFrame) -> DataFrame:
    """(line_id, file_id, line_no, reason, cost, edits, repaired, raw_text) of the lines that do not load: the minimum-cost
    parse of every line that the JVM does not settle as one of cost zero; cost is the number of edits."""
    bad = judged(rows).filter("reason is not null").select("line_id", "file_id", "line_no", "raw_text", "sep", F.col("n_cols").cast("int").alias("n_cols"), *[F.coalesce(f"at.{f}", F.lit(0)).cast("int").alias(f"_{f}") for f in TYPED])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, sep, n, *at in zip(pdf["raw_text"], pdf["sep"], pdf["n_cols"], *[pdf[f"_{f}"] for f in TYPED]):
                reason, edits, fixed = parse(text, sep, int(n), {f: int(p) for f, p in zip(TYPED, at) if p})
                out.append((reason, float(len(edits)), ", ".join(edits), fixed))
            done = pd.DataFrame(out, columns=["reason", "cost", "edits", "repaired"], index=pdf.index)
            yield pd.concat([pdf[["line_id", "file_id", "line_no"]], done, pdf["raw_text"]], axis=1)

    ship(rows.sparkSession)
    out = bad.mapInPandas(run, "line_id long, file_id long, line_no int, reason string, cost double, edits string, repaired string, raw_text string")
    return out.filter("reason is not null")
