"""Several values packed in one cell.

Method: dictionary-guided segmentation. A multi-pattern automaton finds the known whole values (and, for identifiers,
their known beginnings and ends); dynamic programming covers the cell with known values, quoted stretches, separators
and, at a higher cost, unknown words, and takes the cheapest cover. Delimiters inside known values are thereby
protected. Cells that plainly hold one value are settled in the JVM and never reach Python.

Defined results: null, empty and blank cells hold no value. A quoted stretch is one value, whatever it holds, and
comes out without its quotes; an empty one is no value. Brackets around the whole cell, also those of ``c(...)``, and
empty places are no values. A quote that never closes is an ordinary character. Places count from 1. Rows that are
there twice come out twice; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import ship

#: What can stand between two values. Longer ones are tried too, as runs with blanks around them.
SEPARATORS = ",;|/&\t "
#: Beginnings and ends of variant identifiers: chromosome names and reference builds. Fixed values.
CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y", "M", "MT"]
BUILDS = ["b36", "b37", "b38", "hg18", "hg19", "hg38", "GRCh36", "GRCh37", "GRCh38", "grch36", "grch37", "grch38"]
#: Values of the field ``delimiter``: the delimiters themselves. Fixed values.
DELIMITERS = ["-c", ":", ";", ",", "|", "/", "_", "-", "&"]

_WRAP = re.compile(r"^\s*(?:c\s*\((.*)\)|\[(.*)\]|\{(.*)\}|\((.*)\)|<(.*)>)\s*$", re.S)
_MIDDLE = re.compile(r"_[0-9]+_[A-Za-z*<>.:,-]+_[A-Za-z*<>.:,-]+_$")


def automaton(words: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        if w:
            a.add_word(w, len(w))
    a.make_automaton()
    return a


def known_words(words: list[str]) -> Callable[[str], list[tuple[int, int]]]:
    """A finder of the spans of known whole values."""
    a = automaton(words) if words else None
    return lambda text: [(e - n + 1, e + 1) for e, n in a.iter(text)] if a else []


def known_ids() -> Callable[[str], list[tuple[int, int]]]:
    """A finder of variant identifiers: the spans from a known beginning to the nearest known end with sound parts between."""
    begin, end = automaton([f"chr{c}_" for c in CHROMOSOMES] + [f"{c}_" for c in CHROMOSOMES]), automaton([f"_{b}" for b in BUILDS])

    def find(text: str) -> list[tuple[int, int]]:
        ends = [(e - n + 1, e + 1) for e, n in end.iter(text)]
        if not ends:
            return []
        spans, k = [], 0
        starts = sorted((e - n + 1, e) for e, n in begin.iter(text))
        for s, under in starts:
            if s and (text[s - 1].isalnum() or text[s - 1] in "_."):
                continue
            while k < len(ends) and ends[k][0] < under:
                k += 1
            if k < len(ends) and _MIDDLE.match(text[under : ends[k][0] + 1]):
                spans.append((s, ends[k][1]))
        return spans

    return find


def segment(cell: str | None, find: Callable[[str], list[tuple[int, int]]], separators: str = SEPARATORS) -> list[str]:
    """The values of one cell in order, by the cheapest cover."""
    if cell is None or not cell.strip():
        return []
    text = cell.strip()
    known = find(text)
    m = _WRAP.match(text)
    if m and (0, len(text)) not in known:
        text = next(g for g in m.groups() if g is not None).strip()
        known = find(text)
    n = len(text)
    if (0, n) in known:
        return [text]
    spans: list[list[tuple[int, float, str]]] = [[] for _ in range(n)]  # values by their start: (end, cost, value)

    for s, e in known:
        if (s == 0 or text[s - 1] in separators) and (e == n or text[e] in separators):
            spans[s].append((e, 1.0, text[s:e]))
    i = 0
    while i < n:  # quoted stretches: opened at the start of a value, closed at the end of one
        q = text[i]
        if q in "\"'" and (i == 0 or text[i - 1] in separators):
            j = text.find(q, i + 1)
            while j > 0 and j + 1 < n and text[j + 1] not in separators:
                j = text.find(q, j + 1)
            if j > 0:
                spans[i].append((j + 1, 0.5, text[i + 1 : j]))
                i = j
        i += 1
    i = 0
    while i < n:  # unknown words
        if text[i] in separators:
            i += 1
            continue
        j = i
        while j < n and text[j] not in separators:
            j += 1
        spans[i].append((j, 2.0 + 0.01 * (j - i), text[i:j]))
        i = j
    inf = float("inf")
    # best[i][kind]: cheapest cover of text[:i] that ends in a value (1), in separators (0) or is nothing yet (0 at 0).
    # A run of separators opens at 0.1 and grows by one character at a time, blanks for nothing; what stands in it may also be a value
    best = [[inf, inf] for _ in range(n + 1)]
    back: list[list[tuple | None]] = [[None, None] for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n):
        if text[i] in separators:
            blank = text[i] in " \t"
            for kind in (1, 0):
                cost = best[i][kind] + (0.0 if blank else 0.05) + (0.1 if kind or not i else 0.0)
                if cost < best[i + 1][0]:
                    best[i + 1][0], back[i + 1][0] = cost, (i, kind, None)
        cost = best[i][0]  # values and separators alternate: a value never follows a value
        if cost == inf:
            continue
        for e, c, value in spans[i]:
            if cost + c < best[e][1]:
                best[e][1], back[e][1] = cost + c, (i, 0, value)
    at, kind, out = n, int(best[n][1] <= best[n][0]), []
    if best[n][kind] == inf:
        return [w for w in re.split(f"[{re.escape(separators)}]+", text) if w]
    while at:
        at, kind, value = back[at][kind]
        if value is not None and value.strip():
            out.append(value.strip())
    return out[::-1]


def may_hold_several(c: Column) -> Column:
    """False only for cells that plainly hold at most one value: no separator inside, brackets and quotes aside."""
    core = F.regexp_replace(c, r"""^[\s\[\]{}()"',;|/&]+|[\s\[\]{}()"',;|/&]+$""", "")
    return core.rlike(r"[\s,;|/&]") | (c.rlike(r"""["']""") & core.rlike(r"""["']"""))


def split_cells(df: DataFrame, key: str, cell: str, field: str, find: Callable[[], Callable[[str], list[tuple[int, int]]]], suspect: Column | None = None) -> DataFrame:
    """(field, row_key, pos_no, item) of each cell with more than one value. ``find`` makes the finder on each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = find()
        for pdf in batches:
            keys, places, items = [], [], []
            for k, text in zip(pdf["row_key"], pdf["cell"]):
                values = segment(text, finder)
                if len(values) > 1:
                    keys += [k] * len(values)
                    places += range(1, len(values) + 1)
                    items += values
            yield pd.DataFrame({"field": field, "row_key": keys, "pos_no": places, "item": items}).astype({"row_key": "int64", "pos_no": "int32"})

    cells = df.select(F.col(key).cast("long").alias("row_key"), F.col(cell).alias("cell")).filter(F.col("cell").isNotNull() & F.col("row_key").isNotNull())
    cells = cells.filter(may_hold_several(F.col("cell")) if suspect is None else suspect)
    ship(df.sparkSession)
    return cells.mapInPandas(run, "field string, row_key long, pos_no int, item string")


def learned_words(df: DataFrame, cell: str, fixed: DataFrame) -> DataFrame:
    """(w): the dictionary of a column: the fixed words (first column of a table) and every value that some cell quotes."""
    quoted = df.select(F.explode(F.regexp_extract_all(F.col(cell), F.lit(r'"([^"]+)"|\'([^\']+)\''), F.lit(0))).alias("w"))
    words = quoted.select(F.expr("trim(substring(w, 2, length(w) - 2))").alias("w"))
    return words.unionByName(fixed.select(F.col(fixed.columns[0]).alias("w"))).filter("w <> ''").distinct()


def _stretches(text: str, longest: int) -> set[str]:
    """What could be a known value of a cell: stretches between separators, up to the length of the longest word."""
    t = text.strip()
    m = _WRAP.match(t)
    out: set[str] = set()
    for x in {t, *([next(g for g in m.groups() if g is not None).strip()] if m else [])}:
        starts = [i for i in range(len(x)) if i == 0 or x[i - 1] in SEPARATORS]
        ends = [i for i in range(1, len(x) + 1) if i == len(x) or x[i] in SEPARATORS]
        k = 0
        for s in starts:
            while k < len(ends) and ends[k] <= s:
                k += 1
            for e in ends[k:]:
                if e - s > longest:
                    break
                out.add(x[s:e])
    return out


def split_by_words(df: DataFrame, key: str, cell: str, field: str, words: DataFrame, bound: int = 100_000, suspect: Column | None = None) -> DataFrame:
    """As split_cells with the words (w) of a table as dictionary. Up to ``bound`` words (and 16 MB) form one automaton on
    each worker; a larger dictionary is joined: the stretches of each cell that could be values meet the words in a shuffle,
    and each cell is covered with its own known words. The results are the same."""
    got = words.limit(bound + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("w")).alias("b")).first()
    if got["n"] <= bound and (got["b"] or 0) <= 1 << 24:
        known = sorted(r["w"] for r in words.collect())
        return split_cells(df, key, cell, field, lambda: known_words(known), suspect)
    longest = words.agg(F.max(F.length("w"))).first()[0]

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, w) for t in pdf["cell"].unique() for w in _stretches(t, longest)]
            yield pd.DataFrame(rows, columns=["cell", "w"])

    cells = df.select(F.col(key).cast("long").alias("row_key"), F.col(cell).alias("cell")).filter(F.col("cell").isNotNull() & F.col("row_key").isNotNull())
    cells = cells.filter(may_hold_several(F.col("cell")) if suspect is None else suspect)
    ship(df.sparkSession)
    texts = cells.select("cell").distinct()
    of = texts.mapInPandas(stretches, "cell string, w string").join(words, "w", "left_semi").groupBy("cell").agg(F.collect_set("w").alias("words"))
    texts = texts.join(of, "cell", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"cell": pdf["cell"], "items": [segment(t, known_words(list(w))) for t, w in zip(pdf["cell"], pdf["words"])]})

    items = texts.mapInPandas(run, "cell string, items array<string>").filter(F.size("items") > 1)
    out = cells.join(items, "cell").select("row_key", F.posexplode("items").alias("i", "item"))
    return out.select(F.lit(field).alias("field"), "row_key", (F.col("i") + 1).alias("pos_no"), "item")


def split_variant_ids(df: DataFrame, key: str, cell: str, field: str) -> DataFrame:
    return split_cells(df, key, cell, field, known_ids)


def split_names(df: DataFrame, key: str, cell: str, field: str, names: DataFrame, bound: int = 100_000) -> DataFrame:
    """names: a table with the known names in its first column."""
    return split_by_words(df, key, cell, field, learned_words(df, cell, names), bound)


def split_delimiters(df: DataFrame, key: str, cell: str, field: str) -> DataFrame:
    """As above where the values are delimiters themselves: alternatives of a pattern or a list of them."""
    return split_cells(df, key, cell, field, lambda: known_words(DELIMITERS), F.length(F.trim("cell")) > 1)
