"""Quantities recorded in different units.

Units are nodes of a graph; its edges are conversions: an affine function, or one of the two bridges between a scale
and its logarithm. Shortest compositions from each unit to the canonical one are computed beforehand and every cycle is
checked for consistency; the resulting coefficients form a small table that is equi-joined on the source unit.

Which unit a value is in is found from the data: p-value and effect of one row belong to one normal test, so a pair of
fields fits exactly one pair of units within rounding. Rows without such a pair are judged by pval beside log10p and
effect beside odds_ratio, which need no standard error. Such votes are counted per file, field and unit with the first
and last line; a file has one unit, or changes it at a line, or mixes units. Where a file has several units its rows vote
again, for these units only; that vote decides, and rows still without one follow the stretch or the nearest line that votes. Every vote counts, however long the file. Only where a
field has no vote at all, the declared unit (unit columns, notes) holds, else the range of its values, if more than a twentieth of a file's values
are impossible in the canonical unit: no p-value is negative or above 1, no log10p or odds ratio negative.

Defined results: nulls and NaN stay null and are in no unit. A value for which nothing speaks is taken as canonical.
Rows without file or line are judged with the file's first unit, unless units are mixed and they vote themselves. Non-positive ratios and p-values that cannot be
converted come out null. Repeated rows each get their result; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scale import at_most, cut, ship, small

LN10, LN2, SMD = math.log(10), math.log(2), math.pi / math.sqrt(3)

#: (source, target, kind, a, b): affine x -> a x + b, or the bridge ln / exp.
EDGES = [
    ("pval.percent", "pval.prob", "affine", 0.01, 0.0),
    ("pval.ln", "pval.prob", "exp", 1.0, 0.0),
    ("pval.neglog10", "pval.ln", "affine", -LN10, 0.0),
    ("log10p.log10", "log10p.neglog10", "affine", -1.0, 0.0),
    ("log10p.negln", "log10p.neglog10", "affine", 1 / LN10, 0.0),
    ("effect.log10", "effect.lnor", "affine", LN10, 0.0),
    ("effect.log2", "effect.lnor", "affine", LN2, 0.0),
    ("effect.milli", "effect.lnor", "affine", 0.001, 0.0),
    ("effect.smd", "effect.lnor", "affine", SMD, 0.0),
    ("effect.ratio", "effect.lnor", "ln", 1.0, 0.0),
    ("odds_ratio.ln", "odds_ratio.ratio", "exp", 1.0, 0.0),
    ("odds_ratio.percent", "odds_ratio.ratio", "affine", 0.01, 1.0),
]
CANONICAL = {"pval": "prob", "log10p": "neglog10", "effect": "lnor", "odds_ratio": "ratio"}
FIELDS = list(CANONICAL)
VOTING = ["effect", "effect_se", "odds_ratio", "pval", "log10p"]

#: Words of declarations. A column is named by a noun; the words of a scale say how its values are written. Fixed values.
NOUNS = {
    "odds_ratio": r"odds[ -]?ratios?|ors?", "log10p": r"lp|m?log_?10_?p", "pval": r"p|p[ _-]?val(?:ue)?s?|significances?|probabilit(?:y|ies)",
    "effect": r"effects?|betas?|estimates?|slopes?",
}
SCALES = {
    "percent": r"%|\bper ?cent(?:age)?s?\b|\bpct\b|(?<!\w)x ?100(?!0)|\* ?100(?!0)|\b100 ?(?:\*|x\b|times)|\btimes 100(?!0)", "milli": r"\bmilli|\bthousandths?\b|(?<!\w)x ?1000\b|\* ?1000\b|\b1000 ?(?:\*|x\b|times)|\btimes 1000\b|\b1e-0?3\b",
    "smd": r"\bsmd\b|\bstandardi[sz]ed\b|\bcohen", "log2": r"log_?2\b|\bbase[ -](?:2|two)\b", "log10": r"log_?10|\blg\b|\bbase[ -](?:10|ten)\b", "ln": r"\bln|\bnatural log|\be-?log\b|\blog_?e\b|\bbase e\b|\balready logged\b",
}
PLAIN = r"\b(?:not|never|un)[ -]?logged\b|\bratios?\b"
NEGATIVE = r"\bminus\b|\bneg(?:ative)?(?:\b|(?=log))|\bmlog|(?<!\w)- ?(?:log|ln|lg)"
SIGN_KEPT = r"\b(?:minus )?sign (?:is )?kept\b|\bnot negated\b|\bnot minus\b|<= ?0|\bunnegated\b"


def read_unit(text: str | None, of: str | None = None) -> tuple[str, str] | None:
    """(field, unit) that a declaration says, if it says one that is not canonical; ``of`` is the field of a unit column.

    Grammar: clause = [column] scale. The column is the noun with "column" or "header" after it or "in" or "under" before
    it, else the first noun that is not the argument of a function ("log10 of p", "ln(p)"); a clause without column or
    without scale says nothing, except that the logarithm of p with its sign kept can only be log10p. What "instead of"
    introduces does not count.
    """
    low = " ".join((text or "").lower().replace("\u2212", "-").split())
    low = re.sub(r"\binstead of [\w-]+", "", low)
    if not low:
        return None
    body, field = low, of
    if of is None:
        noun = "|".join(f"(?P<{f}>{rx})" for f, rx in NOUNS.items())
        found = []
        for m in re.finditer(rf"(?<![\w-])(?:{noun})(?![\w-])", low):
            before, after = low[: m.start()], low[m.end() :]
            argument = bool(re.search(r"(?:log\w*|ln|lg)(?: of|\() ?$|(?:ln|log\w*) $|\* ?$", before))
            named = bool(re.match(r" (?:column|header|field)", after) or re.search(r"(?:\bin|\bunder(?: the)?) $", before))
            found.append((not named, argument, m.start(), m.lastgroup, m.span()))
        if found:
            field, span = (None, None) if min(found)[1] else min(found)[3:]
            body = low if span is None else low[: span[0]] + " " + low[span[1] :]
            if field is None and re.search(SIGN_KEPT, low) and re.search(SCALES["log10"], low):
                return "log10p", "log10"
    if field is None:
        return None
    has = {k: bool(re.search(rx, body)) for k, rx in SCALES.items()}
    negative, kept = bool(re.search(NEGATIVE, body)), bool(re.search(SIGN_KEPT, body))
    if field == "pval":
        unit = "percent" if has["percent"] else "neglog10" if has["log10"] and negative else "ln" if has["ln"] and not re.search(NEGATIVE, body.replace("negative", "")) else None
    elif field == "log10p":
        unit = "negln" if has["ln"] else "log10" if kept or (has["log10"] and not negative) else None
    elif field == "odds_ratio":
        unit = "percent" if has["percent"] else "ln" if has["ln"] else None
    else:
        unit = next((u for u in ("smd", "milli", "log2", "log10") if has[u]), None)
        if unit is None and (body == "d" and of is not None):
            unit = "smd"
        if unit is None and (re.search(PLAIN, body) or (of is not None and body == "or")) and not has["ln"]:
            unit = "ratio"
    return (field, unit) if unit else None


# ---- the conversion graph


def _apply(steps: list[tuple[str, float, float]], x: float) -> float:
    for kind, a, b in steps:
        x = a * x + b if kind == "affine" else math.log(x) if kind == "ln" else math.exp(x)
    return x


def _inverse(kind: str, a: float, b: float) -> tuple[str, float, float]:
    return ("affine", 1 / a, -b / a) if kind == "affine" else ("exp" if kind == "ln" else "ln", 1.0, 0.0)


def shortest(edges: list[tuple], target: str) -> dict[str, list[tuple[str, float, float]]]:
    """Steps that lead from each unit that can reach ``target`` to it, by breadth-first search over the edges both ways."""
    into: dict[str, list] = {}
    for s, t, kind, a, b in edges:
        into.setdefault(t, []).append((s, (kind, a, b)))
        into.setdefault(s, []).append((t, _inverse(kind, a, b)))
    found, queue = {target: []}, deque([target])
    while queue:
        at = queue.popleft()
        for other, step in into.get(at, []):
            if other not in found:
                found[other] = [step, *found[at]]
                queue.append(other)
    return found


def check_cycles(edges: list[tuple], tolerance: float = 1e-9) -> None:
    """Raises ValueError if two ways between units disagree: every edge must agree with the tree of shortest ways."""
    units = {u for e in edges for u in e[:2]}
    while units:
        root = min(units)
        ways = shortest(edges, root)
        units -= ways.keys()
        for s, t, kind, a, b in edges:
            if s in ways:
                for x in (0.3, 0.7, 1.9):
                    try:
                        one, two = _apply(ways[s], x), _apply([(kind, a, b), *ways[t]], x)
                    except (ValueError, OverflowError):
                        continue
                    if abs(one - two) > tolerance * max(1, abs(one)):
                        raise ValueError(f"conversions disagree: {s} -> {t}")


def compose(edges: list[tuple] = EDGES, canonical: dict[str, str] = CANONICAL) -> list[tuple]:
    """(field, unit, a1, b1, bridge, a2, b2) rows: value -> a2 * bridge(a1 x + b1) + b2 in the canonical unit."""
    check_cycles(edges)
    rows = []
    for field, unit in canonical.items():
        for source, steps in shortest(edges, f"{field}.{unit}").items():
            pre, bridge, post = [1.0, 0.0], "", [1.0, 0.0]
            for kind, a, b in steps:
                if kind != "affine":
                    if bridge:
                        raise ValueError(f"two bridges on the way from {source}")
                    bridge = kind
                elif bridge:
                    post = [a * post[0], a * post[1] + b]
                else:
                    pre = [a * pre[0], a * pre[1] + b]
            rows.append((field, source.split(".", 1)[1], *pre, bridge, *post))
    return rows


# ---- evidence: which unit is a value in


def neglog10_p(z: np.ndarray) -> np.ndarray:
    """-log10 of the two-sided normal p-value of z, also far out in the tail."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = -1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))
    return -(np.log(t) - x * x + poly) / LN10


#: Units of each field in the order in which the graph reaches them from the canonical one.
COMPOSED = compose()
UNITS = {f: [u for g, u, *_ in COMPOSED if g == f] for f in CANONICAL}


def _converted(x: np.ndarray, a1: float, b1: float, bridge: str, a2: float, b2: float) -> np.ndarray:
    y = a1 * x + b1
    return a2 * (np.exp(y) if bridge == "exp" else np.log(y) if bridge == "ln" else y) + b2


def _candidates(pdf: pd.DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """-log10 p of each row for each unit that each field could be in: the value is converted to the canonical unit by
    the composition of the graph and must be possible there."""
    x = {f: pdf[f].to_numpy(dtype=float, na_value=np.nan) for f in FIELDS}
    se = pdf["effect_se"].to_numpy(dtype=float, na_value=np.nan)
    se = np.where(se > 0, se, np.nan)
    strength = {
        "pval": lambda p: np.where((p > 0) & (p <= 1), -np.log10(p), np.nan),
        "log10p": lambda g: np.where(g >= 0, g, np.nan),
        "effect": lambda e: neglog10_p(e / se),
        "odds_ratio": lambda o: neglog10_p(np.log(o) / se),
    }
    out: dict[str, dict[str, np.ndarray]] = {f: {} for f in FIELDS}
    with np.errstate(all="ignore"):
        for f, u, *way in COMPOSED:
            out[f][u] = strength[f](_converted(x[f], *way))
    return out


def row_votes(pdf: pd.DataFrame, fit: float = 0.002, clear: float = 0.02, masks: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """For each field the position of the unit that the row speaks for, else -1. masks limit the units of each field and row
    to those whose bits (2 to the power of their position) are set.

    A pair of fields speaks if one pair of units agrees within ``fit`` and every pair with another unit is off by more
    than ``clear`` (both relative to 1 + -log10 p). Where no effect and p-value speak, the two p-values (as -log10 p) and
    the two effects (as log odds, relative to 0.1 + log odds) are compared.
    """
    cand = _candidates(pdf)
    with np.errstate(all="ignore"):
        odds = {f: {u: (np.log if f == "odds_ratio" else np.array)(_converted(pdf[f].to_numpy(dtype=float, na_value=np.nan), *way)) for g, u, *way in COMPOSED if g == f} for f in ("effect", "odds_ratio")}
    for f, u in ((f, u) for f in FIELDS for u in (UNITS[f] if masks else [])):
        barred = (masks[f] >> UNITS[f].index(u)) & 1 == 0
        for of in (cand, odds):
            if f in of:
                of[f][u] = np.where(barred, np.nan, of[f][u])
    votes = {f: np.full(len(pdf), -1) for f in FIELDS}
    pairs = [(a, b, cand) for a in ("effect", "odds_ratio") for b in ("pval", "log10p")] + [("pval", "log10p", cand), ("effect", "odds_ratio", odds)]
    for k, (a, b, of) in enumerate(pairs):
        x, y = (np.array(list(of[f].values())) for f in (a, b))
        with np.errstate(all="ignore"):
            d = np.abs(x[:, None, :] - y[None, :, :]) / ((0.1 if of is odds else 1) + np.minimum(np.abs(x[:, None, :]), np.abs(y[None, :, :])))
        d = np.where(np.isfinite(d), d, np.inf).reshape(-1, len(pdf))
        best = d.argmin(0)
        low = d.min(0)
        n_b = y.shape[0]
        ids = np.arange(d.shape[0])
        for f, unit_of in ((a, ids // n_b), (b, ids % n_b)):
            mine = unit_of[best]
            other = np.where(unit_of[:, None] == mine[None, :], np.inf, d).min(0) if len(ids) else low
            speaks = (low <= fit) & (other > clear)
            votes[f] = np.where(speaks & (votes[f] < 0) if k > 3 else speaks, mine, votes[f])
    return votes


def _vote_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    units = {f: np.array(u) for f, u in UNITS.items()}
    for pdf in batches:
        votes = row_votes(pdf)
        parts = []
        for f in FIELDS:
            yes = votes[f] >= 0
            part = pd.DataFrame({"file_id": pdf["file_id"][yes], "line_no": pdf["line_no"][yes], "unit": units[f][votes[f][yes]]})
            part = part.groupby(["file_id", "unit"], as_index=False).agg(n=("line_no", "size"), first_line=("line_no", "min"), last_line=("line_no", "max"))
            parts.append(part.assign(field=f))
        out = pd.concat(parts)
        yield out[["file_id", "field", "unit", "n", "first_line", "last_line"]]


def unit_votes(stats: DataFrame) -> DataFrame:
    """(file_id, field, unit, n, first_line, last_line): counted in each batch already, so little is shuffled."""
    cols = stats.select("file_id", "line_no", *[F.col(c).cast("double").alias(c) for c in ("effect", "effect_se", "odds_ratio", "pval", "log10p")]).filter(
        "file_id is not null and line_no is not null"
    )
    ship(stats.sparkSession)
    raw = cols.mapInPandas(_vote_batches, "file_id long, field string, unit string, n long, first_line long, last_line long")
    return raw.groupBy("file_id", "field", "unit").agg(F.sum("n").alias("n"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))


def declared_units(files: DataFrame) -> DataFrame:
    """(file_id, field, unit) that pval_unit, effect_unit or a clause of the note of a file declare and that is not canonical."""
    said = F.array(
        F.struct(F.lit("pval").alias("of"), F.col("pval_unit").alias("text")),
        F.struct(F.lit("effect").alias("of"), F.col("effect_unit").alias("text")),
    )
    notes = F.transform(F.split(F.coalesce("note", F.lit("")), ";"), lambda x: F.struct(F.lit(None).cast("string").alias("of"), x.alias("text")))
    parts = files.select(F.col("file_id").cast("long").alias("file_id"), F.explode(F.concat(said, notes)).alias("s")).select("file_id", "s.of", "s.text").filter("trim(text) <> ''")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(k, r) for k, of, text in zip(pdf["file_id"], pdf["of"], pdf["text"]) if (r := read_unit(text, of if isinstance(of, str) else None))]
            yield pd.DataFrame([(k, *r) for k, r in got], columns=["file_id", "field", "unit"]).astype({"file_id": "int64"})

    ship(files.sparkSession)
    return parts.mapInPandas(read, "file_id long, field string, unit string").groupBy("file_id", "field").agg(F.min("unit").alias("unit"))


def ranged_units(stats: DataFrame) -> DataFrame:
    """(file_id, field, unit) where more than a twentieth of a file's values are impossible in the canonical unit of the
    field: the unit in which they are possible; of several the one that their size suits."""
    x = {f: F.when(present(F.col(f)), F.col(f).cast("double")) for f in ("pval", "log10p", "odds_ratio")}
    share = lambda bad: F.coalesce(F.avg(bad.cast("int")), F.lit(0.0))
    per = stats.filter("file_id is not null").groupBy(F.col("file_id").cast("long").alias("file_id")).agg(
        share(x["pval"] < 0).alias("p_neg"), share(x["pval"] > 1).alias("p_high"), F.max(x["pval"]).alias("p_max"), F.avg(x["pval"]).alias("p_avg"),
        share(x["log10p"] < 0).alias("g_neg"), share(x["odds_ratio"] < 0).alias("o_neg"), F.avg(F.abs(x["odds_ratio"])).alias("o_avg"),
    )
    unit = {
        "pval": F.when(F.col("p_neg") > 0.05, "ln").when(F.col("p_high") > 0.05, F.when((F.col("p_max") <= 100) & (F.col("p_avg") >= 20), "percent").otherwise("neglog10")),
        "log10p": F.when(F.col("g_neg") > 0.05, "log10"),
        "odds_ratio": F.when(F.col("o_neg") > 0.05, F.when(F.col("o_avg") >= 1, "percent").otherwise("ln")),
    }
    each = F.array(*[F.struct(F.lit(f).alias("field"), u.alias("unit")) for f, u in unit.items()])
    return per.select("file_id", F.explode(each).alias("e")).select("file_id", "e.*").filter("unit is not null")


def unit_segments(stats: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, field, unit, from_line, to_line, mixed): where each file's field is in which unit; lines inclusive.

    ``mixed`` marks units whose lines overlap; their lines only tell which comes first.
    """
    votes = cut(unit_votes(stats))
    runs = votes.groupBy("file_id", "field").agg(F.sort_array(F.collect_list(F.struct("first_line", "last_line", "unit"))).alias("runs"))  # at most one per unit
    ordered = F.aggregate(
        F.sequence(F.lit(1), F.size("runs") - 1, F.lit(1)), F.lit(True), lambda ok, i: ok & (F.get("runs", i - 1)["last_line"] < F.get("runs", i)["first_line"])
    )
    runs = runs.withColumn("mixed", ~F.when(F.size("runs") > 1, ordered).otherwise(F.lit(True)))
    mid = lambda i: ((F.get("runs", i)["last_line"] + F.get("runs", i + 1)["first_line"]) / 2).cast("long")
    seg = runs.select("file_id", "field", "runs", "mixed", F.posexplode("runs").alias("i", "run")).select(
        "file_id", "field", F.col("run.unit").alias("unit"),
        F.when(F.col("mixed"), F.col("run.first_line")).when(F.col("i") == 0, F.lit(-(2**62))).otherwise(mid(F.col("i") - 1) + 1).alias("from_line"),
        F.when(F.col("mixed"), F.col("run.last_line")).when(F.col("i") == F.size("runs") - 1, F.lit(2**62)).otherwise(mid(F.col("i"))).alias("to_line"),
        "mixed",
    )
    spoken = votes.select("file_id", "field").distinct()
    said = declared_units(files)
    ranged = ranged_units(stats).join(said, ["file_id", "field"], "left_anti")
    silent = said.unionByName(ranged).join(spoken, ["file_id", "field"], "left_anti")
    return seg.unionByName(silent.select("file_id", "field", "unit", F.lit(-(2**62)).alias("from_line"), F.lit(2**62).alias("to_line"), F.lit(False).alias("mixed")))


def _own_units(effect: pd.Series, effect_se: pd.Series, odds_ratio: pd.Series, pval: pd.Series, log10p: pd.Series, *masks: pd.Series) -> pd.DataFrame:
    allowed = {f: m.to_numpy(dtype=np.int64) for f, m in zip(FIELDS, masks)} if masks else None
    votes = row_votes(pd.DataFrame(dict(zip(VOTING, (effect, effect_se, odds_ratio, pval, log10p)))), masks=allowed)
    return pd.DataFrame({f: np.where(votes[f] >= 0, np.array(UNITS[f], dtype=object)[votes[f]], None) for f in FIELDS})


def _line_batches(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        own = _own_units(*[pdf[c] for c in VOTING])
        for f in FIELDS:
            part = pd.DataFrame({"file_id": pdf["file_id"], "field": f, "block": pdf["line_no"] // block, "line": pdf["line_no"], "unit": own[f].to_numpy()})
            part.loc[part["unit"].isna(), "line"] = -1  # tells only that the block has rows
            yield part.drop_duplicates()


def nearest_votes(stats: DataFrame, mixed: DataFrame, block: int, span: int = 4096) -> DataFrame:
    """(file_id, block, one array of (line, unit) a field): the votes among which a row of the block finds its nearest,
    for the files and fields of ``mixed``: where stretches in one unit begin and end, and the next votes before and after the block."""
    rows = stats.filter("file_id is not null and line_no is not null").select(F.col("file_id").cast("long").alias("file_id"), F.col("line_no").cast("long").alias("line_no"), *[F.col(c).cast("double").alias(c) for c in VOTING])
    ship(stats.sparkSession)
    raw = rows.mapInPandas(lambda it: _line_batches(it, block), "file_id long, field string, block long, line long, unit string")
    raw = raw.join(F.broadcast(mixed.select("file_id", "field")) if at_most(mixed, 200_000) else mixed.select("file_id", "field"), ["file_id", "field"], "left_semi")
    votes = raw.groupBy("file_id", "field", "block").agg(F.sort_array(F.collect_set(F.when(F.col("unit").isNotNull(), F.struct("line", "unit")))).alias("v"))
    before, after = lambda i: F.get("v", i - 1)["unit"], lambda i: F.get("v", i + 1)["unit"]
    ends = F.filter("v", lambda p, i: ~(p["unit"].eqNullSafe(before(i)) & p["unit"].eqNullSafe(after(i))))
    # the nearest votes before and after a block: within stretches of ``span`` blocks, and from stretch to stretch
    key, last, first = ["file_id", "field"], F.get("v", F.size("v") - 1), F.get("v", F.lit(0))
    votes = cut(votes.select(*key, "block", F.floor(F.col("block") / span).alias("part"), ends.alias("v")).withColumns({"last": last, "first": first}))
    reach = lambda k, order: Window.partitionBy(*k).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = votes.groupBy(*key, "part").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("block"))).alias("l"), F.min_by("first", F.when(F.col("first").isNotNull(), F.col("block"))).alias("f"))
    carried = carried.select(*key, "part", F.last("l", True).over(reach(key, F.col("part"))).alias("l"), F.last("f", True).over(reach(key, F.desc("part"))).alias("f"))
    inner = [*key, "part"]
    votes = votes.join(carried, inner).select(
        *key, "block", "v", F.coalesce(F.last("last", True).over(reach(inner, F.col("block"))), "l").alias("before"), F.coalesce(F.last("first", True).over(reach(inner, F.desc("block"))), "f").alias("after"),
    )
    near = F.array_compact(F.concat(F.array("before"), "v", F.array("after")))
    return votes.select("file_id", "field", "block", near.alias("near")).groupBy("file_id", "block").pivot("field", FIELDS).agg(F.first("near"))


def with_units(stats: DataFrame, files: DataFrame, block: int = 64, bound: int = 200_000) -> DataFrame:
    """stats with ``<field>_unit`` for the four fields. Only files with other than canonical units are joined: the list
    is broadcast if it has been counted to at most ``bound`` rows, else shuffled (AQE splits the skewed files)."""
    seg = cut(unit_segments(stats, files))
    odd = seg.filter(F.col("mixed") | ~F.concat_ws(".", "field", "unit").isin([f"{f}.{u}" for f, u in CANONICAL.items()]))
    per_file = odd.filter("not mixed").groupBy("file_id").pivot("field", FIELDS).agg(F.collect_list(F.struct("from_line", "to_line", "unit")))
    line = F.coalesce(F.col("line_no"), F.lit(0)).cast("long")
    per_file = per_file.select(F.col("file_id").alias("_file"), *[F.col(f).alias(f"_{f}_runs") for f in FIELDS])
    out = stats.join(small(per_file, bound), F.col("file_id") == F.col("_file"), "left").drop("_file")
    for f in FIELDS:
        run = F.get(F.filter(f"_{f}_runs", lambda r: (r["from_line"] <= line) & (line <= r["to_line"])), F.lit(0))
        out = out.withColumn(f"{f}_unit", F.coalesce(run["unit"], F.lit(CANONICAL[f]))).drop(f"_{f}_runs")
    bit = F.create_map(*[F.lit(x) for f in FIELDS for i, u in enumerate(UNITS[f]) for x in (f"{f}.{u}", 1 << i)])
    several = seg.groupBy("file_id", "field").agg(F.count(F.lit(1)).alias("k"), F.max("mixed").alias("mixed"), F.min_by("unit", F.struct("from_line", "unit")).alias("u"), F.sum(bit[F.concat_ws(".", "field", "unit")]).alias("m")).filter("k > 1")
    several = cut(several)
    if several.limit(1).count():  # files with more than one unit in a field: their rows vote again, for these units only
        names = several.groupBy(F.col("file_id").alias("_file")).pivot("field", FIELDS).agg(F.first(F.when(F.col("mixed"), F.col("u"))).alias("u"), F.first("m").alias("m"))
        names = small(names.select("_file", *[F.col(f"{f}_{x}").alias(f"_{f}_{x}") for f in FIELDS for x in "um"]), bound)
        same_file = F.col("file_id") == F.col("_file")
        inside = out.join(names, same_file).drop("_file")
        mask = {f: F.coalesce(f"_{f}_m", bit[F.concat(F.lit(f"{f}."), F.col(f"{f}_unit"))]) for f in FIELDS}
        own = F.pandas_udf(_own_units, "struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">")
        inside = inside.withColumn("_own", own(*[F.col(c).cast("double") for c in VOTING], *[mask[f] for f in FIELDS]))
        mixed = several.filter("mixed")
        nearest = {f: F.lit(None).cast("string") for f in FIELDS}
        if mixed.limit(1).count():
            inside = inside.withColumn("_block", F.floor(F.col("line_no") / block))
            near = nearest_votes(stats.join(small(mixed.select(F.col("file_id").alias("_file")).distinct(), bound), same_file, "left_semi"), mixed, block)
            near = near.select(F.col("file_id").alias("_file"), F.col("block").alias("_near_block"), *[F.col(f).alias(f"_{f}") for f in FIELDS])
            inside = inside.join(small(near, bound // block), same_file & (F.col("_block") == F.col("_near_block")), "left").drop("_file", "_block", "_near_block")
            for f in FIELDS:
                nearest[f] = F.array_min(F.transform(f"_{f}", lambda p: F.struct(F.abs(p["line"] - F.col("line_no")).alias("d"), p["line"].alias("line"), p["unit"].alias("unit"))))["unit"]
        for f in FIELDS:
            rest = F.when(F.col(f"_{f}_u").isNotNull(), F.coalesce(nearest[f], F.col(f"_{f}_u"))).otherwise(F.col(f"{f}_unit"))
            inside = inside.withColumn(f"{f}_unit", F.when(F.col(f"_{f}_m").isNull(), F.col(f"{f}_unit")).otherwise(F.coalesce(F.col(f"_own.{f}"), rest)))
        out = out.join(names, same_file, "left_anti").unionByName(inside.select(out.columns))
    return out


def present(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def compositions(spark: SparkSession) -> DataFrame:
    """The table of shortest compositions: (field, unit, a1, b1, bridge, a2, b2, foreign); one row a unit, at most a few dozen."""
    rows = [(f, u, *way, u != CANONICAL[f]) for f, u, *way in COMPOSED]
    return spark.createDataFrame(rows, "field string, unit string, a1 double, b1 double, bridge string, a2 double, b2 double, foreign boolean")


def converted(x: Column) -> Column:
    """A value taken through the composition that its row was joined to; null where that is not defined."""
    y = F.col("a1") * x + F.col("b1")
    bridged = F.when(F.col("bridge") == "exp", F.exp(y)).when(F.col("bridge") == "ln", F.when(y > 0, F.ln(y))).otherwise(y)
    return F.col("a2") * bridged + F.col("b2")


def value_conversions(stats: DataFrame, files: DataFrame) -> DataFrame:
    """(row_id, field, unit, value, canonical, foreign) of each value: an equi-join on field and source unit with the
    compositions, whose row converts it and says whether that is a conversion at all."""
    u = with_units(stats.select("row_id", "file_id", "line_no", "effect_se", *FIELDS), files)
    each = F.array(*[F.when(present(F.col(f)), F.struct(F.lit(f).alias("field"), F.col(f"{f}_unit").alias("unit"), F.col(f).cast("double").alias("value"))) for f in FIELDS])
    values = u.select("row_id", F.explode(F.array_compact(each)).alias("v")).select("row_id", "v.*")
    joined = values.join(F.broadcast(compositions(stats.sparkSession)), ["field", "unit"])
    return joined.select("row_id", "field", "unit", "value", converted(F.col("value")).alias("canonical"), "foreign")


def foreign_values(stats: DataFrame, files: DataFrame) -> DataFrame:
    """(row_id, field, unit, value, canonical) of each value that is not in the canonical unit of its field."""
    return value_conversions(stats, files).filter("foreign").drop("foreign")


def to_canonical(stats: DataFrame, files: DataFrame) -> DataFrame:
    """stats with the four fields in canonical units, by equi-joins on the unit with the table of compositions."""
    out = with_units(stats, files)
    table = compositions(stats.sparkSession)
    parts = ("a1", "b1", "bridge", "a2", "b2")
    for f in FIELDS:
        t = table.filter(F.col("field") == f).select(F.col("unit").alias(f"{f}_unit"), *[F.col(p).alias(f"_conv_{p}") for p in parts])
        out = out.join(F.broadcast(t), f"{f}_unit", "left")  # at most a dozen rows
        a1, b1, bridge, a2, b2 = (F.col(f"_conv_{p}") for p in parts)
        x = a1 * F.col(f) + b1
        y = F.when(bridge == "exp", F.exp(x)).when(bridge == "ln", F.when(x > 0, F.ln(x))).otherwise(x)
        out = out.withColumn(f, F.when(present(F.col(f)), a2 * y + b2)).drop(*[f"_conv_{p}" for p in parts])
    return out.select(*stats.columns, *[f"{f}_unit" for f in FIELDS if f"{f}_unit" not in stats.columns])
