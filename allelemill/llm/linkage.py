"""Matching entities across two sources without a common key.

Method: label-model linkage. Candidates come from equi-joins on coarse keys. Several matching functions each look at one
partial, noisy attribute of a candidate (position, alleles, frequency, effect, gene, chromosome) and vote with one of a
few levels. A generative model with a latent class (same entity or not) learns by expectation maximisation how often
each level is seen in either class, without labels; functions that are still correlated within the classes are found by
their conditional mutual information and modelled jointly. The posterior of the class is the confidence of a match.

The model sees only the counts of vote patterns: at most the product of the levels, whatever the size of the data.

Candidates always agree in a class of alleles (one of the four kinds of single-base changes, strands folded, or ``long``), so
many different records at one position are compared within their class only. A record that lacks an allele, or has only
a code, belongs to every class that it may be of. Exact copies form one class of records; only one of them is compared.

Defined results: exact copies of a row are compared once; ``matches`` reports each copy, ``class_matches`` the classes.
Nulls, blanks and unknown codes make a function abstain. Rows without chromosome are compared by position, rows without
position by chromosome and any of their genes (letters in any order); rows that have none of these have no candidates.
Without any candidate the result is empty.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import cut, trimmed

LEVELS = {
    "v_pos": ["same", "minus1", "plus1", "off2", "indel_same", "indel_near", "indel_far", "far", "na"],
    "v_alleles": ["equal", "palindrome", "strand", "half", "code", "none", "other"],
    "v_freq": ["1", "2", "3", "4", "5", "6", "na"],
    "v_effect": ["1", "2", "3", "4", "5", "6", "na"],
    "v_gene": ["equal", "near", "other", "na"],
    "v_chr": ["equal", "na"],
}
#: First guess of each vote: for (1), against (-1), abstaining (0).
POLARITY = {
    "v_pos": [1, 0.5, 0, -0.5, 1, 0, -1, -2, 0],
    "v_alleles": [0.5, 0.5, 0, 0, 0.5, 0, -2],
    "v_freq": [1, 0.5, 0, -0.5, -1, -2, 0],
    "v_effect": [1, 0.5, 0, -0.5, -1, -2, 0],
    "v_gene": [0.5, 0.5, -2, 0],
    "v_chr": [0.5, 0],
}
STEPS = [0.015, 0.03, 0.045, 0.07, 0.12]


def _flip(c: Column) -> Column:
    return F.translate(F.reverse(c), "ACGT", "TGCA")


def prepared(df: DataFrame, key: str) -> DataFrame:
    """One row per row of df in plain form: id, chromosome c, position p, alleles a1 and a2, frequency f, effect e, genes gs."""
    c = F.regexp_replace(F.regexp_replace(F.upper(trimmed(F.col("chr"))), "^CHR", ""), "^0+(?=.)", "")
    c = F.when(c == "23", "X").when(c == "24", "Y").when(c == "M", "MT").otherwise(c)
    allele = lambda x: F.when(F.upper(trimmed(F.col(x))).rlike("^([ACGT]+|-|I|D)$"), F.upper(trimmed(F.col(x))))
    names = F.split(F.regexp_replace(F.upper(F.coalesce("gene", F.lit(""))), r"\([^)]*\)", " "), r"[/,;|&\s]+")
    genes = F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda x: F.regexp_replace(x, "[^A-Z0-9-]", "")), lambda x: x != "")))
    number = lambda x: F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))
    return df.select(
        F.col(key).cast("long").alias("id"), F.nullif(c, F.lit("")).alias("c"), F.col("pos").cast("long").alias("p"), allele("allele1").alias("a1"), allele("allele2").alias("a2"),
        number("freq1").alias("f"), number("effect").alias("e"), genes.alias("gs"),
    ).filter("id is not null")


_CONTENT = ["c", "p", "a1", "a2", "f", "e", "gs"]
_HASH = ["h1", "h2"]


def representatives(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct records with their class k and its size n, (k, id) of the classes of more than one): k is the smallest
    id of the class; a hash of 128 bits of the contents leads the copies to it."""
    keyed = rows.withColumns({"h1": F.xxhash64(*_CONTENT), "h2": F.xxhash64(F.lit("second"), *_CONTENT)})
    one = cut(keyed.groupBy(*_HASH, *_CONTENT).agg(F.min("id").alias("k"), F.count(F.lit(1)).alias("n")))
    many = one.filter("n > 1").select(*_HASH, "k").join(keyed.select(*_HASH, "id"), _HASH).select("k", "id")
    return one.drop(*_HASH), many


#: Classes of alleles: the single-base changes with strands folded (the first name of each), and all longer ones.
CLASSES = {"A/C": ["A/C", "G/T"], "A/G": ["A/G", "C/T"], "A/T": ["A/T"], "C/G": ["C/G"], "long": []}


def allele_classes(a1: Column, a2: Column) -> Column:
    """The classes that a record may be of: one if both alleles are bases, more where one or both are missing."""
    base = lambda x: x.rlike("^[ACGT]$")
    pair = F.concat_ws("/", F.least(a1, a2), F.greatest(a1, a2))
    kind = F.coalesce(*[F.when(pair.isin(pairs), F.lit(name)) for name, pairs in CLASSES.items() if pairs], F.lit("long"))
    one = F.coalesce(a1, a2)
    half = F.array_compact(F.array(*[F.when(F.contains(F.lit(" ".join(pairs)), one), F.lit(name)) for name, pairs in CLASSES.items() if pairs], F.lit("long")))
    return (
        F.when(a1.isNotNull() & a2.isNotNull(), F.array(kind)).when(one.isNull(), F.array(*[F.lit(x) for x in CLASSES])).when(base(one), half).otherwise(F.array(F.lit("long")))
    )


def candidates(left: DataFrame, right: DataFrame, reach: int = 10) -> DataFrame:
    """Pairs of distinct records that share a class of alleles and a coarse key: both as columns with l_ and r_ before
    their names. A pair that shares several keys comes once."""
    side = lambda df, x: df.select(*[F.col(c).alias(f"{x}_{c}") for c in ["k", *_CONTENT]], allele_classes(F.col("a1"), F.col("a2")).alias(f"{x}_cls"))
    l, r = side(left, "l").withColumn("cls", F.explode("l_cls")), side(right, "r").withColumn("cls", F.explode("r_cls"))
    first = F.array_min(F.array_intersect("l_cls", "r_cls"))  # of the classes in common one brings the pair
    size = 2 * reach
    bins = F.array_distinct(F.array(F.floor((F.col("r_p") - reach) / size), F.floor((F.col("r_p") + reach) / size)))
    lb = l.filter("l_p is not null").withColumn("bin", F.floor(F.col("l_p") / size))
    rb = r.filter("r_p is not null").withColumn("bin", F.explode(bins))
    near = (F.abs(F.col("l_p") - F.col("r_p")) <= reach) & (lb["cls"] == first)
    here = (lb["bin"] == rb["bin"]) & (lb["cls"] == rb["cls"])
    by_place = lb.filter("l_c is not null").join(rb.filter("r_c is not null"), (F.col("l_c") == F.col("r_c")) & here & near)
    no_c1 = lb.filter("l_c is null").join(rb, here & near)
    no_c2 = lb.filter("l_c is not null").join(rb.filter("r_c is null"), here & near)
    letters = lambda gs: F.explode(F.array_distinct(F.transform(gs, lambda g: F.array_join(F.array_sort(F.split(g, "")), ""))))  # noqa: E731  the same for exchanged letters
    lg, rg = l.filter("l_c is not null").withColumn("g", letters("l_gs")), r.filter("r_c is not null").withColumn("g", letters("r_gs"))
    same = (F.col("l_c") == F.col("r_c")) & (lg["g"] == rg["g"]) & (lg["cls"] == rg["cls"]) & (lg["cls"] == first)
    no_p = lg.filter("l_p is null").join(rg, same).drop("cls", "g").unionByName(lg.filter("l_p is not null").join(rg.filter("r_p is null"), same).drop("cls", "g"))
    return reduce(DataFrame.unionByName, [x.drop("bin", "cls") for x in (by_place, no_c1, no_c2)] + [no_p.dropDuplicates(["l_k", "r_k"])]).drop("l_cls", "r_cls")


def votes(pairs: DataFrame) -> DataFrame:
    """pairs with one column for each matching function; built of JVM expressions only."""
    la1, la2, ra1, ra2 = (F.col(x) for x in ("l_a1", "l_a2", "r_a1", "r_a2"))
    both_l, both_r = la1.isNotNull() & la2.isNotNull(), ra1.isNotNull() & ra2.isNotNull()
    coded = ra1.isin("-", "I", "D") | ra2.isin("-", "I", "D")
    coded_l = la1.isin("-", "I", "D") | la2.isin("-", "I", "D")
    l_indel, r_indel = F.length(la1) != F.length(la2), F.length(ra1) != F.length(ra2)
    palindrome = _flip(la1) == la2
    eq, sw = (ra1 == la1) & (ra2 == la2), (ra1 == la2) & (ra2 == la1)
    fe, fs = (ra1 == _flip(la1)) & (ra2 == _flip(la2)), (ra1 == _flip(la2)) & (ra2 == _flip(la1))
    one_r = F.coalesce(ra1, ra2)
    l_at, l_other = F.when(ra1.isNotNull(), la1).otherwise(la2), F.when(ra1.isNotNull(), la2).otherwise(la1)
    # codes: I or the inserted bases stand for the longer allele, D or - for the shorter
    r1_long = ra1.isin("I") | (ra2 == "-") | (ra2 == "D")
    l1_long = F.length(la1) > F.length(la2)
    inserted = F.when(ra1 == "-", ra2).when(ra2 == "-", ra1)
    longer = F.when(l1_long, la1).otherwise(la2)
    tail = F.substr(longer, F.least(F.length(la1), F.length(la2)) + 1)
    code_ok = l_indel & (inserted.isNull() | (F.length(inserted) == F.length(tail)))
    code_eq = inserted.isNull() | (inserted == tail) | (inserted == _flip(tail)) | F.contains(longer, inserted) | F.contains(longer, _flip(inserted))
    # (level, sign): sign 1 the same allele first, -1 swapped, 0 not known
    s = lambda level, sign: F.struct(F.lit(level).alias("level"), F.lit(sign).alias("sign"))
    signed = lambda level, c: F.struct(F.lit(level).alias("level"), F.when(c, 1).otherwise(-1).alias("sign"))
    known = F.coalesce(
        F.when(~both_l | coded_l, F.when(both_l & both_r & (eq | sw), signed("code", eq)).otherwise(s("none", 0))),
        F.when(both_r & coded, F.when(code_ok & code_eq, signed("code", l1_long == r1_long)).otherwise(s("other", 0))),
        F.when(both_r & (eq | sw) & palindrome, s("palindrome", 0)),
        F.when(both_r & (eq | sw), signed("equal", eq)),
        F.when(both_r & (fe | fs), signed("strand", fe)),
        F.when(both_r & l_indel & r_indel & (F.length(la1) + F.length(la2) == F.length(ra1) + F.length(ra2)), F.struct(F.lit("none").alias("level"), F.when((F.length(la1) > F.length(la2)) == (F.length(ra1) > F.length(ra2)), 1).otherwise(-1).alias("sign"))),
        F.when(both_r, s("other", 0)),
        F.when(one_r.isNull(), s("none", 0)),
        F.when(one_r.isin("-", "I", "D"), F.when(l_indel, s("half", 0)).otherwise(s("other", 0))),
        F.when(palindrome & (one_r.isin(la1, la2)), s("half", 0)),
        F.when(one_r == l_at, s("half", 1)), F.when(one_r == l_other, s("half", -1)),
        F.when(one_r == _flip(l_at), s("none", 1)), F.when(one_r == _flip(l_other), s("none", -1)),
        s("other", 0),
    )
    # explode over one element keeps the optimiser from copying these expressions into each of their uses
    p = pairs.withColumn("_a", F.explode(F.array(known)))
    lf, rf, le, re_ = (F.col(x) for x in ("l_f", "r_f", "l_e", "r_e"))
    sign = F.col("_a.sign")
    f_same, f_swap = F.abs(lf - rf), F.abs(1 - lf - rf)
    e_same, e_swap = F.abs(le - re_), F.abs(le + re_)
    taken = F.when(sign != 0, sign).when(f_same + e_same <= f_swap + e_swap, 1).when(f_same.isNotNull() & e_same.isNotNull(), -1).when(F.coalesce(f_same <= f_swap, e_same <= e_swap, F.lit(True)), 1).otherwise(-1)
    p = p.withColumn("_s", F.explode(F.array(taken)))
    df_, de = F.when(F.col("_s") > 0, f_same).otherwise(f_swap), F.when(F.col("_s") > 0, e_same).otherwise(e_swap)

    def step(x: Column) -> Column:
        out = F.when(x.isNull(), "na")
        for i, t in enumerate(STEPS):
            out = out.when(x <= t, str(i + 1))
        return out.otherwise(str(len(STEPS) + 1))

    d = F.col("r_p") - F.col("l_p")
    indel = F.coalesce(l_indel, r_indel, F.lit(False)) | F.coalesce(coded, F.lit(False))
    pos = (
        F.when(d.isNull(), "na").when(indel, F.when(d == 0, "indel_same").when(F.abs(d) <= 2, "indel_near").otherwise("indel_far"))
        .when(d == 0, "same").when(d == -1, "minus1").when(d == 1, "plus1").when(F.abs(d) == 2, "off2").otherwise("far")
    )
    lg, rg = F.col("l_gs"), F.col("r_gs")
    close = F.exists(lg, lambda x: F.exists(rg, lambda y: F.levenshtein(x, y) <= 2))
    gene = F.when((F.size(lg) == 0) | (F.size(rg) == 0), "na").when(F.arrays_overlap(lg, rg), "equal").when(close, "near").otherwise("other")
    return p.select(
        "l_k", "r_k", pos.alias("v_pos"), F.col("_a.level").alias("v_alleles"), step(df_).alias("v_freq"), step(de).alias("v_effect"), gene.alias("v_gene"),
        F.when(F.col("l_c").isNull() | F.col("r_c").isNull(), "na").otherwise("equal").alias("v_chr"),
    )


def fit(patterns: np.ndarray, counts: np.ndarray, sizes: list[int], start: np.ndarray, joint: list[tuple[int, ...]], rounds: int = 200) -> tuple[np.ndarray, list]:
    """Posterior of each vote pattern by expectation maximisation; joint lists which functions are modelled together."""
    post = start.copy()
    codes = []
    for group in joint:
        code = np.zeros(len(patterns), dtype=int)
        for j in group:
            code = code * sizes[j] + patterns[:, j]
        codes.append((code, math.prod(sizes[j] for j in group)))
    for _ in range(rounds):
        w = np.vstack([counts * (1 - post), counts * post])
        logp = np.log(w.sum(1) + 1)[:, None] + np.zeros((2, len(patterns)))
        for code, size in codes:
            t = np.vstack([np.bincount(code, weights=w[y], minlength=size) for y in (0, 1)])
            t = (t + 0.5 / size) / (t.sum(1, keepdims=True) + 0.5)
            logp += np.log(t[:, code])
        new = 1 / (1 + np.exp(np.clip(logp[0] - logp[1], -60, 60)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post, codes


def correlated(patterns: np.ndarray, counts: np.ndarray, post: np.ndarray, sizes: list[int], joint: list[tuple[int, ...]], least: float, most: int) -> tuple | None:
    """The two groups of functions with the highest mutual information within the classes, if above ``least`` (nats)."""
    best, found = least, None
    for a, b in combinations(joint, 2):
        if len(a) + len(b) > most:
            continue
        total = 0.0
        for w in (counts * post, counts * (1 - post)):
            n = w.sum()
            if n < 1:
                continue
            ca, cb = (np.zeros(len(patterns), dtype=int) for _ in (0, 1))
            for j in a:
                ca = ca * sizes[j] + patterns[:, j]
            for j in b:
                cb = cb * sizes[j] + patterns[:, j]
            sa, sb = math.prod(sizes[j] for j in a), math.prod(sizes[j] for j in b)
            t = np.bincount(ca * sb + cb, weights=w, minlength=sa * sb).reshape(sa, sb) / n
            e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True)
            total += (n / counts.sum()) * float((t[t > 0] * np.log(t[t > 0] / e[t > 0])).sum())
        if total > best:
            best, found = total, (a, b)
    return found


def label_model(seen: list[tuple], least: float = 0.02, most: int = 2) -> list[tuple]:
    """(levels..., posterior) for each distinct vote pattern in seen = [(levels..., count)]. At most ``most`` functions are modelled
    jointly: the table of three has hundreds of cells, of which rare ones take any posterior."""
    names = list(LEVELS)
    sizes = [len(LEVELS[n]) for n in names]
    at = [{v: i for i, v in enumerate(LEVELS[n])} for n in names]
    patterns = np.array([[at[j][row[j]] for j in range(len(names))] for row in seen])
    counts = np.array([row[-1] for row in seen], dtype=float)
    score = np.array([sum(POLARITY[n][p[j]] for j, n in enumerate(names)) for p in patterns])
    start = 1 / (1 + np.exp(-2 * (score - 1)))
    joint: list[tuple[int, ...]] = [(j,) for j in range(len(names))]
    post, _ = fit(patterns, counts, sizes, start, joint)
    while pair := correlated(patterns, counts, post, sizes, joint, least, most):
        joint = [g for g in joint if g not in pair] + [pair[0] + pair[1]]
        post, _ = fit(patterns, counts, sizes, post, joint)
    return [(*row[:-1], float(p)) for row, p in zip(seen, post)]


def _linked(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pairs of classes (l_k, r_k, confidence), the distinct records of both sides, the copies of both sides)."""
    spark = left.sparkSession
    (l, l_copies), (r, r_copies) = representatives(prepared(left, left_key)), representatives(prepared(right, right_key))
    v = cut(votes(candidates(l, r)))
    names = list(LEVELS)
    seen = [tuple(x) for x in v.groupBy(*names).count().collect()]  # at most the product of the levels
    schema = ", ".join(f"{n} string" for n in names) + ", confidence double"
    model = spark.createDataFrame(label_model(seen) if seen else [], schema).filter(F.col("confidence") >= least)
    return v.join(F.broadcast(model), names).select("l_k", "r_k", "confidence"), l, r, l_copies, r_copies


def matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float = 0.5) -> DataFrame:
    """(left_key, right_key, confidence) of the pairs of rows whose confidence reaches ``least``."""
    found, _, _, l_copies, r_copies = _linked(left, right, left_key, right_key, least)
    out = found.join(l_copies.select(F.col("k").alias("l_k"), F.col("id").alias("l_id")), "l_k", "left")
    out = out.join(r_copies.select(F.col("k").alias("r_k"), F.col("id").alias("r_id")), "r_k", "left")
    return out.select(F.coalesce("l_id", "l_k").alias(left_key), F.coalesce("r_id", "r_k").alias(right_key), "confidence")


def class_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float = 0.5) -> DataFrame:
    """(left_key, right_key, n_left, n_right, confidence): pairs of classes of exact copies, each named by its smallest id
    and with its size."""
    found, l, r, _, _ = _linked(left, right, left_key, right_key, least)
    out = found.join(l.select(F.col("k").alias("l_k"), F.col("n").alias("n_left")), "l_k").join(r.select(F.col("k").alias("r_k"), F.col("n").alias("n_right")), "r_k")
    return out.select(F.col("l_k").alias(left_key), F.col("r_k").alias(right_key), "n_left", "n_right", "confidence")


def members(df: DataFrame, key: str) -> DataFrame:
    """(class_id, id) of every row: the class of exact copies that it belongs to, named by its smallest id."""
    one, copies = representatives(prepared(df, key))
    return one.filter("n = 1").select(F.col("k").alias("class_id"), F.col("k").alias("id")).unionByName(copies.select(F.col("k").alias("class_id"), "id"))
