"""Mixing sources to target weights.

Method: iterative proportional fitting. Token totals by cell of source, language and topic are raked to the marginals of
all three; every cell's weight is the number of copies that its tokens get on average, at most the ``max_repeats`` of the
source. The texts of a cell are then sampled with that probability by a hash of the text: each gets the whole copies of
the weight, and one more if its hash lies below a threshold. The threshold is calibrated on a histogram of hashes, so
that the cell reaches its tokens nearly exactly instead of only on average. The driver sees one row per cell; histograms and
thresholds stay on the executors.

Topics are found in the texts alone, whatever their source. Each text is read once: its tokens are counted and its words kept
as numbers. From the counts of all texts the ``VOCABULARY`` words are taken that tell most (frequent, yet in at most two fifths
of the texts); how often two of them share a text, against chance, says how alike they are; words that are alike form
``TOPICS`` groups (spherical k-means from spread-out beginnings, without chance). A text's topic is the group that its words
speak for most; texts without any of the words have the topic ``none``.

Targets of languages and topics may be given as shares. Where they are not, languages keep their shares of all texts with a
source target (so favouring a source does not shift the languages), and topics get the shares that the source targets alone
imply, made a little more even (to the power ``TEMPER``). An empty dictionary leaves a marginal free.

The size of the mixture is the largest at which every source reaches its share within its repeats, or ``total_tokens`` if
that is smaller. Sources without any text cannot take part; the shares of the others are kept in proportion.

Equal texts are one text: it is counted once, in the source, language and topic most of its copies have, and its repeats
are limited as a whole; the copy with the smallest id stands for it.

Defined results: null and empty texts and rows without doc_id are left out, as are texts of sources without target (named in the report with
share 0). Source names are compared without regard to case and blanks around them. A null max_repeats is 1. Empty tables
give empty results.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import cut, ship, small, trimmed
from .reading import _WORD
from .tokens import TOKENIZER, encoding, ship_vocabulary

#: Steps of the histogram of hashes.
BUCKETS = 1024
TEMPER = 0.9
VOCABULARY, TOPICS = 512, 12


def source_of(c: Column) -> Column:
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def language_of(c: Column) -> Column:
    """The primary subtag in lower case; blank and undetermined is ``und``."""
    low = F.regexp_extract(F.lower(trimmed(F.coalesce(c, F.lit("")))), "^([a-z]{2,3})", 1)
    return F.when(low == "", "und").otherwise(low)


# ---- tokens and topics


def measured(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """documents with ``n_tokens`` and ``words`` (its distinct words of 4 to 24 letters, as sorted 32-bit hashes) in place of
    the text, in one pass over the texts."""
    kinds = [(c, t) for c, t in documents.dtypes if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        known: dict[str, int] = {}
        for pdf in batches:
            words, n = [], []
            if len(known) > 500_000:
                known.clear()
            for text in pdf["text"]:
                mine = set()
                for w in set(_WORD.findall(text.lower())):
                    if 4 <= len(w) <= 24:
                        if w not in known:
                            known[w] = zlib.crc32(w.encode()) - 2**31 if w.isalpha() else 2**31
                        mine.add(known[w])
                mine.discard(2**31)
                words.append(np.array(sorted(mine), dtype=np.int32))
                n.append(len(enc.encode_ordinary(text)))
            yield pdf.drop(columns=["text"]).assign(n_tokens=n, words=words)

    ship(documents.sparkSession)
    ship_vocabulary(documents.sparkSession, path)
    return documents.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in kinds) + ", n_tokens int, words array<int>")


def telling_words(rows: DataFrame, size: int = VOCABULARY, most: float = 0.4) -> np.ndarray:
    """The up to ``size`` words (hashes, sorted) with the largest n ln(N / n) among those in at most that share of the N
    texts and in at least two; ties by hash."""
    total = rows.count()
    counts = rows.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= 2) & (F.col("n") <= most * total))
    top = counts.orderBy(F.desc(F.col("n") * F.ln(F.lit(float(max(total, 1))) / F.col("n"))), "w").limit(size).collect()
    return np.array(sorted(r["w"] for r in top), dtype=np.int32)


def _held(words: list, vocabulary: np.ndarray) -> np.ndarray:
    """Which of the vocabulary each text holds, as a matrix of 0 and 1."""
    out = np.zeros((len(words), len(vocabulary)), dtype=np.float32)
    lengths = [len(w) for w in words]
    if len(vocabulary) and sum(lengths):
        flat = np.concatenate([np.asarray(w, dtype=np.int32) for w in words])
        at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
        hit = vocabulary[at] == flat
        out[np.repeat(np.arange(len(words)), lengths)[hit], at[hit]] = 1
    return out


def shared_texts(rows: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many texts hold both of two words: summed in each task, so at most size x size numbers leave it."""
    k = len(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k), dtype=np.float64)
        for pdf in batches:
            b = _held(list(pdf["words"]), vocabulary)
            total += b.T @ b
        i, j = np.nonzero(np.triu(total))
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "n": total[i, j].astype("int64")})

    got = rows.select("words").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # at most size^2 / 2 rows
    out = np.zeros((k, k))
    for r in got:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["n"]
    return out


def word_groups(shared: np.ndarray, texts: int, topics: int = TOPICS, rounds: int = 50) -> np.ndarray:
    """The group of each word: k-means over directions of positive pointwise mutual information, from the most frequent word
    and then the words that are least like those taken."""
    n = np.diag(shared).copy()
    if not len(n):
        return np.zeros(0, dtype=int)
    with np.errstate(all="ignore"):
        x = np.nan_to_num(np.maximum(0, np.log(shared * texts / np.outer(n, n))), posinf=0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    picked = [int(n.argmax())]
    while len(picked) < min(topics, len(n)):
        near = (x @ x[picked].T).max(1) - 1e-9 * n / n.max()
        near[picked] = np.inf
        picked.append(int(near.argmin()))
    centres, group = x[picked], np.full(len(n), -1)
    for _ in range(rounds):
        new = (x @ centres.T).argmax(1)
        if (new == group).all():
            break
        group = new
        for g in range(len(centres)):
            if (group == g).any():
                c = x[group == g].sum(0)
                centres[g] = c / max(np.linalg.norm(c), 1e-12)
    return group


def with_topics(rows: DataFrame, vocabulary: np.ndarray, group: np.ndarray, n: np.ndarray, texts: int) -> DataFrame:
    """rows with ``topic`` in place of ``words``: the group with the largest sum of ln(texts / n) over the words of a text."""
    kinds = [(c, t) for c, t in rows.dtypes if c != "words"]
    weight = np.zeros((len(vocabulary), max(group, default=0) + 1), dtype=np.float32)
    if len(vocabulary):
        weight[np.arange(len(vocabulary)), group] = np.log(texts / n)
    names = np.array([f"t{g:02d}" for g in range(weight.shape[1])], dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = _held(list(pdf["words"]), vocabulary) @ weight
            topic = np.where(score.max(1) > 0, names[score.argmax(1)], "none") if len(vocabulary) else "none"
            yield pdf.drop(columns=["words"]).assign(topic=topic)

    return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in kinds) + ", topic string")


# ---- raking


def rake(cells: dict[tuple[str, str, str], float], targets: list[dict[str, float] | None], rounds: int = 200, tolerance: float = 1e-9) -> dict[tuple, float]:
    """Tokens of each cell after proportional fitting to the shares of each of the three marginals; the first marginal is
    fitted last in each round, so it holds exactly. A marginal None is free."""
    keys = sorted(cells)
    x = np.array([cells[k] for k in keys], dtype=float)
    x = x / max(x.sum(), 1e-12)
    index = []
    for axis, t in enumerate(targets):
        if t is None:
            continue
        names = sorted({k[axis] for k in keys})
        want = np.array([t.get(n, 0.0) for n in names])
        index.append((np.array([names.index(k[axis]) for k in keys]), want / max(want.sum(), 1e-12)))
    for _ in range(rounds):
        before = x.copy()
        for at, want in index[::-1]:
            have = np.bincount(at, weights=x, minlength=len(want))
            x = x * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[at]
        if np.abs(x - before).max() < tolerance:
            break
    return dict(zip(keys, x))


def default_targets(cells: dict[tuple[str, str, str], float], want: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
    """(languages, topics) where none are given; see the module."""
    languages: dict[str, float] = defaultdict(float)
    topic: dict[str, float] = defaultdict(float)
    have: dict[str, float] = defaultdict(float)
    for (s, l, _), n in cells.items():
        have[s] += n
        languages[l] += n
    for (s, _, t), n in cells.items():
        if s in want:
            topic[t] += want[s] * n / have[s]
    topic = {t: v**TEMPER for t, v in topic.items()}
    total, even = sum(languages.values()), sum(topic.values())
    return {k: v / total for k, v in languages.items()}, {k: v / even for k, v in topic.items()}


def weights(cells: dict[tuple, float], source_targets: dict[str, float], repeats: dict[str, int], language_targets: dict | None, topic_targets: dict | None, total_tokens: float | None) -> dict[tuple, float]:
    """Copies of each cell, between 0 and the repeats of its source."""
    have = defaultdict(float)
    for (s, _, _), t in cells.items():
        have[s] += t
    want = {s: v for s, v in source_targets.items() if have[s] > 0 and v > 0}
    if not want:
        return {}
    cells = {k: v for k, v in cells.items() if k[0] in want and v > 0}
    total = sum(want.values())
    want = {s: v / total for s, v in want.items()}
    languages, topics = default_targets(cells, want)
    shares = rake(cells, [want, (languages if language_targets is None else language_targets) or None, (topics if topic_targets is None else topic_targets) or None])
    size = min(have[s] * repeats[s] / want[s] for s in want)
    size = min(size, total_tokens) if total_tokens else size
    out = {}
    of: dict[str, list[tuple]] = defaultdict(list)
    for k in cells:
        of[k[0]].append(k)
    for s in want:  # cells beyond their repeats pass the rest on to the other cells of their source
        mine = of[s]
        left, open_ = size * want[s], set(mine)
        base = {k: max(shares[k], 1e-15) for k in mine}
        while open_:
            scale = left / sum(base[k] for k in open_)
            over = {k for k in open_ if base[k] * scale > cells[k] * repeats[s] * (1 + 1e-12)}
            if not over:
                out |= {k: base[k] * scale / cells[k] for k in open_}
                break
            for k in over:
                out[k] = float(repeats[s])
                left -= cells[k] * repeats[s]
            open_ -= over
            if left <= 0:
                out |= {k: 0.0 for k in open_}
                break
    return out


# ---- the operator


def texts(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, src, lang, topic, n_tokens, h) of each distinct text of a source with target; h is a hash in [0, 1)."""
    t = targets.select(source_of(F.col("source")).alias("src")).filter("src is not null").distinct()
    d = documents.filter("text is not null and text <> '' and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), source_of(F.col("source")).alias("src"), language_of(F.col("lang")).alias("lang"), "text")
    d = d.join(small(t, 10_000), "src", "left_semi")
    rows = cut(measured(d.withColumn("hash", F.md5("text")).select("doc_id", "src", "lang", "hash", "text"), path))
    total, vocabulary = rows.count(), telling_words(rows)
    shared = shared_texts(rows, vocabulary)
    lean = with_topics(rows, vocabulary, word_groups(shared, total), np.diag(shared), total)
    kind = lean.groupBy("hash", "src", "lang", "topic").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    one = kind.groupBy("hash").agg(F.max(F.struct("k", "src", "lang", "topic")).alias("m"), F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    h = F.pmod(F.xxhash64("hash"), F.lit(2**40)) / F.lit(float(2**40))
    return one.filter("n_tokens > 0").select("doc_id", "m.src", "m.lang", "m.topic", "n_tokens", h.alias("h"))


_CELL = ["src", "lang", "topic"]


def thresholds(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (src, lang, topic, whole, extra) with ``below``: the hash under which the texts of a cell hold the share ``extra`` of
    its tokens, found on the histogram of the cell and evenly within the step of it that the share falls into."""
    hist = docs.groupBy(*_CELL, F.floor(F.col("h") * BUCKETS).cast("int").alias("b")).agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy(*_CELL).orderBy("b")  # at most BUCKETS rows
    upto = hist.select(*_CELL, "b", "n", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy(*_CELL)).alias("total"))
    met = upto.join(plan.filter("extra > 0"), _CELL).withColumn("want", F.col("extra") * F.col("total"))
    edge = (F.col("b") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("want") - F.col("upto") + F.col("n")) / F.col("n")))) / BUCKETS
    at = met.filter(F.col("upto") >= F.col("want") * (1 - 1e-12)).groupBy(*_CELL).agg(F.min(edge).alias("below"))
    return plan.join(at, _CELL, "left").select(*_CELL, "whole", F.when(F.col("extra") > 0, F.coalesce("below", F.lit(1.0))).otherwise(0.0).alias("below"))


def calibrated(docs: DataFrame, cells: dict[tuple, float], copies: dict[tuple, float], repeats: dict[str, int], rounds: int = 6, tolerance: float = 0.0005) -> DataFrame:
    """docs with ``copies``: sampled so that every source reaches its tokens. What the texts of a source hold too much or too
    little (a few long ones, many small cells) is made up for in its largest cell that can give or take, in the next round in
    the next one (a long text may lie at the very threshold), until every source is within ``tolerance``; the best round holds; each round brings one row per cell to the driver."""
    whole = {k: math.floor(w + 1e-9) for k, w in copies.items()}
    extra = {k: max(0.0, w - whole[k]) if whole[k] < repeats[k[0]] else 0.0 for k, w in copies.items()}
    want: dict[str, float] = defaultdict(float)
    for k, w in copies.items():
        want[k[0]] += w * cells[k]
    best: tuple[float, DataFrame] | None = None
    for turn in range(rounds):
        made = [(*k, whole[k], extra[k]) for k in sorted(copies)]
        plan = cut(thresholds(docs, docs.sparkSession.createDataFrame(made, "src string, lang string, topic string, whole int, extra double")))
        n = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
        out = docs.join(small(plan, 100_000), _CELL).withColumn("copies", n.cast("int")).filter("copies > 0")
        reached = {r["src"]: float(r["t"]) for r in out.groupBy("src").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
        off = {s: w - reached.get(s, 0.0) for s, w in want.items()}
        worst = max((abs(x) / want[s] for s, x in off.items() if want[s]), default=0.0)
        if best is None or worst < best[0]:
            best = (worst, out)
        if worst <= tolerance:
            break
        for s, x in off.items():
            order = sorted((k for k in copies if k[0] == s and whole[k] < repeats[s]), key=lambda k: (-cells[k], k))
            if abs(x) <= tolerance * want[s]:
                continue
            for k in order[turn:] + order[:turn]:
                share = min(1.0, max(0.0, extra[k] + x / cells[k]))
                x -= (share - extra[k]) * cells[k]
                extra[k] = share
                if abs(x) < 1:
                    break
    return best[1]


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, language_targets: dict | None = None, topic_targets: dict | None = None, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, copies) of the selected texts."""
    return _mixed(documents, targets, total_tokens, language_targets, topic_targets, path)[0]


def _mixed(documents: DataFrame, targets: DataFrame, total_tokens: float | None, language_targets: dict | None, topic_targets: dict | None, path: str) -> tuple[DataFrame, list[dict[str, float]]]:
    """The selection and the targets of its three marginals."""
    spark = documents.sparkSession
    docs = cut(texts(documents, targets, path))
    rows = targets.select(source_of(F.col("source")).alias("src"), F.col("target_share").cast("double").alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("r")).filter("src is not null").collect()
    share, repeats = {r["src"]: r["share"] or 0.0 for r in rows}, {r["src"]: max(0, r["r"]) for r in rows}
    share = {s: v for s, v in share.items() if repeats[s] > 0}
    # one row per cell: sources with target x languages x topics
    cells = {tuple(r[c] for c in _CELL): float(r["n"]) for r in docs.groupBy(*_CELL).agg(F.sum("n_tokens").alias("n")).collect()}
    copies = {k: float(w) for k, w in weights(cells, share, repeats, language_targets, topic_targets, total_tokens).items()}
    out = calibrated(docs, cells, copies, repeats)
    there = {c[0] for c, v in cells.items() if v > 0}
    want = {s: v for s, v in share.items() if s in there and v > 0}
    want = {s: v / sum(want.values()) for s, v in want.items()}
    languages, topics = default_targets({k: v for k, v in cells.items() if k[0] in want}, want) if want else ({}, {})
    goals = [want, languages if language_targets is None else language_targets, topics if topic_targets is None else topic_targets]
    return out.select("doc_id", F.col("src").alias("source"), "lang", "topic", "n_tokens", "copies"), goals


def marginals(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, language_targets: dict | None = None, topic_targets: dict | None = None, path: str = TOKENIZER) -> DataFrame:
    """(axis, value, goal, actual_share) of the three marginals of the mixture."""
    selected, goals = _mixed(documents, targets, total_tokens, language_targets, topic_targets, path)
    sums = selected.groupBy("source", "lang", "topic").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()  # one row per cell
    total = sum(r["t"] for r in sums) or 1
    rows = []
    for axis, goal in zip(("source", "lang", "topic"), goals):
        have: dict[str, int] = defaultdict(int)
        for r in sums:
            have[r[axis]] += r["t"]
        rows += [(axis, v, goal.get(v, 0.0) if goal else None, have[v] / total) for v in sorted({*have, *goal})]
    return documents.sparkSession.createDataFrame(rows, "axis string, value string, goal double, actual_share double")


def mixture_report(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, n_texts, most_copies, max_repeats) of each source with a target."""
    per = selected.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("copies").alias("most_copies"))
    total = per.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    t = targets.select(source_of(F.col("source")).alias("source"), F.col("target_share"), F.col("max_repeats")).filter("source is not null")
    r = t.join(per, "source", "left")
    return r.select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
    )
