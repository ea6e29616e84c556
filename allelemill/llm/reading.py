"""Reading level of each document.

Method: a linear pairwise ranker is learnt from pairs of graded passages (the one with the higher grade should score
higher) over features of syntax and vocabulary; isotonic regression turns its scores into grades. Sentence openings and the
level of words are learnt from the passages (a passage's own grade does not count for its own words). The graded passages
are few and fixed (``max_samples`` is a documented bound of the labelled rows that are used); every document is scored.

Only the author's own words are graded: quotes in all their forms, signatures and markup are taken out first, damaged
characters are mended, and texts that are not English or too short get no grade.

Defined results: null and empty texts, texts of fewer than ``min_words`` own words and texts in other languages have no
row, nor have rows without doc_id. Repeated documents are each graded. Ungraded passages are left out of training; without any graded passage there
is no result. Very long texts are graded whole.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import ship

# ---- the author's own words

_OPENER = re.compile(
    r"\[(?P<bb>quote|QUOTE|Quote)\b[^\]]*\]|<(?P<bq>blockquote)\b[^>]*>|^[ \t]*(?P<post>-{3,} ?Original [A-Za-z]+ ?-{3,})[ \t\r]*$|^[ \t]*(?P<mark>>)|^[^\n]{0,120}\bwrote:[ \t\r]*\n(?=[ \t]*(?P<said>>))",
    re.M,
)
_MARKED = re.compile(r"(?:[ \t]*>[^\n]*(?:\n|\Z))+")
_POSTED = re.compile(r"[^\n]*\n(?:From:[^\n]*\n)?(?:[ \t]*\|[^\n]*(?:\n|\Z))*(?:-{3,}[ \t\r]*(?:\n|\Z))?")
_SIGNATURES = [re.compile(r"\[sig\].*?(?:\[/sig\]|\Z)", re.S | re.I), re.compile(r"<hr ?/?>\s*<small>.*?(?:</small>|\Z)", re.S | re.I), re.compile(r"(?:^|\n)(?:-- ?|_{4,})[ \t\r]*\n[^\n]*(?:\n[^\n]{0,120}){0,3}\s*\Z")]
_LINK = re.compile(r"\[url\b[^\]]*\].*?\[/url\]|<a\b[^>]*>.*?</a>|https?://\S+", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|\[/?[A-Za-z][^\[\]]{0,200}\]")
_BREAK = re.compile(r"<(?:br|/p|p|hr)\b[^>]*>", re.I)
_MENDED = [("Â ", " "), ("â€™", "'"), ("’", "'"), (" ", " "), ("​", ""), ("﻿", ""), ("­", ""), ("**", ""), ("__", ""), ("~~", "")]


def _closed(text: str, m: re.Match) -> int:
    """Where the quote ends that m opens; a quote whose inner ones were cut short ends at the last closing tag."""
    if m["bb"]:
        name, one, two = m["bb"], "[", "]"
    else:
        name, one, two = m["bq"], "<", ">"
    tag = re.compile(re.escape(one) + r"(/?)" + name + r"\b[^" + re.escape(two) + "]*" + re.escape(two))
    depth, last = 0, None
    for t in tag.finditer(text, m.start()):
        depth += -1 if t[1] else 1
        if t[1]:
            last = t.end()
        if depth == 0:
            return t.end()
    return last or m.end()


def own_words(text: str | None) -> str:
    """The text without quotes, signatures and markup, with damaged characters mended."""
    if not text:
        return ""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    parts, at = [], 0
    while m := _OPENER.search(text, at):
        parts.append(text[at : m.start()])
        if m["bb"] or m["bq"]:
            at = _closed(text, m)
        elif m["post"]:
            at = _POSTED.match(text, m.start()).end()
        else:
            at = _MARKED.match(text, m.start() if m["mark"] else m.end()).end()
        parts.append("\n")
        at = max(at, m.start() + 1)
    parts.append(text[at:])
    out = "".join(parts)
    for s in _SIGNATURES:
        out = s.sub("\n", out)
    out = html.unescape(html.unescape(_BREAK.sub("\n", out)))
    out = _TAG.sub("", _LINK.sub(" ", out))
    for bad, good in _MENDED:
        out = out.replace(bad, good)
    return out.strip()


# ---- language

#: Frequent function words of the languages told apart; what English has too is no sign of another language. Fixed values.
FUNCTION_WORDS = {
    "en": "the a an of and to in is it that this our my your we you he she they was were for on with as by from or not be are at have had i some every which if so",
    "es": "el la los las de y que en un una por con para su mi es se del al lo nosotros ella yo pero porque aunque sin",
    "de": "der die das und ist ein eine einen den dem mit von zu nicht ich er sie wir es im auf aber weil obwohl für mein",
    "fr": "le la les de et un une des est que dans pour avec sur mon il elle nous je mais parce alors au du ne pas sans a",
    "it": "il lo la gli le di e che un una per con non sono è del della nel ma perché anche come più questo io noi",
    "pt": "o os as de e que um uma para com não é do da no na mas porque também como mais este eu nós em por",
    "nl": "de het een en van dat die niet met voor op te zijn er ook maar omdat wij ik hij zij naar bij uit",
    "sv": "och att det som en ett på är av för med inte jag vi han hon men eftersom till från",
    "da": "og at det som en et på er af for med ikke jeg vi han hun men fordi til fra",
    "pl": "i w na z do że nie się jest to jak ale po przez dla od o tak już bo",
}
_LANGUAGES = list(FUNCTION_WORDS)
_ENGLISH = frozenset(FUNCTION_WORDS["en"].split())
_WORDS = {k: frozenset(v.split()) - (_ENGLISH if k != "en" else frozenset()) for k, v in FUNCTION_WORDS.items()}
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


# ---- features

_END = re.compile(r"[.!?]+(?=\s|$)")
_VOWELS = re.compile(r"[aeiouy]+")


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence, in lower case."""
    return [x for x in map(_WORD.findall, _END.split(text.lower())) if x]


#: Words that join clauses. Fixed values.
CONNECTIVES = [
    "and", "but", "or", "so", "because", "when", "if", "while", "since", "after", "before", "until", "although", "though", "unless", "whereas", "whether", "which", "who", "that", "than", "then", "as", "how", "what", "where", "why",
    "itself", "insofar", "inasmuch", "notwithstanding", "granted", "extent", "were", "is", "according", "concerned", "therefore", "however", "moreover",
]
_LENGTHS = [1, 4, 6, 8, 10, 12, 14, 40]  # edges of the classes of word lengths
_MOST_WORDS = 200_000  #: words that are remembered before the memory starts anew


class Lexicon:
    """What the graded passages tell about words, and the properties of the words met so far, as arrays by number."""

    def __init__(self, passages: list[list[list[str]]], grades: list[int], least_openings: int = 2, prior: float = 2.0) -> None:
        self.prior, self.mean = prior, float(np.mean(grades)) if grades else 0.0
        self.total, self.n, opened = defaultdict(float), Counter(), Counter()
        for sentences, g in zip(passages, grades):
            mine = {w for x in sentences for w in x}
            self.n.update(mine)
            opened.update({x[0] for x in sentences})
            for w in mine:
                self.total[w] += g
        self.openings = sorted(w for w, k in opened.items() if k >= least_openings)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 6 + len(_LANGUAGES)))

    def numbers(self, words: list[str]) -> list[int]:
        number, rows = self.number, self.rows
        out = []
        for w in words:
            k = number.get(w)
            if k is None:
                k = number[w] = len(rows)
                seen = self.n[w] if w in self.n else 0
                level = (self.total[w] + self.prior * self.mean) / (seen + self.prior) if seen else np.nan
                rows.append((len(w), len(_VOWELS.findall(w)), _CONNECTIVE.get(w, -1), self._opening(w), level, seen, *[w in _WORDS[x] for x in _LANGUAGES]))
            out.append(k)
        return out

    def _opening(self, w: str) -> int:
        i = bisect_left(self.openings, w)
        return i if i < len(self.openings) and self.openings[i] == w else -1

    def properties(self) -> np.ndarray:
        """One row a word: length, syllables, place among connectives and openings, level, passages, languages."""
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], dtype=float)])
        return self.table


_CONNECTIVE = {w: i for i, w in enumerate(CONNECTIVES)}


def features(texts: list[str], lexicon: Lexicon, parsed: list[list[list[str]]] | None = None, own: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(features, share of function words of each language) of the texts, a row each, made for all of them at once. ``own`` are
    the grades of the texts if the lexicon was made of them: they are then taken out of the levels of their words."""
    parsed = [sentences_of(t) for t in texts] if parsed is None else parsed
    d = len(texts)
    k = np.array([len(x) for x in parsed], dtype=int)
    per = np.array([len(x) for p in parsed for x in p], dtype=int)
    words = [w for p in parsed for x in p for w in x]
    if len(lexicon.number) > _MOST_WORDS:
        lexicon.forget()
    ids = np.array(lexicon.numbers(words), dtype=int)
    table = lexicon.properties()
    doc_of_sentence = np.repeat(np.arange(d), k)
    doc = np.repeat(doc_of_sentence, per) if len(per) else np.zeros(0, dtype=int)
    n = np.bincount(doc, minlength=d)
    n1, k1 = np.maximum(n, 1), np.maximum(k, 1)
    mean = lambda v, w=None: np.bincount(doc if w is None else doc[w], weights=v if w is None else v[w], minlength=d)
    at = table[ids] if len(ids) else np.zeros((0, table.shape[1]))
    length, syllables, level, seen = at[:, 0], at[:, 1], at[:, 4], at[:, 5]
    order = np.lexsort((per, doc_of_sentence))
    ends = np.cumsum(k)
    sorted_per = np.concatenate([per[order], [0]])
    low, high = ends - k + (k1 - 1) // 2, ends - k + k1 // 2
    median = np.where(k > 0, (sorted_per[np.minimum(low, len(per))] + sorted_per[np.minimum(high, len(per))]) / 2, 0)
    per_mean = n / k1
    per_std = np.sqrt(np.maximum(0, np.bincount(doc_of_sentence, weights=per.astype(float) ** 2, minlength=d) / k1 - per_mean**2))
    long = length >= 4
    content = mean(length, long) / np.maximum(1, np.bincount(doc[long], minlength=d))
    kind = np.searchsorted(_LENGTHS, length, side="right") - 1
    inside = kind < len(_LENGTHS) - 1
    shares = np.bincount(doc[inside] * (len(_LENGTHS) - 1) + kind[inside], minlength=d * (len(_LENGTHS) - 1)).reshape(d, len(_LENGTHS) - 1) / n1[:, None]
    marks = np.array([(t.count("?"), t.count(","), t.count("!")) for t in texts], dtype=float).reshape(d, 3) / k1[:, None]
    joined = at[:, 2] >= 0
    connectives = np.bincount(doc[joined] * len(CONNECTIVES) + at[joined, 2].astype(int), minlength=d * len(CONNECTIVES)).reshape(d, len(CONNECTIVES))
    first = (np.cumsum(per) - per).astype(int)
    open_of = at[first, 3].astype(int) if len(per) else np.zeros(0, dtype=int)
    opened, n_open = open_of >= 0, len(lexicon.openings)
    openings = np.bincount(doc_of_sentence[opened] * n_open + open_of[opened], minlength=d * n_open).reshape(d, n_open) if n_open else np.zeros((d, 0))
    if own is not None:
        total = level * (seen + lexicon.prior) - np.asarray(own, dtype=float)[doc]
        seen = seen - 1
        level = total / (seen + lexicon.prior)
    graded = seen > 0
    count = np.bincount(doc[graded], minlength=d)
    levels = np.where(count > 0, mean(np.nan_to_num(level), graded) / np.maximum(1, count), lexicon.mean)
    x = np.column_stack(
        [
            np.log1p(per_mean), np.log1p(median), per_std / 10, mean(length) / n1, content, mean(syllables) / n1, mean(syllables >= 3) / n1, mean(syllables >= 5) / n1,
            shares, marks, 10 * connectives / n1[:, None], openings / k1[:, None], levels, (n - count) / n1,
        ]
    )
    languages = np.column_stack([mean(at[:, 6 + j]) for j in range(len(_LANGUAGES))]) / n1[:, None]
    return x, languages


def is_english(languages: np.ndarray, least: float = 0.1) -> np.ndarray:
    """English function words are frequent, and more so than those of any other language; one row of shares a text."""
    return (languages[:, 0] >= least) & (languages[:, 0] > languages[:, 1:].max(1, initial=-1)) if len(languages) else np.zeros(0, dtype=bool)


# ---- ranker and calibration


def train_ranker(x: np.ndarray, grade: np.ndarray, ridge: float = 300.0, rounds: int = 30, block: int = 256) -> np.ndarray:
    """Weights w for which x w ranks by grade: logistic regression on the differences of all pairs of unlike grades,
    each pair weighted by the difference of its grades. The pairs are never written out: gradient and curvature are sums over
    rows and columns of the matrix of pairs, taken ``block`` rows at a time."""
    n, dims = x.shape
    ordered = np.sort(grade)
    total = float((ordered * (2 * np.arange(n) - n + 1)).sum())  # sum of the differences over all pairs
    scale = n / max(1.0, total)  # as much weight as there are passages
    w = np.zeros(dims)
    for _ in range(rounds):
        s = x @ w
        g, h = ridge * w / dims, ridge * np.eye(dims) / dims
        for a in range(0, n, block):
            rows = slice(a, min(n, a + block))
            v = scale * np.maximum(0.0, grade[rows, None] - grade[None, :])
            p = 1 / (1 + np.exp(-np.clip(s[rows, None] - s[None, :], -30, 30)))
            pull, bend = v * (p - 1), v * np.maximum(p * (1 - p), 1e-6)
            g = g + x[rows].T @ pull.sum(1) - x.T @ pull.sum(0)
            cross = x[rows].T @ (bend @ x)
            h = h + x[rows].T @ (bend.sum(1)[:, None] * x[rows]) + x.T @ (bend.sum(0)[:, None] * x) - cross - cross.T
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def isotonic(score: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (knots, values) of the best non-decreasing step function of the score."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # [sum, count, first score, last score]
    for k in order:
        blocks.append([float(grade[k]), 1.0, float(score[k]), float(score[k])])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, c, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = last
    knots = np.array([p for b in blocks for p in (b[2], b[3])])
    values = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return knots, values


def cuts_from(knots: np.ndarray, values: np.ndarray, grades: list[int]) -> np.ndarray:
    """Scores at which the calibrated grade passes the middle between two neighbouring grades."""
    out = []
    for low, high in zip(grades, grades[1:]):
        mid = (low + high) / 2
        above = np.flatnonzero(values >= mid)
        below = np.flatnonzero(values < mid)
        hi = knots[above[0]] if len(above) else np.inf
        lo = knots[below[-1]] if len(below) else -np.inf
        out.append(np.mean([lo, hi]) if np.isfinite(lo) and np.isfinite(hi) else hi if np.isfinite(hi) else np.inf)
    return np.array(out)


class Reader:
    """A trained model; plain arrays and lists, so it travels to the workers."""

    def __init__(self, passages: list[str], grades: list[int], ridge: float = 300.0) -> None:
        texts = [own_words(p) for p in passages]
        parsed = [sentences_of(t) for t in texts]
        self.lexicon = Lexicon(parsed, list(grades))
        x = features(texts, self.lexicon, parsed, list(grades))[0]
        g = np.array(grades, dtype=float)
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z = (x - self.mean) / self.scale
        self.w = train_ranker(z, g, ridge)
        s = z @ self.w
        # misgraded passages lie far from the passages that score alike: they are set aside once and the ranker trained again
        knots, values = isotonic(s, g)
        keep = np.abs(np.interp(s, knots, values) - g) < 1.5
        if keep.sum() > len(g) // 2:
            self.w = train_ranker(z[keep], g[keep], ridge)
            s, g = z[keep] @ self.w, g[keep]
        self.grades = sorted({int(v) for v in g})
        self.cuts = cuts_from(*isotonic(s, g), self.grades)
        self.lexicon.forget()

    def rank(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features."""
        return ((x - self.mean) / self.scale) @ self.w

    def level(self, score: np.ndarray) -> np.ndarray:
        return np.array(self.grades)[np.searchsorted(self.cuts, score, side="right")] if len(score) else np.zeros(0, dtype=int)

    def score(self, texts: list[str]) -> np.ndarray:
        return self.rank(features(texts, self.lexicon)[0]) if texts else np.zeros(0)

    def grade(self, texts: list[str]) -> np.ndarray:
        return self.level(self.score(texts))


_ALNUM = re.compile(r"[^\W_]")


def _has_letter(word: str) -> bool:
    """A word holds a letter or digit."""
    return word.isalnum() or bool(_ALNUM.search(word))


def labelled(samples: DataFrame, max_samples: int = 5_000) -> tuple[list[str], list[int]]:
    """The graded passages, each text once (with its median grade if it is graded more than once): at most
    ``max_samples``, by sample_id."""
    rows = samples.filter("passage is not null and grade is not null").groupBy("passage").agg(F.expr("percentile_approx(grade, 0.5)").alias("grade"), F.min("sample_id").alias("id"))
    got = rows.orderBy("id").limit(max_samples).collect()
    return [r["passage"] for r in got], [int(r["grade"]) for r in got]


def reading_levels(documents: DataFrame, samples: DataFrame, min_words: int = 40, ridge: float = 300.0) -> DataFrame:
    """(doc_id, grade, score, n_words) of each document with at least min_words own English words."""
    schema = "doc_id long, grade int, score double, n_words int"
    passages, grades = labelled(samples)
    if not passages:
        return documents.sparkSession.createDataFrame([], schema)
    model = Reader(passages, grades, ridge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, mine, counts = [], [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                words = own_words(text)
                n = sum(map(_has_letter, words.split()))
                if n >= min_words:
                    ids.append(doc_id)
                    mine.append(words)
                    counts.append(n)
            # some hundred texts at a time, so that the arrays of their words stay small
            parts = [features(mine[a : a + 512], model.lexicon) for a in range(0, max(1, len(mine)), 512)]
            x, languages = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            kept = is_english(languages)
            s = model.rank(x[kept]) if kept.any() else np.zeros(0)
            out = {"doc_id": np.array(ids, dtype="int64")[kept], "grade": model.level(s), "score": s, "n_words": np.array(counts, dtype="int32")[kept]}
            yield pd.DataFrame(out).astype({"grade": "int32"})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    ship(documents.sparkSession)
    return docs.mapInPandas(run, schema)
