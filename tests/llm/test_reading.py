import numpy as np
import pytest

from allelemill.llm import reading as R

EASY = ["The dog ran to the hat. We had a red pot. Look at that cup. Is it new? They cut the cake.", "I can see a cat in my box. You got the pen. It was soft. She hit a nail."]
HARD = ["Notwithstanding the incommensurate heterogeneity of the demarcation, one may conclude that a counterintuitive operationalization presupposed the misspecification, insofar as its commensurability was exacerbated.", "To the extent that a paradigmatic equilibration substantiated the multicollinearity, it hardly follows that the phenomenology instantiated any verisimilitude, although our parameterization problematized it."]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""), ("", ""), ("plain words", "plain words"), ("[quote=a]no[/quote]yes", "yes"), ("[QUOTE]\n[i]n[/i]\nno [QUOTE]inner[/QUOTE] no\n[/QUOTE]\nyes", "yes"),
        ("On 01.01.2023, 16:57, x wrote:\n> no\n>> no\nyes", "yes"), ("x wrote:\n> no\nyes", "yes"), ("-----Original post-----\nFrom: x\n| no\n| no\n-----\nyes", "yes"), ("<blockquote><cite>x</cite>no<br>no</blockquote>yes", "yes"),
        ("[QUOTE]no [QUOTE]cut short [/QUOTE]\nyes", "yes"), ("yes\n\n-- \nName\nline", "yes"), ("yes\n___________\nMopa :: 35 years", "yes"), ("yes<hr/><small>me, keeper of 7 bikes</small>", "yes"), ("yes\n[sig][b]x[/b] | http://x.invalid/me[/sig]", "yes"),
        ("<p>a</p><p>b</p>", "a\n\nb"), ("some [b]bold[/b] **word** [url=http://x.invalid/1]pic[/url]", "some bold word"), ("a&amp;nbsp;b&nbsp;c", "a b c"), ("Iâ€™ve a​b Â c", "I've ab  c"), ("yes\r\n> no\r\nyes", "yes\n\nyes"), ("5 > 3 and x < y", "5 > 3 and x < y"),
        ("[quote=a]never closed", "never closed"), ("yes\n> [QUOTE]\n> no\nmore", "yes\n\nmore"),
    ],
)
def test_own_words(text, want):
    assert R.own_words(text).replace("\xa0", " ") == want


def test_long_texts_end():
    for t in ("[quote]" * 5000, "<" * 50_000, "> a\n" * 50_000, "[" * 50_000, "_" * 100_000 + "\n", "-- \n" * 20_000, "a" * 500_000):
        assert isinstance(R.own_words(t), str)
    lexicon = R.Lexicon([], [])
    assert np.isfinite(R.features(["a" * 100_000, "", "!", "one two."], lexicon)[0]).all() and R.features([], lexicon)[0].shape[0] == 0


def english(*texts):
    return list(R.is_english(R.features(list(texts), R.Lexicon([], []))[1]))


def test_language():
    assert english("the dog and the cat were in a box with my hat", "a man was in the park and he had an apple for us") == [True, True]
    others = ["el perro y la casa de mi vecino en la calle", "der hund und die katze mit einem haus für mich", "", "mon voisin a perdu le jardin dans la rue avec une bouteille"]
    others += ["il cane e la casa di mio fratello non sono nella strada perché piove", "o cachorro e a casa do meu vizinho não estão na rua mas no jardim", "de hond en het huis van mijn buurman zijn niet op de straat", "hunden och katten är inte på gatan men i ett hus", "pies i kot nie są na ulicy ale w domu"]
    assert english(*others) == [False] * len(others)


def test_features_of_a_batch_are_those_of_each_text():
    lexicon = R.Lexicon([R.sentences_of(t) for t in EASY + HARD], [1, 1, 5, 5])
    texts = [*EASY, "", "One? Two, three!", *HARD, "no end"]
    whole = R.features(texts, lexicon)
    for i, t in enumerate(texts):
        assert np.allclose(whole[0][i], R.features([t], lexicon)[0][0]) and np.allclose(whole[1][i], R.features([t], lexicon)[1][0])
    med = R.features(["a b c. d e. f g h i j."], lexicon)[0][0]
    assert med[1] == pytest.approx(np.log1p(3)) and med[0] == pytest.approx(np.log1p(10 / 3)) and med[2] == pytest.approx(np.std([3, 2, 5]) / 10)


def test_blocks_give_the_pairwise_ranker():
    r = np.random.default_rng(0)
    x, g = r.normal(size=(60, 4)), r.integers(1, 6, 60).astype(float)
    i, j = np.where(g[:, None] > g[None, :])
    d, v = x[i] - x[j], g[i] - g[j]
    v = v * len(x) / v.sum()
    w = R.train_ranker(x, g, 3.0, block=7)
    p = 1 / (1 + np.exp(-(d @ w)))
    assert np.abs(d.T @ (v * (p - 1)) + 3.0 * w / 4).max() < 1e-6  # the gradient of all pairs vanishes
    big = r.normal(size=(5000, 20))
    assert np.isfinite(R.train_ranker(big, r.integers(1, 6, 5000).astype(float), rounds=2)).all()


def test_isotonic():
    k, v = R.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert list(v) == [1, 1, 2.5, 2.5, 4, 4] and list(k) == [1, 1, 2, 3, 4, 4]
    assert list(R.cuts_from(k, v, [1, 4])) == [1.5] and list(R.cuts_from(k, v, [1, 3, 4])) == [1.5, 3.5]


def test_ranker_orders():
    m = R.Reader(EASY + HARD, [1, 1, 5, 5])
    s = m.score([*EASY, *HARD])
    assert s[:2].max() < s[2:].min() and list(m.grade([EASY[0], HARD[1]])) == [1, 5] and len(m.grade([])) == 0


def test_held_out_accuracy():
    """On passages of five invented levels a tenth left out is graded right."""
    r = np.random.default_rng(0)
    vocab = [["dog", "hat", "pot", "cup"], ["window", "garden", "yellow", "market"], ["delivery", "improved", "practical", "selection"], ["implementation", "considerable", "recommendation"], ["heteroscedasticity", "incommensurability", "operationalization"]]
    join = ["", " and", ", because", ", whereas", ", notwithstanding that"]

    def passage(g):
        return " ".join(" ".join(["the"] + list(r.choice(vocab[g], 3 + g)) + [join[g].strip(", ")] + list(r.choice(vocab[g], 2 * g + 1))) + "." for _ in range(6))

    grades = [g for g in range(5) for _ in range(16)]
    texts = [passage(g) for g in grades]
    test = np.arange(80) % 8 == 0
    m = R.Reader([t for t, x in zip(texts, test) if not x], [g + 1 for g, x in zip(grades, test) if not x])
    got = m.grade([t for t, x in zip(texts, test) if x])
    want = np.array([g + 1 for g, x in zip(grades, test) if x])
    assert (got == want).mean() >= 0.9


def test_frames(spark):
    s = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(EASY + HARD + [EASY[0], "x"], [1, 1, 5, 5, 1, None]))] + [(99, None, 3)], "sample_id int, passage string, grade int")
    d = spark.createDataFrame(
        [(1, " ".join(EASY * 3), 7), (2, " ".join(HARD * 3), 7), (2, " ".join(HARD * 3), 7), (3, "too short", 7), (4, None, 7), (5, "el perro y la casa de mi vecino " * 20, 7), (6, "[quote]" + " ".join(HARD * 3) + "[/quote] " + " ".join(EASY * 3), 7)],
        "doc_id long, text string, grade int",
    )
    got = sorted((r["doc_id"], r["grade"]) for r in R.reading_levels(d, s).collect())
    assert got == [(1, 1), (2, 5), (2, 5), (6, 1)]
    assert R.reading_levels(d, s.limit(0)).count() == 0 and R.reading_levels(d.limit(0), s).count() == 0
