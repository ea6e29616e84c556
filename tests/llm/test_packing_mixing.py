import numpy as np
import pytest
from pyspark.sql import functions as F

from allelemill.llm import mixing as M
from allelemill.llm import packing as P
from allelemill.llm.tokens import TOKENIZER, encoding, sizes

D = "doc_id long, text string, source string, lang string, capacity int, container_id string"


def slow_pack(items, capacity):
    """Sum of squares by its definition: try every container."""
    levels, where = [], []
    for s in items:
        count = {}
        for x in levels:
            if x < capacity:
                count[x] = count.get(x, 0) + 1
        total = lambda c: sum(v * v for v in c.values())
        best = None
        for h in {0, *[x for x in levels if x + s <= capacity]}:
            c = dict(count)
            if h:
                c[h] -= 1
            if h + s < capacity:
                c[h + s] = c.get(h + s, 0) + 1
            key = (total(c), -h)
            if best is None or key < best[0]:
                best = (key, h)
        h = best[1]
        if h:
            k = next(i for i in range(len(levels) - 1, -1, -1) if levels[i] == h)
        else:
            levels.append(0)
            k = len(levels) - 1
        levels[k] += s
        where.append(levels[k])
    return levels, where


@pytest.mark.parametrize("seed", range(4))
def test_pack_is_sum_of_squares(seed):
    r = np.random.default_rng(seed)
    items = r.integers(1, 31, 300)
    where, n = P.pack(items, 30)
    got = np.bincount(where, weights=items, minlength=n).astype(int)
    levels, _ = slow_pack(items, 30)
    assert sorted(got) == sorted(levels) and got.max() <= 30 and len(where) == 300
    assert P.pack(np.array([], dtype=int), 5)[1] == 0 and P.pack(np.array([5, 5]), 5)[1] == 2


def docs(spark, n=300, seed=0):
    r = np.random.default_rng(seed)
    words = ["seed", "brake", "keg", "star", "hem", "nib"]
    rows = []
    for i in range(n):
        s = int(min(5, r.geometric(0.4) - 1))
        text = " ".join(r.choice([words[s], "the", "a", "was", "red", str(i)], int(r.integers(1, 120))))
        rows.append((i, text + f" {words[s]} {i}", [f"S{s}", f" s{s}", f"s{s} "][i % 3], ["en", "EN", "de-XX", None][i % 4], 9, "clash"))
    rows += [(n, None, "s1", "en", 1, ""), (n + 1, "", "s1", "en", 1, ""), (n + 2, "word " * 3000, "s0", "en", 1, ""), (n + 3, rows[0][1], rows[0][2], rows[0][3], 1, "")]
    return spark.createDataFrame(rows, D)


def test_containers(spark):
    d = docs(spark)
    limits = spark.createDataFrame([("a", 64), ("b", 512), ("none", 0), ("null", None)], "limit_name string, capacity_tokens int")
    want = {r["doc_id"]: r["n_tokens"] for r in sizes(d, "doc_id", "text").collect() if r["n_tokens"]}
    for k in ({}, {"shard_items": 60, "full": 1.0}):
        out = P.fill_containers(d, limits, **k).toPandas()
        assert set(out.limit_name) == {"a", "b"}
        for cap, g in out.groupby("capacity"):
            assert g.groupby("doc_id").n_tokens.sum().to_dict() == want
            fill = g.groupby("container_id").n_tokens.sum()
            assert (fill <= cap).all() and (g.container_id.map(fill) == g.fill).all()
            parts = g.groupby("doc_id").size()
            assert all(parts[i] == -(-n // cap) for i, n in want.items())  # split only beyond the capacity
            assert len(fill) <= 1.12 * np.ceil(sum(want.values()) / cap) + 1
    rep = P.fill_report(P.fill_containers(d, limits)).toPandas()
    assert (rep.unused_share < 0.12).all() and (rep.n_containers >= rep.least_containers).all()


def test_containers_of_nothing(spark):
    limits = spark.createDataFrame([("a", 64)], "limit_name string, capacity_tokens int")
    d = docs(spark).filter("text is null or text = ''")
    assert P.fill_containers(d, limits).count() == 0 and P.fill_containers(d.limit(0), limits).count() == 0 and P.fill_containers(docs(spark), limits.limit(0)).count() == 0


def test_tokens():
    enc = encoding(TOKENIZER)
    text = "It's 10 o'clock,  naïve\n<|endoftext|> 中"
    assert enc.decode(enc.encode_ordinary(text)) == text


T = "source string, target_share double, max_repeats int"


def test_mixture(spark):
    d = docs(spark, 600)
    targets = spark.createDataFrame([("s0", 0.3, 1), ("S1 ", 0.3, 2), ("s2", 0.2, 3), ("s3", 0.2, 4), ("gone", 0.1, 4)], T)
    got = M.mixture(d, targets).toPandas()
    caps = {"s0": 1, "s1": 2, "s2": 3, "s3": 4}
    assert (got.copies <= got.source.map(caps)).all() and got.doc_id.is_unique and set(got.source) == set(caps)
    share = (got.n_tokens * got.copies).groupby(got.source).sum()
    share /= share.sum()
    for s, t in {"s0": 0.3, "s1": 0.3, "s2": 0.2, "s3": 0.2}.items():
        assert abs(share[s] - t) < 0.02
    assert 603 not in set(got.doc_id)  # the copy of text 0
    rep = M.mixture_report(M.mixture(d, targets), targets).toPandas().set_index("source")
    assert rep.loc["gone", "actual_share"] == 0 and abs(rep.actual_share.sum() - 1) < 1e-9
    small = M.mixture(d, targets, total_tokens=2000).toPandas()
    assert 1500 < (small.n_tokens * small.copies).sum() < 2500


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("s0", 0.5, 1), (None, 0.5, 2)], T)
    d = docs(spark, 20)
    assert M.mixture(d.limit(0), targets).count() == 0 and M.mixture(d, targets.limit(0)).count() == 0 and M.mixture(d.filter("source is null"), targets).count() == 0
    assert M.mixture_report(M.mixture(d.limit(0), targets), targets).count() == 1


def test_rake_fits_all_marginals():
    r = np.random.default_rng(0)
    cells = {(s, l, t): float(r.uniform(1, 9)) for s in "ab" for l in "xy" for t in "pq"}
    targets = [{"a": 0.7, "b": 0.3}, {"x": 0.4, "y": 0.6}, {"p": 0.2, "q": 0.8}]
    out = M.rake(cells, targets)
    for axis, t in enumerate(targets):
        for k, v in t.items():
            assert sum(x for c, x in out.items() if c[axis] == k) == pytest.approx(v, abs=1e-6)
    w = M.weights(cells, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}, None, None, None)
    tokens = {s: sum(cells[k] * v for k, v in w.items() if k[0] == s) for s in "ab"}
    assert tokens["a"] == pytest.approx(tokens["b"]) and max(v for k, v in w.items() if k[0] == "a") <= 1 + 1e-9


def test_same_result_each_time(spark):
    d, targets = docs(spark, 200), spark.createDataFrame([("s0", 0.5, 1), ("s1", 0.5, 2)], T)
    a, b = (sorted(map(tuple, M.mixture(x, targets).select("doc_id", "copies").collect())) for x in (d, d.repartition(7, F.rand())))
    assert a == b


def test_topics_come_from_the_texts(spark):
    """Texts about two matters, dealt to sources at random, form two topics."""
    rng = np.random.default_rng(1)
    matters = [["engine", "gearbox", "clutch", "piston", "exhaust", "throttle"], ["flour", "butter", "oven", "dough", "yeast", "sugar"]]
    rows = [(i, " ".join(rng.choice(matters[i % 2], 4, replace=False)) + " the and with for", f"s{rng.integers(0, 3)}", "en") for i in range(200)]
    d = spark.createDataFrame([*rows, (900, "zzz", "s1", "en")], "doc_id long, text string, source string, lang string")
    t = M.texts(d, spark.createDataFrame([(f"s{i}", 0.3, 1) for i in range(3)], T)).toPandas()
    first = dict(zip(t.doc_id, t.topic))
    sides = [{first[i] for i in first if i < 900 and i % 2 == k} for k in (0, 1)]
    assert not sides[0] & sides[1] and first[900] == "none"


def test_thresholds_reach_the_tokens(spark):
    d = spark.createDataFrame([("a", "en", "t", 10 + i % 7, float((i * 0.61803398875) % 1)) for i in range(5000)] + [("b", "en", "t", 5, 0.999)], "src string, lang string, topic string, n_tokens int, h double")
    plan = spark.createDataFrame([("a", "en", "t", 1, 0.37), ("b", "en", "t", 0, 0.5), ("c", "en", "t", 2, 0.0)], "src string, lang string, topic string, whole int, extra double")
    at = {r["src"]: r["below"] for r in M.thresholds(d, plan).collect()}
    g = d.filter("src = 'a'").toPandas()
    assert abs(g.n_tokens[g.h < at["a"]].sum() / g.n_tokens.sum() - 0.37) < 0.001 and at["c"] == 0 and 0 < at["b"] <= 1


def test_packing_many_limits_and_levels(spark):
    d = docs(spark, 400)
    limits = spark.createDataFrame([(f"l{i}", 64 + i) for i in range(5)], "limit_name string, capacity_tokens int")
    out = P.fill_containers(d, limits, shard_items=30, shard_tokens=2000).toPandas()
    for (_, cap), g in out.groupby(["limit_name", "capacity"]):
        fill = g.groupby("container_id").n_tokens.sum()
        assert (fill <= cap).all() and not g.duplicated(["doc_id", "part_no"]).any()
    assert out.groupby("limit_name").n_tokens.sum().nunique() == 1
