"""Language ID, toxicity and LM scoring: held-out accuracy, exact parts by brute force, edge cases."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforum.llm import langid, pitman_yor, toxicity

WORDS = {"aa": "der die und nicht ist das mit sich auf eine".split(), "bb": "the and of that was with for this have from".split(), "cc": "los que una por con las del para como más".split()}


def corpus(n, seed=1):
    r = np.random.default_rng(seed)
    return [(i, " ".join(r.choice(WORDS[lang], 30)).capitalize() + ".", lang) for i in range(n) for lang in [list(WORDS)[i % 3]]]


def test_language_of_held_out_texts(spark):
    rows = [*corpus(300), (1000, None, "aa"), (1001, "1234 !!", "aa"), (1002, "", None), (1003, "the and of that", None), (3, corpus(4)[3][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = langid.predict(df, langid.train(df)).collect()
    assert len(out) == len(rows)
    assert all(r.lang_pred == r.lang for r in out if r.doc_id < 300)
    by = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0) and by[1003][0] == "bb" and 0 < by[1003][1] <= 1
    none = langid.train(df.where("lang is null"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), langid.train(df)).count() == 0


def test_bloom_bits():
    r = np.random.default_rng(1)
    sets = {name: r.integers(0, 1 << 63, 3000).astype(np.uint64) for name in "abcdefghij"}
    f = langid.Filters.of(sets)
    for i, name in enumerate(sorted(sets)):
        assert ((f.lookup(sets[name])[:, i // 8] >> (i % 8)) & 1).all()
        miss = ((f.lookup(r.integers(0, 1 << 63, 20000).astype(np.uint64))[:, i // 8] >> (i % 8)) & 1).mean()
        assert miss == pytest.approx(f.false[i], abs=0.02)


def test_ordinal_gradient_by_fit_and_order():
    r = np.random.default_rng(3)
    grade = np.repeat([0, 1, 2], 60)
    rows = [np.unique(np.concatenate((r.integers(10, 200, 20), np.array([[], [3], [3, 4]][g], int)))) for g in grade]
    words, before = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    m = toxicity.Ordinal()
    m.fit(words, before, grade)
    assert m.thresholds[0] < m.thresholds[1]
    s = m.severity(m.linear(words, before))
    assert s[grade == 0].mean() < s[grade == 1].mean() < s[grade == 2].mean()


def test_toxic_texts_are_found(spark):
    r = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join([*r.choice(WORDS["bb"], 25), *(["Scumword!"] if bad else [])])))
        labels.append((i, int(bad)))
    rows += [(700, None), (701, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels[:400], (9999, 1), (5, None)], "doc_id long, toxic int"))
    out = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert all(out[i].toxic == bool(t) for i, t in labels)
    assert not out[700].toxic and not out[701].toxic
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(x.toxic for x in toxicity.score(docs, none).collect())


def stirling_law(n, weight, d):
    """P(t) of so many customers' tables, from the recursion of generalised Stirling numbers."""
    row = [0.0, 1.0]
    for m in range(1, n):
        row = [0.0] + [row[t - 1] + ((m - d * t) * row[t] if t < len(row) else 0) for t in range(1, m + 2)]
        row = [x / max(row) for x in row]
    p = np.array([row[t] * weight**t if t else 0 for t in range(n + 1)])
    return p / p.sum()


@pytest.mark.parametrize("n, weight, d", [(2, 0.3, 0.5), (5, 0.01, 0.5), (5, 3, 0.7), (30, 1.5, 0.3), (30, 40, 0.5), (100, 30, 0.6), (100, 2, 0.8), (3, 100, 0.5)])
def test_tables_follow_their_law(n, weight, d):
    t = pitman_yor.seated(np.full(60_000, n), np.full(60_000, float(weight)), d, np.random.default_rng(1), steps=12)[0]
    law = stirling_law(n, weight, d)
    assert t.min() >= 1 and t.max() <= n
    assert t.mean() == pytest.approx((law * np.arange(n + 1)).sum(), rel=0.02)


def test_very_many_customers_are_seated_at_once():
    rng = np.random.default_rng(2)
    few = pitman_yor.seated(np.full(200, 10**9), np.full(200, 0.5), 0.6, rng)[0]
    assert few.mean() == pytest.approx(1 + 0.5 / 0.6, rel=0.15)  # a Poisson number beside the large one
    many = pitman_yor.seated(np.full(20, 10**9), np.full(20, 2000.0), 0.6, rng, steps=8)[0]
    assert many.mean() == pytest.approx(1 + 2000 / 0.6, rel=0.02)


class OneByOne:
    """The same two levels over a fixed base, sampled one customer at a time, with every table kept."""

    def __init__(self, pairs, base, d, strength, seed=1):
        self.pairs, self.base, self.d, self.s, self.r = pairs, base, d, strength, __import__("random").Random(seed)
        self.rooms = [collections.defaultdict(lambda: collections.defaultdict(list)), collections.defaultdict(lambda: collections.defaultdict(list))]
        self.sums = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
        for u, w in pairs:
            self.enter(0, u, w)

    def p(self, j, u, w):
        if j == 2:
            return self.base[w]
        c, t = self.sums[0][j][u], self.sums[1][j][u]
        own = self.rooms[j][u].get(w, ())
        return (sum(own) - self.d[j] * len(own) + (self.s[j] + self.d[j] * t) * self.p(j + 1, None, w)) / (self.s[j] + c)

    def enter(self, j, u, w):
        if j == 2:
            return
        own = self.rooms[j][u][w]
        weights = [x - self.d[j] for x in own] + [(self.s[j] + self.d[j] * self.sums[1][j][u]) * self.p(j + 1, None, w)]
        k = self.r.choices(range(len(weights)), weights)[0]
        if k == len(own):
            own.append(0)
            self.sums[1][j][u] += 1
            self.enter(j + 1, None, w)
        own[k] += 1
        self.sums[0][j][u] += 1

    def leave(self, j, u, w):
        if j == 2:
            return
        own = self.rooms[j][u][w]
        k = self.r.choices(range(len(own)), own)[0]
        own[k] -= 1
        self.sums[0][j][u] -= 1
        if not own[k]:
            del own[k]
            self.sums[1][j][u] -= 1
            self.leave(j + 1, None, w)

    def sweep(self):
        for u, w in self.pairs:
            self.leave(0, u, w)
            self.enter(0, u, w)


def test_blocks_agree_with_one_customer_at_a_time():
    """Mean tables of contexts and perplexity of held-out pairs within 2 %, mean tables of the root within 5 %."""
    r = np.random.default_rng(5)
    share = 1 / np.arange(1, 61)
    follow = np.array([r.permutation(share) for _ in range(60)])
    text = [0]
    for _ in range(3000):
        text.append(int(r.choice(60, p=follow[text[-1]] / follow[text[-1]].sum())))
    pairs, held = [*zip(text[:2400], text[1:2401])], [*zip(text[2400:-1], text[2401:])]
    d, s = (0.6, 0.4), (1.0, 2.0)
    one = OneByOne(pairs, dict.fromkeys(range(60), 1 / 60), d, s)
    every = sorted({*pairs, *held})
    counts = collections.Counter(pairs)
    context, symbol = (np.array([x[i] for x in every]) for i in (0, 1))
    rng = np.random.default_rng(6)
    lower = pitman_yor.Level(context, np.array([counts[x] for x in every]), rng, d[0], s[0], sampled=False)
    root = pitman_yor.Level(np.zeros(60, np.int64), np.zeros(60, np.int64), rng, d[1], s[1], sampled=False)
    blocks = pitman_yor.Restaurants([lower, root], [symbol], np.full(60, 1 / 60))
    place = {x: i for i, x in enumerate(every)}
    tables, probability = np.zeros((2, 2)), np.zeros((2, len(held)))
    for turn in range(90):
        one.sweep(), blocks.sweep()
        assert lower.customers.sum() == len(pairs) and root.customers.sum() == lower.tables.sum()
        if turn >= 20:
            tables += [[sum(one.sums[1][j].values()) for j in (0, 1)], [lower.tables.sum(), root.tables.sum()]]
            probability += [[one.p(0, *x) for x in held], blocks.predict()[0][[place[x] for x in held]]]
    assert tables[0, 0] == pytest.approx(tables[1, 0], rel=0.02)
    assert tables[0, 1] == pytest.approx(tables[1, 1], rel=0.05)  # customers of the root move given its averaged probabilities
    perplexity = np.exp(-np.log(probability / 70).mean(1))
    assert perplexity[0] == pytest.approx(perplexity[1], rel=0.02)


def test_strengths_are_sampled():
    rng = np.random.default_rng(4)
    seen = {}
    for true in (0.5, 20.0):
        # 400 restaurants of 40 customers with a dish for every table.
        room = np.repeat(np.arange(400), tables := pitman_yor._chinese(np.full(400, 40), np.full(400, true), 0.3, rng))
        level = pitman_yor.Level(room, np.ones(len(room), np.int64), rng, 0.3)
        level.all_customers = np.full(400, 40)
        drawn = [(level.strengthen(), level.strength)[1] for _ in range(200)]
        seen[true] = np.mean(drawn[50:])
        assert level.all_tables.tolist() == tables.tolist()
    assert seen[0.5] == pytest.approx(0.5, rel=0.4) and seen[20.0] == pytest.approx(20, rel=0.3)


def test_frequent_contexts_are_split_by_the_word_before():
    hot, classes = np.array([7], np.uint64), np.array([3], np.uint64)
    last, before = np.array([7] * 50 + [8] * 50, np.uint64), np.arange(100).astype(np.uint64)
    own = pitman_yor.contexts(last, before, hot, classes)
    assert len(set(own[:50].tolist())) == 3 and len(set(own[50:].tolist())) == 1
    assert (own == pitman_yor.contexts(last, before, hot, classes)).all()


def test_held_out_texts_gain_from_word_order(spark):
    r = np.random.default_rng(8)
    words = [f"w{i:03d}" for i in range(120)]
    def text():
        at, out = int(r.integers(120)), []
        for _ in range(60):
            out.append(words[at])
            at = (7 * at + int(r.integers(1, 5))) % 120  # four words follow each
        return " ".join(out)
    df = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    out = pitman_yor.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).where("held_out").toPandas()
    assert (out.score > out.base_score).all()
    assert out.score.sum() / out.n_tokens.sum() > -0.85  # four equal choices: -0.60; the base: about -2.1
    assert out.base_score.sum() / out.n_tokens.sum() < -1.9


def test_scores(spark):
    r = np.random.default_rng(7)
    texts = [(i, " ".join(r.choice([*WORDS["bb"], f"w{i % 7}"], int(r.integers(0, 40)))).title()) for i in range(120)]
    rows = [*texts, (500, None), (501, ""), (502, "\t \n"), (3, texts[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = collections.defaultdict(list)
    for x in pitman_yor.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).collect():
        out[x.doc_id].append(x)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert sum(map(len, out.values())) == len(rows)
    for i, t in rows:
        for x in out[i]:
            own = tokens(t)
            assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(own), sum(c[w] > 0 for w in own), n, zlib.crc32(str(i).encode()) % 5 == 1)
            assert x.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
            assert -1000 < x.score < 0
    assert pitman_yor.score(df.limit(0), F.lit(False)).count() == 0
