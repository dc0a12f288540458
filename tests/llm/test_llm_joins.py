"""Vector searches, components, Jaccard join, line dedup and the pipeline against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from lexforum.llm import components, hnsw, jaccard, kdtree, line_dedup

DDL = "vec_id long, embedding array<float>, label int"


def vector_rows(n=700, dim=16, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(size=dim).astype(np.float32)], 0) for i in range(n)]
    for i in range(0, 60):  # equal vectors
        rows[i * 3 + 1] = (i * 3 + 1, rows[0][1], 0)
    rows += [(5000, None, 0), (5050, [None] * dim, 0), (5100, [float("nan")] * dim, 0), (5200, [0.0] * dim, 0), (5001, [1.0, 2.0], 0)]
    return rows


def usable(rows, zero):
    return {i: np.array(v, float) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and (zero or any(v))}


def best(vectors, q, k, score):
    own = sorted(((-score(vectors[q], v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])))
    return own[:k]


def test_exact_top_k(spark):
    rows = vector_rows()
    out = collections.defaultdict(list)
    for r in kdtree.top_k(spark.createDataFrame([*rows, rows[7]], DDL)).collect():
        out[r.query_id].append((r.rank, -r.score, r.vec_id))
    vectors = {i: np.floor(1024 * v).astype(int) for i, v in usable(rows, True).items()}
    for q in (i for i in vectors if i % 100 == 0):
        want = best(vectors, q, 10, lambda a, b: int(a @ b))
        assert [(s, i) for _, s, i in sorted(out[q])] == want
    assert set(out) == {i for i in vectors if i % 100 == 0}
    assert kdtree.top_k(spark.createDataFrame([], DDL)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i * 100, [3e9 + i, -2e9 * i], 0) for i in range(5)]
    out = kdtree.top_k(spark.createDataFrame(rows, DDL.replace("float", "double"))).collect()
    v = {i: [int(np.floor(1024 * x)) for x in e] for i, e, _ in rows}
    small = [r for r in out if abs(sum(a * b for a, b in zip(v[r.query_id], v[r.vec_id]))) < 2**63]
    assert all(r.score == sum(a * b for a, b in zip(v[r.query_id], v[r.vec_id])) for r in small)


def test_nearest_recall(spark):
    rows = vector_rows()
    out = collections.defaultdict(list)
    for r in hnsw.nearest(spark.createDataFrame(rows, DDL)).collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    vectors = usable(rows, False)
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    hit = total = 0
    for q in (i for i in vectors if i % 50 == 0):
        own = sorted(out[q])
        assert [r for r, _, _ in own] == list(range(1, 6))
        assert all(s == pytest.approx(cos(vectors[q], vectors[i]), abs=1e-12) for _, i, s in own)
        want = sorted((-round(cos(vectors[q], v), 12), i) for i, v in vectors.items() if i != q and len(v) == 16)[:5]
        hit += len({i for _, i in want} & {i for _, i, _ in own})
        total += 5
    assert hit / total >= 0.95
    assert [i for _, i, _ in sorted(out[0])] == [1, 4, 7, 10, 13]  # ties by id


def test_searches_over_several_shards(spark):
    """The merge, and the k-th score carried from the home group, over 8 shards and more."""
    rows = [*vector_rows(1600, 24, 7), (4000, [0.5] * 24, 0), (4000, [0.25] * 24, 0)]
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "1 as shard", "'x' as v").repartition(5)
    vectors = usable(rows[:-2], True)
    out = collections.defaultdict(list)
    for r in kdtree.top_k(df, shard_rows=200).collect():
        out[r.query_id].append((r.rank, -r.score, r.vec_id))
    whole = {i: np.floor(1024 * v).astype(int) for i, v in vectors.items()}
    twice = [np.floor(1024 * np.full(24, x)).astype(int) for x in (0.5, 0.25)]
    for q in (i for i in whole if i % 100 == 0 and len(whole[i]) == 24):
        others = best(whole, q, 10, lambda a, b: int(a @ b)) + [(-int(whole[q] @ t), 4000) for t in twice]
        assert [(s, i) for _, s, i in sorted(out[q])] == sorted(set(others))[:10]
    found = collections.defaultdict(list)
    for r in hnsw.nearest(df, shard_rows=200).collect():
        found[r.query_id].append(r.vec_id)
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    own = {i: v for i, v in usable(rows[:-2], False).items() if len(v) == 24}
    hit = total = 0
    for q in (i for i in own if i % 50 == 0 and i != 4000):
        want = sorted((-round(cos(own[q], v), 12), i) for i, v in own.items() if i != q)[:5]
        hit, total = hit + len({i for _, i in want} & set(found[q])), total + 5
    assert hit / total >= 0.95
    assert hnsw.nearest(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(f"n{r.randint(0, 150)}", f"n{r.randint(0, 150)}") for _ in range(90)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("x", None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "a string, b string")
    for most in (components.ONE_TASK, 0):  # in one task, and by stars
        out = {x.node: x.component for x in components.components(df, one_task=most).collect()}
        assert out == {n: find(n) for n in parent}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def near_copies(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    rows, n = [], 0
    for size in (6, 8, 9, 12, 30, 90, 300):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(r.choice([1, 2, 5, 12])):
                own = list(base)
                for _ in range(r.choice([0, 0, 1, 1, 2, max(1, size // 40)])):
                    own[r.choice([0, -1, r.randrange(size)])] = word()
                rows.append((n, "  ".join(own).capitalize() + "\n"))
                n += 1
    passage = " ".join(word() for _ in range(40))
    rows += [(n + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(25)]
    n += 25
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one two"), (n + 4, "ONE two"), (n + 5, "one two three"), (4, rows[4][1])]
    return rows


def brute_jaccard(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_components(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_shingles").repartition(5)
    out = jaccard.join(df).collect()
    want = brute_jaccard(rows)
    assert len(out) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in out)


def test_jaccard_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(empty).count() == 0
    out = jaccard.join(spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (8, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {None: 7, 7: 7, 8: 8}


def test_light_and_heavy_agree():
    assert [int(jaccard.needed(n)) for n in (1, 2, 4, 5, 6, 10, 11)] == [1, 2, 4, 4, 5, 8, 9]
    element = np.array([5, 1 << 39, 77], np.uint64)
    got = jaccard.unpack(jaccard.pack(element, np.array([0, 0, 3]), 5, np.array([2, 3, 255], np.uint8)))
    assert got[0].tolist() == element.tolist() and got[1].tolist() == [0, 0, 3] and got[2] == 5 and got[3].tolist() == [2, 3, 255]


def brute_lines(rows, least):
    """Deletes every line of a run of `least` words or more that occurs earlier, by trying all runs."""
    docs = {}
    for i, t in rows:
        if t is not None:
            docs.setdefault((i, t), t.split("\n"))
    order = sorted(docs)
    words = lambda ls: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in ls)
    seen, gone = {}, collections.defaultdict(set)
    places = [(key, s, e) for key in order for s in range(len(docs[key])) for e in range(s + 1, len(docs[key]) + 1) if words(docs[key][s:e]) >= least]
    for key, s, e in sorted(places, key=lambda p: (p[0], p[1])):
        body = tuple(docs[key][s:e])
        if body in seen:
            gone[key] |= set(range(s, e))
        else:
            seen[body] = (key, s)
    return {key: "\n".join(x for k, x in enumerate(docs[key]) if k not in gone[key]) for key in order}


def test_line_dedup(spark):
    r = random.Random(9)
    lines = [" ".join(r.choice("abcdef") for _ in range(r.randint(0, 4))) for _ in range(9)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a b\n" * 20), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as _h", "5 as lines_total")
    out = line_dedup.dedup(df, min_words=6).collect()
    want = brute_lines(rows, 6)
    assert len(out) == len(rows)
    for x, t in ((x, t) for x in out for i, t in rows if i == x.doc_id):
        assert x.text == (want[(x.doc_id, t)] if t is not None else None)
    assert line_dedup.dedup(df.limit(0)).count() == 0
    assert not any("Arrow" in s or "Python" in s for s in [df.sparkSession._jvm.PythonSQLUtils.explainString(line_dedup.dedup(df)._jdf.queryExecution(), "simple")])


def test_frequent_keys_and_long_texts(spark):
    """One passage in most documents, one text of 1 MB in two: a hot key in every join, read whole."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = "\n".join(" ".join(word() for _ in range(12)) for _ in range(5))
    long = "\n".join(" ".join(word() for _ in range(10)) for _ in range(17_000))
    rows = [(i, "\n".join([" ".join(word() for _ in range(9)), passage, word()])) for i in range(300)]
    rows += [(1000, long), (1001, long + "\nend"), (1002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = {x.doc_id: x for x in line_dedup.dedup(df).collect()}
    assert out[0].text == rows[0][1] and out[1000].text == long and out[1001].text == "end" and out[1002].text == ""
    assert all(out[i].text == rows[i][1].replace(passage + "\n", "") for i in range(1, 300))
    joined = {x.doc_id: x.component_id for x in jaccard.join(df).collect()}
    assert joined[1001] == 1000 and joined[1002] == 1002
    want = brute_jaccard(rows[:300])
    assert all(joined[i] == want[i][1] for i in range(300))


def test_keyed_join_spreads_frequent_keys(spark):
    from pyspark.sql import functions as F

    from lexforum.llm.shared import hot_from, join_keyed

    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(900)], "k int, v int")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).where("k % 2 = 0")
    want = sorted(tuple(x) for x in rows.join(keyed, "k").select("k", "v", "n", "top").collect())
    for hot in (2, hot_from(spark, 900), 10_000):
        assert sorted(tuple(x) for x in join_keyed(rows, keyed, ["k"], "n", hot).select("k", "v", "n", "top").collect()) == want


def test_null_ids_are_documents_too(spark):
    text = " ".join(["w"] * 60)
    out = line_dedup.dedup(spark.createDataFrame([(None, text), (1, text), (None, "short")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.lines_removed) for r in out) == [("1", 1), ("None", 0), ("None", 0)]
