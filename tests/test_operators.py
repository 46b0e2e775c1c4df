"""Operators on hand-made cases and against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recdata.operators import clean, corpus, evaluate, filters, graph, models, negatives, profiles, sample, similarity, split
from recdata.sources import tables


@pytest.fixture(scope="module")
def inter(spark):
    rows = [(u, i, (u * i) % 5 + 1) for u, n in ((1, 1), (2, 4), (3, 5), (4, 11)) for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating int").cache()


def test_split_sizes(inter):
    got = {(r["user_id"], r["split"]): r["n"] for r in split.split_ratio(inter).groupBy("user_id", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "train"): 1, (2, "train"): 4, (3, "test"): 1, (3, "validation"): 1, (3, "train"): 3, (4, "test"): 3, (4, "validation"): 2, (4, "train"): 6}
    assert {r["user_id"] for r in split.split_ratio(inter, keep_tail=False).select("user_id").collect()} == {3, 4}


def test_folds_rotate(inter):
    tail, rest = split.split_longtail(inter, 4)
    rows = split.rotate_folds(split.folds(rest, 5), 5, tail).collect()
    assert len(rows) == 5 * 21
    for s in range(5):
        tested = {(r["user_id"], r["item_id"]) for r in rows if r["split_no"] == s and r["split"] == "test"}
        valid = {(r["user_id"], r["item_id"]) for r in rows if r["split_no"] == s and r["split"] == "validation"}
        assert tested and not tested & valid and not any(u in (1, 2) for u, _ in tested | valid)
    assert len({(r["user_id"], r["item_id"]) for r in rows if r["split"] == "test"}) == 16


def test_negatives_uniform_and_short(spark, inter):
    items = spark.range(12).withColumnRenamed("id", "item_id")
    pos = inter.where("item_id = 0").select("user_id", "item_id")
    used = inter.select("user_id", "item_id")
    neg = negatives.neg_uniform(pos, used, items, 4)
    got = {u: [r["item_id"] for r in neg.where(f"user_id = {u}").collect()] for u in (1, 2, 3, 4)}
    assert [len(got[u]) for u in (1, 2, 3, 4)] == [4, 4, 4, 1] and all(len(set(x)) == len(x) for x in got.values())
    assert got[4] == [11]
    assert [tuple(r) for r in negatives.shortfall(pos, neg, 4).collect()] == [(4, 4, 1)]
    assert {r["check"]: r["bad"] for r in negatives.check_negatives(pos, neg, used).collect()} == {"used": 0, "positives_only": 0, "negatives_only": 0}
    assert sorted(map(tuple, neg.collect())) == sorted(map(tuple, negatives.neg_uniform(pos.repartition(3), used.repartition(5), items.repartition(2), 4).collect()))


def test_genre_quota(spark):
    items = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["b"]), (4, []), (5, ["a", "b"])], "item_id long, genres array<string>")
    train = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4)], "user_id long, item_id long")
    pos = spark.createDataFrame([(1, 9), (1, 8)], "user_id long, item_id long")
    got = {r["genre"]: r["quota"] for r in negatives.neg_genre_quota(pos, train, items, 4).collect()}
    assert sum(got.values()) == 8 and got["a"] == 4 and got["b"] == 2 and got[""] == 2


def _ndcg(gains, scores, k):
    """Mean over all orders of tied items."""
    best = []
    for order in itertools.permutations(range(len(gains))):
        if all(scores[a] >= scores[b] for a, b in zip(order, order[1:], strict=False)):
            best.append(sum(gains[i] / math.log2(p + 2) for p, i in enumerate(order[:k])))
    ideal = sum(g / math.log2(p + 2) for p, g in enumerate(sorted(gains, reverse=True)[:k]))
    return sum(best) / len(best) / ideal if ideal else 0.0


def test_ranking_metrics(spark):
    cases = {1: ([1, 0, 0, 1, 0, 0, 0], [3, 3, 3, 2, 2, 1, 0]), 2: ([0, 0, 0], [1, 2, 2]), 3: ([1, 1], [5, 5]), 4: ([0, 0, 1, 0], [1, 1, 1, 1])}
    cand = spark.createDataFrame([(u, i, g) for u, (gs, _) in cases.items() for i, g in enumerate(gs)], "user_id long, item_id long, label int")
    pred = spark.createDataFrame([(u, i, float(s)) for u, (_, ss) in cases.items() for i, s in enumerate(ss)], "user_id long, item_id long, score double")
    got = {r["user_id"]: r for r in evaluate.ranking_detail(cand, pred, ks=(3, 5)).collect()}
    for u, (gains, scores) in cases.items():
        for k in (3, 5):
            assert got[u][f"ndcg_{k}"] == pytest.approx(_ndcg(gains, scores, k), abs=1e-12)
        pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a, g in zip(scores, gains, strict=True) if g for b, h in zip(scores, gains, strict=True) if not h]
        assert got[u]["auc"] == (pytest.approx(sum(pairs) / len(pairs)) if pairs else None)
    assert got[4]["rr"] == 0.5 and got[2]["rr"] == 0.0 and got[1]["p_5"] == 0.4
    eps = {r["user_id"]: r for r in evaluate.ranking_detail(cand, pred, ks=(3,), ties="epsilon").collect()}
    assert eps[4]["ndcg_3"] == pytest.approx(1 / math.log2(4)) and eps[4]["auc"] == pytest.approx(1 / 3)  # later in descending order, higher score
    whole = {r["group"]: r for r in evaluate.evaluate(cand, pred, spark.createDataFrame([(1, "x"), (2, "y")], "user_id long, group string")).collect()}
    assert whole["ALL"]["n_users"] == 4 and whole["x"]["n_pos"] == 2 and set(whole) == {"ALL", "x", "y"}


def test_ratio_groups(spark, inter):
    got = {r["user_id"]: r["group"] for r in evaluate.user_groups(inter, ratios=(50, 25, 25)).collect()}
    assert got == {1: "sporadic", 2: "sporadic", 3: "regular", 4: "bibliophilic"}
    with pytest.raises(ValueError):
        evaluate.user_groups(inter, ratios=(50, 20, 20))


@pytest.mark.parametrize("hub", [2, 10_000])
def test_components_of_random_graphs(spark, monkeypatch, hub):
    """Many tasks, hubs that are dealt out, long chains, a star and strings as nodes, against a plain union-find."""
    monkeypatch.setattr(graph, "HUB", hub)
    monkeypatch.setattr(graph, "HUBS", 10**9)
    monkeypatch.setattr(graph, "HELD", 7)
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(300)] + [(3300 - i, 3300) for i in range(200)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in pairs if a != b for x in (a, b)}
    edges = spark.createDataFrame([*pairs, (None, 5), (7, None)], "a long, b long").repartition(5)
    assert {r["node"]: r["component"] for r in graph.connected_components(edges).collect()} == want
    named = edges.select(F.format_string("n%05d", "a").alias("a"), F.format_string("n%05d", "b").alias("b")).where("a NOT LIKE '%null%' AND b NOT LIKE '%null%'")
    assert {r["node"]: r["component"] for r in graph.connected_components(named).collect()} == {f"n{k:05d}": f"n{x:05d}" for k, x in want.items()}


def test_a_spanning_forest_is_small(spark):
    """All edges of a dense group leave a task as one edge for each node but one."""
    edges = spark.range(400).crossJoin(spark.range(400).withColumnRenamed("id", "v")).select(F.col("id").alias("u"), "v").coalesce(1)
    assert graph.spanning_forests(edges).count() == 399


def test_components_and_mapping(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (2, 1)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 100 for i in range(100, 141)}
    assert graph.connected_components(edges.limit(0)).count() == 0
    uses = spark.createDataFrame([(u, 3) for u in range(4)] + [(9, 1)], "user_id long, item_id long")
    assert {tuple(r) for r in clean.canonical_items(edges.where("a < 3"), uses).collect()} == {(1, 3), (2, 3)}


def test_same_review_cleaning(spark):
    items = spark.createDataFrame([(1, "A", "4.0"), (2, "A", "4.0"), (3, "B", "4.0"), (4, "A", "4.0")], "item_id long, author string, avg_rating string")
    rows = [(1, 1, 5, "good"), (1, 2, 5, "good"), (1, 3, 5, "good"), (2, 2, 4, "x"), (3, 4, 5, ""), (3, 1, 5, "")]
    kept = clean.clean_same_review(spark.createDataFrame(rows, "user_id long, item_id long, rating int, review string"), items)
    assert {(r["user_id"], r["item_id"]) for r in kept.collect()} == {(1, 1), (1, 3), (2, 2), (3, 4), (3, 1)}


def test_editions(spark):
    items = spark.createDataFrame([(1, "A", "4.1", 1234), (2, "A", "4.1", 1234), (3, "A", "4.1", 1234), (4, "A", "4.1", 5), (5, "A", "4.1", 5)], "item_id long, author string, avg_rating string, num_rating long")
    inter = spark.createDataFrame([(1, 2), (2, 2), (1, 1)], "user_id long, item_id long")
    assert {tuple(r) for r in clean.merge_editions(items, inter).collect()} == {(1, 2), (3, 2)}


@pytest.mark.parametrize("head", [100_000, 2, 0])
def test_sentence_ranking(spark, monkeypatch, head):
    """However many terms are sent to the tasks."""
    monkeypatch.setattr(profiles, "HEAD", head)
    profile = spark.createDataFrame([(1, "Rare bird. The the the. Zzz qqq."), (2, ""), (3, None)], "user_id long, text string")
    idf = spark.createDataFrame([("rare", 1, 3.0), ("bird", 2, 2.0), ("the", 9, 0.1), (".", 9, 0.0)], "term string, df long, idf double")
    got = lambda **kw: {r["user_id"]: r["text"] for r in profiles.rank_sentences(profile, idf, **kw).collect()}
    assert got() == {1: "Rare bird. The the the. Zzz qqq.", 2: "", 3: ""}
    known = idf.where("term <> '.'")
    low = {r["user_id"]: r["text"] for r in profiles.rank_sentences(profile, known, empty_score=10.0).collect()}
    assert low[1].startswith("Zzz qqq.")


def test_bm25_prefers_match(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple tart with cream"), (3, "car"), (4, "boat and car"), (5, "")], "item_id long, text string")
    got = corpus.bm25(docs.where("item_id = 1"), docs).orderBy("rank").collect()
    assert [r["doc_item"] for r in got] == [1, 2] and got[0]["score"] > got[1]["score"]


@pytest.mark.parametrize("topn", [1, 3, 50])
def test_bm25_equals_brute_force(spark, monkeypatch, topn):
    """Over several blocks and copies of them, with bounds of blocks, with and without tags."""
    for name, value in (("BLOCK", 7), ("QUERIES", 3)):
        monkeypatch.setattr(corpus, name, value)
    rng = random.Random(1)
    texts = {i: " ".join(rng.choices([f"w{k}" for k in range(30)], [1 / (k + 1) for k in range(30)], k=rng.randint(0, 25))) for i in range(40)}
    tags = {i: rng.sample(["a", "b", "c", "Books"], rng.randint(0, 3)) for i in texts}
    words = {i: t.split() for i, t in texts.items()}
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    idf = {w: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean, length = sum(idf.values()) / len(idf), sum(map(len, words.values())) / len(words)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in idf.items()}
    docs = spark.createDataFrame(list(texts.items()), "item_id long, text string").repartition(3)
    tagged = spark.createDataFrame([(i, t) for i, ts in tags.items() for t in ts], "item_id long, tag string")
    for filtered in (False, True):
        want = set()
        for q in range(0, 40, 4):
            scores = {}
            for d, x in words.items():
                if set(x) & set(words[q]) and (not filtered or set(tags[q]) & set(tags[d]) - {"Books"}):
                    scores[d] = sum(idf[w] * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / length)) for w in words[q])
            best = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:topn]
            want |= {(q, d, k + 1, round(scores[d], 6)) for k, d in enumerate(best)}
        got = corpus.bm25(docs.where("item_id % 4 = 0"), docs, topn=topn, tags=tagged if filtered else None).collect()
        assert {(r["query_item"], r["doc_item"], r["rank"], round(r["score"], 6)) for r in got} == want


def test_bm25_leaves_blocks_out(spark, monkeypatch):
    """Texts of ten subjects: a query meets fewer than half of the blocks, and the ranking is that of one block."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["abcdefghij"[i % 10] * 3 + chr(97 + k) for k in range(26)], k=40) + rng.choices(["the", "of", "and"], k=5)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").repartition(3)
    whole = {tuple(r)[:2] + (round(r["score"], 6), r["rank"]) for r in corpus.bm25(docs.where("item_id % 9 = 0"), docs, topn=5).collect()}
    monkeypatch.setattr(corpus, "BLOCK", 20)
    found = corpus.bm25_ranking(docs.where("item_id % 9 = 0"), docs, topn=5)
    assert {tuple(r)[:2] + (round(r["score"], 6), r["rank"]) for r in found.rows.collect()} == whole
    assert found.n_blocks >= 20 and found.share_met() < 0.5


def test_bm25_stores_copies_of_a_text_once(spark):
    """Items that share a text share a row of a block, count for each item, and are ranked by their ids; a term in half of all items weighs nothing and still ranks."""
    texts = ["plum jam half", "plum cake half", "rye bread other", "oat bread other"]
    docs = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "item_id long, text string").repartition(3)
    found = corpus.bm25_ranking(docs.where("item_id IN (0, 3)"), docs, topn=12)
    assert [m.count() for m in found.met] == [2, 0] and found.n_blocks <= 4
    stored = corpus.Block(np.arange(3), np.array([0, 2, 3]), corpus.Postings.of(np.array([0, 1]), np.array(["a", "b"], object), np.ones(2)), np.ones(2), None)
    total, touched = corpus.Scorer(stored.weighed(1.5), 2).scores([(np.array([0]), np.array([0.0])), (np.array([1]), np.array([2.0]))])
    assert touched.tolist() == [[True, False], [False, True]] and total[1, 1] == 2.5
    ranks = {q: [r["doc_item"] for r in found.rows.where(F.col("query_item") == q).orderBy("rank").collect()] for q in (0, 3)}
    assert ranks == {0: [*range(0, 40, 4), 1, 5], 3: [*range(3, 40, 4), 2, 6]}


def test_genre_quotas_are_filled(spark):
    """A genre without enough unused items is made up for by the user's other genres, the most frequent first."""
    items = spark.createDataFrame([(i, ["few"] if i < 3 else ["many", "few"] if i < 5 else ["many"]) for i in range(40)], "item_id long, genres array<string>")
    train = spark.createDataFrame([(1, i) for i in (0, 1, 2, 3, 10)] + [(2, i) for i in range(38)], "user_id long, item_id long")
    pos = spark.createDataFrame([(1, 20), (1, 21), (2, 38)], "user_id long, item_id long")
    used = train.unionByName(pos)
    got = negatives.neg_genre_proportional(pos, train, items, used, 4)
    assert got.count() == got.distinct().count() and got.join(used, ["user_id", "item_id"], "left_semi").count() == 0
    assert {r["user_id"]: r["n"] for r in got.groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {1: 8, 2: 1}


def test_most_frequent_is_a_partition(spark):
    df = spark.range(100).select("id", (F.col("id") % 9 + 1).alias("n"))
    head, rest = sample.most_frequent(df, 40, "n")
    assert head.count() <= 40 and head.count() + rest.count() == 100 and head.agg(F.min("n")).first()[0] > rest.agg(F.max("n")).first()[0]


def test_heavy_users_in_jaccard(spark, monkeypatch):
    rows = [(u, i) for u in range(6) for i in range(30) if (u * i) % 4 != 1]
    df = spark.createDataFrame(rows, "user_id long, item_id long")
    want = {tuple(r) for r in similarity.item_jaccard(df).collect()}
    monkeypatch.setattr(similarity, "HEAVY", 7)
    assert {tuple(r) for r in similarity.item_jaccard(df).collect()} == want and len(want) > 300


def test_learned_scores(spark):
    """A factorisation machine and a perceptron tell pairs of like vectors from unlike ones; word vectors put texts of one subject together."""
    rng = random.Random(2)
    kinds = {i: i % 2 for i in range(40)}
    vec = lambda k: [1.0 * k + rng.gauss(0, 0.2), 1.0 * (1 - k) + rng.gauss(0, 0.2)]
    users, items = (spark.createDataFrame([(i, vec(k)) for i, k in kinds.items()], f"{key} long, vec array<double>") for key in ("user_id", "item_id"))
    cand = spark.createDataFrame([(u, i, int(kinds[u] == kinds[i])) for u in range(40) for i in range(40) if (u + i) % 3], "user_id long, item_id long, label int")
    features = models.pair_features(cand, users, items).cache()
    for model in (models.fit_fm(features, 4, 60), models.fit_mlp(features, 4, 8, 60)):
        rows = models.predict(model, features).join(cand, ["user_id", "item_id"]).collect()
        assert sum((r["score"] >= 0.5) == bool(r["label"]) for r in rows) > 0.9 * len(rows)
    words = {0: [f"a{k}" for k in range(12)], 1: [f"b{k}" for k in range(12)]}
    texts = spark.createDataFrame([(i, [rng.choice(words[i % 2]) for _ in range(40)]) for i in range(60)], "k long, tokens array<string>")
    found = {r["k"]: r["vec"] for r in models.text_vectors(texts, 8).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    same, other = ([cos(found[i], found[j]) for i in range(60) for j in range(i) if (i - j) % 2 == odd] for odd in (0, 1))
    assert sum(same) / len(same) > sum(other) / len(other) + 0.1


def test_weighted_sample_prefers_weight(spark):
    df = spark.range(1000).select(F.col("id").alias("user_id"), F.when(F.col("id") < 100, 50.0).otherwise(1.0).alias("w"))
    got = [r["user_id"] for r in sample.weighted_sample(df, 100, F.col("w")).collect()]
    assert len(set(got)) == 100 and sum(u < 100 for u in got) > 60


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in (30, 10, 20, 20, None)], "k long")
    assert {tuple(r) for r in sample.dense_index(df, "k").collect()} == {(10, 0), (20, 1), (30, 2)}


def test_frontier(spark):
    inter = spark.createDataFrame([(u, (u + k * k) % 30) for u in range(40) for k in (1, 2, 3)], "user_id long, item_id long").distinct()
    users, items, rounds = sample.frontier(inter, spark.createDataFrame([(0,)], "user_id long"), 2, 2, 15)
    assert users.count() == 15 and items.count() > 0 and rounds > 1
    assert users.distinct().count() == 15


def test_top_n_and_cover(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "user_id long, vec array<double>")
    items = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(10)], "item_id long, vec array<double>")
    used = spark.createDataFrame([(1, 9)], "user_id long, item_id long")
    got = [(r["user_id"], r["item_id"], r["rank"]) for r in models.top_n(users, items, used, 2).collect()]
    assert sorted(got) == [(1, 7, 2), (1, 8, 1), (2, 0, 1), (2, 1, 2)]
    cover = spark.createDataFrame([(1, 5)], "user_id long, item_id long")
    assert models.top_n(users, items, used, 2, cover=cover).where("user_id = 1").count() == 4


def test_pooling(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0], True), (1, [3.0, 1.0], False), (2, [2.0, 2.0], True)], "k long, vec array<double>, mask boolean")
    assert {r["k"]: r["vec"] for r in similarity.pool_vectors(df, "k").collect()} == {1: [3.0, 5.0], 2: [2.0, 2.0]}
    assert {r["k"]: r["vec"] for r in similarity.masked_mean(df, "k").collect()} == {1: [1.0, 5.0], 2: [2.0, 2.0]}


def test_pooling_equals_plain_loops(spark, monkeypatch):
    """Nulls, vectors of unlike lengths, null keys, empty vectors, and more keys than a task holds."""
    monkeypatch.setattr(similarity, "KEYS", 3)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(8)]), rng.choice([None, [], *([rng.choice([None, rng.uniform(-1, 1)]) for _ in range(n)] for n in (1, 3, 3, 5))])) for _ in range(200)]
    rows += [(99, None), (99, [])]
    df = spark.createDataFrame(rows, "k int, vec array<double>").repartition(4)
    cells = {}
    for k, vec in rows:
        for at, x in enumerate(vec or []):
            cells.setdefault(k, {}).setdefault(at, []).extend([] if x is None else [x])
    for how, of in (("max", max), ("avg", lambda xs: sum(xs) / len(xs))):
        got = {r["k"]: r["vec"] for r in similarity.pool_vectors(df, "k", how=how).collect()}
        assert got.keys() == cells.keys()
        for k, at in cells.items():
            assert got[k] == [pytest.approx(of(at[i])) if at[i] else None for i in range(len(at))]


@pytest.mark.parametrize("few", [1, 50])
@pytest.mark.parametrize("n", [0, 1, 7, 400, 999, 1000, 2000])
def test_smallest_equals_sort_and_limit(spark, monkeypatch, few, n):
    """Draws that lie close together, far apart and on one value."""
    monkeypatch.setattr(sample, "FEW", few)
    monkeypatch.setattr(sample, "PARTS", 8)
    rng = random.Random(n)
    rows = [(i, rng.choice([0.0, 5.0, rng.random(), 1e-9 * rng.random(), 1e9 * rng.random()])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, x double").repartition(5)
    got = sample.smallest(df, n, F.col("x"), F.desc("id"))
    assert got.columns == ["id", "x"]
    assert sorted(r["id"] for r in got.collect()) == sorted(i for i, _ in sorted(rows, key=lambda r: (r[1], -r[0]))[:n])


def test_numbers_in_groups(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["hot", "hot", "a", f"g{i % 7}"]), i * 37 % 500) for i in range(500)]
    got = sample.number_in_groups(spark.createDataFrame(rows, "g string, x long").repartition(6), "g", ["x"]).collect()
    groups = {}
    for g, x in sorted(rows):
        groups.setdefault(g, []).append(x)
    assert sorted((r["g"], r["x"], r["place"], r["total"]) for r in got) == sorted((g, x, i, len(xs)) for g, xs in groups.items() for i, x in enumerate(xs))


def test_margin_loss_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 6), i, int(rng.random() < 0.4), rng.choice([0.1, 0.5, 0.9, rng.random()])) for i in range(200)] + [(9, 1, 1, 0.5), (10, 1, 0, 0.5)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, label int, score double")
    for margin in (0.0, 0.3, 1.0):
        lost = [max(0.0, margin - (a[3] - b[3])) for a in rows for b in rows if a[0] == b[0] and a[2] and not b[2]]
        assert evaluate.losses(df, df, margin).first()["margin_loss"] == pytest.approx(sum(lost) / len(lost))
    assert evaluate.losses(df.where("label = 1"), df).first()["margin_loss"] is None


def test_item_profile_in_parts(spark):
    """Parts put together are the whole profile, none has more than `size` reviews, and an item without reviews has its fields."""
    items = spark.createDataFrame([(1, "Big"), (2, "Small"), (3, "None")], "item_id long, title string")
    users = spark.createDataFrame([(u, f"s{u}") for u in range(50)], "user_id long, segment string")
    inter = spark.createDataFrame([(u, 1, u % 5 + 1, f"r{u}") for u in range(50)] + [(0, 2, 3, "one"), (1, 9, 3, "no item")], "user_id long, item_id long, rating int, review string")
    whole = {r["item_id"]: r["text"] for r in profiles.item_profile(items, inter, users, ["title"], ["segment"], ["review"]).collect()}
    parts = profiles.item_profile_parts(items, inter, users, ["title"], ["segment"], ["review"], size=8).orderBy("item_id", "part").collect()
    assert [(r["item_id"], r["part"]) for r in parts] == [(1, k) for k in range(7)] + [(2, 0), (3, 0)]
    for i, text in whole.items():
        assert ". ".join(r["text"] for r in parts if r["item_id"] == i) == text
    assert all(r["text"].count(". r") <= 8 for r in parts)


def test_top_n_leaves_short_vectors_out(spark, monkeypatch):
    """Blocks in order of length: users meet fewer than half of them, and the lists are those of all products."""
    monkeypatch.setattr(models, "BLOCK", 20)
    monkeypatch.setattr(models, "USERS", 7)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 4)) * np.exp(-np.arange(400) / 60)[:, None]
    people = rng.normal(size=(30, 4))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "item_id long, vec array<double>").repartition(3)
    users = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(people)] + [(99, [0.0] * 4)], "user_id long, vec array<double>")
    used = spark.createDataFrame([(u, int(i)) for u in range(30) for i in rng.permutation(60)[: u % 9]] + [(3, 399)], "user_id long, item_id long")
    gone = {tuple(r) for r in used.collect()}
    found = models.top_n_ranking(users, items, used, 5)
    got = {(r["user_id"], r["rank"]): r["item_id"] for r in found.rows.collect()}
    for u, v in enumerate(people):
        best = sorted((i for i in range(400) if (u, i) not in gone), key=lambda i: (-round(float(vectors[i] @ v), 9), i))[:5]
        assert [got[u, k + 1] for k in range(5)] == best
    assert [got[99, k + 1] for k in range(5)] == list(range(5))
    assert found.n_blocks == 20 and found.share_met() < 0.5


def test_ngram_idf(spark):
    counts = tables.parse_ngram_counts(spark.createDataFrame([("Cat\t1990,5,3\t2010,9,4",), ("cat\t2010,1,10",), ("c4t\t2010,1,1",)], "value string"))
    got = lambda fold, year=None: {r["term"]: r["df"] for r in corpus.ngram_idf(counts, 100, year, fold=fold).collect()}
    assert got("max") == {"cat": 10} and got("sum") == {"cat": 17} and got("sum", 2000) == {"cat": 14}


def test_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"predicted": {"u_1": {"i-1": 0.5, "i2": 1}}}')
    (tmp_path / "bare.json").write_text('{"u_1": {"i-1": 0.5}}')
    (tmp_path / "limit.json").write_text('{"u-1": ["a", "b"]}')
    (tmp_path / "neg.csv").write_text("user_id,item_id,label,ref_item\nu,a,0,b\n")
    (tmp_path / "prof.csv").write_text('user_id,text\nu,"two\nlines, ""q"""\nv,\n')
    (tmp_path / "dup.csv").write_text("user_id,text\nu,x\nu,y\n")
    assert {tuple(r) for r in tables.read_predictions(spark, str(tmp_path / "p.json"), lines=False).collect()} == {("u_1", "i-1", 0.5), ("u_1", "i2", 1.0)}
    assert [tuple(r) for r in tables.read_predictions(spark, str(tmp_path / "bare.json"), lines=False).collect()] == [("u_1", "i-1", 0.5)]
    assert {tuple(r) for r in tables.read_limit_list(spark, str(tmp_path / "limit.json"), lines=False).collect()} == {("u-1", "a"), ("u-1", "b")}
    assert tables.read_negatives(spark, str(tmp_path / "neg.csv")).first()["label"] == 0
    assert {r["user_id"]: r["text"] for r in tables.read_profiles(spark, str(tmp_path / "prof.csv"), "user_id").collect()} == {"u": 'two\nlines, "q"', "v": ""}
    with pytest.raises(ValueError):
        tables.read_profiles(spark, str(tmp_path / "dup.csv"), "user_id")


def test_predictions_round_trip(spark, tmp_path):
    pred = spark.createDataFrame([("u_1", "i-1", 0.5), ("u_1", "i2", -1.0), ("v", "i-1", 2.0)], "user_id string, item_id string, score double")
    tables.write_predictions(pred, str(tmp_path / "p"))
    assert sorted(map(tuple, tables.read_predictions(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, pred.collect()))
    (tmp_path / "bad.json").write_text('{"user_id": "u", "scores"')
    for read in (tables.read_predictions, tables.read_limit_list):
        for lines in (True, False):
            with pytest.raises(Exception, match="no sound JSON"):
                read(spark, str(tmp_path / "bad.json"), lines).collect()


def test_sales_rank_fills_one_field(spark):
    from recdata.functions.scalar import parse_sales_rank

    texts = ["1,234 in Books (See Top 100)", "['>#5 Paid in Kindle Store", "12 Free in Kindle Store", "#77 in Toys", "Top 100 sellers", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", parse_sales_rank(F.col("t")).alias("r")).orderBy("k").collect()
    inf = float("inf")
    assert [tuple(r["r"]) for r in rows] == [(1234.0, inf, inf, inf), (inf, 5.0, inf, inf), (inf, inf, 12.0, inf), (inf, inf, inf, 77.0), (inf,) * 4, (inf,) * 4]


def test_ingest(spark):
    reviews = spark.createDataFrame([("u", "p", "N", "t\ta", "s", 5.0, 2), ("u", "p", "N", "old", "s", 1.0, 1), ("v", "q", None, None, None, 3.0, 1)], "reviewerID string, asin string, reviewerName string, reviewText string, summary string, overall double, unixReviewTime long")
    meta = spark.createDataFrame([("p", "T"), ("p", "T2"), ("q", "x getTime y"), ("z", "unused")], "asin string, title string")
    inter, items, users = tables.ingest_product_reviews(reviews, meta)
    assert {(r["user_id"], r["item_id"], r["rating"], r["review"]) for r in inter.collect()} == {("u", "p", 5, "t a"), ("v", "q", 3, "")}
    assert [(r["item_id"], r["title"]) for r in items.collect()] == [("p", "T")] and users.count() == 2
    books = spark.createDataFrame([("b", "T", "d", [(" 2",), ("1",)])], "book_id string, title string, description string, authors array<struct<author_id:string>>")
    genres = spark.createDataFrame([("b", {"a, b": 3})], "book_id string, genres map<string,bigint>")
    raw = spark.createDataFrame([("u", "b", 4, "text", "now")], "user_id string, book_id string, rating int, review_text string, date_added string")
    _, book_items, _ = tables.ingest_book_reviews(raw, books, genres)
    row = book_items.first()
    assert row["author"] == "1,2" and row["genres"] == ["a  b"]


def test_write_and_limit(spark, inter, tmp_path):
    splits = split.split_ratio(inter)
    tables.write_dataset(splits, inter.select("user_id").distinct(), inter.select("item_id").distinct(), str(tmp_path / "d"))
    tables.write_dataset(splits.limit(0), inter.select("user_id").limit(0), inter.select("item_id").limit(0), str(tmp_path / "d"), mode="ignore")
    assert spark.read.parquet(str(tmp_path / "d/interactions")).count() == inter.count()
    kept, removed = filters.limit_pairs(inter, split.limit_per_user(inter, 2).select("user_id", "item_id"))
    assert kept.count() == 7 and removed.count() == 14


def test_texts_by_reference_are_tokenised_once(spark):
    """Far more rows than texts: the reference gives the users that the texts themselves give, without a text in the joined rows."""
    texts = spark.createDataFrame([(0, "a b c"), (1, "d."), (2, None)], "doc_id long, review string")
    rows = spark.range(60).selectExpr("id % 7 AS user_id", "id AS item_id", "id % 4 AS doc_id")
    named = filters.users_with_min_tokens(rows, "review", 13, texts)
    whole = filters.users_with_min_tokens(rows.join(texts, "doc_id"), "review", 13)
    assert 0 < named.count() < 7 and sorted(named.collect()) == sorted(whole.collect())


def test_reviews_are_cleaned_by_reference(spark):
    """Places and classes of texts give what the texts themselves give: copies under other ids, ties of length, blank and null texts."""
    words = ["aa", "ab", "b", "", None, "  ", "ab", "éé", "zzz", "a" * 40 + "x", "a" * 40 + "y"]
    texts = spark.createDataFrame(list(enumerate(words)), "doc_id long, review string")
    rng = random.Random(5)
    rows = spark.createDataFrame([(rng.randrange(12), i, rng.randrange(3), rng.randrange(len(words))) for i in range(400)], "user_id long, item_id long, rating int, doc_id long")
    whole = rows.join(texts, "doc_id")
    items = spark.createDataFrame([(i, "xy"[i % 2], i % 3) for i in range(400)], "item_id long, author string, avg_rating int")
    key = ["user_id", "item_id", "rating"]
    assert sorted(clean.clean_same_review(rows, items, texts).select(key).collect()) == sorted(clean.clean_same_review(whole, items).select(key).collect())
    mapping = spark.createDataFrame([(i, i % 9) for i in range(9, 400)], "item_id long, canonical long")
    named = clean.apply_mapping(rows.join(clean.text_places(texts), "doc_id"), mapping, "place").join(texts, "doc_id")
    told = [sorted(map(str, df.select(*key, "review").collect())) for df in (named, clean.apply_mapping(whole, mapping))]
    assert told[0] == told[1]


def test_profiles_move_a_text_once(spark):
    """Profiles from references equal those from texts, and join the texts last."""
    rng = random.Random(3)
    texts = spark.createDataFrame([(i, f"Text {i}. It isn't long.") for i in range(9)], "doc_id long, review string")
    rows = spark.createDataFrame([(u, i, rng.choice([None, 1, 4, 5]), rng.randrange(10)) for u in range(6) for i in range(40) if rng.random() < 0.6], "user_id long, item_id long, rating int, doc_id long")
    items = spark.createDataFrame([(i, f"t{i}") for i in range(42)], "item_id long, title string")
    users = spark.createDataFrame([(u, "s") for u in range(7)], "user_id long, segment string")
    whole = rows.join(texts, "doc_id")
    for make in (
        lambda r, **k: profiles.user_profile(r, items, users, ["title"], ["review"], ["segment"], least=4, **k),
        lambda r, **k: profiles.item_profile(items, r, users, ["title"], ["segment"], ["review"], **k),
        lambda r, **k: profiles.item_profile_parts(items, r, users, ["title"], ["segment"], ["review"], size=2, **k),
    ):
        assert sorted(make(rows, texts=texts).collect()) == sorted(make(whole).collect())


def test_all_negatives_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 4)
    rng = random.Random(8)
    used = {(u, i) for u in range(7) for i in range(23) if rng.random() < 0.4}
    used |= {(1, i) for i in range(23)}
    rows = spark.createDataFrame(sorted(used), "user_id long, item_id long")
    got = negatives.neg_all(rows.where("user_id <> 5"), rows.select("item_id"), rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan  # the pairs of users and items are never joined
    assert sorted((r["user_id"], r["item_id"]) for r in got.collect()) == sorted((u, i) for u in range(7) for i in {i for _, i in used} if u != 5 and (u, i) not in used)


def test_jaccard_moves_no_pair(spark):
    """No join above the counts of pairs: sizes travel with the lists."""
    rows = spark.createDataFrame([(u, i) for u in range(5) for i in range(u, 9)], "user_id long, item_id long")
    got = similarity.item_jaccard(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, line in enumerate(plan) if "Aggregate" in line) < next(i for i, line in enumerate(plan) if "Join" in line)
    sets = {i: {u for u in range(5) if i >= u} for i in range(9)}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert {(r["item_a"], r["item_b"]): r["sim"] for r in got.collect()} == pytest.approx(want)


def test_word_vectors_are_learned_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "LEARNED", 100)
    seen = []
    made = models.Word2Vec
    monkeypatch.setattr(models, "Word2Vec", lambda **k: seen.append(k) or made(**k))
    rows = [(k, [f"{'ab'[k % 2]}{(k * j) % 7}" for j in range(10)]) for k in range(60)]
    got = models.text_vectors(spark.createDataFrame(rows, "doc_id long, tokens array<string>"), 4).collect()
    assert seen[0]["numPartitions"] == 6
    assert len(got) == 60 and all(len(r["vec"]) == 4 and all(map(math.isfinite, r["vec"])) for r in got)


def test_first_draws_do_for_nearly_all(spark, monkeypatch):
    """A few draws more than asked for are stored, not all; whoever needs more gets them, and the same negatives result."""
    stored = []
    made = negatives.materialize
    monkeypatch.setattr(negatives, "materialize", lambda df, name: stored.append((name, kept := made(df, name))) or kept)
    items = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["b"]) for i in range(200)], "item_id long, genres array<string>")
    pos = spark.createDataFrame([(u, u) for u in range(20)] + [(99, i) for i in range(5)], "user_id long, item_id long")
    used = pos.unionByName(spark.createDataFrame([(99, i) for i in range(5, 150)], "user_id long, item_id long"))
    uniform = negatives.neg_uniform(pos, used, items, 4)
    counts = {u: n for u, n in uniform.groupBy("user_id").count().collect()}
    assert counts == {**dict.fromkeys(range(20), 4), 99: 20}
    late = {r["user_id"] for name, df in stored if name == "late" for r in df.collect()}
    assert 99 in late and len(late) < 10
    stored.clear()
    genre = negatives.neg_genre(pos, items, used, 4)
    late, turns = next(df.count() for name, df in stored if name == "late"), next(df.count() for name, df in stored if name == "turns")
    assert 0 < late < turns / 2
    monkeypatch.setattr(negatives, "TOLD", 0)
    assert sorted(map(tuple, uniform.collect())) == sorted(map(tuple, negatives.neg_uniform(pos, used, items, 4).collect()))
    assert sorted(map(tuple, genre.collect())) == sorted(map(tuple, negatives.neg_genre(pos, items, used, 4).collect()))


def test_draws_are_never_sent_to_all_tasks(spark, monkeypatch):
    # Spark takes the draws of a user for one row, so it would broadcast millions
    plans, keep = {}, negatives.materialize
    monkeypatch.setattr(negatives, "TOLD", 0)
    monkeypatch.setattr(negatives, "materialize", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString()), keep(df, name))[1])
    pos = spark.createDataFrame([(u, u % 7) for u in range(9)], "user_id long, item_id long")
    items = spark.range(40).select(F.col("id").alias("item_id"))
    assert negatives.neg_uniform(pos, pos, items, 3).count() == 27
    assert "Generate posexplode" in plans["drawn"] and "Broadcast" not in plans["drawn"]
    catalogue = items.withColumn("genres", F.array(F.lit("a"), (F.col("item_id") % 3).cast("string")))
    assert negatives.neg_genre(pos, catalogue, pos, 2).count() == 18
    joins = [line for line in plans["enough"].split("\n") if "Join [at#" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]


def test_top_n_keeps_few_rows_in_a_task(spark, monkeypatch):
    """Items of one vector fill a list by themselves; users who may get all items are dealt over more copies of a block."""
    counts, keep = {}, models.materialize
    monkeypatch.setattr(models, "ROWS", 100)

    def kept(df, name):
        stored = keep(df, name)
        if name == "scored":
            counts[name] = stored.count()
        if name == "copies" and "at" in stored.columns:
            counts[name] = stored.first()["copies"]
        return stored

    monkeypatch.setattr(models, "materialize", kept)
    items = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(60)], "item_id long, vec array<double>")
    users = spark.createDataFrame([(u, [1.0, 1.0 + u]) for u in range(20)], "user_id long, vec array<double>")
    used = spark.createDataFrame([(4, 2)], "user_id long, item_id long")
    best = [2, 5, 8, 11]
    found = {(r["user_id"], r["rank"]): r["item_id"] for r in models.top_n(users, items, used, 4).collect()}
    assert all([found[u, k + 1] for k in range(4)] == ([5, 8, 11, 14] if u == 4 else best) for u in range(20))
    assert counts == {"scored": 80, "copies": 1}
    cover = spark.createDataFrame([(u, 57) for u in range(20)], "user_id long, item_id long")
    whole = models.top_n(users, items, used, 4, cover=cover)
    assert whole.where("user_id = 4").count() == 59 and whole.where("user_id = 0").count() == 60
    assert counts == {"scored": 20 * 60 - 1, "copies": 12}


def test_bm25_asks_for_a_text_once(spark, monkeypatch):
    """Queries with one text are counted, weighed and, without tags, searched once; rows of a search are no more than a ranking has."""
    counts, keep = {}, corpus.materialize
    monkeypatch.setattr(corpus, "materialize", lambda df, name: (stored := keep(df, name), counts.update({name: stored.count()}))[0])
    texts = ["plum jam half", "plum cake half", "rye bread other", "oat bread other"]
    docs = spark.createDataFrame([(i, texts[i % 4]) for i in range(80)], "item_id long, text string").repartition(3)
    rows = corpus.bm25(docs.where("item_id % 2 = 0"), docs, topn=6).collect()
    assert {(q, d) for q, d, *_ in rows} == {(q, q % 4 + 4 * k) for q in range(0, 80, 2) for k in range(6)}
    assert counts["asked"] == counts["weighted"] == 2 and counts["first"] == 12
    tags = spark.createDataFrame([(i, f"t{i % 5}") for i in range(80)], "item_id long, tag string")
    tagged = corpus.bm25(docs.where("item_id % 2 = 0"), docs, topn=3, tags=tags).collect()
    # of one tag and one text are an item and every twentieth after it
    assert {(q, d) for q, d, _, rank in tagged} == {(q, q % 20 + 20 * k) for q in range(0, 80, 2) for k in range(3)}
    assert counts["asked"] == 2 and counts["weighted"] == 40
