"""Pairs of users and items that meet vectors in blocks, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recdata.operators import factors, learners, models, profiles, similarity

VECTORS = "array<double>"


def tables(spark, n_users=30, n_items=25, width=3, seed=0):
    """Vectors that several ids share, null ones, ones with a null and ones of another width; and all pairs with a label."""
    rng = random.Random(seed)
    some = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(7)] + [None, [1.0, None, 2.0], [0.5]]
    users = {u: some[u % len(some)] for u in range(n_users)}
    items = {i: some[i * 3 % len(some)] for i in range(n_items)}
    pairs = [(u, i) for u in range(n_users + 2) for i in range(n_items + 2) if rng.random() < 0.5]
    return users, items, pairs, spark.createDataFrame(list(users.items()), f"user_id long, vec {VECTORS}"), spark.createDataFrame(list(items.items()), f"item_id long, vec {VECTORS}"), spark.createDataFrame(pairs, "user_id long, item_id long").repartition(3)


def product(a, b):
    return None if a is None or b is None or len(a) != len(b) or None in a or None in b else math.fsum(x * y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("block", "least"), [(1 << 26, 1 << 16), (48, 5)])
def test_pairs_meet_vectors_in_blocks(spark, monkeypatch, block, least):
    """Scores with biases and vectors of each id's own behind the shared ones, in one block and in many blocks and copies."""
    monkeypatch.setattr(similarity, "BYTES", block)
    monkeypatch.setattr(models, "PAIRS", least)
    monkeypatch.setattr(models, "EACH", 1)
    users, items, pairs, user_vectors, item_vectors, cand = tables(spark)
    behind = spark.createDataFrame([(u, [u / 10]) for u in users], f"user_id long, vec {VECTORS}"), spark.createDataFrame([(i, [i / 7]) for i in items if i != 4], f"item_id long, vec {VECTORS}")
    bias = spark.createDataFrame([(i, i / 3) for i in items if i % 2], "item_id long, bias double")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in models.score_pairs(cand, user_vectors, item_vectors, item_bias=bias, bias=0.25, behind=behind).collect()}
    plain = {(u, i): product(users[u], items[i]) for u, i in pairs if u in users and i in items}
    assert got.keys() == {(u, i) for u, i in plain if i != 4}
    for (u, i), score in got.items():
        want = None if plain[u, i] is None else plain[u, i] + u / 10 * i / 7 + 0.25 + (i / 3 if i % 2 else 0)
        assert score is None if want is None else score == pytest.approx(want)
    assert len(models.score_pairs(cand, user_vectors, item_vectors).collect()) == len(plain)


@pytest.mark.parametrize("cover", [False, True])
def test_users_and_items_that_share_vectors_are_one(spark, monkeypatch, cover):
    """Lists are those of all products, with ties, used items and ids without a vector; what is multiplied is distinct vectors."""
    monkeypatch.setattr(models, "BLOCK", 2)
    users, items, _, user_vectors, item_vectors, _ = tables(spark, seed=3)
    users, items = ({k: v for k, v in t.items() if v is None or len(v) == 3} for t in (users, items))
    user_vectors, item_vectors = (t.where("vec IS NULL OR size(vec) = 3") for t in (user_vectors, item_vectors))
    user_vectors = user_vectors.unionByName(spark.createDataFrame([(90, [0.1, 0.2, -0.3])], user_vectors.schema))  # one that has a vector for itself
    users[90] = [0.1, 0.2, -0.3]
    rng = random.Random(5)
    gone = {(u, i) for u in users for i in items if rng.random() < u % 4 / 6}
    asked = {(u, i) for u in users for i in items if (u, i) not in gone and rng.random() < 0.1} if cover else set()
    used = spark.createDataFrame(sorted(gone), "user_id long, item_id long")
    covered = spark.createDataFrame(sorted(asked), "user_id long, item_id long") if cover else None
    found = models.top_n_ranking(user_vectors, item_vectors, used, 4, covered)
    got = {}
    for r in found.rows.orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    for u, v in users.items():
        scored = {i: product(v, x) for i, x in items.items() if (u, i) not in gone and product(v, x) is not None}
        best = sorted(scored, key=lambda i: (-round(scored[i], 9), i))
        last = max([4] + [best.index(i) + 1 for a, i in asked if a == u and i in scored])
        assert got.get(u, []) == best[:last]
    assert found.n_users == 8 and sum(p.count() for p in found.met) <= 8 * found.n_blocks


def test_user_item_jaccard_is_the_mean_over_all_items(spark, monkeypatch):
    """Also for items and users that training does not have, a candidate among the user's own items, and users with several lists."""
    monkeypatch.setattr(similarity, "HEAVY", 4)
    rng = random.Random(2)
    train = sorted({(rng.randrange(12), int(15 * rng.random() ** 2)) for _ in range(90)})
    cand = sorted({(rng.randrange(14), rng.randrange(18)) for _ in range(40)})
    schema = "user_id long, item_id long"
    asked, known = spark.createDataFrame(cand + cand[:3], schema), spark.createDataFrame(train + train[:5], schema)
    got = {(r["user_id"], r["item_id"]): r["sim"] for r in similarity.user_item_jaccard(asked, known).collect()}
    users = {i: {u for u, x in train if x == i} for i in range(18)}
    want = {}
    for u, i in cand:
        sims = [len(users[i] & users[j]) / len(users[i] | users[j]) for v, j in train if v == u and j != i]
        if sims:
            want[u, i] = sum(sims) / len(sims)
    assert got == pytest.approx(want)


def test_sentences_match_vectors_chosen_by_number(spark, monkeypatch):
    """As with the vectors joined to sentences, in one block and in many; vectors that are null, zero, short or missing."""
    texts = spark.createDataFrame([(d, " ".join(f"Word{d} number {k} here." for k in range(d + 2))) for d in range(4)] + [(4, ""), (5, None)], "doc_id long, review string")
    inter = spark.createDataFrame([(u, i, 1 + (u + i) % 5, (u * 3 + i) % 6) for u in range(6) for i in range(7) if (u * i) % 4 != 1], "user_id long, item_id long, rating int, doc_id long")
    rng = random.Random(4)
    vectors = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(8)] + [(8, None), (9, [0.0] * 3), (10, [1.0]), (11, [1.0, None, 0.0])], f"vec_id long, vec {VECTORS}")
    items = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(5)] + [(5, None)], f"item_id long, vec {VECTORS}")
    choose = lambda pos: (F.col("user_id") * 5 + F.col("item_id") + pos) % 13
    rows = inter.join(texts, "doc_id").select("user_id", "item_id", "rating", F.posexplode(profiles.sentences(F.col("review"))).alias("pos", "sentence"))
    want = {r["user_id"]: r["text"] for r in profiles.match_vectors(rows.withColumn("vec_id", choose(F.col("pos"))).join(vectors, "vec_id"), items).collect()}
    for block in (1 << 27, 100):
        monkeypatch.setattr(profiles, "BYTES", block)
        assert {r["user_id"]: r["text"] for r in profiles.match_chosen(inter, texts, vectors, items, choose).collect()} == want


def test_sentences_match_an_items_text(spark, monkeypatch):
    """Against a loop over all reviews, also with texts and items that have no known term or are missing."""
    docs = {0: "The cat sat. A dog ran home. The cat ran.", 1: "A fish swam. The dog sat here.", 2: "", 3: None, 4: "Unknown words only. More unknown things."}
    bodies = {0: "cat sat cat", 1: "dog home", 2: "cat sat cat", 3: "nothing known", 4: ""}
    idf = {"cat": 1.5, "dog": 1.1, "sat": 0.7, "ran": 0.4, "home": 2.0, "the": 0.1, "fish": 2.5}
    inter = [(u, i, 4 + (u + i) % 2, (u + 2 * i) % 6) for u in range(5) for i in range(6)]
    reviews = {d: [] if t is None else [s if s.endswith(".") else s + "." for s in t.split(". ") if s] for d, t in docs.items()}
    want = {}
    for user in range(5):
        rows = []
        for u, i, rating, d in inter:
            if u != user or not reviews.get(d):
                continue
            v = {t: bodies.get(i, "").split().count(t) * idf[t] for t in bodies.get(i, "").split() if t in idf}
            likes = []
            for pos, sentence in enumerate(reviews[d]):
                words = sentence.lower().rstrip(".").split()
                w = {t: words.count(t) * idf[t] for t in words if t in idf}
                norm = math.sqrt(sum(x * x for x in w.values()) * sum(x * x for x in v.values()))
                likes.append((-round(sum(w[t] * v.get(t, 0) for t in w) / norm, 9) if norm else 0, pos, sentence))
            rows += [(turn, -rating, i, s) for turn, (_, _, s) in enumerate(sorted(likes))]
        if rows:
            want[user] = " ".join(s for *_, s in sorted(rows))
    frames = spark.createDataFrame(inter, "user_id long, item_id long, rating int, doc_id long"), spark.createDataFrame(list(docs.items()), "doc_id long, review string"), spark.createDataFrame(list(bodies.items()), "item_id long, text string"), spark.createDataFrame([(t, 1, x) for t, x in idf.items()], "term string, df long, idf double")
    for block in (1 << 27, 60):
        monkeypatch.setattr(profiles, "BYTES", block)
        assert {r["user_id"]: r["text"] for r in profiles.match_sentences(*frames).collect()} == want


def test_learners_agree_with_those_on_features(spark, monkeypatch):
    """In one block and in many: the same probabilities as Spark ML's learners give on features of each pair."""
    rng = np.random.default_rng(3)
    users = spark.createDataFrame([(u, rng.normal(size=2).tolist()) for u in range(10)], f"user_id long, vec {VECTORS}")
    items = spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(10)], f"item_id long, vec {VECTORS}")
    pairs = spark.createDataFrame([(u, i, int(rng.random() < (0.2, 0.8)[(u + i) % 2])) for u in range(10) for i in range(10)], "user_id long, item_id long, label int").coalesce(1)
    features = models.pair_features(pairs, users, items).coalesce(1).cache()
    plain = [{(r["user_id"], r["item_id"]): r["score"] for r in models.predict(m, features).collect()} for m in (models.fit_fm(features, 3, 6), models.fit_mlp(features, 4, 5, 5))]
    for block, least in ((1 << 26, 1 << 16), (48, 9)):
        monkeypatch.setattr(similarity, "BYTES", block)
        monkeypatch.setattr(models, "PAIRS", least)
        monkeypatch.setattr(models, "EACH", 1)
        for fit, size, turns, want in ((learners.fit_fm, 3, 6, plain[0]), (learners.fit_mlp, 5, 5, plain[1])):
            if block == 48 and fit is learners.fit_mlp:
                turns = 1  # many short jobs
                want = None
            got = {(r["user_id"], r["item_id"]): r["score"] for r in fit(pairs, users, items, size, turns).predict(pairs, users, items).collect()}
            assert len(got) == 100 and (want is None or got == pytest.approx(want, abs=2e-3))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(5, 3)), rng.normal(size=(4, 3))
    u, i, y = rng.integers(0, 5, 30), rng.integers(0, 4, 30), rng.integers(0, 2, 30).astype(float)
    for gradient, n in ((learners._fm_gradient, 6 * 2 + 6 + 1), (learners._mlp_gradient, 6 * 4 + 4 + 8 + 2)):
        w = rng.normal(size=n) / 2
        told = gradient(a, b, u, i, y, w)[1]
        for k in range(n):
            step = np.eye(n)[k] * 1e-6
            assert told[k] == pytest.approx((gradient(a, b, u, i, y, w + step)[0] - gradient(a, b, u, i, y, w - step)[0]) / 2e-6, rel=1e-4, abs=1e-5)
