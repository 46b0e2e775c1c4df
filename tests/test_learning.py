"""Factorisation, model selection, abbreviations, hot terms and JSON objects against plain versions."""

import json
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recdata.functions.scalar import hash_key
from recdata.operators import corpus, factors, models, negatives, profiles, similarity
from recdata.sources import scratch, tables


def planted(seed=0, users=40, items=30):
    """Pairs whose label follows from two hidden features and how popular an item is."""
    rng = np.random.default_rng(seed)
    a, b, bias = rng.normal(size=(users, 2)), rng.normal(size=(items, 2)), rng.normal(size=items)
    return [(u, i, int(1.5 * a[u] @ b[i] + bias[i] > 0)) for u in range(users) for i in range(items)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long, label int").repartition(3)


def auc(scores, labels):
    pairs = [(x > y) + (x == y) / 2 for x, p in zip(scores, labels, strict=True) if p for y, q in zip(scores, labels, strict=True) if not q]
    return sum(pairs) / len(pairs)


@pytest.mark.parametrize("biases", [(False, False), (True, True)])
def test_factors_equal_a_plain_loop(spark, biases):
    """Three blocks and two rounds, against one loop over the strata, a pair at a time."""
    rows, d, rank, rate, reg = planted(1, 15, 12)[::2] + [(99, 3, 1), (3, 99, 0)], 3, 4, 0.1, 0.02
    df = frame(spark, rows)
    model = factors.fit_factors(df, rank=rank, rounds=2, rate=rate, reg=reg, user_bias=biases[0], item_bias=biases[1], blocks=d, batch=1)
    state = {}
    for kind, name in ((0, "user_id"), (1, "item_id")):
        for r in factors.initial(df.select(F.col(name).alias("id")).distinct(), kind, rank, 42, d).collect():
            state[kind, r["id"]] = [r["block"], np.array(r["vec"]), 0.0]
    drawn = df.select("*", *(F.xxhash64(F.lit(42), F.lit(t), "user_id", "item_id").alias(f"d{t}") for t in range(2))).collect()
    for turn in range(2):
        for s in range(d):
            for r in sorted(drawn, key=lambda r: (state[0, r["user_id"]][0], r[f"d{turn}"])):
                u, i = state[0, r["user_id"]], state[1, r["item_id"]]
                if (i[0] - u[0]) % d != s:
                    continue
                off = 1 / (1 + math.exp(-(u[1] @ i[1] + u[2] + i[2]))) - r["label"]
                u[1], i[1] = u[1] - rate * (off * i[1] + reg * u[1]), i[1] - rate * (off * u[1] + reg * i[1])
                u[2] -= rate * off * biases[0]
                i[2] -= rate * off * biases[1]
    for kind, table, name in ((0, model.users, "user_id"), (1, model.items, "item_id")):
        got = {r[name]: (r["vec"], r["bias"]) for r in table.collect()}
        assert got.keys() == {k for t, k in state if t == kind}
        for k, (vec, bias) in got.items():
            assert vec == pytest.approx(state[kind, k][1]) and bias == pytest.approx(state[kind, k][2])


def test_factors_learn_what_was_planted(spark):
    """Pairs held out are ranked far better than by chance, with a smaller log loss than the base rate's and than that of weighted least squares."""
    rows = planted()
    random.Random(1).shuffle(rows)
    train, test = frame(spark, rows[:900]), frame(spark, rows[900:])
    model = factors.fit_factors(train, rank=4, rounds=8, rate=0.1, reg=0.01, item_bias=True, user_bias=True, validation=test, patience=2, blocks=2, batch=8)
    told = factors.predict_pairs(model, test).join(test, ["user_id", "item_id"]).collect()
    labels = [r["label"] for r in told]
    base = sum(labels) / len(labels)
    assert auc([r["score"] for r in told], labels) > 0.85
    assert min(model.losses) < 0.8 * -(base * math.log(base) + (1 - base) * math.log(1 - base))
    users, items = models.als_vectors(models.fit_als(train.where("label = 1").withColumn("rating", F.lit(1)), rank=4))
    least_squares = models.score_pairs(test, users, items).join(test, ["user_id", "item_id"]).collect()
    clipped = [(min(max(r["score"], 1e-12), 1 - 1e-12), r["label"]) for r in least_squares]
    assert min(model.losses) < -sum(math.log(p) if y else math.log(1 - p) for p, y in clipped) / len(clipped)


def test_fitting_stops_early_and_keeps_the_best(spark):
    rows = planted(2)
    train = frame(spark, rows[::2])
    noise = frame(spark, [(u, i, 1 - y) for u, i, y in rows[::2]])  # gets worse from the first round on
    model = factors.fit_factors(train, rank=2, rounds=9, rate=0.2, validation=noise, patience=2, blocks=1)
    assert len(model.losses) == 3 and model.losses[0] == min(model.losses)
    assert factors.log_loss(noise, *(t.select(k, "vec", "bias") for t, k in ((model.users, "user_id"), (model.items, "item_id")))) == pytest.approx(model.losses[0])


def test_halving_finds_the_full_loops_winner(spark):
    users = spark.range(200).withColumnRenamed("id", "user_id")
    quality, asked = [0.1, 0.9, 0.4, 0.8, 0.2], []

    def fit(candidates, some):
        asked.append(([c["candidate"] for c in candidates], some.count()))
        tried = F.explode(F.array(*(F.struct(F.lit(c["candidate"]).alias("candidate"), F.lit(c["q"]).alias("q")) for c in candidates))).alias("c")
        return some.select("user_id", tried).select("user_id", "c.*")

    best, told = models.select_by_halving([{"q": q} for q in quality], fit, lambda pred: pred.groupBy("candidate").agg(F.avg("q").alias("metric")), users)
    assert best == {"q": 0.9} and [sorted(t["metrics"]) for t in told] == [[0, 1, 2, 3, 4], [1, 2, 3], [1, 3]]
    assert [len(c) for c, _ in asked] == [5, 3, 2] and asked[0][1] < asked[1][1] < asked[2][1] == 200


TEXT = "Dr. Smith met Mr. Jones at 5 p.m. yesterday. They spoke with Dr. Brown, e.g. about z.B. tests. Was it good? Mr. Jones said so. The test was long. "


def test_abbreviations_are_learned_and_spared(spark):
    others = ["We spoke of tests and of what was good yesterday.", "They said so, and it was long so far.", "Tests are good. So they met Brown and Jones and Smith.", "Good tests met long tests about it."] * 4
    docs = spark.createDataFrame([(k, TEXT) for k in range(6)] + list(enumerate(others, 10)) + [(90, None), (91, "")], "doc_id long, text string").repartition(3)
    found = {r["term"]: r for r in corpus.abbreviations(docs).collect()}
    assert {"dr", "mr", "e.g", "z.b", "p.m"} <= set(found) and not {"yesterday", "tests", "so", "long"} & set(found)
    assert found["dr"]["with_stop"] == 12 and found["dr"]["without"] == 0
    got = [r["sentence"] for r in corpus.split_sentences(docs.where("doc_id = 0"), corpus.abbreviations(docs)).orderBy("pos").collect()]
    assert got == ["Dr. Smith met Mr. Jones at 5 p.m. yesterday.", "They spoke with Dr. Brown, e.g. about z.B. tests.", "Was it good?", "Mr. Jones said so.", "The test was long."]
    assert corpus.split_sentences(docs.where("doc_id >= 90"), corpus.abbreviations(docs)).count() == 0


def test_long_lists_of_abbreviations_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(0, TEXT)], "doc_id long, text string")
    listed = spark.createDataFrame([("dr",), ("mr",)], "term string")
    whole = corpus.split_sentences(docs, listed).orderBy("pos").collect()
    monkeypatch.setattr(corpus, "SHORT_LIST", 1)
    assert corpus.split_sentences(docs, listed).orderBy("pos").collect() == whole and len(whole) > 5


def test_sentences_match_by_given_vectors(spark):
    """The most alike sentence of each item first, items in turn, the better rated first; missing vectors count as unlike."""
    rows = [(1, 7, 5, 0, "far", [0.0, 1.0]), (1, 7, 5, 1, "near", [1.0, 0.1]), (1, 8, 4, 0, "none", None), (1, 8, 4, 1, "some", [1.0, 1.0]), (1, 9, 5, 0, "alone", [1.0, 0.0]), (2, 7, 1, 0, "other", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating int, pos int, sentence string, vec array<double>")
    items = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 2.0])], "item_id long, vec array<double>")
    assert {r["user_id"]: r["text"] for r in profiles.match_vectors(df, items).collect()} == {1: "near alone some far none", 2: "other"}


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_terms_are_looked_up_with_any_head(spark, most):
    rng = random.Random(most)
    rows = [(k, rng.choice(["the"] * 50 + [f"t{i}" for i in range(20)])) for k in range(300)]
    table = {"the": (200, 0.1), **{f"t{i}": (i + 1, float(i)) for i in range(15)}}
    df = spark.createDataFrame(rows, "k long, term string").repartition(4)
    got = profiles.with_terms(df, spark.createDataFrame([(t, *x) for t, x in table.items()], "term string, df long, idf double"), most=most).collect()
    assert sorted((r["k"], r["term"], r["idf"] if r["idf"] is not None else -1) for r in got) == sorted((k, t, table.get(t, (0, -1))[1]) for k, t in rows)


def test_one_json_object_is_read_by_many_tasks(spark, tmp_path):
    said = {f"u{k}": {f"i{j}": j / 7 for j in range(k % 5 + 1)} for k in range(3000)}
    lists = {f"u{k}": [f"i{j}" for j in range(k % 4)] for k in range(3000)}
    files = {"bare": said, "named": {"predicted": said}, "lists": lists}
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body, indent=2 if name == "bare" else None))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for name in ("bare", "named"):
            df = tables.read_predictions(spark, str(tmp_path / name), lines=False)
            assert df.rdd.getNumPartitions() > 2
            assert {(r["user_id"], r["item_id"]): r["score"] for r in df.collect()} == {(u, i): s for u, x in said.items() for i, s in x.items()}
        df = tables.read_limit_list(spark, str(tmp_path / "lists"), lines=False)
        assert df.rdd.getNumPartitions() > 2 and sorted(tuple(r) for r in df.collect()) == sorted((u, i) for u, x in lists.items() for i in x)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("body", [{"a}b": {"x": 1.0}, "c": {"d]}": 2.0}}, {"predicted": {"a\"}": {"x, {": 0.5}}}, {"u": {}}, {}, {"u": {"i": 1.0}}])
def test_json_objects_with_odd_keys(spark, tmp_path, body):
    (tmp_path / "odd").write_text(json.dumps(body))
    want = body.get("predicted", body)
    got = tables.read_predictions(spark, str(tmp_path / "odd"), lines=False).collect()
    assert {(r["user_id"], r["item_id"]): r["score"] for r in got} == {(u, i): s for u, x in want.items() for i, s in x.items()}


@pytest.mark.parametrize("text", ['{"u": {"i": 1.0', "not json", '{"u": 5}', '{"u": {"i": "x"}}'])
def test_malformed_json_raises(spark, tmp_path, text):
    (tmp_path / "bad").write_text(text)
    with pytest.raises(Exception, match=re.compile("no sound JSON|JSON|cast", re.S)):
        tables.read_predictions(spark, str(tmp_path / "bad"), lines=False).collect()


def test_stored_tables_are_let_go(spark):
    """A table that nothing refers to any more is not kept alive, and a released one has no files."""
    import gc

    before = len(scratch._paths)
    kept = scratch.materialize(spark.range(5).toDF("x"), "kept")
    scratch.materialize(spark.range(5).toDF("x"), "dropped")
    gc.collect()
    assert len(scratch._paths) == before + 1
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and kept.count() == 5
    scratch.release(kept)
    assert not os.path.isdir(folder) and len(scratch._paths) == before
    assert hash_key(1, "x") is not None


def test_similarities_by_blocks_of_vectors(spark, monkeypatch):
    """Over several blocks and copies, with equal vectors, missing ones and nulls: means of clamped products, and cosines of pairs."""
    for name, value in (("BYTES", 48), ("IDS", 3), ("EACH", 0), ("PAIRS", 4)):
        monkeypatch.setattr(similarity, name, value)
    rng = np.random.default_rng(3)
    vecs = {i: [float(np.float32(x)) for x in rng.normal(size=3)] for i in range(9)}
    vecs |= {9: vecs[2], 10: [0.0, 0.0, 0.0], 11: [1.0, None, 2.0]}
    vectors = spark.createDataFrame(list(vecs.items()), "item_id long, vec array<float>")
    own = {u: [int(i) for i in rng.choice(14, 5, replace=False)] for u in range(6)}
    asked = {u: [int(i) for i in rng.choice(14, 6, replace=False)] for u in range(7)}
    table = lambda rows: spark.createDataFrame([(u, i) for u, items in rows.items() for i in items], "user_id long, item_id long")
    product = lambda a, b: sum(x * y for x, y in zip(vecs[a], vecs[b], strict=True)) if 11 not in (a, b) else None
    scaled = lambda x: min(1.0, max(0.0, (x + 0.5) / 1.0))
    soft, mean, cosines = {}, {}, {}
    for u, items in own.items():
        for a in asked[u]:
            found = [product(a, b) for b in items if a in vecs and b in vecs]
            if found:
                soft[u, a] = np.mean([scaled(x) for x in found if x is not None]) if set(found) != {None} else None
            others = [b for b in items if b != a]
            mean[u, a] = np.mean([scaled(product(a, b) or 0.0) if a in vecs and b in vecs else scaled(0.0) for b in others])
            for b in others:
                if a in vecs and b in vecs:
                    low, high = sorted((a, b))
                    norm = 0 if 11 in (a, b) else (product(a, a) * product(b, b)) ** 0.5
                    cosines[low, high] = product(a, b) / norm if norm else 0.0
    same = lambda got, want: got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-12 for k in want)
    assert same({(r["user_id"], r["item_id"]): r["label"] for r in negatives.neg_cf_weighted(table(asked), table(own), vectors, -0.5, 0.5).collect()}, soft)
    assert same({(r["user_id"], r["item_id"]): r["sim"] for r in similarity.user_item_sim(table(asked), table(own), vectors, -0.5, 0.5).collect()}, mean)
    pairs = similarity.candidate_pairs(table(asked), table(own))
    assert same({(r["item_a"], r["item_b"]): r["sim"] for r in similarity.vector_sim(pairs, vectors, "cosine").collect()}, cosines)


@pytest.mark.parametrize("head", [0, 2, 1000])
def test_ngrams_are_counted_in_place(spark, monkeypatch, head):
    """Only n-grams that the table has are shuffled; repeated keys are one profile; the order is that of a plain sort."""
    monkeypatch.setattr(profiles, "HEAD", head)
    joined = []
    monkeypatch.setattr(profiles, "with_terms", lambda rows, *a, made=profiles.with_terms: joined.append(made(rows, *a)) or joined[-1])
    texts = [(1, "b a b c"), (2, "c c a z"), (3, None), (4, "a b"), (4, "b b d")]
    idf = {"a": 0.5, "b": 1.0, "c": 2.0, "a b": 3.0}
    table = spark.createDataFrame([(t, i + 1, w) for i, (t, w) in enumerate(idf.items())], "term string, df long, idf double")
    got = profiles.rank_ngrams(spark.createDataFrame(texts, "doc_id long, text string"), table, (1, 2), key="doc_id")
    found, first, tf = {}, {}, {}
    for d, text in texts:
        words = (text or "").split()
        for pos, g in enumerate(words + [" ".join(p) for p in zip(words, words[1:], strict=False)]):
            first[d, g] = min(pos, first.get((d, g), pos))
            tf[d, g] = tf.get((d, g), 0) + 1
    for d, g in sorted(first, key=lambda x: (x[0], -tf[x] * idf.get(x[1], 0.0), first[x], x[1])):
        found.setdefault(d, []).append(g)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {d: " ".join(found.get(d, [])) for d, _ in texts}
    assert "Aggregate [doc_id" not in joined[0]._jdf.queryExecution().optimizedPlan().toString()  # stored per text, not shuffled per n-gram
