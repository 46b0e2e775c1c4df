"""Models: held-out accuracy, exact base scores, normalised probabilities; and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recdata.llm import ctw, gam, langid, lm, queries
from recdata.llm.common import id_crc

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = queries.QUERIES["op5_quality_classifier"](spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    told = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    told = told[told["held_out"]]
    assert (told["predicted"] == told["quality"]).mean() > 0.95


def plain_step(g, h, leaves, least):
    """A shallow tree over ordered bins by plain loops: (value of each bin)."""
    bounds = [0, len(g)]
    score = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(bounds, bounds[1:], strict=False):
            for cut in range(a + 1, b):
                gain = score(a, cut) + score(cut, b) - score(a, b)
                if sum(h[a:cut]) >= least and sum(h[cut:b]) >= least and gain > best + 1e-12:
                    best, at = gain, cut
        if at is None:
            break
        bounds = sorted([*bounds, at])
    return [sum(g[a:b]) / (sum(h[a:b]) + 1) for a, b in zip(bounds, bounds[1:], strict=False) for _ in range(a, b)]


def plain_pair_step(g, h, least):
    """The best table of one cut on each axis: (its entries, its gain)."""
    best = (None, -math.inf)
    n, m = len(g), len(g[0])
    quarter = lambda t, i, j: [sum(t[a][b] for a in rows for b in cols) for rows in (range(i), range(i, n)) for cols in (range(j), range(j, m))]
    for i in range(1, n):
        for j in range(1, m):
            gs, hs = quarter(g, i, j), quarter(h, i, j)
            gain = sum(x * x / (y + 1) for x, y in zip(gs, hs, strict=True)) - sum(gs) ** 2 / (sum(hs) + 1)
            if gain > best[1] + 1e-12:
                leaf = [x / (y + 1) if y >= least else 0.0 for x, y in zip(gs, hs, strict=True)]
                best = ([[leaf[2 * (a >= i) + (b >= j)] for b in range(m)] for a in range(n)], gain)
    return best


def test_gam_equals_plain_loops():
    """Trees, pair tables, boosting and scores against plain loops over bins and rows."""
    rng = np.random.default_rng(1)
    for n in (2, 5, 12):
        g, h = rng.normal(size=n), rng.uniform(0.1, 2, size=n)
        assert gam._step(g, h, 4, 0.5) == pytest.approx(plain_step(g.tolist(), h.tolist(), 4, 0.5))
        g, h = rng.normal(size=(n, 4)), rng.uniform(0.1, 2, size=(n, 4))
        table, gain = gam._pair_step(g, h, 0.5)
        want = plain_pair_step(g.tolist(), h.tolist(), 0.5)
        assert gain == pytest.approx(want[1]) and np.allclose(table, want[0])
    x = rng.integers(0, 6, size=(80, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    model = gam.fit(x, y, bins=6, coarse_bins=3, rounds=3, pair_rounds=0, n_pairs=0)
    logit = [model.base] * 80
    tables = [[0.0] * (len(e) + 1) for e in model.edges]
    bins = [[sum(v >= edge for edge in edges) for v in x[:, k]] for k, edges in enumerate(model.edges)]
    for _ in range(3):
        for k in range(3):
            p = [1 / (1 + math.exp(-t)) for t in logit]
            size = len(tables[k])
            g = [sum(y[i] - p[i] for i in range(80) if bins[k][i] == b) for b in range(size)]
            h = [sum(p[i] * (1 - p[i]) for i in range(80) if bins[k][i] == b) for b in range(size)]
            step = [0.1 * v for v in plain_step(g, h, 4, 1.0)]
            tables[k] = [a + b for a, b in zip(tables[k], step, strict=True)]
            logit = [t + step[bins[k][i]] for i, t in enumerate(logit)]
    for k in range(3):
        assert model.tables[k] == pytest.approx(tables[k])
    whole = gam.fit(x, y, bins=6, coarse_bins=3, rounds=3, pair_rounds=2, n_pairs=2)
    for i in range(80):
        total = whole.base + sum(t[sum(x[i, k] >= e for e in whole.edges[k])] for k, t in enumerate(whole.tables))
        total += sum(t[sum(x[i, a] >= e for e in whole.coarse[a]), sum(x[i, b] >= e for e in whole.coarse[b])] for a, b, t in whole.pairs)
        assert whole.logits(x[i : i + 1])[0] == pytest.approx(total)


def test_very_long_texts_and_clashing_columns(spark):
    """Three million characters in one row, and columns named like those the operators add."""
    from recdata.llm import chat, simhash

    long = "the cat sat on the mat, and " * 110_000
    rows = [(1, long, "en"), (2, "der Hund und die Katze", "de"), (3, "x" * 3_000_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("features", "__total", "__part", "fp", "f0", "least", "bits", "grams", "score")})
    told = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, langid.train(df)).collect()}
    assert told[1] == "en" and told[2] == "de" and set(told) == {1, 2, 3}
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert {r["doc_id"]: 0 <= r["score"] <= 1 for r in gam.classify(df, labels, F.lit(True)).collect()} == {1: True, 2: True, 3: True}
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r["doc_id"]: r["n_bytes"] for r in lm.score_documents(df, F.lit(True)).collect()} == {i: len(t.encode()) + 1 for i, t, _ in rows}
    chats = df.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text", F.lit("clash").alias("turns"), F.lit("clash").alias("formatted"), F.lit("clash").alias("t"))
    made = chat.format_chats(chats.withColumn("parts", chat.text_part(F.col("text"))))
    assert made.select(chat.read_loss(F.col("formatted"), F.col("mask"))).first()[0] == "".join(t for _, t, _ in rows)


def test_large_language_among_small_ones(spark):
    """Rare words of a language with nearly all of the text do not speak for one with little."""
    rng = random.Random(8)
    words = {lang: [f"{lang}{rng.randrange(26**4):x}" for _ in range(n)] for lang, n in (("en", 3000), ("de", 60))}
    common = {lang: [f"{lang}the", f"{lang}of", f"{lang}and"] for lang in words}
    make = lambda lang: " ".join(rng.choice(common[lang]) if rng.random() < 0.2 else rng.choice(words[lang]) for _ in range(60))
    rows = [(i, make("de" if i % 200 == 0 else "en"), "de" if i % 200 == 0 else "en") for i in range(800)]
    test = [(1000 + i, make(lang), lang) for i, lang in enumerate(["de", "en"] * 40)]
    schema = "doc_id long, text string, lang string"
    got = langid.identify(spark.createDataFrame(test, schema), langid.train(spark.createDataFrame(rows, schema))).collect()
    told = {i: lang for i, _, lang in test}
    assert sum(r["lang_pred"] == told[r["doc_id"]] for r in got) == len(got)


def test_language_ties_go_to_the_first_name(spark):
    train = spark.createDataFrame([(1, "one two", "bb"), (2, "one two", "aa")], "doc_id long, text string, lang string")
    for heads in (0, 64):
        got = langid.identify(train, langid.train(train, most_words=heads, most_grams=heads)).collect()
        assert [r["lang_pred"] for r in got] == ["aa", "aa"] and all(r["score"] == pytest.approx(0.5) for r in got)


def test_gam_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000], rounds=20)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_gam_edge_cases(spark):
    schema = "doc_id long, text string, score string"
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (2, "", "c"), (None, "words " * 40, None)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = gam.classify(df, none, F.lit(True)).collect()
    assert len(got) == 4 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    assert gam.classify(df.limit(0), none, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in gam.classify(df, one, F.lit(True)).collect())


def test_language_on_held_out_rows(spark):
    got = queries.QUERIES["op8_language_id"](spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet"), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert (got[got["held_out"]]["lang"] == got[got["held_out"]]["lang_pred"]).mean() > 0.98


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "???", None)], "doc_id long, text string, lang string")
    model = langid.train(train)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the dog"), (4, "the dog"), (5, "Hunde"), (6, "\u00b2 \u00bd"), (None, "zzz")], "doc_id long, text string")
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(df, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (6, "und"), (4, "en"), (5, "de")} <= got
    assert langid.identify(df.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, langid.train(train.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("heads", [(1 << 16, 1 << 16), (16, 1 << 16), (16, 24), (0, 0)])
def test_language_uses_every_word_and_gram(spark, heads):
    """Against the whole counts, however few features are sent to the tasks."""
    rng = random.Random(4)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "efgha"}
    make = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12)))
    rows = [(i, make(lang), lang) for i in range(90) for lang in [rng.choices(["aa", "bb", "cc"], [8, 2, 1])[0]]]
    train, words, grams = rows[:60], {lang: Counter() for lang in letters}, {lang: Counter() for lang in letters}
    for _, text, lang in train:
        words[lang].update(text.split())
    for lang, counts in words.items():
        for word, n in counts.items():
            for gram in langid.features(word):
                grams[lang][gram] += n

    def score(table, lang, feature):
        share = sum(counts[feature] for counts in table.values()) / sum(sum(counts.values()) for counts in table.values())
        return math.log((table[lang][feature] + 10 * share) / (sum(table[lang].values()) + 10))

    def known(table, feature):
        return any(feature in counts for counts in table.values())

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(df.where("doc_id < 60"), most_words=heads[0], most_grams=heads[1])
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        total = {lang: math.log(sum(x == lang for *_, x in train) / len(train)) for lang in letters}
        for word in text.split():
            marked, at, parts = f"\0{word}\0", 0, []
            while at < len(marked):
                part = next((p for n in range(5, 0, -1) if len(p := marked[at : at + n]) == n and known(grams, p)), None)
                parts += [part] if part else []
                at += len(part) if part else 1
            for lang in letters:
                total[lang] += score(words, lang, word) if known(words, word) else sum(score(grams, lang, p) for p in parts)
        best = max(sorted(total), key=total.get)
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total.values()))


class PlainTree:
    """Context-tree weighting by recursion over dictionaries of counts."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.longer, self.known = depth, {}, {}, {}
        for text in texts:
            raw = b"\xff" * depth + text.encode().lower() + b"\xff"
            for i in range(depth, len(raw)):
                for k in range(8):
                    node, bit = (1 << k) | (raw[i] >> (8 - k)), raw[i] >> (7 - k) & 1
                    for d in range(depth + 1):
                        context = raw[i - d : i]
                        self.counts.setdefault((context, node), [0, 0])[bit] += 1
                        if d:
                            self.longer.setdefault((context[1:], node), set()).add(context)

    def kt(self, context, node):
        a, b = self.counts[context, node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)

    def weighted(self, context, node):
        if (context, node) not in self.known:
            own = self.kt(context, node)
            below = own if len(context) == self.depth else sum(self.weighted(c, node) for c in self.longer[context, node])
            self.known[context, node] = own if len(context) == self.depth else np.logaddexp(own, below) + math.log(0.5)
        return self.known[context, node]

    def chance(self, context, node, d=0):
        """The probability of 1 after `context`; where training has not seen it, that of the longest suffix seen."""
        here = context[len(context) - d :]
        a, b = self.counts.get((here, node), (0, 0))
        p = (b + 0.5) / (a + b + 1)
        if d == self.depth or not a + b:
            return p
        stop = 0.5 * math.exp(self.kt(here, node) - self.weighted(here, node))
        longer = context[len(context) - d - 1 :]
        return stop * p + (1 - stop) * (self.chance(context, node, d + 1) if (longer, node) in self.counts else p)

    def bits(self, text):
        raw, out = b"\xff" * self.depth + text.encode().lower() + b"\xff", 0.0
        for i in range(self.depth, len(raw)):
            for k in range(8):
                p = self.chance(raw[i - self.depth : i], (1 << k) | (raw[i] >> (8 - k)))
                out -= math.log2(p if raw[i] >> (7 - k) & 1 else 1 - p)
        return out


def test_tree_probabilities_sum_to_one(spark):
    seen = Counter()
    for text in ("the cat sat", "on the mat"):
        seen.update(ctw.byte_grams([text], 3)[0].tolist())
    rows = [(g, n, n) for g, n in seen.items()]
    for context in (b"the", b"xyz", b"\xff\xff\xff"):
        every = [int.from_bytes(context + bytes([s]), "big") for s in range(256)]
        grams = spark.createDataFrame(rows + [(g, 0, 1) for g in every if g not in seen], "gram long, n long, seen long")
        bits = {r["gram"]: r["bits"] for r in ctw.gram_bits(grams, 3, size=16).collect()}
        assert sum(2.0 ** -bits[g] for g in every) == pytest.approx(1.0)


@pytest.mark.parametrize("head", [1 << 17, 4])
def test_scores(spark, head):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("Ab bb cc Dd ee ff gg").lower() + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (7, rows[7][1]), (102, "Unseen WORDS"), (None, "a1")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, bits string").repartition(3)
    training = id_crc(F.col("doc_id"), 7) != 2
    got = lm.score_documents(df, training, depth=2, head=head).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(lm.tokens(t or ""))
    n, v = sum(counts.values()), len(counts)
    texts = {i: t or "" for i, t in rows}
    for r in got:
        words = lm.tokens(texts[r["doc_id"]])
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(counts[w] > 0 for w in words) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r["score"] < 0 and r["n_bytes"] == len(texts[r["doc_id"]].encode()) + 1
    assert lm.score_documents(df.limit(0), training, depth=2).count() == 0
    nothing = lm.score_documents(df, F.lit(False), depth=2).where("doc_id = 101").first()
    assert nothing["score"] == pytest.approx(-8 * math.log10(2)) and nothing["n_known"] == 0


@pytest.mark.parametrize("depth", [2, 4])
def test_score_uses_every_gram(spark, depth):
    """The score is that of a plain tree of all training grams, however few are sent to the tasks."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefg h") for _ in range(rng.randint(0, 80)))) for i in range(40)] + [(99, "\u00e9 unseen Z"), (100, "abab" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tree = PlainTree([t for i, t in rows if i % 3], depth)
    want = {i: -math.log10(2) * tree.bits(t) for i, t in rows}
    for nodes in (0, 16, 1 << 19):
        got = {r["doc_id"]: r["score"] for r in lm.score_documents(df, F.col("doc_id") % 3 != 0, depth=depth, nodes=nodes).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_scored_text_fits_training(spark):
    got = queries.QUERIES["op10_lm_scoring"](spark, SF).toPandas()
    sums = got.groupby("held_out")[["score", "n_bytes"]].sum()
    bits = -sums["score"] / math.log10(2) / sums["n_bytes"]
    assert bits[True] < 2.6 and abs(bits[True] - bits[False]) < 0.3


def test_pipeline(spark):
    """Each stage on the smallest tables, against versions of its own in plain Python."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_dedup_operators import WORD, brute_removal, similar_pairs

    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, None, None, None), (None, "", "en", "s", 0)], raw.schema)
    docs = raw.unionByName(odd).unionByName(raw.where("doc_id = 3")).withColumns({c: F.lit("kept") for c in ("gone", "_gone", "__n", "spans")}).cache()
    stage, frame = dict(corpus_pipeline.STAGES), {}
    for name in ("quality_rules", "quality_classifier", "simhash_near_dedup", "substring_dedup"):
        out = stage[name](spark, docs if not frame else frame[last][0], sf).cache()
        assert out.columns == docs.columns and out.where("gone = 'kept' AND _gone = 'kept' AND __n = 'kept' AND spans = 'kept'").count() == out.count()
        frame[name], last = (out, {r["doc_id"]: r["text"] for r in out.collect()}), name
    first, second, third, fourth = (frame[name][1] for name in frame)
    assert first == {r["doc_id"]: text for r in docs.collect() if (text := plain_rules(r["text"] or "")) is not None}
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id")["quality"]
    assert set(second) <= set(first) and all(i in second for i in first if labels.get(i) == 1) and all(second[i] == first[i] for i in second)
    assert not any(i in second for i in first if labels.get(i) == 0)
    pairs, sets = similar_pairs(second)
    parent = {i: i for i in second}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(third) == {i for i in second if root(i) == i} and frame["simhash_near_dedup"][0].count() == len(third)
    removed = {i: kept for i, _, _, kept in brute_removal(list(third.items()), 50)}
    assert {i: " ".join(WORD.findall(t)) for i, t in fourth.items()} == removed
    packed = corpus_pipeline.run(spark, sf).toPandas()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(packed["doc_id"]) == set(fourth)
    for doc_id, pieces in packed.groupby("doc_id"):
        ids = np.array([*plain.encode(fourth[doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert sorted(zip(pieces["start"], pieces["length"], pieces["ids_crc32"], strict=True)) == [(s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes())) for s in range(0, len(ids), 1024)]
    for _, pieces in packed.sort_values("offset").groupby("sequence_id"):
        assert pieces["offset"].tolist() == [0, *pieces["length"].cumsum()[:-1]] and pieces["length"].sum() <= 1024
    nothing = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        nothing = f(spark, nothing, sf)
    assert nothing.count() == 0


def plain_rules(text):
    """What the line rules leave of a text; None if they reject it."""
    from recdata.llm import rules

    find = lambda pattern, x: re.findall(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), pattern), x)
    words = re.findall(rules.WORD, text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(covered) > 50 * len(words):
        return None
    kept, lost, seen, often = [], 0, set(), Counter(text.split("\n"))
    for line in text.split("\n"):
        again = line in seen and often[line] >= 3
        seen.add(line)
        n, debris, bars = len(re.findall(rules.WORD, line)), len(find(rules.DEBRIS, line)), len(find(rules.SEPARATOR, line))
        if n and ((debris >= 2 and 2 * debris >= n) or (bars >= 3 and 5 * bars >= n and rules.QUOTE not in line) or (n <= 15 and find(rules.BOILERPLATE, line)) or (n >= 20 and not find(rules.SENTENCE_MARK, line)) or again):
            lost += sum(map(len, re.findall(rules.WORD, line)))
        else:
            kept.append(line)
    return "\n".join(kept) if 100 * lost <= 50 * sum(map(len, words)) else None
