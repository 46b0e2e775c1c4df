"""SimHash, substrings and top-k against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recdata.llm import covertree, fmindex, prefixes, simhash, substrings, topk
from recdata.llm.common import possible

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_fingerprint(text):
    words = plain_words(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints):
    parent = dict(zip(ids, ids, strict=True))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(200)) for _ in range(12)]
    texts = [None, "", "One", "one", "a b", "A B C"] + base + [b.replace(" ", "  ", 3) for b in base[:6]] + [b + " tail" for b in base[3:9]] + [base[0].upper()]
    rows = [(i * 3 % 101, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    prints = {i: brute_fingerprint(t) for i, t, _ in rows}
    want = components([i for i, _, _ in rows], prints)
    for r in got:
        assert r["fp"] % (1 << 64) == prints[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def similar_pairs(texts, size=5, least=0.8):
    """(pairs of ids whose shingle sets reach the similarity, the sets) by comparing all."""
    sets = {}
    for i, t in texts.items():
        words = plain_words(t)
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    like = lambda a, b: a == b or len(a & b) >= least * len(a | b)
    return [(i, j) for i, j in itertools.combinations(sorted(sets), 2) if like(sets[i], sets[j])], sets


def components_of(nodes, pairs):
    """The smallest node that each can reach."""
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in nodes}


@pytest.mark.parametrize(("tables", "most", "turns"), [(24, 8, 6), (1, 0, 2), (1, 0, 0)])
def test_similar_documents(spark, monkeypatch, tables, most, turns):
    """All links of 0.8 and more are found and no other, also almost without anchors, with pivots in every turn and with none."""
    monkeypatch.setattr(prefixes, "TURNS", turns)
    monkeypatch.setattr(prefixes, "MANY", most)
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts, n = {}, 0
    for _ in range(40):
        base = fresh(rng.randint(60, 300))
        for edits in (0, 1, 2, 5, 20):
            words = list(base)
            for at in rng.sample(range(len(words)), min(edits, len(words) // 3)):
                words[at] = f"x{rng.random()}"
            texts[n] = rng.choice([" ", "\n", "  "]).join(words)
            n += 1
    # a large group of near copies, and a passage that many unlike documents share
    group, passage = fresh(120), fresh(60)
    for k in range(60):
        texts[n] = " ".join(group[:k] + [f"y{k}"] + group[k + 1 :])
        texts[n + 1] = " ".join([*passage, *fresh(12)])
        n += 2
    texts |= {n: None, n + 1: "", n + 2: "One", n + 3: "one", n + 4: "a b c", n + 5: "A b c", n + 6: "a b c d e f"}
    rows = [(i, t, "clash") for i, t in texts.items()]
    df = spark.createDataFrame([*rows, rows[3], (None, "x", "y"), (None, None, None)], "doc_id int, text string, component_id string").repartition(3)
    got = simhash.similar_documents(df, tables=tables).collect()
    assert len(got) == len(rows) + 3 and sum(r["component_id"] is None for r in got) == 2
    pairs, _ = similar_pairs(texts)
    assert len(pairs) > 1500
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == components_of(texts, pairs)
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_similar_documents_of_whole_table(spark):
    """No pair of unlike texts at 0.8 or more is lost, in any band, against all pairs that share a shingle of their first words' worth."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()}
    sets = {i: frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w := plain_words(t)) >= 5 else frozenset([tuple(w)]) for i, t in docs.items()}
    first = {}
    for i in sorted(docs):
        first.setdefault(sets[i], i)
    count = collections.Counter(s for x in first for s in x)
    held, bands = collections.defaultdict(list), collections.Counter()
    pairs = [(i, first[x]) for i, x in sets.items() if first[x] != i]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")).collect()}
    for x, i in first.items():
        tried = set()
        for s in sorted(x, key=lambda s: (count[s], s))[: len(x) - -(-len(x) * 4 // 5) + 1]:
            for j in held[s]:
                if j not in tried:
                    tried.add(j)
                    alike = len(x & sets[j]) / len(x | sets[j])
                    if alike >= 0.8:
                        pairs.append((i, j))
                        bands[f"{alike * 20 // 1 / 20:.2f}", found[i] == found[j]] += 1
            held[s].append(i)
    print(sorted(bands.items()))
    assert sum(bands.values()) > 30 and not [band for band, linked in bands if not linked]
    assert found == components_of(docs, pairs)


@pytest.mark.parametrize("hot", [1, 3, 256])
def test_links_are_complete(spark, hot):
    rng = np.random.default_rng(0)
    words = set()
    for b in rng.integers(0, 2**63, 60, dtype=np.int64).tolist():
        words.add(b)
        for _ in range(6):
            x = np.uint64(b)
            for k in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= np.uint64(1) << np.uint64(k)
            words.add(int(x.view(np.int64)))
    words = sorted(words)
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(w,) for w in words], "fp long"), hot).collect()}
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 2}


def brute_removal(rows, size):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            least[window] = min(least.get(window, i), i)
    out = []
    for i, w in split:
        gone = {p for k in range(len(w) - size + 1) if least[tuple(w[k : k + size])] < i for p in range(k, k + size)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("hot", "shard", "bits"), [(64, 400_000, 64), (2, 500, 64), (2, 500, 3)])
def test_removal_equals_brute_force(spark, monkeypatch, hot, shard, bits):
    """Also with a copy of the index for every two segments, many shards, and hashes that say next to nothing: they route, they do not decide."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD", shard)
    monkeypatch.setattr(substrings, "PIECE", 20 if hot == 2 else 256)
    monkeypatch.setattr(substrings, "HASH_BITS", bits)
    rng = random.Random(hot)
    vocab = [f"w{i}" for i in range(30)]
    passage, rows = [rng.choice(vocab) for _ in range(70)], []
    for i in range(12 if bits == 3 else 90):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        if i % 10 == 1:
            words = rows[rng.randrange(len(rows))][1].split() + words[:5]
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(words)))
    rows += [(200, "a " * 300), (201, "a " * 120 + "b " + "a " * 70), (202, "x y " * 100), (203, "x y " * 60), (204, None), (205, ""), (-7, "y x " * 40)]
    df = spark.createDataFrame([(*r, "clash", "kept", "kept") for r in rows], "doc_id long, text string, spans string, __cut string, _key string").repartition(3)
    got = substrings.remove_repeats(df).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], " ".join(WORD.findall(r["text"] or ""))) for r in got) == brute_removal(rows, 50)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and r["__cut"] == r["_key"] == "kept"


def test_removal_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id int, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(df).collect())
    assert got == [(-1, 0), (1, 0), (1, 0), (2, 60)]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_fm_index_finds_every_window():
    """Least labels of windows of documents that are not in the index, against brute force."""
    rng = np.random.default_rng(5)
    for n, symbols, depth in itertools.product([1, 2, 40, 400], [2, 5], [2, 5, 9]):
        sequence, labels = np.append(rng.integers(1, symbols, n - 1), 0), rng.integers(0, 50, n)
        index = fmindex.FMIndex(sequence, symbols, depth, labels)
        bwt = np.concatenate([index.wavelet.rank(np.full(n + 1, c), np.arange(n + 1))[None] for c in range(symbols)])
        assert (np.diff(bwt, axis=1).sum(axis=0) == 1).all() and bwt[:, -1].tolist() == np.bincount(sequence, minlength=symbols).tolist()
        other = rng.choice([-1, *range(1, symbols)], 200)  # -1: a word that the index does not have
        starts, ends = np.array([0, 3, 150, 150]), np.array([3, 150, 150, 200])
        least = {}
        for i in range(n - depth + 1):
            window = tuple(sequence[i : i + depth])
            least[window] = min(least.get(window, 99), labels[i])
        want = [least.get(tuple(other[k : k + depth]), -1) for a, b in zip(starts, ends, strict=True) for k in range(a, b - depth + 1)]
        assert fmindex.least_labels(index, other.astype(np.int32), starts, ends).tolist() == want


def test_possible_keeps_every_partner(spark):
    df = spark.range(5000)
    some, rest = possible(df, "id", spark.range(100, 200))
    assert some.count() + rest.count() == 5000 and some.where("id >= 100 AND id < 200").count() == 100 and rest.count() > 4000


def test_top_k_equals_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK", 40), ("ASKED", 3), ("CHUNK", 2), ("SAMPLE", 64)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=6).round(2).tolist() for i in range(300)}
    for i in range(100, 160):
        vectors[i] = vectors[7]
    odd = [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (None, [1.0] * 6)]
    rows = [*vectors.items(), *odd, (50, vectors[50]), (77, vectors[7])]  # 77 twice, with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(4)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x in vectors.items()}
    assert set(got) == {q for q in whole if q % 50 == 0}
    for q, found in got.items():
        best = sorted((-max(int(whole[q] @ x), int(whole[q] @ whole[7]) if i == 77 else -(10**9)), i) for i, x in whole.items() if i != q)[:5]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 131072)]


def test_cover_tree_invariants():
    """Nested levels, separated nodes, one parent within reach, radii and lengths that hold."""
    rng = np.random.default_rng(0)
    for trial in range(40):
        n = int(rng.integers(1, 200))
        x = rng.normal(size=(n, 3))
        x[n // 2 :] = x[0] if trial % 3 == 0 else x[n // 2 :]
        tree = covertree.cover_tree(np.arange(n), x, int(rng.integers(1, 9)))
        assert (tree.x == x[tree.order]).all() and tree.ids.tolist() == tree.order.tolist()
        apart = lambda a, b, t=tree: np.sqrt(((t.x[a][:, None] - t.x[b][None]) ** 2).sum(-1))
        for level, nodes in enumerate(tree.rows):
            between = apart(nodes, nodes)[~np.eye(len(nodes), dtype=bool)]
            assert len(nodes) == 1 or between.min() > tree.reach[level]
            below = np.repeat(np.arange(len(nodes)), np.diff(tree.starts[level]))
            assert len(below) == n and (np.sqrt(((tree.x - tree.x[nodes[below]]) ** 2).sum(1)) <= tree.radii[level][below]).all()
            assert (np.sqrt((tree.x**2).sum(1)) <= tree.norms[level][below] + 1e-9).all()
            if level + 1 < len(tree.rows):
                assert set(nodes.tolist()) <= set(tree.rows[level + 1].tolist())
                children = [tree.children(level, k) for k in range(len(nodes))]
                assert np.concatenate(children).tolist() == list(range(len(tree.rows[level + 1])))
                assert all(apart(nodes[[k]], tree.rows[level + 1][c]).max() <= tree.reach[level] + 1e-9 for k, c in enumerate(children))


def test_dual_tree_prunes_clusters():
    """Over clustered vectors most pairs are never scored, and k-th scores carried from block to block save more; results are those of brute force."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    x = np.floor(256 * (4 * centres[rng.integers(0, 30, 3000)] + 0.05 * rng.normal(size=(3000, 8))))
    ids, asks = np.arange(3000), np.arange(3000) % 20 == 0
    tree, scored = covertree.cover_tree(ids[asks], x[asks]), []
    for carried in (True, False):
        search, total, found = None, 0, {}
        for block in np.array_split(ids, 3):
            if search is None or not carried:
                search = covertree.Search(tree, 5, np.full(len(tree.x), -np.inf))
            search.run(covertree.cover_tree(block, x[block]))
            total += 0 if carried else search.scored
        scored.append(search.scored if carried else total)
        if carried:
            for q, i, s in zip(*(a.tolist() for a in search.found()), strict=True):
                found.setdefault(q, []).append((-s, i))
            assert search.pruned and all(sorted(found[q]) == sorted((-int(s), i) for i, s in enumerate((x @ x[q]).tolist()) if i != q)[:5] for q in ids[asks].tolist())
    assert scored[0] < scored[1] < 3000 * 150 / 2


def test_search_decides(spark, monkeypatch):
    """Documents are streamed through an index of others; without the backward search nothing is found."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(20)), passage, *(f"b{i}x{j}" for j in range(20))])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(df, size=50).collect()}
    assert got[0] == rows[0][1] and all("p0" not in got[i].split() and f"a{i}x19" in got[i] for i in range(1, 30))
    segments = substrings._segments(substrings._keyed(df), 50)
    lists = substrings._lists(substrings._shared(segments))
    cut = substrings._cut(substrings._keyed(df).join(lists, ["doc_id", "text_key"]), 50).collect()
    assert all(r["doc_id"] == r["holder"] if r["copy"] < 0 else r["doc_id"] > r["holder"] for r in cut)
    assert {r["doc_id"] for r in cut if r["copy"] >= 0 and r["holder"] == 0} == set(range(1, 30))
    found = substrings._search(spark.createDataFrame(cut), 50, 2)
    assert found.where("gone").agg(F.sum("n")).first()[0] == 29 * 11
    other = [r.asDict() | {"words": " ".join(["none"] * len(r["words"].split()))} if r["copy"] < 0 else r.asDict() for r in cut]
    assert substrings._search(spark.createDataFrame(other, "holder long, copies int, more boolean, copy int, doc_id long, text_key long, start int, n int, words string"), 50, 2).where("gone").count() == 0


def test_very_long_text(spark):
    words = [f"w{i * i % 7919}" for i in range(300_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[1000:290_000])), (3, " ".join(words[299_990:]))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(df).collect()} == {1: 0, 2: 289_000, 3: 0}


def test_anchors_are_never_sent_to_all_tasks(spark, tmp_path):
    # Spark takes the copies of a fingerprint at its anchors for one row, so it would broadcast millions
    spark.createDataFrame([(0,), (1,), (7,), (1 << 40,)], "fp long").write.parquet(f"{tmp_path}/fps")
    made = simhash.links(spark.read.parquet(f"{tmp_path}/fps"))
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert [line for line in plan.split("\n") if "bit_count" in line and "SortMergeJoin" in line]
    assert not [line for line in plan.split("\n") if "bit_count" in line and "Broadcast" in line]
    assert {tuple(r) for r in made.collect()} == {(0, 1), (0, 1 << 40), (1, 7), (1, 1 << 40)}
