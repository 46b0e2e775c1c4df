"""Tokenizer alignment, license scans and manifests against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recdata.llm import align, licenses, merkle, queries_corpus

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


# --- tokenizer alignment ---


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    # the byte of each character of the byte-level alphabet
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in kept} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in kept)}
    return a, b, letters


def plain_alignment(texts, tokenizers):
    """All by loops over the tokens of the two libraries: digest columns in the order of `texts`."""
    a_lib, b_lib, letters = tokenizers
    per_text = []
    for text in texts:
        ends_a, ends_b, groups, links = defaultdict(list), defaultdict(list), [], []
        a = b = []
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            bytes_a = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_lib.id_to_piece, b)]
            if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
                a = b = []
        if a:
            for ids, parts, ends in ((a, bytes_a, ends_a), (b, bytes_b, ends_b)):
                at = 0
                for i, part in zip(ids, parts, strict=True):
                    at += len(part)
                    ends[at].append(i)
            now = [[], []]
            for end in sorted(ends_a.keys() | ends_b.keys()):
                now[0] += ends_a.get(end, [])
                now[1] += ends_b.get(end, [])
                if end in ends_a and end in ends_b:
                    links += [(x, y) for x in ends_a[end] for y in ends_b[end]]
                    groups.append("|".join(",".join(map(str, side)) for side in now))
                    now = [[], []]
        per_text.append((len(a), len(b), groups, links))
    count = Counter(link for x in per_text for link in x[3])
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in per_text
    ]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
ODD = [None, "", " ", "  two  blanks ", "a▁b", "\n\n x\t", "<0x41> <s></s><unk> <|endoftext|>", "naïve ﬁ 日本語 \U0001f600", "a\x00b", "\x85　x", "same same same", "same same same", "word " * 3000, "x" * 3000, "é" * 2000]


def test_alignment_equals_plain_loops(spark, tokenizers, monkeypatch):
    """Small containers and few slots make no difference; nulls, repeated ids, clashing columns and texts that do not come back included."""
    rows = [(i, t, "p", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], "p", 1), (None, "no id same", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string, slot int").repartition(3)
    want = sorted((str(r[0]), *x) for r, x in zip(rows, plain_alignment([r[1] for r in rows], tokenizers), strict=True))
    got = sorted((str(r["doc_id"]), *(r[n] for n in NAMES)) for r in align.align(df, RANKS, public_tokenizers.PATTERN, MODEL).collect())
    assert got == want
    assert align.align(df.limit(0), RANKS, public_tokenizers.PATTERN, MODEL).count() == 0


def test_alignment_of_whole_table(spark, tokenizers):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(k, *x) for k, x in zip(docs, plain_alignment(list(docs.values()), tokenizers), strict=True)}
    got = {(r["doc_id"], *(r[n] for n in (*NAMES[:-1], "groups_sha256"))) for r in queries_corpus.op11_tokenizer_alignment(spark, SF).collect()}
    assert got == want


def test_bitmaps_open_to_what_was_packed():
    rng = np.random.default_rng(0)
    for n in (1, 2, align.FEW, align.FEW + 1, 500, align.SLOTS):
        slots, times = np.sort(rng.permutation(align.SLOTS)[:n]), rng.integers(1, rng.choice([2, 5, 3000]), n)
        packed = align.pack_planes(slots, times)
        opened = align.open_planes(packed)
        assert (opened[0] == slots).all() and (opened[1] == times).all() and align.popcounts(packed) == (n, times.sum())


def test_pieces_of_long_texts_never_change_ids():
    rng, model = random.Random(0), align.pieces(MODEL)[0]
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", "▁", "é", "7", "!", "word", " the"]) for _ in range(rng.randint(0, 300)))
        assert align.piece_ids(MODEL, text, 16).tolist() == model.encode(text)


def test_alignment_of_a_million_characters():
    for text in ("word and " * 110_000, "x" * 1_000_000, "\n" * 1_000_000):
        began = time.time()
        a, ends_a, b, ends_b = align.tokens_of(text, RANKS, public_tokenizers.PATTERN, MODEL)
        n, links, _ = align.aligned(a, ends_a, b, ends_b)
        assert ends_a[-1] == ends_b[-1] == 1 + len(text) and n == len(links) and time.time() - began < 30


# --- license scans ---


def plain_scan(text):
    """Base places by loops over words, every rule without its keywords, suppression by comparing all pairs."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    base = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    joined = b" " + " ".join(words).encode() + b" "
    found = [(joined[: m.start()].count(b" ") - 1, joined[: m.end()].count(b" "), r) for r in licenses.rules() for m in r.pattern.finditer(joined)]
    left = [x for x in found if not any(y[2].order < x[2].order and y[0] <= x[0] and x[1] <= y[1] for y in found)]
    return len(words), base, sorted((s, e, r.order) for s, e, r in left)


SAID = [
    "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "All rights reserved.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0 (the License);", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU Lesser General Public License v2.1", "available under GPLv3", "cc by cc by cc-by",
    "MIT", "mit der", "BSD-3-Clause License", "The Unlicense license", "Mozilla Public License 2.0", "do what the fuck you want to public license", "Creative Commons Attribution-ShareAlike 4.0", "todos los derechos reservados",
    "General\nPublic*License", "python software foundation license version 2", "Permission is hereby granted, free of charge, to any person obtaining a copy", "zlib/libpng license", "beer-ware license", " nbsp", "1234", "rights", "Tous droits réservés",
]


def test_scans_equal_plain_loops():
    rng = random.Random(0)
    for text in [None, "", "!?", *SAID, *(rng.choice([" ", "\n", "; "]).join(rng.choices(SAID, k=rng.randint(2, 12))) for _ in range(300))]:
        n, base, found = licenses.scan_text(text or "")
        assert (n, base, [(s, e, r.order) for s, e, r in found]) == (lambda x: (x[0], x[1], sorted(x[2], key=lambda y: (y[0], -y[1], y[2]))))(plain_scan(text))


def test_every_rule_has_its_keywords():
    """Each family's own identifier, a grant and a versioned name are found with the keywords as gates."""
    assert len(licenses.rules()) > 200
    for label, text in [("gpl", "under the gplv2"), ("lgpl", "LGPLv3"), ("agpl", "GNU Affero General Public License"), ("bsd", "new BSD license"), ("mit", "MIT license"), ("cc0", "CC0 license"), ("mpl", "MPL 2.0"), ("epl", "Eclipse Public License v 2.0")]:
        assert label in {r.label for _, _, r in licenses.scan_text("distributed " + text if text.startswith("under") else "licensed under the " + text)[2]}, text


def test_scan_of_odd_rows(spark):
    texts = [None, "", *SAID]
    df = spark.createDataFrame([*((i, t, "x", "y") for i, t in enumerate(texts)), (2, texts[2], "x", "y"), (None, "cc by", None, None)], "doc_id long, text string, labels string, kinds string")
    rows = licenses.scan(df).collect()
    assert len(rows) == len(df.collect())
    for r in rows:
        n, base, found = plain_scan("cc by" if r["doc_id"] is None else texts[r["doc_id"]])
        assert r["n_words"] == n and [*zip(r["base_starts"], r["base_labels"], strict=True)] == base
        assert sorted(zip(r["starts"], r["ends"], strict=True)) == sorted((s, e) for s, e, _ in found) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(base or found)
    assert licenses.scan(df.limit(0)).count() == 0


def test_scan_of_a_very_long_text():
    began = time.time()
    n, base, found = licenses.scan_text("mit license, cc by and general public license; " * 100_000)
    assert n == 800_000 and len(base) == 200_000 and len(found) == 100_000 * 2 and time.time() - began < 60


def test_scan_query_over_whole_table(spark):
    rows = queries_corpus.op12_license_scans(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        n, base, found = plain_scan(texts[r["doc_id"]])
        starts = [at for at, _ in base]
        labels = {label for _, label in base}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(base), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and r["labels"] == ",".join(sorted(labels | {licenses.rules()[o].label for _, _, o in found}))


# --- manifests ---


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(hashes):
    """(root, for each leaf its siblings as (left, right) from the leaf up)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i // 3 * 3
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        at = [i // 3 for i in at]
        level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append((r[0], h(*map(field, r)), r))
    named = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in named:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: plain_tree([x[1] for x in sources[s]]) for s in named}
    root, tops = plain_tree([trees[s][0] for s in named])
    out = []
    for s, top in zip(named, tops, strict=True):
        for (doc, leaf, r), path in zip(sources[s], trees[s][1], strict=True):
            node = leaf
            if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and r[4] is not None:
                node = h(*map(field, (*r[:4], r[4].replace("\n", ""))))
            for left, right in path + top:
                node = h(left, node, right)
            out.append((str(doc), leaf, trees[s][0], root, h(*(x for p in path + top for x in p)), node, node == root))
    return sorted(out)


def told(spark, df):
    found = merkle.manifest(df, changed={"text": merkle.tampered_text(F.col("doc_id"), F.col("text"))})
    rows = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), merkle.folded(F.col("leaf_now"), F.col("path"))).collect()
    return sorted((str(r[0]), *r[1:], r[5] == r[3]) for r in rows)


@pytest.mark.parametrize(("depth", "n"), [(1, 40), (2, 100), (5, 1), (5, 3), (5, 300), (1, 1)])
def test_manifest_equals_plain_trees(spark, monkeypatch, depth, n):
    """Blocks of three leaves take several rounds, and more sources than a block has nodes; nulls, equal ids and rows, clashing columns."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 3**depth)
    rng = random.Random(n)
    rows = [(k if k % 13 else None, rng.choice([None, "", "a", "é", "hot", "hot", "hot", f"s{k % 11}"]), rng.choice([None, "en"]), k, rng.choice([None, "", "a\nb", "x", "\n\n" + "y" * k])) for k in range(n)]
    rows += rows[:2] + [(5, "hot", "en", 1, "other")] * (n > 3)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place string, hash string").repartition(4)
    assert told(spark, df) == plain_manifest(rows)


def test_manifest_of_nothing_and_of_a_long_text(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert told(spark, spark.createDataFrame([], schema)) == []
    rows = [(8, "s", "en", 1, "long\n" * 1_000_000), (9, "s", "en", 1, "long\n" * 1_000_000)]
    assert told(spark, spark.createDataFrame(rows, schema)) == plain_manifest(rows)


def test_manifest_query_over_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in queries_corpus.op13_merkle_manifest(spark, SF).collect())
    assert got == plain_manifest(rows)
