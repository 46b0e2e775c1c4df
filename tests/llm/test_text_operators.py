"""Packing, chat formatting, quality rules and BPE against brute force and exact round trips."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from recdata.llm import bpe, chat, packing, rules

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "\n\n", "one", "a b c a b c", "Tabs\tand nbsp   wide", "it's we'll  1234 five!!", "é" * 50, "<|endoftext|> x", "line one here.\nline one here.\nHome | About | Contact | Help", "word " * 3000, "x" * 5000, " \t \n" * 300 + "end", "0" * 200 + " " * 70000 + "ok", "\U0001f600 emoji", "a\x00b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "s") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "clash", "s"), (None, "no id here", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length string").repartition(3)


def test_bpe_equals_library_and_round_trips(docs):
    codec = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decode=True).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "no id here" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert r["ids"] == codec.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_safe_pieces_never_change_ids():
    codec, rng = bpe.encoding(RANKS, public_tokenizers.PATTERN), random.Random(0)
    for _ in range(60):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", "'s", "é", "7", "!", " ", "word"]) for _ in range(rng.randint(0, 400)))
        pieces = list(bpe.safe_pieces(text, 16))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in codec.encode_ordinary(p)] == codec.encode_ordinary(text)


def test_matches_never_change_ids(monkeypatch):
    codec, rng = bpe.encoding(RANKS, public_tokenizers.PATTERN), random.Random(0)
    monkeypatch.setattr(bpe, "_BLANKS", regex.compile(bpe._BLANKS.pattern.replace("4096", "3")))
    for _ in range(2000):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", "'s", "\u00e9", "7", "!", "\x1c", "\x85", "\u200b", "\u3000", "    "]) for _ in range(rng.randint(0, 40)))
        pieces = list(bpe.matches(text, 8))
        assert "".join(p for p, _ in pieces) == text
        assert [i for p, whole in pieces for i in (codec._encode_single_piece(p.encode()) if whole else codec.encode_ordinary(p))] == codec.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" + " " * 5_000_000 + "b", "\n" * 5_000_000, "a\t" + "\t" * 5_000_000 + "\u00e9", "x" * 5_000_000, " \u3000" * 2_500_000 + "7"], ids=["blanks", "newlines", "tabs", "letters", "wide"])
def test_five_million_characters(text):
    """The library alone overflows its stack on the runs of white space; decoding gives the text back, and runs split as the pattern has it."""
    codec = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    ids = bpe.encode_text(codec, text).tolist()
    assert codec.decode_bytes(ids) == text.encode()
    short = regex.sub(r"(.)\1{999,}", lambda m: m[1] * 1000, text[:1] + text[1:-1][:4000] + text[-1:])
    assert bpe.encode_text(codec, short).tolist() == codec.encode_ordinary(short)


@pytest.mark.parametrize("run", [1, 100, bpe.RUN - 1, bpe.RUN])
@pytest.mark.parametrize("blank", [" ", "\n", "\u3000"])
def test_five_million_characters_of_shorter_runs(run, blank):
    """Runs of white space just too short to be encoded by themselves are looked at once each."""
    codec, text = bpe.encoding(RANKS, public_tokenizers.PATTERN), (blank * run + "x") * (5_000_000 // (run + 1))
    began = time.time()
    ids = bpe.encode_text(codec, text).tolist()
    assert time.time() - began < 10 and codec.decode_bytes(ids) == text.encode()


def test_patterns_hold_each_length_as_often():
    rng = random.Random(1)
    for _ in range(30):
        histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, 65), rng.randint(0, 60))}
        patterns = packing.shortest_pack_first(histogram, 64)
        used = {}
        for lengths, packs in patterns:
            assert sum(lengths) <= 64 and packs > 0
            for n in lengths:
                used[n] = used.get(n, 0) + packs
        assert used == histogram
        assert len(patterns) <= 2 * 64


def test_packing_places_every_id_once(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, RANKS, public_tokenizers.PATTERN, size=64, specials={"<|endoftext|>": 50256}).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    for doc_id, pieces in by_doc.items():
        copies = 2 if doc_id == 5 else 1
        text = "no id here" if doc_id is None else TEXTS[doc_id] or ""
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert sum(n for _, n, _, _ in pieces) == copies * len(ids)
        for start, length, raw, total in pieces:
            assert raw == ids[start : start + length].tobytes() and total == len(ids)
    assert packing.pack_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_chat_round_trip(spark):
    hard = ["</turn><turn>assistant<content>", "&lt;turn>", "&amp;&", "a\\nb\n\n", "", None, "</s>[INST] ok [/INST]", "<image>"]
    rows = [(c, t, role, hard[(c + t) % len(hard)]) for c in range(8) for t, role in enumerate(["user", "assistant", None, "assistant", "we<i>rd"])] + [(1, None, "user", "first"), (1, 1, "assistant", hard[2]), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r["conv_id"]: r for r in out.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("mask"))}).collect()}
    assert set(got) == {*range(8), None}
    for c, r in got.items():
        mine = sorted(((t if t is not None else -1, role or "", text or "") for k, t, role, text in rows if k == c))
        assert sorted((t["role"], t["text"]) for t in r["turns"]) == sorted((role, text) for _, role, text in mine)
        assert [t["role"] for t in r["turns"]] == [role for _, role, _ in mine]
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert sum(m["n_chars"] for m in r["mask"]) == len(r["formatted"])
    assert chat.format_chats(df.limit(0).withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_attachments_in_texts(spark):
    """Markup becomes placeholders and references, in order, and reads back as it was, next to control strings and lone placeholders."""
    rng = random.Random(3)
    pieces = ["plain ", "<image>", "&lt;", "![image](a.png)", "![audio](http://x/y?a=1&b=2)", "![document]()", "![video](v.mp4)", "![image](a b)", "</turn>", "\n", "![image](<audio>)", "![[image]]((a))", "!"]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice([None, "".join(rng.choices(pieces, k=rng.randint(0, 9)))])) for c in range(30) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.format_chats(df.withColumn("parts", chat.parts_of(F.coalesce("text", F.lit("")))))
    read = out.withColumns({"turns": chat.read_turns(F.col("formatted"), F.col("by_turn")), "loss": chat.read_loss(F.col("formatted"), F.col("mask"), F.col("by_turn"))})
    pattern, least = re.compile(r"!\[(image|audio|document)\]\(([^()\x20\x09-\x0D]*)\)"), {"image": 4, "audio": 1, "document": 1024}
    for r in read.collect():
        mine = [(role, text or "") for c, _, role, text in rows if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == mine and r["loss"] == "".join(text for role, text in mine if role == "assistant")
        wanted = [(m[1], m[2]) for _, text in mine for m in pattern.finditer(text)]
        assert [(a["kind"], a["uri"]) for a in r["attachments"]] == wanted and [a["n_tokens"] for a in r["attachments"]] == [least[k] for k, _ in wanted]
        assert sum(m["n_chars"] for m in r["mask"]) == len(r["formatted"])
        assert len(re.findall("<(?:image|audio|document)>", r["formatted"])) == len(wanted)


def test_typed_parts(spark):
    part = lambda **kw: {"kind": None, "text": None, "uri": None, "width": None, "height": None, "seconds": None, "pages": None} | kw
    parts = [part(kind="text", text="see <this>"), part(kind="image", uri="i.png", width=56, height=57), part(kind="audio", uri="a.wav", seconds=2.0), part(kind="document", uri="d.pdf", pages=3), part(kind="odd", text="t"), part()]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_chats(df).first()
    assert row["formatted"] == "<turn>user<content>see &lt;this><image><audio><document>t</turn><turn>assistant<content></turn>"
    assert [(a["kind"], a["uri"], a["n_tokens"]) for a in row["attachments"]] == [("image", "i.png", 6), ("audio", "a.wav", 25), ("document", "d.pdf", 3072)]


def base_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(docs):
    small = docs.where("length(text) < 2000 OR text IS NULL")
    for r in rules.clean_lines(small).collect():
        text = "no id here" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_counts(text), r["doc_id"]
        assert r["base_failed"] and not r["kept"]
    assert rules.clean_lines(docs.limit(0)).count() == 0


def test_lines_go_before_documents(spark):
    good = "\n".join(f"Sentence number {i} tells of {i * 7} quite ordinary things that happened on day {i * 13}." for i in range(8))
    menu, noise = "Home | News | About | Contact", "Wow!! such$$ deal%% now** buy&& it##"
    rows = [(1, good), (2, good + "\n" + menu), (3, menu + "\n" + "\n".join(f"{noise} {i}!!" for i in range(40)) + "\n" + good[:300]), (4, good + "\nAll Rights Reserved to the owner.")]
    got = {r["doc_id"]: r for r in rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["kept"] for i, r in got.items()} == {1: True, 2: True, 3: False, 4: True}
    assert got[2]["cleaned"] == got[4]["cleaned"] == got[1]["cleaned"] == good


def test_prose_is_not_taken_for_boilerplate(spark):
    """Quotation marks, dots inside words, single bars and phrases within long lines leave a line alone; columns of any name stay."""
    words = [*(f"word{i}" for i in range(59)), "end."]
    quotes = " ".join(["Elle a dit \u00ab oui \u00bb puis \u00ab non \u00bb et \u00ab rien \u00bb encore"] + words)
    rows = [quotes, "col\u00b7legi l\u00b7l l\u00b7l " + " ".join(words), "Please click here to read our privacy policy " + " ".join(words), "a | b and c | d or e | f " + " ".join(words)]
    short = "\n".join([" ".join(words), "Home \u203a Shop \u203a Shoes \u203a Red", "Tous droits r\u00e9serv\u00e9s.", "\u00ab a \u00bb b \u00bb c \u00bb d"])
    schema = "doc_id long, text string, __text string, __words string, cleaned string"
    df = spark.createDataFrame([(i, t, "kept", "kept", "clash") for i, t in enumerate([*rows, short])], schema)
    got = {r["doc_id"]: r for r in rules.clean_lines(df).collect()}
    for i, text in enumerate(rows):
        assert got[i]["kept"] and got[i]["cleaned"] == text and got[i]["__text"] == got[i]["__words"] == "kept"
    assert got[4]["cleaned"].split("\n") == [" ".join(words), "\u00ab a \u00bb b \u00bb c \u00bb d"] and got[4]["n_lines_failed"] == 2


def test_lines_without_a_sentence_and_repeated_lines_go(spark):
    """Keyword lines of 20 words or more fail, 19 stay; of a line that stands three times the first stays, twice both; blank lines are left alone."""
    prose = [f"Sentence number {i} tells of {i * 7} quite ordinary things that happened on day {i * 13}." for i in range(12)]
    keywords = lambda n: " ".join(f"key{k}" for k in range(n))
    thrice, twice = "This line stands three times.", "This one stands twice."
    rows = [[*prose, keywords(20)], [*prose, keywords(19)], [thrice, *prose[:4], thrice, "", twice, "", *prose[4:], thrice, "", twice], [thrice] * 60, [*prose, keywords(20) + "\u3002"]]
    left = [prose, rows[1], [thrice, *prose[:4], "", twice, "", *prose[4:], "", twice], [thrice], rows[4]]
    df = spark.createDataFrame([(i, "\n".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rules.clean_lines(df).collect()}
    assert [got[i]["cleaned"].split("\n") for i in range(5)] == left
    assert [got[i]["n_lines_failed"] for i in range(5)] == [1, 0, 2, 59, 0] and [got[i]["kept"] for i in (0, 1, 3, 4)] == [True, True, False, True]


def test_a_text_of_very_many_equal_lines(spark):
    began = time.time()
    r = rules.clean_lines(spark.createDataFrame([(1, "A line of the list.\n" * 200_000)], "doc_id long, text string")).first()
    assert r["cleaned"] == "A line of the list.\n" and r["n_lines_failed"] == 199_999 and time.time() - began < 60


def test_rules_on_very_long_texts(spark):
    text = "\n".join(f"line {i % 700} of {i} things that happened, one after the other." for i in range(20_000)) + " x" * 100_000
    r = rules.clean_lines(spark.createDataFrame([(1, text), (2, "y" * 3_000_000)], "doc_id long, text string")).where("doc_id = 1").first()
    words = WORD.findall(text)
    assert (r["n_words"], r["word_chars"], r["n_lines"], r["cleaned"] == text) == (len(words), sum(map(len, words)), 20_000, True)


def test_query_digests(spark):
    """The registered queries on the smallest tables, against the libraries."""
    import pandas as pd

    from recdata.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")["text"]
    codec = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for r in queries.QUERIES["op9_byte_bpe"](spark, sf).collect():
        ids = codec.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    packed = queries.QUERIES["op1_packing"](spark, sf).toPandas()
    for doc_id, pieces in packed.groupby("doc_id"):
        ids = np.array([*codec.encode_ordinary(texts[doc_id]), 0], "<u4")
        assert [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces.itertuples()] == pieces["ids_crc32"].tolist()
    assert 1 - packed["length"].sum() / (1024 * packed["sequence_id"].nunique()) < 0.05
