"""SimHash near-duplicates by anchor-point covering.

Two fingerprints of 64 bits that differ in at most two bits differ in at most
one bit in one of their halves. For a half, 31 of its bits are compared through
a covering code: the Hamming code of length 31 is perfect, so every word lies
within radius 1 of exactly one of its 2^26 code words, the anchors. If x lies
within 1 of an anchor and y within 1 of x, then y lies within 2 of that anchor.
So each fingerprint is replicated to the anchors within covering radius plus
threshold (at most 16 for a half), and meets, at one of them, each fingerprint
that calls this anchor its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recdata.operators.graph import connected_components

from . import prefixes
from .common import grown, kind_of, map_rows, materialize, possible, release, slices
from .ctw import lower_bytes
from .prefixes import unique_shingles

#: Members of one anchor beyond which it is dealt out again; results do not depend on it.
HOT = 256


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """SimHash of a text: a bit is 1 if set in over half the hashes of its shingles; 0 without words. UTF-8 is split at the six ASCII white-space characters."""
    words = lower_bytes(text).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(b" ".join(words), seed)
    columns = [words[i : len(words) - size + 1 + i] for i in range(size)]
    total, ones = 0, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(b" ".join(shingle), seed) for shingle in zip(*columns, strict=True)), "<u8", len(columns[0]))
    for first in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[first : first + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(bits)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long: the fingerprint's bits as a signed number) of every whole text; null texts have no words."""

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        for keys, texts in batches:
            found = np.array([fingerprint(text or "", size, seed) for text in texts], np.uint64)
            yield {id_col: keys, "fp": found.view(np.int64)}

    return map_rows(df, [id_col, text_col], rows, {id_col: kind_of(df, id_col), "fp": "long"})


def _syndrome(word: Column) -> Column:
    """The position, 1 to 31, of the bit that makes a 31-bit word a code word; 0 if it is one."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1)
        out = out.bitwiseOR(F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(mask).cast("long"))).cast("int").bitwiseAND(F.lit(1)), j))
    return out


def _flip(word: Column, position: Column) -> Column:
    """The word with the bit at `position` changed; 0 changes none."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(position - 1, F.lit(0)))
    return word.bitwiseXOR(F.when(position > 0, one).otherwise(F.lit(0).cast("long")))


def halves(fp: Column) -> list[Column]:
    """31 bits of each half of a fingerprint."""
    keep = F.lit((1 << 31) - 1).cast("long")
    return [fp.bitwiseAND(keep), F.shiftrightunsigned(fp, 32).bitwiseAND(keep)]


def own_anchor(word: Column) -> Column:
    return _flip(word, _syndrome(word))


def near_anchors(word: Column) -> Column:
    """The code words within 2 of a 31-bit word: itself alone if it is one, else 16."""
    s = _syndrome(word)
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("i"), i.bitwiseXOR(s).alias("j"))), lambda p: p["i"] < p["j"])
    return F.when(s == 0, F.array(word)).otherwise(F.transform(pairs, lambda p: _flip(_flip(word, p["i"]), p["j"])))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) with a < b: distinct fingerprints that differ in one or two bits.

    `fps` has the distinct fingerprints in fp. Pairs come from anchors (see
    above). An anchor that `hot` fingerprints or more call their own is dealt
    out again, exactly: of three parts of the other half at least one is the
    same in both, so part number and value join the key. Only links leave the
    join, not the pairs compared.
    """
    sides = [F.struct(F.lit(k).alias("half"), word.alias("word")) for k, word in enumerate(halves(F.col("fp")))]
    by_half = fps.select("fp", F.explode(F.array(*sides)).alias("s")).select("fp", "s.half", "s.word")
    own = by_half.select("fp", "half", own_anchor(F.col("word")).alias("anchor"))
    near = by_half.select("fp", "half", F.explode(near_anchors(F.col("word"))).alias("anchor"))
    crowded = own.groupBy("half", "anchor").agg(F.count("*").alias("n")).where(F.col("n") >= hot).select("half", "anchor", F.lit(True).alias("hot"))
    other = F.when(F.col("half") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit((1 << 32) - 1).cast("long")))
    parts = [F.struct(F.lit(k).alias("part"), F.shiftrightunsigned(other, low).bitwiseAND(F.lit((1 << n) - 1).cast("long")).alias("value")) for k, (low, n) in enumerate(((0, 11), (11, 11), (22, 10)))]
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("value")))

    def dealt(rows: DataFrame) -> DataFrame:
        marked = rows.join(crowded, ["half", "anchor"], "left")
        return marked.select("fp", "half", "anchor", F.explode(F.when(F.col("hot"), F.array(*parts)).otherwise(whole)).alias("p")).select("fp", "half", "anchor", "p.part", "p.value")

    x, y = (grown(dealt(rows)).withColumnRenamed("fp", name) for rows, name in ((own, "x"), (near, "y")))
    close = (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2)
    met = x.join(y, (x.half == y.half) & (x.anchor == y.anchor) & (x.part == y.part) & (x.value == y.value) & close)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """One row for each document: (id, fp, component_id).

    Documents with equal fingerprints, and those whose fingerprints differ in at
    most two bits, are linked; component_id is the smallest id that can be
    reached. Copies are one fingerprint before anything is compared, so a group
    of copies of any size costs one row. Null and empty texts have fingerprint
    zero and are linked like any other. A null id never becomes a
    component_id unless all ids of its component are null. Repeated rows come
    back as often as they came; an empty table gives an empty result; columns
    other than the two named are not read.
    """
    prints = materialize(fingerprints(df, id_col, text_col, size, seed), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    found = connected_components(links(distinct.select("fp")))
    groups = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


#: Words of 31 bits drawn from a wide fingerprint, each with an anchor of its own: they save work and change no result.
TABLES = 24
#: Standard deviations beyond the expected distance at which fingerprints are too far apart for a text to be compared by its shingles.
MARGIN = 6.5
_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
LANES = [f"f{k}" for k in range(4)]


def wide_fingerprints(df: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """((id, f0 to f3, set, n), sketch), both stored.

    f0 to f3: SimHash of 256 bits of the set of shingles of every whole text,
    zero without words. set: a digest of that set, equal for equal sets alone. n:
    its size. sketch: see `prefixes.merged_sketch`.
    """
    fields = {id_col: kind_of(df, id_col), **dict.fromkeys(LANES, "long"), "set": "binary", "n": "int", "block": "int", "part": "int", "counts": "binary"}

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        counted = np.zeros(prefixes.SKETCH, np.int64)
        for keys, texts in batches:
            texts = [t or "" for t in texts]
            for part in slices(texts, 1 << 19):
                hashes, n = unique_shingles(texts[part], size)
                total, first = np.zeros((len(n), 256), np.int32), np.cumsum(n) - n
                for at in range(0, len(hashes), 1 << 15):
                    lanes = hashes[at : at + (1 << 15), None] ^ _LANES
                    lanes = (lanes ^ (lanes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    lanes ^= lanes >> np.uint64(29)
                    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1, bitorder="little")
                    some = np.flatnonzero((n > 0) & (first < at + len(bits)) & (first + n > at))
                    total[some] += np.add.reduceat(bits, np.maximum(first[some] - at, 0), axis=0, dtype=np.int32)
                counted += np.bincount((hashes & np.uint64(prefixes.SKETCH - 1)).astype(np.int64), minlength=prefixes.SKETCH)
                found = np.packbits(2 * total > n[:, None], axis=1, bitorder="little").view(np.int64)
                sets = [xxhash.xxh3_128_digest(hashes[s : s + k].tobytes()) for s, k in zip(first.tolist(), n.tolist(), strict=True)]
                none = [None] * len(n)
                yield {id_col: keys[part], **{f: found[:, k] for k, f in enumerate(LANES)}, "set": sets, "n": n.astype(np.int32), "block": none, "part": none, "counts": none}
        yield from ({**dict.fromkeys(fields, [None] * len(told["block"])), **told} for told in prefixes.sketch_rows(counted))

    stored = materialize(map_rows(df, [id_col, text_col], rows, fields), "fingerprints")
    return stored.where("block IS NULL").select(id_col, *LANES, "set", "n"), stored.where("block IS NOT NULL").select("block", "part", "counts")


def anchor_keys(distinct: DataFrame, tables: int) -> DataFrame:
    """(key, least): for each of `tables` words of a wide fingerprint its number and its anchor, the code word within 1 of it."""
    drawn = np.stack([np.random.default_rng(t).permutation(256)[:31] for t in range(tables)])
    places, ones = np.arange(1, 32, dtype=np.uint8), np.int64(1) << np.arange(31, dtype=np.int64)

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        for least, *lanes in batches:
            for at in range(0, len(least), 128):
                fps = np.stack([np.array(x[at : at + 128], np.int64) for x in lanes], axis=1)
                bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")[:, drawn].astype(bool)
                off = np.bitwise_xor.reduce(bits * places, axis=2).astype(np.int64)  # the bit, from 1 on, in which a word differs from its anchor
                words = bits @ ones
                anchors = np.where(off > 0, words ^ (np.int64(1) << np.maximum(off - 1, 0)), words)
                keys = (np.arange(tables, dtype=np.int64) << 32) | anchors
                yield {"key": keys.ravel(), "least": np.repeat(np.array(least[at : at + 128], np.int64), tables)}

    return map_rows(distinct, ["least", *LANES], rows, {"key": "long", "least": "long"})


def _verified(met: DataFrame, docs: DataFrame, distinct: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) of `met`, ids of `distinct`, whose shingles have a similarity of `least` or more; stored.

    Pairs too far apart in all 256 bits are left out first: of pairs that reach
    `least`, fewer than one in a thousand million are (see MARGIN).
    """
    angle = math.acos(2 * least / (1 + least)) / math.pi
    radius = 256 * angle + MARGIN * math.sqrt(256 * angle * (1 - angle))
    sides = [distinct.select(F.col("least").alias(side), F.col("n").alias(f"{side}n"), *(F.col(f).alias(f"{side}{f}") for f in LANES)) for side in ("a", "b")]
    apart = sum((F.bit_count(F.col(f"a{f}").bitwiseXOR(F.col(f"b{f}"))) for f in LANES), F.lit(0))
    fit = F.least("an", "bn") >= F.greatest("an", "bn") * least - 1e-9
    near = materialize(met.join(sides[0], "a").join(sides[1], "b").where((apart <= radius) & fit).select("a", "b"), "near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = possible(docs, "id", wanted)[0].join(wanted, "id").groupBy("id").agg(F.min("text").alias("text"))

    def sets(batches: Iterator[tuple]) -> Iterator[dict]:
        for ids, texts in batches:
            yield {"id": ids, "shingles": [unique_shingles([text or ""], size)[0].tobytes() for text in texts]}

    shingled = materialize(map_rows(texts, ["id", "text"], sets, {"id": "long", "shingles": "binary"}), "shingles")

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common / max(1, len(x) + len(y) - common))
        return pd.Series(out, dtype=float)

    pairs = near.join(shingled.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(shingled.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    links = materialize(pairs.where(jaccard("sa", "sb") >= least).select("a", "b"), "links")
    release(near, shingled)
    return links


def similar_documents(df: DataFrame, size: int = 5, least: float = 0.8, tables: int = TABLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row: documents whose sets of `size`-word shingles have a Jaccard similarity of `least` or more are linked.

    Texts with equal sets are one from the start. Then links are found in two
    ways. First by anchors: each set has a SimHash of 256 bits, from which
    `tables` words of 31 bits are drawn; sets that share the anchor of a word
    (see the module's text) are candidates of the smallest id there. That joins
    most of a group of near copies at the price of a few candidates for each.
    Then by prefixes (see `prefixes`), which miss no pair: two sets that reach
    `least` share a shingle among the first few of each, in any order of all
    shingles. Only pairs between components are still looked at, so a group
    that has come together never becomes all its pairs. All candidates are
    compared by their shingles.

    Ids are integers; rows with a null id get a null component_id. Null and
    empty texts have no words and are linked with each other; texts of fewer
    than `size` words are one shingle. Repeated rows come back as often as they
    came; rows of one id with different texts are linked by any of these texts
    or by the least of them; an empty table gives an empty result; other columns
    are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints, sketch = wide_fingerprints(docs, "id", "text", size)
    lanes = [F.first(f).alias(f) for f in (*LANES, "n")]
    distinct = materialize(prints.where("id IS NOT NULL").groupBy("set").agg(F.min("id").alias("least"), *lanes), "distinct")
    keys = materialize(anchor_keys(distinct, tables), "anchors")
    shared = keys.groupBy("key").agg(F.min("least").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    met = keys.withColumnRenamed("least", "b").join(shared, "key").where("a <> b").select("a", "b").distinct()
    links = _verified(met, docs, distinct, size, least)
    release(keys)
    found = connected_components(links)
    postings = prefixes.shared_postings(docs, prints, distinct, sketch, size, least)
    turn, whole = 0, False
    while not whole:
        met, whole = prefixes.crossing(postings, found, least, turn)
        more = _verified(met, docs, distinct, size, least)
        before, links = links, materialize(links.unionByName(more), "links")
        release(met, more, before)
        found = connected_components(links)
        turn += 1
    release(postings, links)
    named = distinct.join(found.withColumnRenamed("node", "least"), "least", "left").select("set", F.coalesce("component", "least").alias("component_id"))
    told = prints.where("id IS NOT NULL").join(named, "set").select(F.col("id").alias(id_col), "component_id")
    return told.unionByName(prints.where("id IS NULL").select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("component_id")))
