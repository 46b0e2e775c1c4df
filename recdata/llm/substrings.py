"""Substring deduplication with a compressed FM-index for each shard.

Only text that can repeat reaches an index. Every window of `size` words is
dealt out by its anchor, the least hash among its runs of GRAM words, so equal
windows have equal anchors. An anchor that occurs in one document alone is done
with. Of every other anchor the document with the smallest id, its first
holder, is indexed, and the documents after it are streamed through that index:
neighbouring windows whose anchors have one first holder travel as one piece.
Shards are made of first holders; a shard's FM-index gives, by backward search,
the matching statistics of the pieces streamed through it, and an interval of
length `size` tells the smallest id that holds a window.

Windows that the first holder of their anchor does not have may still repeat
among the documents after it. They go through the same search once more, now
each by its own hash. Hashes only say where to look: a window goes if the index
holds its words, and windows that share a hash but not their words go round
again until none is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW, WORD, fresh, give_back, map_rows, materialize, possible, release, slices
from .fmindex import FMIndex, least_labels

#: Words of an anchor.
GRAM = 24
#: Segments with one anchor for which its index is copied once more and the streamed documents are dealt out over the copies; results do not depend on it.
HOT = 64
#: Windows of a streamed piece at most; longer ones are cut.
PIECE = 256
#: Bits of a hash; results do not depend on it.
HASH_BITS = 64
#: Words of a shard, about: those indexed and those streamed.
SHARD = 400_000

_find = re.compile(WORD).findall
_B = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_B, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Hashes of `bits` bits of ranges of words of some texts, put one after the other."""

    def __init__(self, texts: list[list[str]], bits: int) -> None:
        self.drop = np.uint64(64 - bits)
        self.counts = np.array([len(t) for t in texts], np.int64)
        flat = np.array([w for t in texts for w in t], object)
        words = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * _powers(_B, n), out=self.sums[1:])
        self.inverse = _powers(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)) >> self.drop


def segments_of(texts: list[list[str]], size: int, bits: int = 64) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in some texts: text number, first window, how many, anchor."""
    hashed = Hashed(texts, bits)
    n = int(hashed.counts.sum())
    empty = (np.zeros(0, np.int64),) * 4
    if n < size:
        return empty
    gram = min(GRAM, size)
    at = np.arange(n - gram + 1)
    least = hashed.of(at, at + gram)
    wide, span = size - gram + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    offset = np.cumsum(hashed.counts) - hashed.counts
    text = np.repeat(np.arange(len(texts)), hashed.counts)
    start = np.arange(n - size + 1)
    start = start[start + size <= (offset + hashed.counts)[text[start]]]
    if not len(start):
        return empty
    anchor = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[start[1:]] != text[start[:-1]])
    begins = np.flatnonzero(new)
    owner = text[start[begins]]
    return owner, start[begins] - offset[owner], np.diff(np.append(begins, len(start))), anchor[begins].view(np.int64)


def _segments(docs: DataFrame, size: int) -> DataFrame:
    bits = HASH_BITS

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        for ids, keys, texts in batches:
            for part in slices(texts, 1 << 21):
                owner, first, windows, anchor = segments_of([_find(t) for t in texts[part]], size, bits)
                if len(owner):
                    yield {"doc_id": np.array(ids[part], np.int64)[owner], "text_key": np.array(keys[part], np.int64)[owner], "start": first.astype(np.int32), "n": windows.astype(np.int32), "anchor": anchor}

    fields = {"doc_id": "long", "text_key": "long", "start": "int", "n": "int", "anchor": "long"}
    return map_rows(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), ["doc_id", "text_key", "text"], rows, fields)


def _shared(segments: DataFrame) -> DataFrame:
    """The segments whose anchor several documents have, with its first holder, over how many copies of the index its streams are dealt, and whether there are more than two segments."""
    anchors = segments.groupBy("anchor").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"), F.count("*").alias("n_rows"))
    copies = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_rows") / HOT)))).cast("int")
    return segments.join(anchors.where("holder < last").select("anchor", "holder", copies.alias("copies"), (F.col("n_rows") > 2).alias("more")), "anchor").drop("anchor")


_KIND = ["holder", "copies", "more"]


def _lists(shared: DataFrame) -> DataFrame:
    """The segments of each text as arrays; of repeated rows once."""
    lists = shared.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n", *_KIND)).alias("s"))
    return lists.select("doc_id", "text_key", *(f"s.{name}" for name in ("start", "n", *_KIND)))


def pieces_of(doc_id: int, start: np.ndarray, n: np.ndarray, kind: list[np.ndarray], longest: int) -> Iterator[tuple[int, int, int]]:
    """Neighbouring segments of one kind put together: number of one of them, first window, how many. Streamed pieces have `longest` windows at most."""
    order = np.argsort(start, kind="stable")
    start, n, kind = start[order], n[order], [k[order] for k in kind]
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > start[:-1] + n[:-1]
    for k in kind:
        new[1:] |= k[1:] != k[:-1]
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(start)) - 1
    for b, first, end in zip(begins.tolist(), start[begins].tolist(), (start[ends] + n[ends]).tolist(), strict=True):
        most = end - first if kind[0][b] == doc_id else longest
        for at in range(first, end, most):
            yield int(order[b]), at, min(most, end - at)


def _cut(wanted: DataFrame, size: int) -> DataFrame:
    """The words of all pieces. Those of a first holder are to be indexed, in each copy; all others are streamed."""
    fields = {"holder": "long", "copies": "int", "more": "boolean", "copy": "int", "doc_id": "long", "text_key": "long", "start": "int", "n": "int", "words": "string"}
    schema, longest = ", ".join(f"{name} {kind}" for name, kind in fields.items()), PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(name) for name in ("start", "n", *_KIND)]
            bounds = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            ids, keys, out, held = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), [], 0
            for row in range(batch.num_rows):
                words = _find(batch.column("text")[row].as_py())
                start, n, *kind = (x[bounds[row] : bounds[row + 1]] for x in flat)
                for k, at, many in pieces_of(ids[row], start, n, kind, longest):
                    holder, copies, more = (x[k].item() for x in kind)
                    copy = -1 if holder == ids[row] else hash((ids[row], at)) % copies
                    out.append((holder, copies, more, copy, ids[row], keys[row], at, many, " ".join(words[at : at + many + size - 1])))
                    held += many
                if held > 1 << 18:
                    yield _batch(out, fields)
                    out, held = [], 0
            if out:
                yield _batch(out, fields)
        give_back()

    return wanted.select("doc_id", "text_key", "text", "start", "n", *_KIND).mapInArrow(run, schema)


def _batch(rows: list[tuple], fields: dict[str, str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[kind]) for c, kind in zip(columns, fields.values(), strict=True)], names=list(fields))


class Shard:
    """The pieces of some first holders, indexed; all other text is streamed through it."""

    def __init__(self, ids: list[int], texts: list[list[str]], size: int) -> None:
        self.size, self.ids = size, np.unique(np.array(ids, np.int64))
        lengths = np.array([len(t) for t in texts], np.int64)
        codes, self.names = pd.factorize(np.array([w for t in texts for w in t], object))
        self.names = pd.Index(self.names, dtype=object)
        ends = np.cumsum(lengths + 1) - 1
        sequence = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)  # 0 after each piece
        inside = np.ones(len(sequence), bool)
        inside[ends if len(ends) else 0] = False
        sequence[inside] = codes + 1
        labels = np.repeat(np.searchsorted(self.ids, np.array(ids, np.int64)), lengths + 1) if len(ends) else np.zeros(1, np.int64)
        self.index = FMIndex(sequence, len(self.names) + 1, size, labels)

    def repeated(self, ids: np.ndarray, texts: list[list[str]]) -> np.ndarray:
        """For each window of each piece, one after the other, whether a document with a smaller id than the piece's has it."""
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        codes = self.names.get_indexer(np.array([w for t in texts for w in t], object))
        least = least_labels(self.index, np.where(codes < 0, -1, codes + 1).astype(np.int32), ends - lengths, ends)
        own = np.repeat(ids, lengths - self.size + 1)
        return (least >= 0) & (self.ids[np.maximum(least, 0)] < own)


def _search(cut: DataFrame, size: int, n_shards: int) -> DataFrame:
    """(doc_id, text_key, start, n, gone, hashes): runs of streamed windows that go, and of those that stay and may repeat elsewhere, with their hashes."""
    fields = {"doc_id": "long", "text_key": "long", "start": "int", "n": "int", "gone": "boolean", "hashes": "array<bigint>"}
    bits = HASH_BITS

    def told(shard: Shard, ids: list, keys: list, starts: list, more: list, texts: list[list[str]]) -> dict:
        gone = shard.repeated(np.array(ids, np.int64), texts)
        windows = np.array([len(t) - size + 1 for t in texts], np.int64)
        piece = np.repeat(np.arange(len(texts)), windows)
        wanted = gone | np.array(more, bool)[piece]
        new = np.ones(len(gone), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (gone[1:] != gone[:-1])
        begins = np.flatnonzero(new)
        n = np.diff(np.append(begins, len(gone)))
        begins, n = begins[wanted[begins]], n[wanted[begins]]
        owner, goes = piece[begins], gone[begins]
        within = begins - (np.cumsum(windows) - windows)[owner]
        stays = [begins[~goes], n[~goes], owner[~goes]]
        hashed = Hashed(texts, bits)
        offset = np.cumsum(hashed.counts) - hashed.counts - (np.cumsum(windows) - windows)  # from windows to words
        at = np.repeat(stays[0] - np.cumsum(stays[1]) + stays[1], stays[1]) + np.arange(stays[1].sum())
        at += np.repeat(offset[stays[2]], stays[1])
        sizes = np.where(goes, 0, n)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(hashed.of(at, at + size).view(np.int64)))
        return {"doc_id": np.array(ids, np.int64)[owner], "text_key": np.array(keys, np.int64)[owner], "start": (np.array(starts, np.int64)[owner] + within).astype(np.int32), "n": n.astype(np.int32), "gone": goes, "hashes": lists}

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        held: tuple[list, list] | None = ([], [])
        shard = None
        for copies, ids, keys, starts, more, texts in batches:
            first = next((k for k, copy in enumerate(copies) if copy >= 0), len(copies))  # those to be indexed come first
            if first:
                held[0].extend(ids[:first])
                held[1].extend(t.split(" ") for t in texts[:first])
            if first < len(copies) and shard is None:
                shard, held = Shard(*held, size), None
            for part in slices(texts[first:], 1 << 22):
                some = slice(first + part.start, first + part.stop)
                yield told(shard, ids[some], keys[some], starts[some], more[some], [t.split(" ") for t in texts[some]])

    everywhere = F.when(F.col("copy") < 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array("copy"))
    dealt = cut.withColumn("to", F.explode(everywhere)).repartition(n_shards, "holder", "copies", "more", "to").sortWithinPartitions(F.col("copy") >= 0)
    return map_rows(dealt, ["copy", "doc_id", "text_key", "start", "more", "words"], rows, fields)


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text"))


def repeated_windows(df: DataFrame, size: int = 50) -> DataFrame:
    """(doc_id, text_key, first, n): runs of windows of `size` words, in words from `first` on, that also start in a document with a smaller id.

    Documents without one have no row.
    """
    docs, marks = _keyed(df), None
    segments = materialize(_segments(docs, size), "segments")
    while True:
        shared = materialize(_shared(segments), "shared")
        release(segments)
        if marks is not None and shared.isEmpty():
            return marks
        lists = _lists(shared)
        cut = materialize(_cut(possible(docs, "doc_id", lists.select("doc_id"))[0].join(lists, ["doc_id", "text_key"]), size), "cut")
        total = cut.agg(F.sum((F.col("n") + size - 1) * F.when(F.col("copy") < 0, F.col("copies")).otherwise(1))).first()[0] or 0
        found = materialize(_search(cut, size, max(1, -(-int(total) // SHARD))), "found")
        release(shared, cut)
        gone = found.where("gone").select("doc_id", "text_key", F.col("start").alias("first"), "n")
        marks = gone if marks is None else marks.unionByName(gone)
        left = found.where("NOT gone").select("doc_id", "text_key", "start", F.posexplode("hashes").alias("at", "anchor"))
        segments = left.select("doc_id", "text_key", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n"), "anchor")


def covered_spans(firsts: list[int], counts: list[int], size: int) -> list[tuple[int, int]]:
    """Disjoint spans of words, in order, that runs of windows cover; see `repeated_windows`."""
    spans: list[list[int]] = []
    for first, n in sorted(zip(firsts, counts, strict=True)):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], first + n - 1 + size)
        else:
            spans.append([int(first), int(first + n - 1 + size)])
    return [(a, b) for a, b in spans]


def remove_repeats(df: DataFrame, size: int = 50) -> DataFrame:
    """Removes each word covered by a window of `size` words that also starts in a document with a smaller doc_id.

    `df` has doc_id (an integer) and text. Returns its rows and columns, with
    text replaced by what is left (white space between kept words as it was)
    and n_words, n_removed and spans (the spans of words removed) added or
    replaced; any other column stays, whatever its name. Windows are judged on
    the input. Repetition within one document, and between rows with the same
    doc_id, is left alone; repeated rows come back as often as they came. A
    null text stays null and has no words; with a null doc_id nothing is
    removed and no other row is compared with it. Empty tables give empty
    results.
    """
    marks = repeated_windows(df, size).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    key, own, cut_col, runs = fresh(df, "key", "id", "cut", "runs")
    marks = materialize(marks.select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("runs").alias(runs)), "marks")
    keyed = df.withColumns({key: F.xxhash64("text"), own: F.col("doc_id").cast("long")})
    touched, rest = possible(keyed, own, marks.select(own))
    word = re.compile(WORD)

    @F.pandas_udf("text string, n_words long, n_removed long, bounds array<int>")
    def cut(texts: pd.Series, firsts: pd.Series, counts: pd.Series) -> pd.DataFrame:
        out = []
        for text, some_firsts, some_counts in zip(texts, firsts, counts, strict=True):
            places = [m.span() for m in word.finditer(text or "")]
            spans = covered_spans(some_firsts.tolist(), some_counts.tolist(), size) if some_firsts is not None else []
            kept, last = [], 0
            for a, b in spans:
                kept.append(text[last : places[a][0]])
                last = places[b][0] if b < len(places) else len(text)
            out.append(("".join(kept) + text[last:] if spans else text, len(places), sum(b - a for a, b in spans), [x for span in spans for x in span]))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed", "bounds"])

    same = F.struct(F.col("text"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<int>").alias("bounds"))
    joined = touched.join(marks, [own, key], "left").withColumn(cut_col, cut("text", F.transform(runs, lambda r: r["first"]), F.transform(runs, lambda r: r["n"])))
    both = joined.select(*keyed.columns, cut_col).unionByName(rest.withColumn(cut_col, same))
    bounds = F.col(cut_col)["bounds"]
    pairs = F.transform(F.sequence(F.lit(0), (F.size(bounds) / 2).cast("int") - 1), lambda i: F.struct(F.get(bounds, 2 * i).alias("start"), F.get(bounds, 2 * i + 1).alias("end")))
    spans = F.when(F.size(bounds) > 0, pairs).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    result = {"text": F.col(cut_col)["text"], "n_words": F.col(cut_col)["n_words"], "n_removed": F.col(cut_col)["n_removed"], "spans": spans}
    return both.withColumns(result).drop(cut_col, key, own)
