"""Packing by shortest-pack-first over the histogram of lengths.

Krell et al., "Efficient Sequence Packing without Cross-contamination", 2021:
only the histogram of lengths goes to the driver. Lengths are placed longest
first, each into the shortest packs (those with most room), and packs of one
composition are handled together as a pattern with a count. The patterns are
then joined back to the pieces by the rank of a piece among those of its
length.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encode_text, encoding
from .common import kind_of, map_rows, materialize

Pattern = tuple[tuple[int, ...], int]


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Patterns (lengths, how many packs) that hold each length as often as the histogram has it.

    Each length splits at most one group of packs beside those it fills, so
    the patterns number at most a small multiple of `size`, whatever the counts.
    """
    groups: list[tuple[int, int, tuple[int, ...], int]] = []  # least used first: used, order, lengths, packs
    order = 0
    for length in sorted(histogram, reverse=True):
        left, back = histogram[length], []
        while left:
            if groups and groups[0][0] + length <= size:
                used, _, lengths, packs = heapq.heappop(groups)
                taken = min(packs, left)
                if packs > taken:
                    order += 1
                    back.append((used, order, lengths, packs - taken))
                grown = (*lengths, length)
            else:
                used, grown, taken = 0, (length,), left
            order += 1
            heapq.heappush(groups, (used + length, order, grown, taken))
            left -= taken
            for group in back:
                heapq.heappush(groups, group)
            back = []
    merged: Counter[tuple[int, ...]] = Counter()
    for _, _, lengths, packs in groups:
        merged[lengths] += packs
    return sorted(merged.items())


def slots(patterns: list[Pattern]) -> np.ndarray:
    """The places of a packing, sorted by (length, rank): length, first rank, sequence of that rank, offset.

    A place stands for consecutive ranks of one length in consecutive sequences.
    """
    rows, ranks, sequence = [], Counter(), 0
    for lengths, packs in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, ranks[length], sequence, offset))
            ranks[length] += packs
            offset += length
        sequence += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def token_ids(codec: tiktoken.Encoding, text: str, specials: dict[str, int]) -> np.ndarray:
    """The ids of a text in which each string of `specials` stands for its id, as for the tokenizers library."""
    if not any(name in text for name in specials):
        return encode_text(codec, text)
    parts = re.split("(" + "|".join(map(re.escape, specials)) + ")", text)
    return np.concatenate([np.array([specials[part]], np.uint32) if k % 2 else encode_text(codec, part) for k, part in enumerate(parts)])


def token_pieces(df: DataFrame, rank_file: str, pattern: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", specials: dict[str, int] | None = None) -> DataFrame:
    """The ids of each text with `end_id` after them, cut into pieces of at most `size`.

    `specials`: strings that stand for one id each; without them such strings are ordinary text.

    Returns (id, start, length, ids binary: little-endian unsigned 32-bit,
    doc_tokens, part, place): `place` counts the earlier pieces of that
    length in the input partition `part`. A null text counts as empty and gives
    a piece with `end_id` alone.
    """
    fields = {id_col: kind_of(df, id_col), "start": "long", "length": "long", "ids": "binary", "doc_tokens": "long", "part": "int", "place": "long"}

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        codec, part, seen = encoding(rank_file, pattern), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4")
        for keys, texts in batches:
            for first in range(0, len(keys), 512):
                out: list[tuple] = []
                for key, text in zip(keys[first : first + 512], texts[first : first + 512], strict=True):
                    ids = np.concatenate([token_ids(codec, text or "", specials or {}).astype("<u4"), end])
                    for start in range(0, len(ids), size):
                        piece = ids[start : start + size]
                        out.append((key, start, len(piece), piece.tobytes(), len(ids), part, seen[len(piece)]))
                        seen[len(piece)] += 1
                yield dict(zip(fields, zip(*out, strict=True), strict=True))

    return map_rows(df, [id_col, text_col], rows, fields)


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with columns length, part and place.

    The pieces must be stored (their `part` and `place` may not change when read
    again). Pieces of equal length are interchangeable: which of them gets which
    sequence follows from (part, place). Sequences are numbered from 0 without
    gaps. Only the histogram (at most `size` rows) reaches the driver, and only
    the places (bounded by `size`, see `shortest_pack_first`) are sent to all
    tasks. The join on (part, length) adds to each piece how many pieces of its
    length lie in earlier partitions; no key of it holds more rows than one
    partition has.
    """
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    places = slots(shortest_pack_first(histogram, size))
    wide = np.int64(1) << 44  # ranks of one length stay below it
    keys = places[:, 0] * wide + places[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = places[np.searchsorted(keys, length.to_numpy() * wide + rank.to_numpy(), side="right") - 1]
        return pd.DataFrame({"sequence_id": at[:, 2] + rank.to_numpy() - at[:, 1], "offset": at[:, 3]})

    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    return ranked.withColumn("at", place("length", "rank")).select("*", "at.sequence_id", "at.offset").drop("part", "place", "before", "rank", "at")


def pack_documents(df: DataFrame, rank_file: str, pattern: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", instead: dict[str, Column] | None = None, specials: dict[str, int] | None = None) -> DataFrame:
    """Tokenises, cuts and packs every whole text; see `token_pieces` and `pack`.

    `instead`: columns made from `ids` that stand in its place, where the ids
    themselves are not wanted; they are made before anything is stored, so that
    the ids are neither stored nor shuffled.

    Null texts count as empty; repeated rows and ids are packed as often as they
    come; an empty table gives no rows; other columns are not read, so their
    names cannot clash.
    """
    pieces = token_pieces(df, rank_file, pattern, size, end_id, id_col, text_col, specials)
    if instead is not None:
        pieces = pieces.withColumns(instead).drop("ids")
    return pack(materialize(pieces, "pieces"), size)
