"""Alignment of two tokenizers over a corpus, by inverted bitmaps of id pairs.

Two tokens are linked where their bytes end together. For each pair of ids the
documents that link them are kept as a bitmap, cut into containers of
consecutive documents: one plane of bits for each binary digit of how often a
document links the pair, so that popcounts of the planes give the number of
links, and the popcount of all planes together (OR) the number of documents.
Containers that few documents share store slots instead of bits. Counts of
pairs then go back along the postings: each bitmap is opened again, and adds
the count of its pair to the documents in it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONG, encode_text, encoding
from .common import kind_of, map_rows, materialize, slices

#: Documents of a container, and the pairs of a container at which it is closed early: they bound a container's memory.
SLOTS, PAIRS = 1024, 1 << 20
#: Ids of a vocabulary for which texts are kept ready.
WIDEST = 1 << 16
#: Documents up to which a bitmap is stored as slots.
FEW = 48


@functools.lru_cache(maxsize=2)
def pieces(model_file: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes], np.ndarray]:
    """(the model, the bytes of each id, their lengths), once for each worker: a piece in UTF-8 with U+2581 as a space, <0xHH> as one byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.vocab_size()))]
    return model, table, np.array([len(x) for x in table], np.int64)


@functools.lru_cache(maxsize=2)
def ranked(rank_file: str, pattern: str) -> np.ndarray:
    """How many bytes each id of a byte-level vocabulary stands for."""
    codec = encoding(rank_file, pattern)
    sizes = np.zeros(codec.n_vocab, np.int64)
    for token, rank in codec._mergeable_ranks.items():
        sizes[rank] = len(token)
    return sizes


@functools.lru_cache(maxsize=2)
def _cuts_at_blanks(model_file: str) -> bool:
    """Whether no piece of a model has a blank after another character, so that nothing is merged across such a place."""
    model = pieces(model_file)[0]
    return not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.vocab_size()))


def piece_ids(model_file: str, text: str, most: int = LONG) -> np.ndarray:
    """The ids of a whole text. A long one is encoded in parts that begin at a blank after another character, which stands for the blank that the model puts first."""
    model = pieces(model_file)[0]
    parts, start = [], 0
    while len(text) - start > most and _cuts_at_blanks(model_file):
        at = text.find(" ", start + most)
        while at >= 0 and text[at - 1] in " ▁":
            at = text.find(" ", at + 1)
        if at < 0 or at + 1 == len(text):
            break
        parts.append(text[start:at])
        start = at + 1
    parts.append(text[start:])
    ids = model.encode(parts, num_threads=1)
    return np.array([i for part in ids for i in part], np.int64)


def tokens_of(text: str, rank_file: str, pattern: str, model_file: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids A, byte ends A, ids B, byte ends B) of a blank and the text; nothing where either does not give these bytes back."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none, none, none
    whole = " " + text
    raw = whole.encode()
    codec, sizes = encoding(rank_file, pattern), ranked(rank_file, pattern)
    _, pieces_table, piece_sizes = pieces(model_file)
    a = encode_text(codec, whole).astype(np.int64)
    b = piece_ids(model_file, text)
    # A's tokens are pieces of the bytes themselves, so their lengths tell; B normalises, so its bytes must be compared
    if sizes[a].sum() != len(raw) or b"".join(map(pieces_table.__getitem__, b.tolist())) != raw:
        return none, none, none, none
    return a, np.cumsum(sizes[a]), b, np.cumsum(piece_sizes[b])


@functools.lru_cache(maxsize=1)
def _written(n: int) -> list[str]:
    """The ids below `n` as text with a comma after them, then with a bar, then with a semicolon."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(n)]


def aligned(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[int, np.ndarray, str]:
    """(number of groups, the pair a * 2^32 + b of each link, the groups written out)."""
    if not len(a):
        return 0, np.zeros(0, np.int64), ""
    # tokens have a byte at least, so in each list every end stands once
    common = ends_a[ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)] == ends_a]
    links = (a[np.searchsorted(ends_a, common)] << 32) | b[np.searchsorted(ends_b, common)]
    # each token belongs to the first group that ends where it ends or later; A's come first in a group
    side = np.concatenate([2 * np.searchsorted(common, ends_a), 2 * np.searchsorted(common, ends_b) + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    mark = np.full(len(side), 2)
    mark[:-1] = np.where(side[1:] == side[:-1], 0, np.where(side[1:] >> 1 == side[:-1] >> 1, 1, 2))
    n = max(WIDEST, int(a.max()) + 1, int(b.max()) + 1)
    groups = "".join(map(_written(n).__getitem__, (mark * n + np.concatenate([a, b])[order]).tolist()))
    return len(common), links, groups[:-1]


def pack_planes(slots: np.ndarray, times: np.ndarray) -> bytes:
    """The bitmap of one pair in one container: which documents link it, and how often.

    First byte 0: slots as unsigned 16-bit, then times as unsigned 32-bit, for
    `FEW` documents at most. Else the number of planes, and the planes, lowest
    digit first, of SLOTS bits each.
    """
    if len(slots) <= FEW:
        return b"\0" + slots.astype("<u2").tobytes() + times.astype("<u4").tobytes()
    n = int(times.max()).bit_length()
    planes = np.zeros((n, SLOTS), np.uint8)
    planes[:, slots] = (times >> np.arange(n, dtype=times.dtype)[:, None]) & 1
    return bytes([n]) + np.packbits(planes, axis=1, bitorder="little").tobytes()


def open_planes(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(slots, times) of a bitmap."""
    n = packed[0]
    if not n:
        k = (len(packed) - 1) // 6
        return np.frombuffer(packed, "<u2", k, 1).astype(np.int64), np.frombuffer(packed, "<u4", k, 1 + 2 * k).astype(np.int64)
    planes = np.unpackbits(np.frombuffer(packed, np.uint8, offset=1).reshape(n, -1), axis=1, bitorder="little")
    slots = np.flatnonzero(planes.any(axis=0))
    return slots, (planes[:, slots].astype(np.int64) << np.arange(n)[:, None]).sum(axis=0)


def popcounts(packed: bytes) -> tuple[int, int]:
    """(documents, links) of a bitmap: the bits of the planes OR-merged, and those of each plane times its weight."""
    n = packed[0]
    if not n:
        k = (len(packed) - 1) // 6
        return k, int(np.frombuffer(packed, "<u4", k, 1 + 2 * k).sum(dtype=np.int64))
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(n, -1)
    return int(np.bitwise_count(np.bitwise_or.reduce(planes)).sum()), int((np.bitwise_count(planes).sum(axis=1, dtype=np.int64) << np.arange(n)).sum())


def _postings(slots: list[np.ndarray], pairs: list[np.ndarray], times: list[np.ndarray], container: int) -> dict:
    """The bitmaps of one container, a row for each pair."""
    slot, pair, count = np.concatenate(slots), np.concatenate(pairs), np.concatenate(times)
    order = np.argsort(pair, kind="stable")
    slot, pair, count = slot[order], pair[order], count[order]
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(pair)).astype(np.int64)
    packed = [pack_planes(slot[s:e], count[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    told = [popcounts(x) for x in packed]
    return {"container": [container] * len(packed), "pair": pair[starts], "planes": packed, "docs": [x[0] for x in told], "links": [x[1] for x in told]}


_DOC = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "binary"}
_POSTING = {"pair": "long", "planes": "binary", "docs": "long", "links": "long"}


def index(df: DataFrame, rank_file: str, pattern: str, model_file: str, id_col: str, text_col: str) -> DataFrame:
    """Both kinds of rows in one pass: documents (slot not null) and postings (pair not null), stored.

    A container holds documents of one input partition: its number is made of
    that of the partition and a count within it.
    """
    fields = {"id": kind_of(df, id_col), "container": "long", "slot": "int", **_DOC, **_POSTING}

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        container, held = TaskContext.get().partitionId() << 32, 0
        docs: list[tuple] = []
        slots, pairs, times = [], [], []

        def closed() -> Iterator[dict]:
            nothing = [None] * len(docs)
            columns = dict(zip(("id", "container", "slot", *_DOC), zip(*docs, strict=True), strict=True))
            yield {**columns, **dict.fromkeys(_POSTING, nothing)}
            found = _postings(slots, pairs, times, container)
            for first in range(0, len(found["planes"]), 1 << 14):
                part = {k: v[first : first + (1 << 14)] for k, v in found.items()}
                yield {**dict.fromkeys(fields, [None] * len(part["planes"])), **part}

        for keys, texts in batches:
            for part in slices([t or "" for t in texts], 1 << 20):
                for key, text in zip(keys[part], texts[part], strict=True):
                    a, ends_a, b, ends_b = tokens_of(text or "", rank_file, pattern, model_file)
                    n, links, groups = aligned(a, ends_a, b, ends_b)
                    some, how_often = np.unique(links, return_counts=True)
                    docs.append((key, container, len(docs), len(a), len(b), n, len(links), hashlib.sha256(groups.encode()).hexdigest().encode() if n else b""))
                    slots.append(np.full(len(some), len(slots), np.int64))
                    pairs.append(some)
                    times.append(how_often.astype(np.int64))
                    held += len(some)
                    if len(docs) == SLOTS or held >= PAIRS:
                        yield from closed()
                        docs.clear(), slots.clear(), pairs.clear(), times.clear()
                        container, held = container + 1, 0
        if docs:
            yield from closed()

    return materialize(map_rows(df, [id_col, text_col], rows, fields), "alignment")


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, docs, links, best): how many documents and links hold each pair, and whether no pair of its B id has more links.

    Popcounts are added up where the bitmaps are read, so a pair of every
    document is one number for each task.
    """
    counted = materialize(postings.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    most = counted.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counted.withColumn("b", b).join(most, "b").select("pair", "docs", "links", (F.col("links") == F.col("most")).alias("best"))


def align(df: DataFrame, rank_file: str, pattern: str, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: how its tokens by a byte-level BPE (A) and by a sentencepiece model (B) meet.

    Returns (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): groups
    is the SHA-256 of the aligned groups in hexadecimal, empty without tokens;
    count_sum adds up how many links of the whole corpus hold the pair of each
    link; n_best counts links whose pair is among the most frequent of its B id.
    Strings of special tokens are plain text. A null or empty text, and one that
    a tokenizer does not give back byte by byte, has no tokens and zeros. Ids
    are not looked at, so repeated rows, null and equal ids each count and come
    back as often as they came; an empty table gives an empty result; other
    columns are not read. Very long texts are tokenised in parts; a container
    ends early when they fill it. No key of a shuffle has more rows than there
    are containers, or pairs in one container.
    """
    stored = index(df, rank_file, pattern, model_file, id_col, text_col)
    postings = stored.where("pair IS NOT NULL").select("container", *_POSTING)
    counts = pair_counts(postings).select("pair", F.col("links").alias("count"), "best")
    met = postings.select("container", "pair", "planes").join(counts, "pair").select("container", "planes", "count", "best")

    def scores(frame: pd.DataFrame) -> pd.DataFrame:
        total, best = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for packed, count, top in zip(frame["planes"], frame["count"].tolist(), frame["best"].tolist(), strict=True):
            slots, times = open_planes(packed)
            total[slots] += times * count
            if top:
                best[slots] += times
        some = np.flatnonzero(total)
        return pd.DataFrame({"container": int(frame["container"].iloc[0]), "slot": some.astype(np.int32), "count_sum": total[some], "n_best": best[some]})

    told = met.groupBy("container").applyInPandas(scores, "container long, slot int, count_sum long, n_best long")
    docs = stored.where("slot IS NOT NULL").select("id", "container", "slot", *_DOC)
    zero = F.lit(0).cast("long")
    return docs.join(told, ["container", "slot"], "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), F.col("groups").cast("string").alias("groups")
    )
