"""Scores of documents under a unigram model of words and a context tree over bytes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of, map_rows, materialize, most_frequent, slices
from .ctw import byte_grams, gram_bits, gram_counts, lower_bytes

#: Bits for the number of a text within a slice, below those of a gram.
_ROW = np.uint64(20)
#: Words whose counts are sent to every task; the counts of all others are joined.
HEAD = 1 << 17


def tokens(text: str) -> list[bytes]:
    """Words in lower case (A-Z) as UTF-8, then the end, which is empty. Bytes are split at the six ASCII white-space characters."""
    return [*lower_bytes(text).split(), b""]


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; counted in each task before anything is shuffled."""

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        seen: Counter[bytes] = Counter()
        for (texts,) in batches:
            for text in texts:
                seen.update(tokens(text or ""))
                if len(seen) > 1 << 19:
                    yield {"word": list(seen), "n": list(seen.values())}
                    seen.clear()
        if seen:
            yield {"word": list(seen), "n": list(seen.values())}

    return map_rows(df, [text_col], rows, {"word": "binary", "n": "long"}).groupBy("word").agg(F.sum("n").alias("n"))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))


def _first_scores(df: DataFrame, head: dict[bytes, int], grams: np.ndarray, lengths: np.ndarray, depth: int, id_col: str, text_col: str) -> DataFrame:
    """What a task can say of each text alone: code length and known words by the heads, and the grams and words it must look up."""
    sent = df.sparkSession.sparkContext.broadcast((head, grams, lengths))

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        head, frequent, lengths = sent.value
        part, row = TaskContext.get().partitionId(), 0
        for keys, texts in batches:
            texts = [t or "" for t in texts]
            for some in slices(texts, 1 << 20):
                grams, n_bytes = byte_grams(texts[some], depth)
                text_of = np.repeat(np.arange(len(n_bytes), dtype=np.uint64), n_bytes)
                marked = np.sort((grams << _ROW) | text_of)
                first = np.flatnonzero(np.append(True, marked[1:] != marked[:-1]))
                times = np.diff(np.append(first, len(marked)))
                names, owner = marked[first] >> _ROW, (marked[first] & ((np.uint64(1) << _ROW) - np.uint64(1))).astype(np.int64)
                at = np.minimum(np.searchsorted(frequent, names), max(0, len(frequent) - 1))
                told = frequent[at] == names if len(frequent) else np.zeros(len(names), bool)
                bits = np.bincount(owner[told], times[told] * lengths[at[told]], len(n_bytes)) if len(frequent) else np.zeros(len(n_bytes))
                order = np.argsort(owner[~told], kind="stable")
                sizes = np.bincount(owner[~told], minlength=len(n_bytes))
                looked_up = {"grams": _lists(names[~told][order].view(np.int64), sizes), "gram_times": _lists(times[~told][order].astype(np.int32), sizes)}
                out = []
                for text in texts[some]:
                    counts = Counter(tokens(text))
                    seen = [head.get(w, 0) for w in counts]
                    times = list(counts.values())
                    rare = [(w, n) for w, n, c in zip(counts, times, seen, strict=True) if not c]
                    n_times = np.array(times)
                    log_counts = np.log10(np.array(seen) + 1.0)  # of words outside the head nothing
                    out.append((part, row, counts.total(), counts.total() - sum(n for _, n in rare), float(n_times @ log_counts), [w for w, _ in rare], [n for _, n in rare]))
                    row += 1
                columns = dict(zip(list(fields)[5:], zip(*out, strict=True), strict=True))
                yield {id_col: keys[some], "n_bytes": n_bytes, "bits": bits} | looked_up | columns

    fields = {id_col: kind_of(df, id_col), "n_bytes": "long", "bits": "double", "grams": "array<bigint>", "gram_times": "array<int>", "part": "int", "row": "long", "n_tokens": "long", "known": "long", "logs": "double", "rare": "array<binary>", "times": "array<int>"}
    return map_rows(df, [id_col, text_col], rows, fields)


def score_documents(df: DataFrame, training: Column, depth: int = 4, nodes: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Scores every whole text by a context tree and by Laplace-smoothed unigrams, both learned where `training` is true.

    Returns (id, n_tokens, n_known, train_tokens, base_score, score, n_bytes).
    score: log10 of the context tree's probability of the lower-cased bytes of
    the text and an end mark; base_score: the sum over tokens of log10((c + 1) /
    (N + V + 1)). Null texts count as empty: the end alone. A null in
    `training` counts as false. Repeated rows come back as often as they came.
    Without training rows every token is unknown and every bit has probability
    1/2. An empty table gives an empty result; other columns are not read.

    The tree holds every gram of the training texts (see `ctw.gram_bits`). The
    counts of the `head` most frequent words and the code lengths of the
    `nodes` most frequent grams are sent to every task; every other word or
    gram is looked up by a join in which it counts once for each document, so
    the two sizes do not change a result.
    """
    docs = df.select(F.col(id_col), F.col(text_col), F.coalesce(training, F.lit(False)).alias("__learn"))
    learned = docs.where("__learn")
    lengths = materialize(gram_bits(materialize(gram_counts(docs, depth, text_col, "__learn"), "grams"), depth), "lengths")
    cached = most_frequent(lengths, nodes, "seen")[0].select("gram", "bits").toArrow()
    cached_grams, cached_bits = cached["gram"].to_numpy().view(np.uint64), cached["bits"].to_numpy()
    order = np.argsort(cached_grams)
    vocabulary = materialize(word_counts(learned, text_col), "words")
    totals = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    frequent = most_frequent(vocabulary, head, "n")[0].select("word", "n").toArrow().to_pydict()
    first = materialize(_first_scores(docs, dict(zip(frequent["word"], frequent["n"], strict=True)), cached_grams[order], cached_bits[order], depth, id_col, text_col), "scores")
    rare = first.select("part", "row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("part", "row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    found = rare.join(vocabulary, "word").groupBy("part", "row").agg(F.sum("times").alias("known_rare"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("logs_rare"))
    open_grams = first.select("part", "row", F.explode(F.arrays_zip("grams", "gram_times")).alias("g")).select("part", "row", F.col("g.grams").alias("gram"), F.col("g.gram_times").alias("times"))
    told = open_grams.join(lengths, "gram").groupBy("part", "row").agg(F.sum(F.col("times") * F.col("bits")).alias("bits_rare"))
    joined = first.drop("rare", "times", "grams", "gram_times").join(found, ["part", "row"], "left").join(told, ["part", "row"], "left")
    base = F.col("logs") + F.coalesce("logs_rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    known = F.col("known") + F.coalesce("known_rare", F.lit(0))
    return joined.select(id_col, "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), ((F.col("bits") + F.coalesce("bits_rare", F.lit(0.0))) * -math.log10(2)).alias("score"), "n_bytes")
