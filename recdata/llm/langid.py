"""Language identification with word-first backoff.

A word that training has seen scores each language by its log frequency there.
Any other word is covered from its start by the longest character n-grams that
training has seen, falling back to shorter ones, down to single characters; a
character that is not known says nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, map_rows, materialize, most_frequent

_LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: To the counts of a language come those of so many features from all languages together. A rare feature of a large language so says little for a small one that has never had it.
PRIOR = 10.0
#: Marks the ends of a word in its n-grams.
EDGE = "\x00"


def features(word: str) -> Iterator[str]:
    """The n-grams of a word with its ends marked, longest first."""
    marked = f"{EDGE}{word}{EDGE}"
    for n in range(min(LONGEST, len(marked)), 0, -1):
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


def word_counts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, feature, n): words over all texts, counted in each task before anything is shuffled."""

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        words: dict[str, Counter[str]] = {}

        def flush() -> Iterator[dict]:
            for lang, counts in words.items():
                yield {"lang": [lang] * len(counts), "feature": list(counts), "n": list(counts.values())}
            words.clear()

        for langs, texts in batches:
            for lang, text in zip(langs, texts, strict=True):
                words.setdefault(lang, Counter()).update(_LETTERS.findall((text or "").lower()))
                if sum(map(len, words.values())) > 1 << 18:
                    yield from flush()
        yield from flush()

    fields = {"lang": "string", "feature": "string", "n": "long"}
    return map_rows(df, [lang_col, text_col], rows, fields).groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, feature, n): n-grams of a table of word counts, so each word is taken apart once for each language."""

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        grams: Counter[tuple[str, str]] = Counter()

        def flush() -> Iterator[dict]:
            if grams:
                yield {"lang": [k[0] for k in grams], "feature": [k[1] for k in grams], "n": list(grams.values())}
            grams.clear()

        for langs, words, counts in batches:
            for lang, word, n in zip(langs, words, counts, strict=True):
                for gram in features(word):
                    grams[lang, gram] += n
                if len(grams) > 1 << 18:
                    yield from flush()
        yield from flush()

    fields = {"lang": "string", "feature": "string", "n": "long"}
    return map_rows(words, ["lang", "feature", "n"], rows, fields).groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Head:
    """The most frequent features and their log frequencies by language; `whole` if the table has no others."""

    def __init__(self, table: DataFrame, most: int, n_langs: int) -> None:
        found = most_frequent(table, most, "n")[0].select("feature", "scores").toArrow()
        self.at = {name: k for k, name in enumerate(found["feature"].to_pylist())}
        self.matrix = np.array(found["scores"].to_pylist(), float).reshape(len(self.at), n_langs)
        self.whole = len(self.at) == table.count()


@dataclass
class Model:
    """Log frequencies of all words and n-grams by language, as tables (feature, n, scores), and the heads of both."""

    langs: list[str]
    prior: np.ndarray
    words: DataFrame
    grams: DataFrame
    word_head: Head
    gram_head: Head


def cover(word: str, scores: Callable[[str], np.ndarray | None], n_langs: int) -> np.ndarray:
    """The scores of a word by the longest known n-grams that cover it from its start."""
    marked, i, out = f"{EDGE}{word}{EDGE}", 0, np.zeros(n_langs)
    while i < len(marked):
        for n in range(min(LONGEST, len(marked) - i), 0, -1):
            if (found := scores(marked[i : i + n])) is not None:
                out = out + found
                i += n
                break
        else:
            i += 1
    return out


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", most_words: int = 1 << 17, most_grams: int = 1 << 17) -> Model:
    """A model of all rows of `df` with a language.

    Every word and n-gram of every text stays in the model's tables. The most
    frequent ones, as many as the two limits, are sent to the tasks, so that
    only others have to be joined; the limits do not change a result.
    """
    rows = df.where(F.col(lang_col).isNotNull())
    words = materialize(word_counts(rows, lang_col, text_col), "words")
    grams = materialize(gram_counts(words), "grams")
    priors = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(priors)
    tables = []
    for counts in (words, grams):
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        common = F.sum("n") * (PRIOR / max(1, sum(totals.values())))
        by_lang = [F.log((F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)) + common) / (totals.get(lang, 0) + PRIOR)) for lang in langs]
        tables.append(materialize(counts.groupBy("feature").agg(F.sum("n").alias("n"), F.array(*by_lang).cast("array<double>").alias("scores")), "scores"))
    n_docs = np.array([priors[lang] for lang in langs], float)
    heads = [Head(table, most, len(langs)) for table, most in zip(tables, (most_words, most_grams), strict=True)]
    return Model(langs, np.log(n_docs / n_docs.sum()) if langs else n_docs, *tables, *heads)


def _by_grams(unknown: DataFrame, model: Model) -> DataFrame:
    """(feature, scores) of words that training has not seen: each once, covered by n-grams of the head or, by a join, of the whole table."""
    n_langs = len(model.langs)
    sent = unknown.sparkSession.sparkContext.broadcast((model.gram_head.at, model.gram_head.matrix))

    def missing(batches: Iterator[tuple]) -> Iterator[dict]:
        head = sent.value[0]
        for (words,) in batches:
            pairs = [(word, gram) for word in words for gram in set(features(word)) if gram not in head]
            yield {"feature": [word for word, _ in pairs], "gram": [gram for _, gram in pairs]}

    def covered(batches: Iterator[tuple]) -> Iterator[dict]:
        head, matrix = sent.value
        for words, names, rows in batches:
            out = []
            for word, some, scores in zip(words, names, rows, strict=True):
                more = {name: np.array(scores[k * n_langs : (k + 1) * n_langs]) for k, name in enumerate(some or [])}
                out.append(cover(word, lambda gram: matrix[at] if (at := head.get(gram)) is not None else more.get(gram), n_langs).tolist())
            yield {"feature": words, "scores": out}

    if model.gram_head.whole:
        given = unknown.select("feature", F.lit(None).cast("array<string>").alias("names"), F.lit(None).cast("array<double>").alias("rows"))
    else:
        pairs = map_rows(unknown, ["feature"], missing, {"feature": "string", "gram": "string"})
        found = pairs.join(model.grams.select(F.col("feature").alias("gram"), "scores"), "gram").groupBy("feature").agg(F.collect_list(F.struct("gram", "scores")).alias("found"))
        given = unknown.join(found, "feature", "left").select("feature", F.col("found.gram").alias("names"), F.flatten("found.scores").alias("rows"))
    return map_rows(given, ["feature", "names", "rows"], covered, {"feature": "string", "scores": "array<double>"})


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text.

    score is the probability of lang_pred by the model. A text that is null or
    has no letter gets `und` and 0, and so does every text if the model knows
    no language. Ties go to the language that comes first by name. Repeated
    rows come back as often as they came; an empty table gives an empty result;
    other columns are not read. Words outside the model's head are scored once
    each and joined, in one row for each text and word.
    """
    if not model.langs:
        return df.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = df.sparkSession.sparkContext.broadcast((model.prior, model.word_head.at, model.word_head.matrix))

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        prior, head, matrix = sent.value
        part, row = TaskContext.get().partitionId(), 0
        for keys, texts in batches:
            out: dict[str, list] = {name: [] for name in fields}
            for key, text in zip(keys, texts, strict=True):
                counts = Counter(_LETTERS.findall((text or "").lower()))
                at: list[int] = []
                times: list[int] = []
                rare: dict[str, int] = {}
                for word, n in counts.items():
                    if (found := head.get(word)) is None:
                        rare[word] = n
                    else:
                        at.append(found)
                        times.append(n)
                letters = any(c.isalpha() for word in counts for c in word)  # superscripts pass the pattern
                total = prior + np.array(times, float) @ matrix[at] if at else prior
                for name, value in zip(fields, (key, part, row, letters, total.tolist(), list(rare), list(rare.values())), strict=True):
                    out[name].append(value)
                row += 1
            yield out

    fields = {id_col: kind_of(df, id_col), "__part": "int", "__row": "long", "__letters": "boolean", "__total": "array<double>", "__rare": "array<string>", "__times": "array<int>"}
    first = materialize(map_rows(df, [id_col, text_col], rows, fields), "first")
    rare = first.select("__part", "__row", F.explode(F.arrays_zip("__rare", "__times")).alias("w")).select("__part", "__row", F.col("w.__rare").alias("feature"), F.col("w.__times").alias("times"))
    wanted = materialize(rare.select("feature").distinct().join(model.words.select("feature", "scores"), "feature", "left"), "wanted")
    scored = wanted.where("scores IS NOT NULL").unionByName(_by_grams(wanted.where("scores IS NULL").select("feature"), model))
    sums = [F.sum(F.col("times") * F.get("scores", F.lit(k))) for k in range(len(model.langs))]
    found = rare.join(scored, "feature").groupBy("__part", "__row").agg(F.array(*sums).alias("__more"))
    total = F.when(F.col("__more").isNull(), F.col("__total")).otherwise(F.zip_with("__total", "__more", lambda a, b: a + b))
    joined = first.drop("__rare", "__times").join(found, ["__part", "__row"], "left").withColumn("__total", total).withColumn("__best", F.array_max("__total"))
    name = F.get(F.array(*map(F.lit, model.langs)), (F.array_position("__total", F.col("__best")) - 1).cast("int"))
    chance = 1 / F.aggregate("__total", F.lit(0.0), lambda acc, t: acc + F.exp(t - F.col("__best")))
    return joined.select(id_col, F.when(F.col("__letters"), name).otherwise("und").alias("lang_pred"), F.when(F.col("__letters"), chance).otherwise(0.0).alias("score"))
