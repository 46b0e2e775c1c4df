"""Corpus statistics and retrieval."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recdata.functions.text import all_letters, ngrams, sentences, tokenize
from recdata.sources.scratch import materialize

from .similarity import suffices


def ngram_idf(counts: DataFrame, total: int, from_year: int | None = None, alpha: bool = True, fold: str = "max") -> DataFrame:
    """(term, df, idf) from yearly counts (ngram, year, volumes) of a corpus with `total` volumes.

    Volumes are summed for each form, then forms that differ in case are merged
    by their maximum or sum; idf is log10(total / df). With `alpha` only
    n-grams of letters count.
    """
    rows = counts if from_year is None else counts.where(F.col("year") >= from_year)
    rows = rows.where(all_letters(F.col("ngram"))) if alpha else rows
    forms = rows.groupBy("ngram").agg(F.sum("volumes").alias("v"))
    merge = {"max": F.max, "sum": F.sum}[fold]
    terms = forms.groupBy(F.lower("ngram").alias("term")).agg(merge("v").alias("df"))
    return terms.withColumn("idf", F.log10(F.lit(float(total)) / F.col("df")))


def corpus_idf(docs: DataFrame, sizes: tuple[int, ...] = (1,), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, idf) of the n-grams of our own texts; idf is log10(texts / df)."""
    terms = docs.select(key, F.explode(F.array_distinct(ngrams(tokenize(F.col(text)), sizes))).alias("term"))
    n = docs.agg(F.count("*").alias("n_docs"))
    counted = terms.groupBy("term").agg(F.count("*").alias("df"))
    return counted.join(F.broadcast(n)).select("term", "df", F.log10(F.col("n_docs") / F.col("df")).alias("idf"))


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(tokenize(F.col(text))).alias("term")).distinct()


#: A word as the search for abbreviations sees it: white space around it, and the marks taken off both ends.
WORD, OPENING, CLOSING = r"[^\x20\x09-\x0D]+", r"^[\"'(\[{]+", r"[\"')\]},;:!?]+$"
#: Letters, with full stops inside.
ABBREVIATED = r"^\p{L}+(\.\p{L}+)*$"
#: Kiss and Strunk's threshold, and the chance of a full stop after an abbreviation.
LEAST, STOPPED = 0.3, 0.99


def abbreviations(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """(term, with_stop, without, score): words that the texts themselves show to be abbreviations, in lower case.

    Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection"
    (2006): an abbreviation nearly always has a full stop behind it. The
    log-likelihood ratio of the two being bound to each other rather than
    independent counts more for short words and for full stops inside, and less
    for every time the word stands without one. All words of all texts count.
    """
    found = docs.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))).alias("w"))
    bare = F.lower(F.regexp_replace(F.regexp_replace("w", OPENING, ""), CLOSING, ""))
    words = found.select(bare.alias("w")).select(F.regexp_replace("w", r"\.$", "").alias("term"), F.col("w").endswith(".").alias("stop")).where(F.col("term").rlike(ABBREVIATED))
    counts = materialize(words.groupBy("term").agg(F.count(F.when(F.col("stop"), 1)).alias("with_stop"), F.count(F.when(~F.col("stop"), 1)).alias("without")), "words")
    total = counts.agg(F.sum("with_stop").alias("stops"), F.sum(F.col("with_stop") + F.col("without")).alias("words"))
    rows = counts.where("with_stop > 0").join(F.broadcast(total))  # one row
    p = F.least(F.greatest(F.col("stops") / F.col("words"), F.lit(1e-9)), F.lit(1 - 1e-9))
    ratio = 2 * (F.col("with_stop") * (F.log(F.lit(STOPPED)) - F.log(p)) + F.col("without") * (F.log(F.lit(1 - STOPPED)) - F.log(1 - p)))
    letters = F.length(F.regexp_replace("term", r"\.", ""))
    score = ratio * F.exp(-letters.cast("double")) * (F.length("term") - letters + 1) * F.pow(letters.cast("double"), -F.col("without").cast("double"))
    return rows.select("term", "with_stop", "without", F.round(score, 9).alias("score")).where(F.col("score") >= least)


def split_sentences(docs: DataFrame, abbreviated: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, sentence): sentences as `functions.text.sentences` cuts them, but for cuts behind a word of `abbreviated` (term).

    Rows are pieces between possible cuts; only the last word of each is looked
    up. A short list is sent to all tasks, a long one is joined, where a hot
    word's pieces may be split by Spark.
    """
    pieces = docs.select(key, F.posexplode(sentences(F.col(text))).alias("piece", "words"))
    last = F.regexp_extract("words", r"([^\x20]*)\.$", 1)
    pieces = pieces.withColumn("term", F.lower(F.regexp_replace(last, OPENING, "")))
    known = abbreviated.select("term", F.lit(True).alias("glued")).distinct()
    known = F.broadcast(known) if known.limit(SHORT_LIST + 1).count() <= SHORT_LIST else known
    marked = pieces.join(known, "term", "left").withColumn("ends", F.when(F.col("glued"), 0).otherwise(1))
    before = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("pos", F.coalesce(F.sum("ends").over(before), F.lit(0)).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("piece", "words")))
    return placed.groupBy(key, "pos").agg(F.array_join(F.transform(ordered, lambda r: r["words"]), " ").alias("sentence"))


#: Abbreviations that are sent to all tasks, at most.
SHORT_LIST = 100_000


def query_text(fields: list[Column]) -> Column:
    from recdata.functions.text import join_fields

    return join_fields(fields, " ")


#: Texts of a block, and queries of a task, about; a task gets more where there are very many, MOST at most.
BLOCK, QUERIES, MOST = 2048, 512, 8192
#: Shelves of blocks, and copies of each, that are aimed at; blocks of a shelf at most.
SHELVES, COPIES, SHELF = 8, 8, 32
#: A term in this share of all blocks or more is bounded for all of them at once.
WIDE = 0.25
#: A term in this share of a block's texts or more is multiplied as a row of a matrix; queries multiplied at once.
DENSE, STRIPE = 1 / 16, 256
#: Terms by which like texts are put next to each other.
LEAD = 3
#: Texts whose tokens a task holds at once.
HELD = 256


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of HELD rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, HELD):
            yield batch.slice(first, HELD)


def _counted(texts: DataFrame) -> DataFrame:
    """`texts` with, instead of text: (length, terms, times, lead), its tokens, each once, and its most frequent words."""
    others = [c for c in texts.columns if c != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = [Counter(tokens) for tokens in batch.column("tokens").to_pylist()]
            lead = [" ".join(sorted((t for t in c if t.isalpha()), key=lambda t: (-c[t], t))[:LEAD]) for c in found]
            columns = [pa.array([c.total() for c in found], pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), pa.array(lead, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *columns], names=[*others, "length", "terms", "times", "lead"])

    rows = texts.select(*others, tokenize(F.col("text")).alias("tokens"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*others).schema)
    return rows.mapInArrow(count, f"{kinds}, length long, terms array<string>, times array<int>, lead string")


@dataclass
class Postings:
    """An inverted block: for each key, from starts[key] on, the numbers of the rows that have it, with a value each, and the largest value."""

    keys: pd.Index
    starts: np.ndarray
    rows: np.ndarray
    values: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, keys: np.ndarray, values: np.ndarray) -> Postings:
        codes, names = pd.factorize(keys)
        order = np.argsort(codes, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(codes, minlength=len(names)))).astype(np.int64)
        values = values[order]
        most = np.maximum.reduceat(values, starts[:-1]) if len(names) else np.zeros(0)
        return cls(pd.Index(names, dtype=object), starts, rows[order].astype(np.int32), values.astype(float), most)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where the postings of some keys stand, one key after the other."""
        sizes = self.starts[codes + 1] - self.starts[codes]
        return np.repeat(self.starts[codes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _flat(lists: pd.Series, kind: type = object) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of a column one after the other, and the row of each entry."""
    sizes = lists.map(len).to_numpy(int)
    flat = np.concatenate(lists.tolist()) if sizes.sum() else np.zeros(0)
    return np.repeat(np.arange(len(lists)), sizes), flat.astype(kind)


class Scorer:
    """Scores of a block's texts: terms that many of them have are multiplied as a matrix, the others by their postings."""

    def __init__(self, docs: Postings, n_docs: int) -> None:
        self.docs, self.n_docs = docs, n_docs
        sizes = np.diff(docs.starts)
        frequent = np.flatnonzero(sizes >= max(2, DENSE * n_docs))
        self.column = np.full(len(sizes), -1)
        self.column[frequent] = np.arange(len(frequent))
        self.matrix = np.zeros((len(frequent), n_docs))
        self.matrix[np.repeat(np.arange(len(frequent)), sizes[frequent]), docs.rows[docs.places(frequent)]] = docs.values[docs.places(frequent)]

    def scores(self, asked: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, which texts have a term of it) for queries, each by the codes of its terms and their weights."""
        row, (codes, weight) = np.repeat(np.arange(len(asked)), [len(c) for c, _ in asked]), map(np.concatenate, zip(*asked, strict=True))
        column = self.column[codes]
        dense = column >= 0
        factor = np.zeros((len(asked), len(self.matrix)))
        factor[row[dense], column[dense]] = weight[dense]
        total = factor @ self.matrix
        row, codes, weight = row[~dense], codes[~dense], weight[~dense]
        at, sizes = self.docs.places(codes), self.docs.starts[codes + 1] - self.docs.starts[codes]
        cells = np.repeat(row, sizes) * self.n_docs + self.docs.rows[at]
        np.add.at(total.reshape(-1), cells, np.repeat(weight, sizes) * self.docs.values[at])
        touched = total > 0
        for some in [k for k, (_, w) in enumerate(asked) if (w <= 0).any()]:  # where a weight is not over zero, scores do not tell
            touched[some] = False
            touched[some, self.docs.rows[self.docs.places(asked[some][0])]] = True
        return total, touched


@dataclass
class Block:
    """Texts of a block: the items of each (ids from first[k] on are those of text k), how often they have their terms, what their lengths add, and with tags the postings of the items."""

    ids: np.ndarray
    first: np.ndarray
    counts: Postings
    longer: np.ndarray
    tagged: Postings | None

    def weighed(self, k1: float) -> Postings:
        """The postings with the part of a score that is the text's."""
        tf, rows = self.counts.values.astype(float), self.counts.rows.astype(np.int64)
        values = tf * (k1 + 1) / (tf + self.longer[rows])
        most = np.maximum.reduceat(values, self.counts.starts[:-1]) if len(self.counts.keys) else np.zeros(0)
        return Postings(self.counts.keys, self.counts.starts, rows, values, most)

    def best(self, asked: pd.DataFrame, topn: int, total: np.ndarray, touched: np.ndarray) -> pd.DataFrame:
        """(query_item, doc_item, score): items that may be among the `topn` best of the queries, of those that score `least` at least; `total` and `touched` are those of `Scorer`."""
        least = asked["least"].to_numpy(float)
        least = least - 1e-7 * (1 + np.where(np.isfinite(least), np.abs(least), 0))
        names, sizes = asked["item_id"].to_numpy(), np.diff(self.first)
        if self.tagged is None:
            total[~touched] = -np.inf
            if total.shape[1] > topn:
                least = np.maximum(least, np.partition(total, total.shape[1] - topn, axis=1)[:, total.shape[1] - topn])
            q, k = np.nonzero(touched & (total >= least[:, None]))
            enough = suffices(q, total[q, k], sizes[k], np.full(len(asked), topn))  # items that share a text fill the ranking sooner
            enough = enough - 1e-7 * (1 + np.where(np.isfinite(enough), np.abs(enough), 0))
            kept = total[q, k] >= enough[q]
            q, k = q[kept], k[kept]
            places = np.repeat(self.first[k] - np.cumsum(sizes[k]) + sizes[k], sizes[k]) + np.arange(sizes[k].sum())
            return pd.DataFrame({"query_item": np.repeat(names[q], sizes[k]), "doc_item": self.ids[places], "score": np.repeat(total[q, k], sizes[k])})
        text, out = np.repeat(np.arange(len(sizes)), sizes), []
        for q, tags in enumerate(asked["tags"]):
            mine = self.tagged.keys.get_indexer(np.asarray(tags, object))
            shared = np.zeros(len(text), bool)
            shared[self.tagged.rows[self.tagged.places(mine[mine >= 0])]] = True
            some = np.flatnonzero(touched[q] & (total[q] >= least[q]))
            if not len(some):
                continue
            # the best texts, as many as hold `topn` items that share a tag
            counts = np.add.reduceat(shared, self.first[:-1], dtype=np.int64)[some]
            enough = suffices(np.zeros(len(some), int), total[q, some], counts, np.array([topn]))[0]
            some = some[total[q, some] >= enough]
            items = np.repeat(self.first[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some]) + np.arange(sizes[some].sum())
            items = items[shared[items]]
            scores = total[q, text[items]]
            low = max(least[q], np.partition(scores, len(scores) - topn)[len(scores) - topn]) if len(scores) > topn else least[q]
            items = items[scores >= low]
            out.append(pd.DataFrame({"query_item": names[q], "doc_item": self.ids[items], "score": total[q, text[items]]}))
        return pd.concat(out) if out else pd.DataFrame({"query_item": [], "doc_item": [], "score": []})


@dataclass
class Ranking:
    """What a search of blocks needs and finds; see `bm25`."""

    rows: DataFrame
    met: list[DataFrame]
    n_blocks: int
    n_queries: int

    def share_met(self) -> float:
        """The share of all pairs of a query and a block that were searched."""
        return sum(pairs.count() for pairs in self.met) / max(1, self.n_blocks * self.n_queries)


def inverted_blocks(counted: DataFrame, k1: float, b: float, avgdl: float) -> tuple[DataFrame, int]:
    """((block, docs: a Block pickled, terms, most), number of blocks): like texts next to each other, BLOCK to a block at most.

    `counted` has a row for each text: item_id (the smallest of its items), ids and, if wanted, tags: a list for each of ids.
    """
    names = ["item_id", "ids", "length", "terms", "times", *(["tags"] if "tags" in counted.columns else [])]

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, k, part = [], 0, TaskContext.get().partitionId()
        for batch in chain(_sliced(batches), [None]):
            if batch is not None:
                held.append(batch.to_pandas())
            n = sum(map(len, held))
            while n >= BLOCK or batch is None and n:
                rows = pd.concat(held)
                some, held = rows.iloc[:BLOCK].sort_values("item_id"), [rows.iloc[BLOCK:]]
                n -= len(some)
                at, keys = _flat(some["terms"])
                tf, length = _flat(some["times"], float)[1], some["length"].to_numpy(float)
                counts = Postings.of(at, keys, tf)
                # whole numbers, as small as they fit: a block is moved once for each copy
                counts = replace(counts, rows=counts.rows.astype(np.uint16 if len(some) <= 1 << 16 else np.int32), values=counts.values.astype(np.min_scalar_type(int(tf.max(initial=0)))), most=np.zeros(0))
                ids, tagged = _flat(some["ids"], int)[1], None
                if "tags" in some:
                    tagged = Postings.of(*(x := _flat(pd.Series([t for tags in some["tags"] for t in tags]))), np.ones(len(x[0])))
                block = Block(ids, np.append(0, np.cumsum(some["ids"].map(len))).astype(int), counts, k1 * (1 - b + b * length / avgdl), tagged)
                packed, postings = pickle.dumps(block), block.weighed(k1)
                columns = [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([packed], pa.binary()), pa.array([postings.keys.tolist()], pa.list_(pa.string())), pa.array([postings.most.tolist()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "k", "docs", "terms", "most"])
                k += 1

    near = counted.repartitionByRange("lead", "item_id").sortWithinPartitions("lead", "item_id").select(*names)
    stored = materialize(near.mapInArrow(invert, "part int, k int, docs binary, terms array<string>, most array<double>"), "blocks")
    sizes = stored.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row for each partition, so it may be sent to all tasks
    return stored.join(F.broadcast(before), "part").select((F.col("before") + F.col("k")).alias("block"), "docs", "terms", "most"), stored.count()


def block_bounds(terms: DataFrame, blocks: DataFrame, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """((item_id, block, bound), (item_id, rest)): what a document of a block can score at most for a query.

    The block directory (term, block, largest value) is joined with the terms of
    the queries (item_id, term, weight). A term that nearly all blocks have adds
    its largest value anywhere to the bound of every block instead, `rest`.
    Blocks without any other term of a query have no row: for them `rest` is
    the bound.
    """
    directory = blocks.select("block", F.explode(F.arrays_zip("terms", "most")).alias("t")).select("block", F.col("t.terms").alias("term"), F.col("t.most").alias("most"))
    spread = directory.groupBy("term").agg(F.count("*").alias("n"), F.max("most").alias("top"))
    weight = F.greatest("weight", F.lit(0.0))
    known = materialize(terms.join(spread, "term").withColumn("wide", F.col("n") >= WIDE * n_blocks), "terms")
    rest = known.groupBy("item_id").agg(F.sum(F.when(F.col("wide"), weight * F.col("top")).otherwise(0.0)).alias("rest"))
    narrow = known.where("NOT wide").join(directory, "term").groupBy("item_id", "block").agg(F.sum(weight * F.col("most")).alias("bound"))
    return materialize(narrow.join(rest, "item_id").select("item_id", "block", (F.col("bound") + F.col("rest")).alias("bound")), "bounds"), materialize(rest, "rest")


def search_blocks(pairs: DataFrame, weighted: DataFrame, blocks: DataFrame, topn: int, k1: float, n_blocks: int, n_queries: int) -> DataFrame:
    """(query_item, doc_item, score) of pairs (item_id, block, least): the items of the block that may be among the query's `topn` best, all of which score `least` at least.

    Blocks stand on shelves. A query goes to each shelf once, with the numbers of
    the blocks it asks for; the queries of a shelf are dealt over copies of it.
    So what is shuffled is each query SHELVES times and each block COPIES times
    at most, as long as shelves and copies may grow with the input.
    """
    width, share = min(SHELF, max(1, math.ceil(n_blocks / SHELVES))), min(MOST, max(QUERIES, math.ceil(n_queries / COPIES)))

    def search(key: tuple, asked: pd.DataFrame, shelf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, packed in zip(shelf["block"], shelf["docs"], strict=True) if len(asked) else ():
            theirs = asked[[block in some for some in asked["blocks"]]]
            if not len(theirs):
                continue
            held = pickle.loads(packed)  # noqa: S301  written by inverted_blocks
            weigher = Scorer(held.weighed(k1), len(held.first) - 1)
            # queries with one text are next to each other and scored once
            theirs = theirs.sort_values(["asker", "item_id"])
            for first in range(0, len(theirs), STRIPE):
                some = theirs.iloc[first : first + STRIPE]
                new = (some["asker"] != some["asker"].shift()).to_numpy()
                each = some[new]
                terms = _flat(each["terms"])[1]
                codes, ends = held.counts.keys.get_indexer(terms), np.cumsum(each["terms"].map(len).to_numpy(int))[:-1]
                weights = _flat(each["weights"], float)[1]
                total, touched = weigher.scores([(c[c >= 0], w[c >= 0]) for c, w in zip(np.split(codes, ends), np.split(weights, ends), strict=True)])
                at = np.cumsum(new) - 1
                out.append(held.best(some, topn, total[at], touched[at]))
        return pd.concat(out) if out else pd.DataFrame({"query_item": [], "doc_item": [], "score": []})

    visits = pairs.withColumn("shelf", F.floor(F.col("block") / width)).groupBy("shelf", "item_id").agg(F.collect_list("block").alias("blocks"), F.first("least").alias("least"))
    visits = materialize(visits, "visits")
    copies = visits.groupBy("shelf").agg(F.ceil(F.count("*") / share).alias("copies"))
    asked = visits.join(F.broadcast(copies), "shelf").withColumn("copy", F.pmod(F.xxhash64("item_id"), F.col("copies"))).drop("copies").join(weighted, "item_id")
    shelved = blocks.select(F.floor(F.col("block") / width).alias("shelf"), "block", "docs").join(F.broadcast(copies), "shelf")
    dealt = shelved.select("shelf", "block", "docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return asked.groupBy("shelf", "copy").cogroup(dealt.groupBy("shelf", "copy")).applyInPandas(search, "query_item long, doc_item long, score double")


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, eps: float = 0.25, topn: int = 1000, tags: DataFrame | None = None, ignore_tag: str = "Books") -> DataFrame:
    """(query_item, doc_item, score, rank): Okapi BM25 of each query over the documents.

    `queries` and `docs` have item_id (an integer, each once) and text. A
    negative idf is replaced by `eps` times the mean idf. With `tags` (item_id,
    tag) only items that share a tag with the query's item, other than
    `ignore_tag`, are ranked. Documents without a common term are not ranked.
    Ties go to the smaller id.

    See `bm25_ranking` for how it is found.
    """
    return bm25_ranking(queries, docs, k1, b, eps, topn, tags, ignore_tag).rows


def bm25_ranking(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, eps: float = 0.25, topn: int = 1000, tags: DataFrame | None = None, ignore_tag: str = "Books") -> Ranking:
    """`bm25` with the pairs of queries and blocks that were searched.

    Items with the same text are one text with a list of items (of the `topn`
    smallest without tags, which suffice). Queries with the same text are one
    query; with tags, which are each item's own, they share their scores. Texts are packed into inverted
    blocks, like texts together. A directory
    of the blocks gives what each block can score at most for a query. Every
    query is first searched in the block with its highest bound, which gives a
    score that its `topn` best reach at least; after that only in blocks whose
    bound reaches this score. Blocks and queries that have nothing to do with
    each other never meet. What is shuffled is each distinct text once, the
    terms of a query for each shelf of blocks it meets, copies of shelves (see
    `search_blocks`), and the best rows of each meeting. A task holds a shelf's
    blocks packed, one of them unpacked, and MOST queries at most. Only three
    numbers reach the driver.
    """
    texts = docs.select(F.col("item_id").cast("long"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("same"))
    none = F.array().cast("array<string>")
    if tags is not None:
        own = materialize(tags.where(F.col("tag") != ignore_tag).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.collect_set("tag").alias("tags")), "tags")
        texts = texts.join(own, "item_id", "left").withColumn("tags", F.coalesce("tags", none))
    one = F.struct("item_id", "tags") if tags is not None else F.struct("item_id")
    grouped = texts.groupBy("same").agg(F.first("text").alias("text"), F.sort_array(F.collect_list(one)).alias("items"))
    items = F.col("items") if tags is not None else F.slice("items", 1, topn)
    pick = lambda name: F.transform(items, lambda x: x[name]).alias(name if name == "tags" else "ids")
    grouped = grouped.select(F.col("items")[0]["item_id"].alias("item_id"), F.size("items").cast("long").alias("copies"), pick("item_id"), *([pick("tags")] if tags is not None else []), "text")
    counted = materialize(_counted(grouped), "counted")
    named = queries.select(F.col("item_id").cast("long"), "text")
    # (item_id, asker): of the queries with the same text the smallest asks for all; an item with several rows has several texts
    told = named.groupBy("item_id").agg(F.sort_array(F.collect_list(F.sha2(F.coalesce("text", F.lit("")), 256))).alias("same")).where("item_id IS NOT NULL")
    told = told.groupBy("same").agg(F.min("item_id").alias("asker"), F.collect_list("item_id").alias("ids"))
    askers = materialize(told.select(F.explode("ids").alias("item_id"), "asker"), "askers")
    asked = materialize(_counted(named.join(askers.select(F.col("asker").alias("item_id")), "item_id", "left_semi")), "asked")
    corpus = counted.agg(F.sum("copies").alias("n_docs"), (F.sum(F.col("length") * F.col("copies")) / F.sum("copies")).alias("avgdl")).first()
    n_docs, avgdl = corpus["n_docs"] or 0, corpus["avgdl"] or 1.0
    df = counted.select(F.explode("terms").alias("term"), "copies").groupBy("term").agg(F.sum("copies").alias("df"))
    idf = materialize(df.select("term", (F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")), "idf")
    mean = idf.agg(F.avg("idf")).first()[0] or 0.0
    idf = idf.withColumn("idf", F.when(F.col("idf") < 0, F.lit(eps * mean)).otherwise(F.col("idf")))
    terms = asked.select("item_id", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("item_id", F.col("t.terms").alias("term"), F.col("t.times").alias("qtf"))
    terms = materialize(terms.join(idf, "term").select("item_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "weights")
    weighted = terms.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("w")).select("item_id", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights"))
    weighted = weighted.withColumnRenamed("item_id", "asker")
    if tags is not None:
        weighted = weighted.join(askers, "asker").join(own, "item_id", "left").withColumn("tags", F.coalesce("tags", none))
    else:
        weighted = weighted.withColumn("item_id", F.col("asker"))
    weighted = materialize(weighted, "weighted")
    blocks, n_blocks = inverted_blocks(counted, k1, b, avgdl)
    n_queries = asked.count() if tags is None else askers.count()
    bounds, rest = block_bounds(terms, blocks, n_blocks)
    nothing = F.lit(float("-inf"))
    home = bounds.groupBy("item_id").agg(F.max_by("block", F.struct("bound", -F.col("block"))).alias("home"))
    home = rest.join(home, "item_id", "left").select(F.col("item_id").alias("asker"), "rest", F.coalesce("home", F.lit(0).cast("long")).alias("block"))
    home = materialize(home.withColumn("item_id", F.col("asker")) if tags is None else home.join(askers, "asker"), "home")
    first = materialize(search_blocks(home.select("item_id", "block", nothing.alias("least")), weighted, blocks, topn, k1, n_blocks, n_queries), "first")
    seeds = first.groupBy(F.col("query_item").alias("item_id")).agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("item_id", F.get("s", F.lit(topn - 1)).alias("seed"))
    known = home.withColumnRenamed("block", "home").join(seeds, "item_id", "left").withColumn("least", F.coalesce("seed", nothing))
    reaches = lambda bound: F.col("least") - 1e-7 * (1 + F.abs(bound)) <= bound
    some = bounds.withColumnRenamed("item_id", "asker").join(known, "asker").where((F.col("block") != F.col("home")) & reaches(F.col("bound"))).select("item_id", "block", "least")
    # where the terms of nearly all blocks suffice, or nothing is known, so does every block
    anywhere = known.where(reaches(F.col("rest"))).select("item_id", "home", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    pairs = materialize(some.unionByName(anywhere.where("block <> home").select("item_id", "block", "least")).distinct(), "pairs")
    found = first.unionByName(search_blocks(pairs, weighted, blocks, topn, k1, n_blocks, n_queries))
    order = Window.partitionBy("query_item").orderBy(F.desc(F.round("score", 9)), "doc_item")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= topn)
    if tags is None:
        each = askers.select(F.col("item_id").alias("__item"), F.col("asker").alias("query_item"))
        ranked = ranked.join(each, "query_item").select(F.col("__item").alias("query_item"), "doc_item", "score", "rank")
    return Ranking(ranked, [home, pairs], n_blocks, n_queries)
