"""Queries on files, text columns, filters, exports, towers, saved runs and model selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recdata.functions.scalar import hash_int, hash_key, parse_count, parse_sales_rank, rating_to_int, set_jaccard
from recdata.functions.text import blank_if_like, clean_white_space, flatten_description, normalise_tokens, tokenize, top_entries, truncate
from recdata.operators import clean, corpus, evaluate, filters, graph, models, negatives, profiles, report, sample, similarity, split, stats
from recdata.sources import tables
from recdata.sources.scratch import materialize, temporary_path

from . import views as v
from .queries_eval import _EVAL, _GENRE_NEG, _GENRES, _POPULAR, _POS, SPLIT, _detail_sql, _evaluated, _groups_sql, _metrics, _popularity, _positives, _rounded, _runs, _RUNS, _splits, _summary_sql, _uniform_sql, _HUNDRED, tokens_sql
from .queries_splits import ORACLES as splits_sql
from .queries_text import _normal_sql


# files


def dataset_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV under the names of product reviews, and read back."""
    path, splits = temporary_path(spark, "dataset"), _splits(spark, sf_dir)
    for name in ("train", "validation", "test"):
        theirs = splits.where(F.col("split") == name).select(F.col("user_id").alias("reviewerID"), F.col("item_id").alias("asin"), F.col("rating").cast("double").alias("overall"), F.lit('said "so",\nand left').alias("reviewText"))
        theirs.write.option("header", True).option("escape", '"').csv(f"{path}/{name}.csv")
    v.users(spark, sf_dir).select(F.col("user_id").alias("reviewerID")).write.option("header", True).csv(f"{path}/users.csv")
    v.items(spark, sf_dir).select(F.col("item_id").alias("asin"), "title", F.col("author").alias("brand")).write.option("header", True).csv(f"{path}/items.csv")
    inter, users, items = tables.read_dataset(spark, path, tables.PRODUCT_REVIEWS)
    known = inter.join(users, "user_id", "left_semi").join(items.select("item_id", "author"), "item_id")
    return known.select("user_id", "item_id", "rating", "split", "author", F.md5("review").alias("review_md5"))


def limit_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five training items of each user, written as lines of JSON and read back."""
    path, train = temporary_path(spark, "limit"), _splits(spark, sf_dir).where("split = 'train'")
    few = split.limit_per_user(train, 5)
    few.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(F.collect_list(F.col("item_id").cast("string")).alias("items")).write.json(path)
    listed = tables.read_limit_list(spark, path).select(*(F.col(c).cast("long").alias(c) for c in ("user_id", "item_id")))
    kept, removed = filters.limit_pairs(train, listed)
    return kept.select("user_id", "item_id", F.lit(True).alias("kept")).unionByName(removed.select("user_id", "item_id", F.lit(False).alias("kept")))


def negatives_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre negatives written as CSV, read back, without ref_item each once."""
    path, splits = temporary_path(spark, "negatives"), _splits(spark, sf_dir)
    negatives.neg_genre(_positives(splits), v.items(spark, sf_dir), negatives.used_items(splits, "test"), 4).write.option("header", True).csv(path)
    return negatives.drop_ref_item(tables.read_negatives(spark, path)).select(*(F.col(c).cast("long").alias(c) for c in ("user_id", "item_id")), "label")


def profiles_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles written as CSV and read back with checks of their keys."""
    path, items = temporary_path(spark, "profiles"), v.items(spark, sf_dir)
    made = profiles.item_profile_from_items(items, ["title", "author", "genres"], ["genres"])
    made.write.option("header", True).option("escape", '"').csv(path)
    read = tables.read_profiles(spark, path, "item_id", items.select(F.col("item_id").cast("string").alias("item_id")))
    return read.select(F.col("item_id").cast("long").alias("item_id"), "text")


def _saved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    splits, found, wanted = _splits(spark, sf_dir), {}, None
    for name in ("validation", "test"):
        pos = splits.where((F.col("split") == name) & (F.col("rating") >= 4)).select("user_id", "item_id")
        found[name] = materialize(negatives.neg_uniform(pos, negatives.used_items(splits, name), splits.select("item_id"), 10), name)
        both = pos.unionByName(found[name].select("user_id", "item_id"))
        wanted = both if wanted is None else wanted.unionByName(both)
    path = temporary_path(spark, "predictions")
    tables.write_predictions(_popularity(splits, wanted.distinct()), path)
    saved = tables.read_predictions(spark, path)
    return splits, saved.select(*(F.col(c).cast("long").alias(c) for c in ("user_id", "item_id")), "score"), found


def eval_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written and read back, evaluated on validation and on test."""
    splits, saved, found = _saved(spark, sf_dir)
    groups = evaluate.user_groups(splits.where("split = 'train'"), (5, 25))
    return _rounded(evaluate.evaluate_saved(splits, saved, found, 4, groups))


def report_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations and results written in a folder for each run, read, filtered by learning rate and put into one table."""
    path, results = temporary_path(spark, "runs"), materialize(_runs(spark, sf_dir), "runs")
    for run, rate in (("popular", 0.0), ("random", 0.0), ("mixed", 0.01)):
        spark.createDataFrame([(rate, 32)], "lr double, batch_size int").coalesce(1).write.json(f"{path}/configs/{run}")
        results.where(F.col("run") == run).drop("run").coalesce(1).write.option("header", True).csv(f"{path}/results/{run}")
    configs, read = tables.read_runs(spark, f"{path}/configs/*", f"{path}/results/*")
    read = read.withColumns({"n_users": F.col("n_users").cast("long"), "ndcg_5": F.col("ndcg_5").cast("double")})
    return report.runs_table(filters.filter_runs(configs, learning_rate=0.0, batch_size=32).select("run", "lr"), read, ["ndcg_5"])


def ingest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw interactions under the names of product reviews, some titles with page debris."""
    raw = v.raw_interactions(spark, sf_dir)
    number = F.unix_timestamp("ts")
    reviews = raw.select(F.col("user_id").cast("string").alias("reviewerID"), F.col("item_id").cast("string").alias("asin"), F.lit("N").alias("reviewerName"), F.concat(F.lit("a\tb "), F.col("l_orderkey").cast("string")).alias("reviewText"), F.lit(None).cast("string").alias("summary"), F.col("rating").cast("double").alias("overall"), number.alias("unixReviewTime"))
    meta = v.items(spark, sf_dir).select(F.col("item_id").cast("string").alias("asin"), F.when(F.col("item_id") % 7 == 0, "x getTime y").otherwise(F.col("title")).alias("title"))
    inter, items, users = tables.ingest_product_reviews(reviews, meta)
    return inter.join(items.select("item_id", "title"), "item_id", "left").join(users, "user_id").select("user_id", "item_id", "review", "title", "name")


def ingest_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as books of two authors, with their words as genres."""
    part = v.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    key = F.col("p_partkey").cast("string").alias("book_id")
    author = lambda c: F.struct(F.concat(F.lit(" "), F.col(c)).alias("author_id"))
    books = part.select(key, F.col("p_name").alias("title"), F.lit("d").alias("description"), F.array(author("p_type"), author("p_brand")).alias("authors"))
    genres = part.select(key, F.map_from_arrays(F.array(F.concat_ws(",", "p_type", "p_brand")), F.array(F.lit(1).cast("long"))).alias("genres"))
    reviews = v.interactions(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), F.col("item_id").cast("string").alias("book_id"), "rating", F.lit("t").alias("review_text"), F.lit("now").alias("date_added"))
    inter, items, users = tables.ingest_book_reviews(reviews, books.unionByName(books), genres)
    joined = inter.join(items, "item_id").join(users, "user_id", "left_semi")
    return joined.select("user_id", "item_id", "rating", "author", F.array_join("genres", "|").alias("genres"))


# text and number columns


def flatten_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.lit("['"), F.regexp_replace("p_name", " ", "', '"), F.lit("']"))
    return v.table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", flatten_description(written).alias("description"))


def top_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.favourite_genres(v.interactions(spark, sf_dir), v.items(spark, sf_dir), 5)
    return found.select("user_id", top_entries(F.col("sorted_genres"), 2).alias("genres"))


def blank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("people who like "), "p_name")).otherwise(F.col("p_name"))
    return v.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select("p_partkey", blank_if_like(cell).alias("cell"))


def truncated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.md5(F.array_join(truncate(tokenize(F.col("text")), 50), " ")).alias("tokens_md5"))


def white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.md5(clean_white_space(F.col("html"))).alias("html_md5"))


def negation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    tokens = F.concat(F.array(F.lit("did"), F.lit("n't")), tokenize(F.col("text")))
    return rows.select("conv_id", "turn", F.md5(F.array_join(normalise_tokens(tokens), " ")).alias("tokens_md5"))


def sales_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written as ranks in five forms."""
    part = v.table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    number = F.format_number(F.floor(F.col("p_retailprice") * 10), 0)
    kind = F.element_at(F.array(*map(F.lit, (" in Books", " Paid in Kindle Store", " Free in Kindle Store", " in Toys (top sellers)", " best sellers"))), F.col("p_size") % 5 + 1)
    ranks = parse_sales_rank(F.concat(F.lit("Top 100: "), number, kind))
    return part.select("p_partkey", ranks.alias("r")).select("p_partkey", *(F.nullif(F.col(f"r.{c}"), F.lit(float("inf"))).alias(c) for c in ("books", "paid", "free", "any")))


def written_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with commas and ratings in words, as numbers."""
    part = v.table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    words = F.element_at(F.array(*map(F.lit, ("did not like it", "it was ok", "liked it", "Really liked it", "it was amazing", ""))), F.col("p_size") % 6 + 1)
    return part.select("p_partkey", parse_count(F.format_number(F.floor("p_retailprice"), 0)).alias("n"), rating_to_int(words, "words").alias("rating"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.items(spark, sf_dir).select("item_id", corpus.query_text([F.col("title"), F.col("author"), F.array_join("genres", " ")]).alias("text"))


# filters and samples


def rated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    inter = v.interactions(spark, sf_dir).withColumn("rating", F.when(F.col("item_id") % 10 != 0, F.col("rating")).otherwise(-1))
    return filters.rated(inter).select("user_id", "item_id", "rating")


def users_min_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.users_with_min_authors(v.interactions(spark, sf_dir), v.items(spark, sf_dir), 20).select("user_id", "item_id")


def users_min_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = v.review_refs(spark, sf_dir, v.interactions(spark, sf_dir))
    return filters.users_with_min_tokens(refs, "review", 20_000, v.review_texts(spark, sf_dir))


def sound_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without page debris that have more than 30 ratings."""
    counts = v.interactions(spark, sf_dir).groupBy("item_id").agg(F.format_number(F.count("*") * 100, 0).alias("num_rating"))
    title = F.when(F.col("item_id") % 7 == 0, F.concat(F.lit("var t = new Date().getTime();"), "title")).otherwise(F.col("title"))
    items = v.items(spark, sf_dir).withColumn("title", title).join(counts, "item_id")
    return filters.well_rated_items(filters.sound_items(items), 3000).select("item_id", "title")


def trained_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows of users who have training rows rated 5."""
    splits = _splits(spark, sf_dir)
    return evaluate.keep_trained_users(splits.where("split = 'test'"), splits.where("split = 'train' AND rating = 5")).select("user_id", "item_id")


def common_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of both train and test."""
    splits = _splits(spark, sf_dir)
    return splits.where("split = 'train'").select("user_id").intersect(splits.where("split = 'test'").select("user_id"))


def restricted_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    liked = filters.filter_rating(v.interactions(spark, sf_dir), 5)
    users = split.restrict(v.users(spark, sf_dir), liked, "user_id").select(F.lit("user").alias("kind"), F.col("user_id").alias("id"))
    return users.unionByName(split.restrict(v.items(spark, sf_dir), liked, "item_id").select(F.lit("item").alias("kind"), F.col("item_id").alias("id")))


def refreshed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = v.table(spark, sf_dir, "part", "p_partkey", "p_type", "p_size")
    newer = part.where("p_size > 10").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("title"), F.concat(F.lit("by "), "p_type").alias("author"))
    return clean.refresh_items(v.items(spark, sf_dir).select("item_id", "title", "author"), newer, ["title", "author"])


def validation_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows of other users in each of three rounds."""
    rows = _splits(spark, sf_dir).where("split = 'validation'").select("user_id", "item_id")
    parts = [sample.keep_users(rows, sample.sample_users(rows, 50, seed=42 + r)).withColumn("round", F.lit(r)) for r in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def neg_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four negatives for each training positive, none of them in train."""
    splits = _splits(spark, sf_dir)
    pos = splits.where("split = 'train' AND rating >= 4").select("user_id", "item_id")
    return negatives.neg_uniform(pos, negatives.used_items(splits, "train"), splits.select("item_id"), 4)


def neg_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _splits(spark, sf_dir)
    pos = splits.where("split = 'validation' AND rating >= 4").select("user_id", "item_id")
    return negatives.neg_uniform(pos, negatives.used_items(splits, "validation"), splits.select("item_id"), 10)


def genre_negatives_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _splits(spark, sf_dir)
    neg = negatives.neg_genre(_positives(splits), v.items(spark, sf_dir), negatives.used_items(splits, "test"), 4)
    return negatives.drop_ref_item(neg).select("user_id", "item_id")


# profiles, exports, vectors


def user_profile_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile that begins with an earlier one: the user's favourite genres."""
    inter, items = v.interactions(spark, sf_dir), v.items(spark, sf_dir)
    earlier = profiles.favourite_genres(inter, items, 3).select("user_id", F.array_join("sorted_genres", ", ").alias("text"))
    return profiles.user_profile(inter, items, v.users(spark, sf_dir), ["title"], user_fields=["segment"], least=5, earlier=earlier)


def item_profile_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.item_profile_from_items(v.items(spark, sf_dir), ["title", "author", "genres"], ["genres"])


def item_user_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = similarity.item_user_sets(filters.filter_rating(v.interactions(spark, sf_dir), 4))
    return sets.select("item_id", F.size("users").cast("long").alias("n"), F.md5(F.array_join(F.col("users").cast("array<string>"), ",")).alias("users_md5"))


def author_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the authors of each user's training and test items."""
    rows = _splits(spark, sf_dir).join(v.items(spark, sf_dir).select("item_id", "author"), "item_id")
    sets = rows.groupBy("user_id").agg(F.collect_set(F.when(F.col("split") == "train", F.col("author"))).alias("a"), F.collect_set(F.when(F.col("split") == "test", F.col("author"))).alias("b"))
    return _rounded(sets.select("user_id", set_jaccard(F.col("a"), F.col("b")).alias("sim")))


def normalised_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.normalised_ids(v.interactions(spark, sf_dir), "item_id")
    return _rounded(found.select("item_id", F.col("vec")[0].alias("x")))


def score_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of vectors with normalised ids put behind them."""
    inter = materialize(v.interactions(spark, sf_dir).select("user_id", "item_id"), "interactions")
    ids = models.normalised_ids(inter, "user_id"), models.normalised_ids(inter, "item_id")
    return _rounded(models.score_pairs(inter, v.user_vectors(spark, sf_dir), v.item_vectors(spark, sf_dir), behind=ids))


def external_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of `embeddings` as items that training has not seen: the five best of each user after the item's tower."""
    items = v.table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    users = models.apply_tower(v.user_vectors(spark, sf_dir), v.tower(spark, sf_dir, 3))
    none = v.interactions(spark, sf_dir).select("user_id", "item_id").limit(0)
    return _rounded(models.top_n(users, models.apply_tower(items, v.tower(spark, sf_dir, 5)), none, 5))


def graph_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = v.interactions(spark, sf_dir).select((F.col("user_id") * 2).alias("a"), (F.col("item_id") * 2 + 1).alias("b"))
    return stats.is_connected(graph.connected_components(edges))


# evaluation


def eval_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cand, pred = _evaluated(spark, sf_dir)
    rows = cand.join(pred, ["user_id", "item_id"]).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "score", "label"))).alias("r"))
    arrays = rows.select("user_id", F.col("r.score").alias("scores"), F.col("r.label").alias("labels"))
    return _rounded(evaluate.array_metrics(arrays))


def user_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cand, pred = _evaluated(spark, sf_dir)
    users = v.users(spark, sf_dir).select("user_id", F.col("name").alias("text"))
    items = v.items(spark, sf_dir).select("item_id", F.col("title").alias("text"))
    return report.listing(cand, pred, users, items, 100)


def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much chance to mix with popularity, by ndcg on validation."""
    splits = _splits(spark, sf_dir)
    pos = splits.where("split = 'validation' AND rating >= 4").select("user_id", "item_id")
    neg = negatives.neg_uniform(pos, negatives.used_items(splits, "validation"), splits.select("item_id"), 10)
    cand = materialize(pos.withColumn("label", F.lit(1)).unionByName(neg), "candidates")
    popular = materialize(_popularity(splits, cand), "popular")
    chance = (hash_int(hash_key(3, "user_id", "item_id")) % 1000).cast("double")
    fit = lambda params: popular.withColumn("score", F.col("score") * (1.0 - params["share"]) + chance / 100.0 * params["share"])
    metric = lambda pred: evaluate.evaluate(cand, pred, ks=(5,), ties="trec").where("group = 'ALL'").first()["ndcg_5"]
    best, tried = models.select_model([{"share": s} for s in (0.0, 0.25, 1.0)], fit, metric)
    return _rounded(spark.createDataFrame([(p["share"], m, p == best) for p, m in tried], "share double, ndcg_5 double, best boolean"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(candidates of validation with label, score by popularity, and chance from 0 to 10; their users)."""
    splits = _splits(spark, sf_dir)
    pos = splits.where("split = 'validation' AND rating >= 4").select("user_id", "item_id")
    neg = negatives.neg_uniform(pos, negatives.used_items(splits, "validation"), splits.select("item_id"), 10)
    cand = materialize(pos.withColumn("label", F.lit(1)).unionByName(neg), "candidates")
    chance = (hash_int(hash_key(3, "user_id", "item_id")) % 1000).cast("double") / 100.0
    rows = materialize(cand.join(_popularity(splits, cand), ["user_id", "item_id"]).withColumn("chance", chance), "popular")
    return rows, rows.select("user_id").distinct()


def model_halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five shares of chance in popularity, by ndcg on validation: all on a quarter of the users, the better ones on more."""
    rows, users = _mixed(spark, sf_dir)

    def fit(candidates: list[dict], some: DataFrame) -> DataFrame:
        tried = F.explode(F.array(*(F.struct(F.lit(c["candidate"]).alias("candidate"), F.lit(c["share"]).alias("share")) for c in candidates))).alias("c")
        mixed = F.col("score") * (1.0 - F.col("c.share")) + F.col("chance") * F.col("c.share")
        return rows.join(some, "user_id", "left_semi").select("*", tried).select("c.candidate", "user_id", "item_id", "label", mixed.alias("score"))

    def score(pred: DataFrame) -> DataFrame:
        detail = evaluate.ranking_detail(pred, pred, ks=(5,), ties="trec", key=("candidate", "user_id"))
        return detail.groupBy("candidate").agg(F.avg("ndcg_5").alias("metric"))

    grid = [{"share": s} for s in _HALVED]
    best, told = models.select_by_halving(grid, fit, score, users)
    after = [*(set(t["metrics"]) for t in told[1:]), {grid.index(best)}]
    found = [(turn, t["share"], k, m, k in after[turn]) for turn, t in enumerate(told) for k, m in t["metrics"].items()]
    return _rounded(spark.createDataFrame(found, "turn int, share double, candidate int, ndcg_5 double, kept boolean"))


def existing_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset written twice with mode `ignore`, the second time without its users: what is there stays."""
    path, splits, users, items = temporary_path(spark, "ignored"), _splits(spark, sf_dir), v.users(spark, sf_dir), v.items(spark, sf_dir)
    for some in (users, users.limit(0)):
        tables.write_dataset(splits, some, items, path, mode="ignore")
    return spark.read.parquet(f"{path}/users").select("user_id", "segment")


_SAVED = lambda name: _uniform_sql(pos=f"{SPLIT}, pos AS (SELECT user_id, item_id FROM split WHERE split = '{name}' AND rating >= 4), used AS (SELECT DISTINCT user_id, item_id FROM split WHERE {{}})".format({"train": "split = 'train'", "validation": "split <> 'test'", "test": "true"}[name]), k=4 if name == "train" else 10)
_EVAL_SAVED = lambda name: f"WITH {_SAVED(name)}, cand AS (SELECT user_id, item_id, 1 AS label FROM pos UNION ALL SELECT * FROM neg), {_POPULAR.format(cand='cand')}, {_groups_sql(5, 25)}, {_detail_sql()} {_summary_sql('groups')}"
_SHARES = (0.0, 0.25, 1.0)
_CHANCE = f"({v.key_int(3, 'user_id', 'item_id')} % 1000)"
_SELECTION = f"""WITH {_SAVED("validation")}, cand AS (SELECT user_id, item_id, 1 AS label FROM pos UNION ALL SELECT * FROM neg), {_POPULAR.format(cand="cand")},
{", ".join(f"s{k} AS (SELECT user_id, item_id, score * {1 - s}::DOUBLE + CAST({_CHANCE} AS DOUBLE) / 100.0::DOUBLE * {s}::DOUBLE AS score FROM popular), {_detail_sql(pred=f's{k}', ties='trec', ks=(5,), name=f'd{k}')}" for k, s in enumerate(_SHARES))},
found AS ({" UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, avg(ndcg_5) AS m FROM d{k}" for k, s in enumerate(_SHARES))})
SELECT share, {v.half_up("m", 6)} AS ndcg_5, m = (SELECT max(m) FROM found) AS best FROM found"""
#: Shares of chance, the better the less.
_HALVED = (0.75, 0.0, 1.0, 0.25, 0.1)
_DRAWN = f"({v.key_int(42, 'user_id')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
_TURN = lambda n, share, source, keep: f"""t{n} AS (SELECT candidate, avg(ndcg_5) AS m FROM told WHERE {_DRAWN} < {share}::DOUBLE AND candidate IN ({source}) GROUP BY candidate),
k{n} AS (SELECT {n} AS turn, {share}::DOUBLE AS share, candidate, m, row_number() OVER (ORDER BY m DESC, candidate) <= {keep} AS kept FROM t{n})"""  # noqa: E731
_HALVING = f"""WITH {_SAVED("validation")}, cand AS (SELECT user_id, item_id, 1 AS label FROM pos UNION ALL SELECT * FROM neg), {_POPULAR.format(cand="cand")},
shares AS (SELECT * FROM (VALUES {", ".join(f"({k}, {s}::DOUBLE)" for k, s in enumerate(_HALVED))}) AS x(candidate, share)),
asked AS (SELECT candidate, user_id, item_id, label FROM cand, shares),
mixed AS (SELECT candidate, user_id, item_id, score * (1.0::DOUBLE - share) + CAST({_CHANCE} AS DOUBLE) / 100.0::DOUBLE * share AS score FROM popular, shares),
{_detail_sql(cand="asked", pred="mixed", keys="candidate, user_id", ties="trec", ks=(5,), name="told")},
{_TURN(0, 0.25, "SELECT candidate FROM shares", 3)}, {_TURN(1, 0.5, "SELECT candidate FROM k0 WHERE kept", 2)}, {_TURN(2, 1.0, "SELECT candidate FROM k1 WHERE kept", 1)}
SELECT CAST(turn AS INTEGER) AS turn, share, CAST(candidate AS INTEGER) AS candidate, {v.half_up("m", 6)} AS ndcg_5, kept FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2)"""
_LIMITED = f"{SPLIT}, few AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {v.key(42, 'user_id', 'item_id')}, item_id) AS k FROM train)"
_FAVOURITES = f"{_GENRES}, c AS (SELECT user_id, genre, count(*) AS n FROM inter JOIN genre_items USING (item_id) GROUP BY user_id, genre), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) AS rn FROM c)"
_ITEM_PROFILE = f"SELECT item_id, {_normal_sql('title || chr(46) || chr(32) || author || chr(46) || chr(32) || array_to_string(genres, chr(44) || chr(32))')} AS text FROM (SELECT item_id, title, author, list_filter(genres, lambda x, i: list_position(genres, x) = i) AS genres FROM items)"

ORACLES = {
    "dataset_folder": f"WITH {SPLIT} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, rating, split, p_brand AS author, md5('said \"so\",' || chr(10) || 'and left') AS review_md5 FROM split JOIN part ON p_partkey = item_id",
    "limit_list_file": f"WITH {_LIMITED} SELECT user_id, item_id, k <= 5 AS kept FROM few",
    "negatives_file": f"WITH {_POS}, {_GENRES}, {_GENRE_NEG} SELECT DISTINCT user_id, item_id, 0 AS label FROM genre_neg",
    "genre_negatives_once": f"WITH {_POS}, {_GENRES}, {_GENRE_NEG} SELECT DISTINCT user_id, item_id FROM genre_neg",
    "graph_connected": splits_sql["components"].replace("SELECT node, component FROM least", "SELECT count(DISTINCT component) AS n_components, count(DISTINCT component) = 1 AS connected FROM least"),
    "profiles_file": f"WITH {v.ITEMS} {_ITEM_PROFILE}",
    "eval_saved": f"SELECT *, 'validation' AS split FROM ({_EVAL_SAVED('validation')}) UNION ALL SELECT *, 'test' AS split FROM ({_EVAL_SAVED('test')})",
    "report_folder": f"WITH {_RUNS} SELECT run, 0.0::DOUBLE AS lr, \"group\", n_users, {_HUNDRED('ndcg_5')} AS ndcg_5 FROM runs WHERE run <> 'mixed'",
    "ingest_products": f"""WITH raw AS (SELECT o_custkey AS u, l_partkey AS i, l_shipdate AS ts, 'a b ' || l_orderkey AS review FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY u, i ORDER BY epoch(ts)::BIGINT DESC, encode(review) DESC) AS rn FROM raw)
SELECT CAST(u AS VARCHAR) AS user_id, CAST(i AS VARCHAR) AS item_id, review, CASE WHEN i % 7 <> 0 THEN p_name END AS title, 'N' AS name FROM r JOIN part ON p_partkey = i WHERE rn = 1""",
    "ingest_books": f"WITH {v.INTERACTIONS} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, rating, least(p_type, p_brand) || ',' || greatest(p_type, p_brand) AS author, p_type || ' ' || p_brand AS genres FROM inter JOIN part ON p_partkey = item_id",
    "flatten_descriptions": "SELECT p_partkey, p_name AS description FROM part",
    "top_genres": f"WITH {v.INTERACTIONS}, {_FAVOURITES} SELECT user_id, string_agg(genre, ', ' ORDER BY rn) AS genres FROM g WHERE rn <= 2 GROUP BY user_id",
    "blank_cells": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR p_name LIKE '%like%' THEN '' ELSE p_name END AS cell FROM part",
    "truncated_tokens": f"SELECT doc_id, md5(array_to_string(({tokens_sql('text')})[1:50], ' ')) AS tokens_md5 FROM documents",
    "white_space": "SELECT page_id, md5(translate(html, chr(10) || chr(9) || chr(13), '   ')) AS html_md5 FROM pages",
    "negation_tokens": f"SELECT conv_id, turn, md5(array_to_string(['did', 'not'] || {tokens_sql('text')}, ' ')) AS tokens_md5 FROM conversations",
    "sales_ranks": "SELECT p_partkey, " + ", ".join(f"CASE WHEN p_size % 5 = {k} THEN floor(p_retailprice * 10) END AS \"{name}\"" for k, name in enumerate(("books", "paid", "free", "any"))) + " FROM part",
    "written_counts": "SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS n, CAST(CASE WHEN p_size % 6 = 5 THEN 0 ELSE p_size % 6 + 1 END AS INTEGER) AS rating FROM part",
    "query_texts": f"WITH {v.ITEMS} SELECT item_id, title || ' ' || author || ' ' || array_to_string(list_filter(genres, lambda x, i: list_position(genres, x) = i), ' ') AS text FROM items",
    "rated_rows": f"WITH {v.INTERACTIONS} SELECT user_id, item_id, rating FROM inter WHERE item_id % 10 <> 0",
    "users_min_authors": f"WITH {v.INTERACTIONS} SELECT user_id, item_id FROM inter WHERE user_id IN (SELECT user_id FROM inter JOIN part ON p_partkey = item_id GROUP BY user_id HAVING count(DISTINCT p_brand) >= 20)",
    "users_min_tokens": f"WITH {v.INTERACTIONS}, sizes AS (SELECT doc_id, len({tokens_sql('text')}) AS n FROM documents) SELECT user_id FROM inter JOIN sizes ON doc_id = (user_id * 31 + item_id) % (SELECT count(*) FROM documents) GROUP BY user_id HAVING sum(n) >= 20000",
    "sound_items": f"WITH {v.INTERACTIONS} SELECT item_id, any_value(p_name) AS title FROM inter JOIN part ON p_partkey = item_id WHERE item_id % 7 <> 0 GROUP BY item_id HAVING count(*) > 30",
    "trained_users": f"WITH {SPLIT}, fans AS MATERIALIZED (SELECT DISTINCT user_id FROM train WHERE rating = 5), tested AS MATERIALIZED (SELECT user_id, item_id FROM split WHERE split = 'test') SELECT user_id, item_id FROM tested SEMI JOIN fans USING (user_id)",
    "common_users": f"WITH {SPLIT} SELECT DISTINCT user_id FROM train WHERE user_id IN (SELECT user_id FROM split WHERE split = 'test')",
    "restricted_dims": f"WITH {v.INTERACTIONS} SELECT 'user' AS kind, c_custkey AS id FROM customer WHERE c_custkey IN (SELECT user_id FROM inter WHERE rating >= 5) UNION ALL SELECT 'item', p_partkey FROM part WHERE p_partkey IN (SELECT item_id FROM inter WHERE rating >= 5)",
    "refreshed_items": "SELECT p_partkey AS item_id, CASE WHEN p_size > 10 AND p_size % 2 = 0 THEN p_type ELSE p_name END AS title, CASE WHEN p_size > 10 THEN 'by ' || p_type ELSE p_brand END AS author FROM part",
    "validation_rounds": f"WITH {SPLIT}, rows AS (SELECT user_id, item_id FROM split WHERE split = 'validation'), "
    + ", ".join(f"u{r} AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM rows) ORDER BY {v.key(42 + r, 'user_id')}, user_id LIMIT 50)" for r in range(3))
    + " "
    + " UNION ALL ".join(f"SELECT user_id, item_id, {r} AS round FROM rows WHERE user_id IN (SELECT user_id FROM u{r})" for r in range(3)),
    "neg_training": f"WITH {_SAVED('train')} SELECT * FROM neg",
    "neg_validation": f"WITH {_SAVED('validation')} SELECT * FROM neg",
    "user_profile_earlier": f"""WITH {v.INTERACTIONS}, {v.USERS}, {_FAVOURITES}, e AS (SELECT user_id, string_agg(genre, ', ' ORDER BY rn) AS earlier FROM g WHERE rn <= 3 GROUP BY user_id),
c5 AS (SELECT user_id, string_agg(title, '. ' ORDER BY item_id) AS collected FROM inter JOIN items USING (item_id) WHERE rating >= 5 GROUP BY user_id)
SELECT user_id, {_normal_sql(r"trim(regexp_replace(concat_ws('. ', segment, earlier, coalesce(collected, '')), '(\. )+', '. ', 'g'))")} AS text FROM users JOIN e USING (user_id) LEFT JOIN c5 USING (user_id)""",
    "item_profile_file": f"WITH {v.ITEMS} {_ITEM_PROFILE}",
    "item_user_sets": f"WITH {v.INTERACTIONS} SELECT item_id, count(*) AS n, md5(string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id)) AS users_md5 FROM inter WHERE rating >= 4 GROUP BY item_id",
    "author_jaccard": f"""WITH {SPLIT}, rows AS (SELECT user_id, split, p_brand AS a FROM split JOIN part ON p_partkey = item_id), sets AS (SELECT user_id, a, bool_or(split = 'train') AS t, bool_or(split = 'test') AS s FROM rows GROUP BY user_id, a)
SELECT user_id, {v.half_up("coalesce(count(*) FILTER (WHERE t AND s) / nullif(count(*) FILTER (WHERE t OR s), 0)::DOUBLE, 0)", 6)} AS sim FROM sets GROUP BY user_id""",
    "normalised_ids": f"WITH {v.INTERACTIONS}, i AS (SELECT DISTINCT item_id FROM inter) SELECT item_id, {v.half_up('row_number() OVER (ORDER BY item_id) / (SELECT count(*) FROM i)::DOUBLE', 6)} AS x FROM i",
    "score_appended": f"""WITH {v.INTERACTIONS}, {v.ITEM_VECTORS}, {v.USER_VECTORS}, i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) / (count(*) OVER ())::DOUBLE AS x FROM (SELECT DISTINCT item_id FROM inter)),
u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) / (count(*) OVER ())::DOUBLE AS x FROM (SELECT DISTINCT user_id FROM inter))
SELECT user_id, item_id, {v.half_up("list_dot_product(uv.vec, iv.vec) + u.x * i.x", 6)} AS score FROM inter JOIN user_vecs AS uv USING (user_id) JOIN item_vecs AS iv USING (item_id) JOIN i USING (item_id) JOIN u USING (user_id)""",
    "external_items": f"""WITH {v.USER_VECTORS}, us AS (SELECT user_id, {v.tower_sql("vec", 3)} AS vec FROM user_vecs), items AS (SELECT vec_id AS item_id, {v.tower_sql("list_transform(embedding, lambda x: CAST(x AS DOUBLE))", 5)} AS vec FROM embeddings),
ranked AS (SELECT user_id, item_id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (SELECT user_id, item_id, round(list_dot_product(u.vec, i.vec), 9) AS score FROM us AS u, items AS i))
SELECT user_id, item_id, {v.half_up("score", 6)} AS score, rank FROM ranked WHERE rank <= 5""",
    "eval_arrays": f"""{_EVAL}, {_detail_sql()} SELECT user_id, n_pos, n_neg, {', '.join(f'{v.half_up(m, 6)} AS {m}' for m in _metrics())} FROM detail""",
    "user_listing": f"""{_EVAL}, chosen AS (SELECT DISTINCT user_id FROM cand ORDER BY user_id LIMIT 100)
SELECT user_id, c_name AS user_text, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank, item_id, label, score, p_name AS text
FROM cand JOIN popular USING (user_id, item_id) JOIN chosen USING (user_id) JOIN customer ON c_custkey = user_id JOIN part ON p_partkey = item_id""",
    "model_selection": _SELECTION,
    "model_halving": _HALVING,
    "existing_kept": f"WITH {v.USERS} SELECT user_id, segment FROM users",
}
QUERIES = {
    f.__name__: f
    for f in (
        dataset_folder, limit_list_file, negatives_file, profiles_file, eval_saved, report_folder, ingest_products, ingest_books, flatten_descriptions, top_genres, blank_cells, truncated_tokens, white_space, negation_tokens,
        sales_ranks, written_counts, query_texts, rated_rows, users_min_authors, users_min_tokens, sound_items, trained_users, common_users, restricted_dims, refreshed_items, validation_rounds,
        neg_training, neg_validation, genre_negatives_once, user_profile_earlier, item_profile_file, item_user_sets, author_jaccard, normalised_ids, score_appended, external_items, graph_connected,
        eval_arrays, user_listing, model_selection, model_halving, existing_kept,
    )
}
