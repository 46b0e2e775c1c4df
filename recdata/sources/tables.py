"""Reading and writing of interaction data, profiles, predictions and results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recdata.functions.scalar import rating_to_int
from recdata.functions.text import clean_white_space
from recdata.operators.clean import latest


@dataclass
class DatasetSpec:
    """Column names of a dataset: standard name to name in the files, and how its ratings are written."""

    interactions: dict[str, str] = field(default_factory=lambda: {"user_id": "user_id", "item_id": "item_id", "rating": "rating"})
    users: dict[str, str] = field(default_factory=lambda: {"user_id": "user_id"})
    items: dict[str, str] = field(default_factory=lambda: {"item_id": "item_id"})
    ratings: str = "number"


#: Reviews whose columns are reviewerID, asin and overall.
PRODUCT_REVIEWS = DatasetSpec({"user_id": "reviewerID", "item_id": "asin", "rating": "overall", "review": "reviewText"}, {"user_id": "reviewerID"}, {"item_id": "asin", "title": "title", "author": "brand"})


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A CSV file with a header, quoted texts over several lines, every column as text unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.select(*columns) if columns else df


def unify(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The named columns under their standard names."""
    return df.select(*(F.col(theirs).alias(ours) for ours, theirs in names.items()))


def read_dataset(spark: SparkSession, path: str, spec: DatasetSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(interactions with split, users, items) of a folder with train, validation, test, users and items CSV files."""
    parts = [unify(read_csv(spark, f"{path}/{name}.csv"), spec.interactions).withColumn("split", F.lit(name)) for name in ("train", "validation", "test")]
    inter = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("rating", rating_to_int(F.col("rating"), spec.ratings))
    return inter, unify(read_csv(spark, f"{path}/users.csv"), spec.users), unify(read_csv(spark, f"{path}/items.csv"), spec.items)


def ingest_book_reviews(reviews: DataFrame, items: DataFrame, genres: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(interactions, items, users) of book reviews; authors sorted and joined, genres by map keys; the first row of an item stays."""
    inter = reviews.select("user_id", F.col("book_id").alias("item_id"), F.col("rating").cast("int").alias("rating"), F.col("review_text").alias("review"), "date_added")
    authors = F.array_join(F.array_sort(F.transform("authors", lambda a: F.trim(a["author_id"]))), ",")
    names = genres.select("book_id", F.transform(F.map_keys("genres"), lambda g: F.replace(g, F.lit(","), F.lit(" "))).alias("genres"))
    books = latest(items, ["book_id"], [F.col("title"), F.col("description")]).withColumn("author", authors).drop("authors").join(names, "book_id", "left")
    books = books.withColumn("genres", F.coalesce("genres", F.array().cast("array<string>"))).withColumnRenamed("book_id", "item_id")
    return inter, books, inter.select("user_id").distinct()


def ingest_product_reviews(reviews: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(interactions, items, users) of product reviews: the latest review of a user and item, items that occur, without page debris."""
    text = lambda c: clean_white_space(F.coalesce(F.col(c).cast("string"), F.lit("")))
    inter = reviews.select(F.col("reviewerID").alias("user_id"), F.col("asin").alias("item_id"), F.col("overall").cast("int").alias("rating"), text("reviewText").alias("review"), text("summary").alias("summary"), F.col("unixReviewTime").cast("long").alias("ts"))
    inter = latest(inter, ["user_id", "item_id"], [F.desc("ts"), F.desc("review")])
    sound = meta.where(~F.coalesce(F.col("title").contains("getTime"), F.lit(False)))
    items = sound.withColumnRenamed("asin", "item_id").join(inter.select("item_id"), "item_id", "left_semi")
    items = latest(items, ["item_id"], [F.col("title")]).withColumn("title", text("title"))
    users = latest(reviews.select(F.col("reviewerID").alias("user_id"), F.col("reviewerName").alias("name")), ["user_id"], [F.col("name")])
    return inter, items, users


def read_negatives(spark: SparkSession, path: str) -> DataFrame:
    """user_id, item_id, label, and ref_item where the file has it."""
    df = read_csv(spark, path)
    return df.withColumn("label", F.col("label").cast("int"))


def _told(value: Column, path: str) -> Column:
    """`value`, or an error where a file does not hold what it should."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"no sound JSON in {path}")))


_NAMED = r'"predicted"\s*:\s*\{'


def _entries(spark: SparkSession, path: str, kind: T.DataType, close: str) -> DataFrame:
    """(key, value) of the entries of one JSON object whose values end with `close`, a bracket; it may stand under the key predicted.

    The file is read by byte ranges as lines that end with `close`, so any
    number of tasks share it. A bracket within a text cuts an entry into two
    that are not JSON; then the file is read whole by one task instead. Raises
    on malformed JSON.
    """
    lines = spark.read.option("lineSep", close).text(path).select(F.trim(F.regexp_replace("value", r"[\r\n\t]", " ")).alias("value"), F.input_file_name().alias("file"))
    body = F.regexp_replace(F.regexp_replace("value", r"^[,\s]*", ""), r"^\{(\s*" + _NAMED + ")?", "")
    rows = lines.select("file", F.col("value").rlike(r"^\{\s*" + _NAMED).cast("int").alias("named"), F.trim(body).alias("value"))
    ends = F.col("value").isin("", "}")
    parsed = rows.select("*", F.from_json(F.concat(F.lit("{"), "value", F.lit(close + "}")), T.MapType(T.StringType(), kind)).alias("entry"))
    sound = F.col("entry").isNotNull() & (F.size("entry") == 1) & F.forall(F.map_values("entry"), lambda x: x.isNotNull())
    told = parsed.agg(F.count(F.when(~ends & ~F.coalesce(sound, F.lit(False)), 1)).alias("bad"), F.count(F.when(ends, 1)).alias("ends"), F.coalesce(F.sum("named"), F.lit(0)).alias("named"), F.countDistinct("file").alias("files")).first()
    # what is left of a whole object is one end, and one more if it stands under a key
    if not told["bad"] and told["ends"] == told["files"] + told["named"]:
        return parsed.where(~ends).select(F.explode("entry").alias("key", "value"))
    text, whole = spark.read.text(path, wholetext=True), T.MapType(T.StringType(), kind)
    wrapped = F.from_json("value", T.StructType([T.StructField("predicted", whole)]))["predicted"]
    return text.select(F.explode(_told(F.coalesce(wrapped, F.from_json("value", whole)), path)).alias("key", "value"))


def read_predictions(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """(user_id, item_id, score) of lines {"user_id": ..., "scores": {item: score}}, as `write_predictions` makes them.

    With lines=False of one JSON object user -> item -> score, bare or under the
    key predicted, read by byte ranges (see `_entries`). Ids are texts. Raises
    on malformed JSON.
    """
    scores = T.MapType(T.StringType(), T.DoubleType())
    if lines:
        row = F.from_json("value", T.StructType([T.StructField("user_id", T.StringType()), T.StructField("scores", scores)]))
        users = spark.read.text(path).where(F.trim("value") != "").select(row.alias("r")).select(_told(F.col("r.user_id"), path).alias("user_id"), _told(F.col("r.scores"), path).alias("scores"))
    else:
        users = _entries(spark, path, scores, "}").select(F.col("key").alias("user_id"), F.col("value").alias("scores"))
    return users.select("user_id", F.explode("scores").alias("item_id", "score"))


def write_predictions(pred: DataFrame, path: str) -> None:
    """One JSON object for each user, on a line of its own: {"user_id": ..., "scores": {item: score}}."""
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("item_id").cast("string"), "score")))
    pred.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(pairs.alias("scores")).write.mode("overwrite").json(path)


def read_profiles(spark: SparkSession, path: str, key: str, ids: DataFrame | None = None) -> DataFrame:
    """(key, text). Raises if a key repeats or, with `ids`, if the keys differ from them."""
    df = read_csv(spark, path, [key, "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    counts = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d")).first()
    if counts["n"] != counts["d"]:
        raise ValueError(f"{counts['n'] - counts['d']} rows repeat a {key}")
    if ids is not None and (ids.join(df, key, "left_anti").limit(1).count() or df.join(ids, key, "left_anti").limit(1).count()):
        raise ValueError(f"the profiles are not those of the given {key}s")
    return df


def read_ngram_counts(spark: SparkSession, path: str) -> DataFrame:
    """(ngram, year, matches, volumes) of lines `ngram TAB year,matches,volumes TAB ...`, also compressed."""
    return parse_ngram_counts(spark.read.text(path))


def parse_ngram_counts(lines: DataFrame) -> DataFrame:
    cells = F.split("value", "\t")
    rows = lines.select(cells[0].alias("ngram"), F.explode(F.slice(cells, 2, F.size(cells) - 1)).alias("cell")).select("ngram", F.split("cell", ",").alias("c"))
    return rows.select("ngram", F.col("c")[0].cast("int").alias("year"), F.col("c")[1].cast("long").alias("matches"), F.col("c")[2].cast("long").alias("volumes"))


def read_limit_list(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """(user_id, item_id) of lines {"user_id": ..., "items": [...]}, or with lines=False of one JSON object user -> [items], read by byte ranges. Raises on malformed JSON."""
    items = T.ArrayType(T.StringType())
    if lines:
        row = F.from_json("value", T.StructType([T.StructField("user_id", T.StringType()), T.StructField("items", items)]))
        users = spark.read.text(path).where(F.trim("value") != "").select(row.alias("r")).select(_told(F.col("r.user_id"), path).alias("user_id"), _told(F.col("r.items"), path).alias("items"))
    else:
        users = _entries(spark, path, items, "]").select(F.col("key").alias("user_id"), F.col("value").alias("items"))
    return users.select("user_id", F.explode("items").alias("item_id"))


def write_dataset(inter: DataFrame, users: DataFrame, items: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """Interactions partitioned by split, users and items, as parquet, csv or json.

    With mode `ignore` what exists is left as it is.
    """
    for name, df, by in (("interactions", inter, ["split"]), ("users", users, []), ("items", items, [])):
        flat = df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}) if kind == "csv" else df
        writer = flat.write.mode(mode).format(kind).option("header", True).option("escape", '"')
        (writer.partitionBy(*by) if by else writer).save(f"{path}/{name}")


def read_runs(spark: SparkSession, config_glob: str, result_glob: str) -> tuple[DataFrame, DataFrame]:
    """(configs, results) of a folder of runs; run is the name of the folder that holds the file."""
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    configs = spark.read.option("multiLine", True).json(config_glob).withColumn("run", folder)
    return configs, spark.read.option("header", True).csv(result_glob).withColumn("run", folder)
