"""Tables of evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recdata.functions.scalar import round_half_up


def runs_table(configs: DataFrame, results: DataFrame, metrics: list[str], digits: int = 2) -> DataFrame:
    """One row for each run and group: its configuration and its metrics in hundredths, rounded half up."""
    values = [round_half_up(F.col(m) * 100, digits).alias(m) for m in metrics]
    return configs.join(results, "run").select(*configs.columns, "group", "n_users", *values)


def long_metrics(results: DataFrame, metrics: list[str], digits: int = 2) -> DataFrame:
    """(run, group, metric, value)."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), round_half_up(F.col(m) * 100, digits).alias("value")) for m in metrics))
    return results.select("run", "group", F.explode(pairs).alias("m")).select("run", "group", "m.metric", "m.value")


def pivot_runs(long: DataFrame, metric: str, runs: list[str]) -> DataFrame:
    """One row for each group, one column for each run."""
    return long.where(F.col("metric") == metric).groupBy("group").pivot("run", runs).agg(F.max("value"))


def mark_best(long: DataFrame) -> DataFrame:
    """Adds best: whether a value is the largest of its group and metric."""
    return long.withColumn("best", F.col("value") == F.max("value").over(Window.partitionBy("group", "metric")))


def listing(cand: DataFrame, pred: DataFrame, users: DataFrame, items: DataFrame, n_users: int = 100) -> DataFrame:
    """(user_id, user_text, rank, item_id, label, score, text): the candidates of the first `n_users` users (by id) by score, then smaller ids, with both texts."""
    some = cand.select("user_id").distinct().orderBy("user_id").limit(n_users)
    rows = cand.join(F.broadcast(some), "user_id").join(pred.select("user_id", "item_id", "score"), ["user_id", "item_id"])
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id"))
    told = rows.withColumn("rank", rank).join(users.select("user_id", F.col("text").alias("user_text")), "user_id", "left").join(items.select("item_id", "text"), "item_id", "left")
    return told.select("user_id", "user_text", "rank", "item_id", "label", "score", "text")
