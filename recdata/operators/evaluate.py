"""Evaluation of rankings: per query, per user group, micro and macro."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recdata.functions.scalar import group_label

from .sample import dense_index

def break_ties(scored: DataFrame, key: tuple[str, ...] = ("user_id",), epsilon: float = 1e-7) -> DataFrame:
    """Scores made distinct: epsilon is added for each item of equal score before it, in descending order of ids."""
    rank = F.row_number().over(Window.partitionBy(*key, "score").orderBy(F.desc("item_id")))
    return scored.withColumn("score", F.col("score") + F.lit(epsilon) * (rank - 1))


def ranking_detail(cand: DataFrame, pred: DataFrame, ks: tuple[int, ...] = (5, 10, 20), precisions: tuple[int, ...] = (1, 5), ties: str = "average", key: tuple[str, ...] = ("user_id",), level: float = 1) -> DataFrame:
    """Metrics of each query: ndcg_k, p_k, rr, auc, n_pos, n_neg.

    `cand` has the key, item_id and label (a gain); `pred` the key, item_id and
    score. Candidates without a prediction do not count. Relevant is a label of
    at least `level`. ties: `average` gives items of equal score the mean gain
    in ndcg; `trec` orders them by descending id; `epsilon` does so by changing
    the scores. Precision and rr always use descending ids. auc is null where
    a query has one class only. All windows are over the key, so each row is
    shuffled once.
    """
    rows = cand.select(*key, "item_id", F.col("label").cast("double").alias("gain")).join(pred.select(*key, "item_id", F.col("score").cast("double").alias("score")), [*key, "item_id"])
    if ties == "epsilon":
        rows = break_ties(rows, key)
    query = Window.partitionBy(*key)
    best = query.orderBy(F.desc("score"), F.desc("item_id"))
    same = Window.partitionBy(*key, "score")
    relevant = (F.col("gain") >= level).cast("int")
    rows = rows.withColumns({"rel": relevant, "pos": F.row_number().over(best), "ideal": F.row_number().over(query.orderBy(F.desc("gain"), "item_id")), "below": F.rank().over(query.orderBy("score"))})
    rows = rows.withColumns({"tied": F.count("*").over(same), "mean_gain": F.avg("gain").over(same)})
    used = F.col("mean_gain") if ties == "average" else F.col("gain")
    at = lambda value, place, k: F.sum(F.when(F.col(place) <= k, value / F.log2(F.col(place) + F.lit(1.0))).otherwise(0.0))
    sums: dict[str, Column] = {"n_pos": F.sum("rel"), "n_neg": F.sum(1 - F.col("rel"))}
    for k in ks:
        ideal = at(F.col("gain"), "ideal", k)
        sums[f"ndcg_{k}"] = F.when(ideal > 0, at(used, "pos", k) / ideal).otherwise(0.0)
    for k in precisions:
        sums[f"p_{k}"] = F.sum(F.when(F.col("pos") <= k, F.col("rel")).otherwise(0)) / F.lit(float(k))
    sums["rr"] = F.coalesce(F.lit(1.0) / F.min(F.when(F.col("rel") == 1, F.col("pos"))), F.lit(0.0))
    ranks = F.sum(F.when(F.col("rel") == 1, F.col("below") + (F.col("tied") - 1) / 2.0).otherwise(0.0))
    positives, negatives = sums["n_pos"], sums["n_neg"]
    sums["auc"] = F.when((positives > 0) & (negatives > 0), (ranks - positives * (positives + 1) / 2.0) / (positives * negatives))
    return rows.groupBy(*key).agg(*(value.alias(name) for name, value in sums.items()))


def metric_names(detail: DataFrame) -> list[str]:
    return [c for c in detail.columns if c.startswith(("ndcg_", "p_")) or c in ("rr", "auc")]


def user_groups(train: DataFrame, thresholds: tuple[int, ...] | None = (5, 50), ratios: tuple[int, ...] | None = None, names: tuple[str, ...] = ("sporadic", "regular", "bibliophilic")) -> DataFrame:
    """(user_id, group): by thresholds of training counts, or by ratios (in hundredths) of users in order of counts, fewest first."""
    counts = train.groupBy("user_id").agg(F.count("*").alias("n"))
    if ratios is None:
        return counts.select("user_id", group_label(F.col("n"), thresholds).alias("group"))
    if sum(ratios) != 100:
        raise ValueError("ratios must sum to 100")
    total = counts.agg(F.count("*").alias("total"))
    ranked = dense_index(counts, ["n", "user_id"], "at").withColumn("rn", F.col("at") + 1).join(F.broadcast(total))
    group, reached = F.lit(names[len(ratios) - 1]), 100
    for name, ratio in reversed(list(zip(names, ratios, strict=False))[:-1]):
        reached -= ratios[names.index(name) + 1]
        group = F.when(F.col("rn") <= F.floor(F.col("total") * reached / 100), F.lit(name)).otherwise(group)
    return ranked.select("user_id", group.alias("group"))


def evaluate(cand: DataFrame, pred: DataFrame, groups: DataFrame | None = None, **options: object) -> DataFrame:
    """(group, n_users, n_pos, n_neg, metrics): means over users, for ALL and for each group of users."""
    detail = ranking_detail(cand, pred, **options)
    return summarise(detail, groups)


def summarise(detail: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    labelled = detail.withColumn("groups", F.array(F.lit("ALL")))
    if groups is not None:
        labelled = detail.join(groups, "user_id", "left").withColumn("groups", F.array_compact(F.array(F.lit("ALL"), F.col("group")))).drop("group")
    metrics = [F.avg(m).alias(m) for m in metric_names(detail)]
    return labelled.withColumn("group", F.explode("groups")).groupBy("group").agg(F.count("*").alias("n_users"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), *metrics)


def evaluate_queries(cand: DataFrame, pred: DataFrame, groups: DataFrame | None = None, **options: object) -> DataFrame:
    """Queries are (user_id, ref_item). micro: means over queries; macro: over each user's queries, then over users."""
    detail = ranking_detail(cand, pred, key=("user_id", "ref_item"), **options)
    names = metric_names(detail)
    labelled = detail.withColumn("groups", F.array(F.lit("ALL")))
    if groups is not None:
        labelled = detail.join(groups, "user_id", "left").withColumn("groups", F.array_compact(F.array(F.lit("ALL"), F.col("group")))).drop("group")
    rows = labelled.withColumn("group", F.explode("groups"))
    per_user = rows.groupBy("group", "user_id").agg(F.count("*").alias("n"), *(F.sum(m).alias(f"s_{m}") for m in names), *(F.count(m).alias(f"c_{m}") for m in names), *(F.avg(m).alias(f"a_{m}") for m in names))
    return per_user.groupBy("group").agg(
        F.count("*").alias("n_users"),
        F.sum("n").alias("n_queries"),
        *((F.sum(f"s_{m}") / F.sum(f"c_{m}")).alias(f"micro_{m}") for m in names),
        *(F.avg(f"a_{m}").alias(f"macro_{m}") for m in names),
    )


def array_metrics(df: DataFrame, scores: str = "scores", labels: str = "labels", **options: object) -> DataFrame:
    """Metrics from parallel arrays, one row for each query (user_id); positions stand for item ids."""
    rows = df.select("user_id", F.posexplode(F.arrays_zip(F.col(scores).alias("s"), F.col(labels).alias("l"))).alias("item_id", "x"))
    flat = rows.select("user_id", "item_id", F.col("x.s").alias("score"), F.col("x.l").alias("label"))
    return ranking_detail(flat.select("user_id", "item_id", "label"), flat.select("user_id", "item_id", "score"), **options)


def losses(cand: DataFrame, pred: DataFrame, margin: float = 1.0) -> DataFrame:
    """(bce, mse, margin_loss) over labelled predictions between 0 and 1; the margin loss over pairs of a user's positives and negatives.

    The pairs are never formed: a user's rows are sorted, and running counts and
    sums of the negatives tell what each positive loses.
    """
    rows = cand.select("user_id", "item_id", "label").join(pred.select("user_id", "item_id", "score"), ["user_id", "item_id"])
    p = F.least(F.greatest(F.col("score"), F.lit(1e-12)), F.lit(1 - 1e-12))
    y = F.col("label").cast("double")
    point = rows.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("bce"), F.avg((F.col("score") - y) * (F.col("score") - y)).alias("mse"))
    # a positive at its score less the margin loses to the negatives that come after it, each by how far it is behind
    at = F.when(F.col("label") >= 1, F.col("score") - F.lit(margin)).otherwise(F.col("score"))
    below = F.col("label") < 1
    over = Window.partitionBy("user_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("user_id", "label", at.alias("at"))
    placed = placed.select("user_id", "label", "at", F.count(F.when(below, 1)).over(over).alias("k"), F.coalesce(F.sum(F.when(below, F.col("at"))).over(over), F.lit(0.0)).alias("s"))
    lost = F.when(F.col("label") >= 1, F.col("s") - F.col("k") * F.col("at")).otherwise(0.0)
    per_user = placed.groupBy("user_id").agg(F.sum(lost).alias("lost"), F.count(F.when(below, 1)).alias("down"), F.count(F.when(F.col("label") >= 1, 1)).alias("up"))
    n_pairs = F.sum(F.col("down") * F.col("up"))
    pair = per_user.agg(F.when(n_pairs > 0, F.sum("lost") / n_pairs).alias("margin_loss"))
    return point.join(F.broadcast(pair))


def keep_trained_users(cand: DataFrame, train: DataFrame) -> DataFrame:
    return cand.join(train.select("user_id"), "user_id", "left_semi")


def evaluate_saved(splits: DataFrame, saved: DataFrame, negatives: dict[str, DataFrame], least: int = 4, groups: DataFrame | None = None, **options: object) -> DataFrame:
    """Metrics of saved predictions for each split in `negatives` (validation, test): columns of `evaluate`, and split.

    Positives are the split's rows rated `least` or better; `negatives` has
    (user_id, item_id, label) for each split, and `saved` (user_id, item_id,
    score) over both. Groups are counted among the users of the split.
    """
    out = None
    for name, neg in negatives.items():
        pos = splits.where((F.col("split") == name) & (F.col("rating") >= least)).select("user_id", "item_id", F.lit(1).alias("label"))
        found = evaluate(pos.unionByName(neg.select("user_id", "item_id", "label")), saved, groups, **options).withColumn("split", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out
