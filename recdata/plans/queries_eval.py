"""Queries on negative samples, evaluation, statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recdata.functions.scalar import hash_int, hash_key, round_half_up
from recdata.operators import corpus, evaluate, negatives, report, split, stats
from recdata.sources.scratch import materialize

from . import views as v

K_NEG = 10


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(split.split_ratio(v.interactions(spark, sf_dir)), "splits")


def _positives(splits: DataFrame) -> DataFrame:
    return splits.where("split = 'test' AND rating >= 4").select("user_id", "item_id")


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(splits, positives, uniform negatives) of the test split."""
    splits = _splits(spark, sf_dir)
    pos = _positives(splits)
    return splits, pos, negatives.neg_uniform(pos, negatives.used_items(splits, "test"), splits.select("item_id"), K_NEG)


def _popularity(splits: DataFrame, cand: DataFrame) -> DataFrame:
    """Scores of candidates: how often the item is in train."""
    train = splits.where("split = 'train'").groupBy("item_id").agg(F.count("*").alias("score"))
    return cand.join(train, "item_id", "left").select("user_id", "item_id", F.coalesce("score", F.lit(0)).cast("double").alias("score"))


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    splits, pos, neg = _sampled(spark, sf_dir)
    cand = materialize(pos.withColumn("label", F.lit(1)).unionByName(neg), "candidates")
    return splits, cand, _popularity(splits, cand)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: round_half_up(F.col(c), digits) for c, kind in df.dtypes if kind == "double"})


def neg_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[2]


def neg_uniform_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits, pos, neg = _sampled(spark, sf_dir)
    return negatives.check_negatives(pos, neg, negatives.used_items(splits, "test"))


def neg_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one author's items as the catalogue many users fall short."""
    splits = _splits(spark, sf_dir)
    pos = _positives(splits)
    few = splits.join(v.items(spark, sf_dir).where("author = 'Brand#11'"), "item_id", "left_semi").select("item_id")
    neg = negatives.neg_uniform(pos, negatives.used_items(splits, "test"), few, 3 * K_NEG)
    return negatives.shortfall(pos, neg, 3 * K_NEG)


def neg_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the query users: every twentieth id."""
    splits = _splits(spark, sf_dir)
    users = splits.where("user_id % 20 = 0")
    return negatives.neg_all(users, splits.select("item_id"), negatives.used_items(splits, "train")).select("user_id", "item_id")


def neg_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _splits(spark, sf_dir)
    return negatives.neg_genre(_positives(splits), v.items(spark, sf_dir), negatives.used_items(splits, "test"), 4).select("user_id", "ref_item", "item_id")


def neg_genre_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _splits(spark, sf_dir)
    return negatives.neg_genre_quota(_positives(splits), splits.where("split = 'train'"), v.items(spark, sf_dir), 4)


def neg_genre_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _splits(spark, sf_dir)
    return negatives.neg_genre_proportional(_positives(splits), splits.where("split = 'train'"), v.items(spark, sf_dir), negatives.used_items(splits, "test"), 4).select("user_id", "item_id")


def _ranking(spark: SparkSession, sf_dir: str, splits: DataFrame) -> DataFrame:
    """BM25 neighbours, among all items, of the query items."""
    texts = v.item_texts(spark, sf_dir)
    asked = _searched(splits).select("item_id").distinct()
    return corpus.bm25(texts.join(asked, "item_id", "left_semi"), texts, topn=100)


def _searched(splits: DataFrame) -> DataFrame:
    """The positives whose item is a query: every twentieth id."""
    return _positives(splits).where("item_id % 20 = 0")


def neg_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _splits(spark, sf_dir)
    ranking = _ranking(spark, sf_dir, splits)
    return negatives.neg_search(_searched(splits), ranking, negatives.used_items(splits, "test"), 10, depth=100)


def neg_cf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits, _, neg = _sampled(spark, sf_dir)
    return _rounded(negatives.neg_cf_weighted(neg, splits.where("split = 'train'"), v.item_vectors(spark, sf_dir), -0.5, 0.5))


def eval_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits, cand, pred = _evaluated(spark, sf_dir)
    return _rounded(evaluate.evaluate(cand, pred, evaluate.user_groups(splits.where("split = 'train'"), (5, 25))))


def eval_groups_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _splits(spark, sf_dir)
    return evaluate.user_groups(splits.where("split = 'train'"), (10, 25)).groupBy("group").agg(F.count("*").alias("n_users"))


def eval_groups_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits, cand, pred = _evaluated(spark, sf_dir)
    groups = evaluate.user_groups(splits.where("split = 'train'"), ratios=(50, 30, 20))
    return _rounded(evaluate.evaluate(cand, pred, groups))


def eval_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cand, pred = _evaluated(spark, sf_dir)
    return _rounded(evaluate.ranking_detail(cand, pred))


def eval_trec(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cand, pred = _evaluated(spark, sf_dir)
    return _rounded(evaluate.evaluate(cand, pred, ties="trec"))


def eval_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits, cand, pred = _evaluated(spark, sf_dir)
    return _rounded(evaluate.evaluate(cand, pred, evaluate.user_groups(splits.where("split = 'train'"), (5, 25)), ties="epsilon"))


def eval_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings as gains, relevant from 4 on."""
    splits = _splits(spark, sf_dir)
    cand = splits.where("split = 'test'").select("user_id", "item_id", F.col("rating").alias("label"))
    return _rounded(evaluate.evaluate(cand, _popularity(splits, cand), level=4))


def eval_query_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _splits(spark, sf_dir)
    pos = _positives(splits)
    neg = negatives.neg_genre(pos, v.items(spark, sf_dir), negatives.used_items(splits, "test"), 4)
    cand = materialize(negatives.assemble_queries(pos, neg), "queries")
    pred = cand.select("user_id", "ref_item", "item_id").join(_popularity(splits, cand.select("user_id", "item_id").distinct()), ["user_id", "item_id"])
    return _rounded(evaluate.evaluate_queries(cand, pred, evaluate.user_groups(splits.where("split = 'train'"), (5, 25)), ks=(5,)))


def loss_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cand, pred = _evaluated(spark, sf_dir)
    chance = F.col("score") / (F.col("score") + 20.0)
    return _rounded(evaluate.losses(cand, pred.withColumn("score", chance), 0.5))


def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inter = v.interactions(spark, sf_dir)
    users = stats.counts(inter, "user_id").select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "n")
    return users.unionByName(stats.counts(inter, "item_id").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "n"))


def stats_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    inter = v.interactions(spark, sf_dir)
    users = stats.describe(stats.counts(inter, "user_id"), "n").withColumn("kind", F.lit("user"))
    return _rounded(users.unionByName(stats.describe(stats.counts(inter, "item_id"), "n").withColumn("kind", F.lit("item"))))


def stats_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(stats.counts(v.interactions(spark, sf_dir), "user_id"), "n")


def stats_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = v.raw_interactions(spark, sf_dir)
    return _rounded(stats.sparsity(raw).join(F.broadcast(stats.density(raw))), 9)


def stats_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _splits(spark, sf_dir)
    users = stats.group_stats(splits, (5, 25)).withColumn("kind", F.lit("user"))
    return users.unionByName(stats.group_stats(splits, (5, 25), "item_id").withColumn("kind", F.lit("item")))


def stats_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.author_stats(_splits(spark, sf_dir), v.items(spark, sf_dir)))


def stats_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.split_shares(_splits(spark, sf_dir)))


def stats_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.train_only_users(_splits(spark, sf_dir))


def stats_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rating_counts(v.interactions(spark, sf_dir))


def stats_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits, cand, _ = _evaluated(spark, sf_dir)
    return stats.label_counts(cand, evaluate.user_groups(splits.where("split = 'train'"), (5, 25)))


def split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.check_splits(_splits(spark, sf_dir), v.users(spark, sf_dir), v.items(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits, cand, popular = _evaluated(spark, sf_dir)
    chance = cand.select("user_id", "item_id", (hash_int(hash_key(3, "user_id", "item_id")) % 1000).cast("double").alias("score"))
    both = cand.select("user_id", "item_id").join(popular, ["user_id", "item_id"]).join(chance.withColumnRenamed("score", "c"), ["user_id", "item_id"])
    mixed = both.select("user_id", "item_id", (F.col("score") * 10 + F.col("c") / 100).alias("score"))
    groups = evaluate.user_groups(splits.where("split = 'train'"), (5, 25))
    parts = [evaluate.evaluate(cand, p, groups, ks=(5,), ties="trec").withColumn("run", F.lit(name)) for name, p in (("popular", popular), ("random", chance), ("mixed", mixed))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def report_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = spark.sql("SELECT * FROM VALUES ('popular', 'count', 0.0D), ('random', 'none', 0.0D), ('mixed', 'count', 0.01D) AS t(run, profile, lr)")
    return report.runs_table(configs, _runs(spark, sf_dir), ["ndcg_5", "p_1", "rr"])


def report_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.mark_best(report.long_metrics(_runs(spark, sf_dir), ["ndcg_5", "rr"]))


def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pivot_runs(report.long_metrics(_runs(spark, sf_dir), ["ndcg_5"]), "ndcg_5", ["popular", "random", "mixed"])


SPLIT = f"{v.INTERACTIONS}, {v.split_sql()}, train AS (SELECT * FROM split WHERE split = 'train')"
_POS = f"{SPLIT}, pos AS (SELECT user_id, item_id FROM split WHERE split = 'test' AND rating >= 4), used AS (SELECT DISTINCT user_id, item_id FROM split)"


def _uniform_sql(catalogue: str = "SELECT DISTINCT item_id FROM split", k: int = K_NEG, pos: str | None = None) -> str:
    return f"""{pos or _POS}, need AS (SELECT user_id, count(*) * {k} AS need FROM pos GROUP BY user_id),
idx AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM ({catalogue})),
tries AS (SELECT user_id, need, d FROM need, range(0, need * 2 + 8) AS t(d)),
drawn AS (SELECT user_id, need, {v.key_int(42, "user_id", "d")} % (SELECT count(*) FROM idx) AS idx, min(d) AS d FROM tries GROUP BY 1, 2, 3),
fresh AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) AS rn FROM (SELECT * FROM drawn JOIN idx USING (idx)) ANTI JOIN used USING (user_id, item_id)),
cut AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS got FROM fresh WHERE rn <= need),
enough AS (SELECT user_id, item_id FROM cut WHERE got >= need),
rest AS (SELECT user_id, item_id, need, row_number() OVER (PARTITION BY user_id ORDER BY {v.key(42, "user_id", "item_id")}, item_id) AS rn
  FROM (SELECT user_id, need, item_id FROM need, idx WHERE user_id NOT IN (SELECT user_id FROM enough)) ANTI JOIN used USING (user_id, item_id)),
neg AS (SELECT user_id, item_id, 0 AS label FROM enough UNION ALL SELECT user_id, item_id, 0 FROM rest WHERE rn <= need)"""


_CAND = f"{_uniform_sql()}, cand AS (SELECT user_id, item_id, 1 AS label FROM pos UNION ALL SELECT * FROM neg)"
_POPULAR = "popular AS (SELECT user_id, c.item_id, CAST(coalesce(n, 0) AS DOUBLE) AS score FROM {cand} AS c LEFT JOIN (SELECT item_id, count(*) AS n FROM train GROUP BY item_id) AS t ON t.item_id = c.item_id)"


def _detail_sql(cand: str = "cand", pred: str = "popular", keys: str = "user_id", ties: str = "average", ks: tuple = (5, 10, 20), level: int = 1, name: str = "detail") -> str:
    score = "score"
    pre = f"{name}_in AS (SELECT {keys}, item_id, CAST(label AS DOUBLE) AS gain, score FROM {cand} JOIN {pred} USING ({keys}, item_id))"
    if ties == "epsilon":
        pre += f", {name}_e AS (SELECT {keys}, item_id, gain, score + 1e-7::DOUBLE * (row_number() OVER (PARTITION BY {keys}, score ORDER BY item_id DESC) - 1) AS score FROM {name}_in)"
    source = f"{name}_e" if ties == "epsilon" else f"{name}_in"
    gain = "mean_gain" if ties == "average" else "gain"
    ndcg = ", ".join(
        f"coalesce(sum(CASE WHEN p <= {k} THEN {gain} / log2(p + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= {k} THEN gain / log2(ideal + 1) ELSE 0 END), 0), 0) AS ndcg_{k}" for k in ks
    )
    return f"""{pre},
{name}_r AS (SELECT *, CAST(gain >= {level} AS INTEGER) AS rel, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, item_id DESC) AS p,
  row_number() OVER (PARTITION BY {keys} ORDER BY gain DESC, item_id) AS ideal, rank() OVER (PARTITION BY {keys} ORDER BY score) AS below,
  count(*) OVER (PARTITION BY {keys}, score) AS tied, avg(gain) OVER (PARTITION BY {keys}, score) AS mean_gain FROM {source}),
{name} AS (SELECT {keys}, CAST(sum(rel) AS BIGINT) AS n_pos, CAST(sum(1 - rel) AS BIGINT) AS n_neg, {ndcg},
  sum(CASE WHEN p <= 1 THEN rel ELSE 0 END) / 1.0::DOUBLE AS p_1, sum(CASE WHEN p <= 5 THEN rel ELSE 0 END) / 5.0::DOUBLE AS p_5,
  coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN p END), 0) AS rr,
  (sum(CASE WHEN rel = 1 THEN below + (tied - 1) / 2.0::DOUBLE ELSE 0 END) - sum(rel) * (sum(rel) + 1) / 2.0::DOUBLE) / nullif(sum(rel) * sum(1 - rel), 0) AS auc
  FROM {name}_r GROUP BY {keys})"""


def _metrics(ks: tuple = (5, 10, 20)) -> list[str]:
    return [*(f"ndcg_{k}" for k in ks), "p_1", "p_5", "rr", "auc"]


def _summary_sql(groups: str | None, detail: str = "detail", ks: tuple = (5, 10, 20), rounded: bool = True) -> str:
    means = ", ".join(f"{v.half_up(f'avg({m})', 6) if rounded else f'avg({m})'} AS {m}" for m in _metrics(ks))
    parts = f"SELECT 'ALL' AS \"group\", * FROM {detail}"
    if groups:
        parts += f" UNION ALL SELECT \"group\", {detail}.* FROM {detail} JOIN {groups} USING (user_id)"
    return f"SELECT \"group\", count(*) AS n_users, CAST(sum(n_pos) AS BIGINT) AS n_pos, CAST(sum(n_neg) AS BIGINT) AS n_neg, {means} FROM ({parts}) GROUP BY \"group\""


def _groups_sql(a: int, b: int) -> str:
    return f"groups AS (SELECT user_id, CASE WHEN count(*) <= {a} THEN '1-{a}' WHEN count(*) <= {b} THEN '{a + 1}-{b}' ELSE '{b + 1}+' END AS \"group\" FROM train GROUP BY user_id)"


_GENRES = f"{v.ITEMS}, genre_items AS (SELECT DISTINCT item_id, unnest(genres) AS genre FROM items)"
_QUOTA = f"""cnts AS (SELECT user_id, genre, count(*) AS cnt FROM train JOIN genre_items USING (item_id) GROUP BY ALL),
q0 AS (SELECT *, sum(cnt) OVER (PARTITION BY user_id) AS total, count(*) OVER (PARTITION BY user_id) AS n0, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, genre) AS rn
  FROM cnts JOIN (SELECT user_id, count(*) * 4 AS need FROM pos GROUP BY user_id) USING (user_id)),
q1 AS (SELECT *, least(n0, need) AS n, greatest(1, CAST(floor(CAST(cnt * need AS DOUBLE) / total + 0.5) AS BIGINT)) AS q FROM q0 WHERE rn <= need),
q2 AS (SELECT *, CAST(sum(q) OVER (PARTITION BY user_id) - need AS BIGINT) AS over_, CAST(coalesce(sum(q - 1) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spare FROM q1),
quota AS (SELECT user_id, genre, CAST(q - greatest(0, least(q - 1, over_ - spare)) + greatest(0, -over_) // n + CASE WHEN rn <= greatest(0, -over_) % n THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q2)"""
_GENRE_INDEX = """gidx AS (SELECT genre, item_id, row_number() OVER (PARTITION BY genre ORDER BY item_id) - 1 AS idx FROM genre_items), gsize AS (SELECT genre, count(*) AS size FROM genre_items GROUP BY genre)"""
_GENRE_NEG = f"""{_GENRE_INDEX}, mine AS (SELECT user_id, p.item_id AS ref_item, genre, count(*) OVER (PARTITION BY user_id, p.item_id) AS n,
  row_number() OVER (PARTITION BY user_id, p.item_id ORDER BY {v.key(42, "user_id", "p.item_id", "genre")}, genre) - 1 AS g FROM pos AS p JOIN genre_items AS gi ON gi.item_id = p.item_id),
turns AS (SELECT user_id, ref_item, genre, (3 - g) // n + 1 AS wanted FROM mine WHERE g <= 3),
tries AS (SELECT user_id, ref_item, genre, wanted, d FROM turns, range(0, wanted * 2 + 8) AS r(d)),
drawn AS (SELECT user_id, ref_item, genre, wanted, {v.key_int(42, "user_id", "ref_item", "genre", "d")} % size AS idx, min(d) AS d FROM tries JOIN gsize USING (genre) GROUP BY ALL),
fresh AS (SELECT *, row_number() OVER (PARTITION BY user_id, ref_item, genre ORDER BY d) AS rn FROM (SELECT * FROM drawn JOIN gidx USING (genre, idx)) ANTI JOIN used USING (user_id, item_id)),
enough AS (SELECT user_id, ref_item, genre, item_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id, ref_item, genre) AS got FROM fresh WHERE rn <= wanted) WHERE got >= wanted),
again AS (SELECT *, row_number() OVER (PARTITION BY user_id, ref_item, genre ORDER BY {v.key(42, "user_id", "ref_item", "item_id")}, item_id) AS rn
  FROM (SELECT user_id, ref_item, genre, wanted, item_id FROM (SELECT * FROM turns ANTI JOIN enough USING (user_id, ref_item, genre)) JOIN genre_items USING (genre)) ANTI JOIN used USING (user_id, item_id)),
genre_neg AS (SELECT user_id, ref_item, item_id FROM enough UNION SELECT user_id, ref_item, item_id FROM again WHERE rn <= wanted)"""
_PROPORTIONAL = f"""{_GENRE_INDEX}, tries AS (SELECT user_id, genre, quota AS wanted, d FROM quota, range(0, quota * 2 + 8) AS r(d)),
drawn AS (SELECT user_id, genre, wanted, {v.key_int(42, "user_id", "genre", "d")} % size AS idx, min(d) AS d FROM tries JOIN gsize USING (genre) GROUP BY ALL),
c1 AS (SELECT user_id, item_id, min(genre) AS genre, arg_min(wanted, genre) AS wanted, arg_min(d, genre) AS turn FROM (SELECT * FROM drawn JOIN gidx USING (genre, idx)) ANTI JOIN used USING (user_id, item_id) GROUP BY user_id, item_id),
p1 AS (SELECT user_id, item_id, genre FROM (SELECT *, row_number() OVER (PARTITION BY user_id, genre ORDER BY turn, item_id) AS rn FROM c1) WHERE rn <= wanted),
m1 AS (SELECT user_id, genre, quota - coalesce(got, 0) AS wanted FROM quota LEFT JOIN (SELECT user_id, genre, count(*) AS got FROM p1 GROUP BY ALL) USING (user_id, genre) WHERE quota > coalesce(got, 0)),
b1 AS (SELECT user_id, item_id FROM used UNION SELECT user_id, item_id FROM p1),
c2 AS (SELECT user_id, item_id, min(genre) AS genre, arg_min(wanted, genre) AS wanted, arg_min({v.key(42, "user_id", "genre", "item_id")}, genre) AS turn FROM (SELECT user_id, genre, wanted, item_id FROM m1 JOIN genre_items USING (genre)) ANTI JOIN b1 USING (user_id, item_id) GROUP BY user_id, item_id),
p2 AS (SELECT user_id, item_id, genre FROM (SELECT *, row_number() OVER (PARTITION BY user_id, genre ORDER BY turn, item_id) AS rn FROM c2) WHERE rn <= wanted),
taken AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
short AS (SELECT user_id, CAST(sum(quota - coalesce(got, 0)) AS BIGINT) AS need FROM quota LEFT JOIN (SELECT user_id, genre, count(*) AS got FROM taken GROUP BY ALL) USING (user_id, genre) WHERE quota > coalesce(got, 0) GROUP BY user_id),
b2 AS (SELECT user_id, item_id FROM used UNION SELECT user_id, item_id FROM taken),
rest AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY cnt DESC, genre) AS best FROM (SELECT user_id, need, cnt, genre, item_id FROM cnts JOIN short USING (user_id) JOIN genre_items USING (genre)) ANTI JOIN b2 USING (user_id, item_id)),
p3 AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, genre, {v.key(42, "user_id", "item_id")}, item_id) AS rn FROM rest WHERE best = 1) WHERE rn <= need)"""


def bm25_sql(queries: str, docs: str, topn: int, name: str = "ranking", tags: str | None = None) -> str:
    """SQL of `corpus.bm25` over relations (item_id, tokens)."""
    shared = f"JOIN {tags} AS allowed ON allowed.query_item = q.query_item AND allowed.item_id = tf.item_id" if tags else ""
    return f"""tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(tokens) AS term FROM {docs}) GROUP BY ALL),
dl AS (SELECT item_id, len(tokens) AS dl FROM {docs}),
idf0 AS (SELECT term, ln((SELECT count(*) FROM dl) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf FROM tf GROUP BY term),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
qtf AS (SELECT query_item, term, count(*) AS qtf FROM (SELECT item_id AS query_item, unnest(tokens) AS term FROM {queries}) GROUP BY ALL),
scored AS (SELECT q.query_item, tf.item_id AS doc_item, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(dl) FROM dl)))) AS score
  FROM qtf AS q JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.item_id = tf.item_id {shared} GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_item ORDER BY round(score, 9) DESC, doc_item) AS INTEGER) AS rank FROM scored) WHERE rank <= {topn})"""


def tokens_sql(text: str) -> str:
    """SQL of `tokenize`."""
    spaced = rf"regexp_replace(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '<br />|[;:]', ' ', 'g'), '\"', '', 'g'), '([''.,()!?])', ' \1 ', 'g')"
    return rf"list_filter(string_split(regexp_replace({spaced}, '\s+', ' ', 'g'), ' '), lambda t: t <> '')"


_ITEM_DOCS = f"{v.ITEM_TEXTS}, docs AS (SELECT item_id, {tokens_sql('text')} AS tokens FROM item_texts)"
#: The query items: every twentieth id, against all items.
_QUERY_ITEMS = "asked AS (SELECT * FROM docs WHERE item_id % 20 = 0)"
_EVAL = f"WITH {_CAND}, {_POPULAR.format(cand='cand')}"
_RUNS = f"""{_CAND}, {_POPULAR.format(cand="cand")},
random_ AS (SELECT user_id, item_id, CAST({v.key_int(3, "user_id", "item_id")} % 1000 AS DOUBLE) AS score FROM cand),
mixed AS (SELECT user_id, item_id, p.score * 10 + r.score / 100 AS score FROM popular AS p JOIN random_ AS r USING (user_id, item_id)), {_groups_sql(5, 25)},
{_detail_sql(pred="popular", ties="trec", ks=(5,), name="d1")}, {_detail_sql(pred="random_", ties="trec", ks=(5,), name="d2")}, {_detail_sql(pred="mixed", ties="trec", ks=(5,), name="d3")},
runs AS ({" UNION ALL ".join(f"SELECT '{run}' AS run, * FROM ({_summary_sql('groups', d, (5,), rounded=False)})" for run, d in (("popular", "d1"), ("random", "d2"), ("mixed", "d3")))})"""
_HUNDRED = lambda m: v.half_up(f"{m} * 100", 2)


def _moments(kind: str, key: str) -> str:
    d = f"(SELECT CAST(count(*) AS DOUBLE) AS n FROM inter GROUP BY {key})"
    central = lambda k: f"avg((n - m) ** {k})"
    skew = f"{central(3)} / ({central(2)} ** 1.5)"
    return f"""SELECT count(*) AS n, {v.half_up("min(n)", 6)} AS min, {v.half_up("max(n)", 6)} AS max, {v.half_up("avg(n)", 6)} AS mean, {v.half_up("var_samp(n)", 6)} AS variance, {v.half_up("stddev_samp(n)", 6)} AS std,
  {v.half_up(skew, 6)} AS skewness, {v.half_up(f"{central(4)} / ({central(2)} ** 2) - 3", 6)} AS kurtosis, '{kind}' AS kind FROM {d}, (SELECT avg(n) AS m FROM {d})"""


ORACLES = {
    "neg_uniform": f"WITH {_uniform_sql()} SELECT * FROM neg",
    "neg_uniform_checks": f"""WITH {_uniform_sql()} SELECT 'used' AS "check", count(*) AS bad FROM neg SEMI JOIN used USING (user_id, item_id)
UNION ALL SELECT 'positives_only', count(*) FROM (SELECT DISTINCT user_id FROM pos) ANTI JOIN neg USING (user_id) UNION ALL SELECT 'negatives_only', count(*) FROM (SELECT DISTINCT user_id FROM neg) ANTI JOIN pos USING (user_id)""",
    "neg_shortfall": f"WITH {_uniform_sql("SELECT DISTINCT item_id FROM split JOIN part ON p_partkey = item_id WHERE p_brand = 'Brand#11'", 3 * K_NEG)} SELECT user_id, need, coalesce(got, 0) AS got FROM (SELECT user_id, need FROM need) LEFT JOIN (SELECT user_id, count(*) AS got FROM neg GROUP BY user_id) USING (user_id) WHERE coalesce(got, 0) < need",
    "neg_all": f"WITH {_POS} SELECT user_id, item_id FROM (SELECT user_id, item_id FROM (SELECT DISTINCT user_id FROM split WHERE user_id % 20 = 0), (SELECT DISTINCT item_id FROM split)) ANTI JOIN train USING (user_id, item_id)",
    "neg_genre": f"WITH {_POS}, {_GENRES}, {_GENRE_NEG} SELECT * FROM genre_neg",
    "neg_genre_quota": f"WITH {_POS}, {_GENRES}, {_QUOTA} SELECT * FROM quota",
    "neg_genre_proportional": f"WITH {_POS}, {_GENRES}, {_QUOTA}, {_PROPORTIONAL} SELECT user_id, item_id FROM taken UNION ALL SELECT * FROM p3",
    "neg_search": f"""WITH {_POS}, {_ITEM_DOCS}, {_QUERY_ITEMS}, {bm25_sql("asked", "docs", 100)},
near AS (SELECT DISTINCT user_id, item_id AS ref_item, doc_item AS item_id, rank FROM pos JOIN ranking ON query_item = item_id AND doc_item <> item_id)
SELECT user_id, item_id, 0 AS label, ref_item FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ref_item ORDER BY rank, item_id) AS rn FROM near ANTI JOIN used USING (user_id, item_id)) WHERE rn <= 10""",
    "neg_cf_weighted": f"""WITH {_uniform_sql()}, {v.ITEM_VECTORS},
scored AS (SELECT n.user_id, n.item_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(a.vec, b.vec) + 0.5::DOUBLE)) AS s
  FROM neg AS n JOIN train AS t ON t.user_id = n.user_id JOIN item_vecs AS a ON a.item_id = n.item_id JOIN item_vecs AS b ON b.item_id = t.item_id)
SELECT user_id, item_id, {v.half_up("avg(s)", 6)} AS label FROM scored GROUP BY user_id, item_id""",
    "eval_user": f"{_EVAL}, {_groups_sql(5, 25)}, {_detail_sql()} {_summary_sql('groups')}",
    "eval_groups_threshold": f"WITH {SPLIT}, {_groups_sql(10, 25)} SELECT \"group\", count(*) AS n_users FROM groups GROUP BY 1",
    "eval_groups_ratio": f"""{_EVAL}, counted AS (SELECT user_id, row_number() OVER (ORDER BY count(*), user_id) AS rn, count(*) OVER () AS total FROM train GROUP BY user_id),
groups AS (SELECT user_id, CASE WHEN rn <= floor(total * 50 / 100) THEN 'sporadic' WHEN rn <= floor(total * 80 / 100) THEN 'regular' ELSE 'bibliophilic' END AS "group" FROM counted), {_detail_sql()} {_summary_sql("groups")}""",
    "eval_detail": f"{_EVAL}, {_detail_sql()} SELECT user_id, n_pos, n_neg, {', '.join(f'{v.half_up(m, 6)} AS {m}' for m in _metrics())} FROM detail",
    "eval_trec": f"{_EVAL}, {_detail_sql(ties='trec')} {_summary_sql(None)}",
    "eval_tiebreak": f"{_EVAL}, {_groups_sql(5, 25)}, {_detail_sql(ties='epsilon')} {_summary_sql('groups')}",
    "eval_graded": f"WITH {SPLIT}, cand AS (SELECT user_id, item_id, rating AS label FROM split WHERE split = 'test'), {_POPULAR.format(cand='cand')}, {_detail_sql(level=4)} {_summary_sql(None)}",
    "eval_query_micro_macro": f"""WITH {_POS}, {_GENRES}, {_GENRE_NEG},
cand AS (SELECT user_id, item_id, 1 AS label, item_id AS ref_item FROM pos UNION ALL SELECT user_id, item_id, 0, ref_item FROM genre_neg),
{_POPULAR.format(cand="(SELECT DISTINCT user_id, item_id FROM cand)").replace("popular AS", "scores AS")},
popular AS (SELECT c.user_id, c.ref_item, c.item_id, score FROM cand AS c JOIN scores AS s ON s.user_id = c.user_id AND s.item_id = c.item_id), {_groups_sql(5, 25)}, {_detail_sql(keys="user_id, ref_item", ks=(5,))},
parts AS (SELECT 'ALL' AS "group", * FROM detail UNION ALL SELECT "group", detail.* FROM detail JOIN groups USING (user_id)),
micro AS (SELECT "group", count(*) AS n_queries, {", ".join(f"avg({m}) AS micro_{m}" for m in _metrics((5,)))} FROM parts GROUP BY 1),
macro AS (SELECT "group", count(*) AS n_users, {", ".join(f"avg({m}) AS macro_{m}" for m in _metrics((5,)))} FROM (SELECT "group", user_id, {", ".join(f"avg({m}) AS {m}" for m in _metrics((5,)))} FROM parts GROUP BY 1, 2) GROUP BY 1)
SELECT "group", n_users, n_queries, {", ".join(f"{v.half_up(f'{k}_{m}', 6)} AS {k}_{m}" for m in _metrics((5,)) for k in ("micro", "macro"))} FROM micro JOIN macro USING ("group")""",
    "loss_metrics": f"""{_EVAL}, rows AS (SELECT user_id, label, score / (score + 20.0::DOUBLE) AS s FROM cand JOIN popular USING (user_id, item_id)),
point AS (SELECT avg(-(label * ln(least(greatest(s, 1e-12), 1 - 1e-12)) + (1 - label) * ln(1 - least(greatest(s, 1e-12), 1 - 1e-12)))) AS bce, avg((s - label) * (s - label)) AS mse FROM rows),
pairs AS (SELECT avg(greatest(0.0::DOUBLE, 0.5::DOUBLE - (a.s - b.s))) AS m FROM rows AS a JOIN rows AS b USING (user_id) WHERE a.label = 1 AND b.label = 0)
SELECT {v.half_up("bce", 6)} AS bce, {v.half_up("mse", 6)} AS mse, {v.half_up("m", 6)} AS margin_loss FROM point, pairs""",
    "stats_counts": f"WITH {v.INTERACTIONS} SELECT 'user' AS kind, user_id AS id, count(*) AS n FROM inter GROUP BY user_id UNION ALL SELECT 'item', item_id, count(*) FROM inter GROUP BY item_id",
    "stats_describe": f"WITH {v.INTERACTIONS} {_moments('user', 'user_id')} UNION ALL {_moments('item', 'item_id')}",
    "stats_histogram": f"""WITH {v.INTERACTIONS} SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 50 THEN '11-50' WHEN n <= 100 THEN '51-100' WHEN n <= 200 THEN '101-200' WHEN n <= 500 THEN '201-500' WHEN n <= 1000 THEN '501-1000' ELSE '1001+' END AS bin,
  count(*) AS n FROM (SELECT count(*) AS n FROM inter GROUP BY user_id) GROUP BY 1""",
    "stats_density": f"""WITH raw AS (SELECT o_custkey AS u, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT DISTINCT u, i FROM raw)
SELECT (SELECT count(*) FROM raw) AS n, (SELECT count(DISTINCT u) FROM raw) AS n_users, (SELECT count(DISTINCT i) FROM raw) AS n_items, {v.half_up("1 - (SELECT count(*) FROM raw) / ((SELECT count(DISTINCT u) FROM raw) * (SELECT count(DISTINCT i) FROM raw))::DOUBLE", 9)} AS sparsity,
  (SELECT count(*) FROM e) AS n_edges, {v.half_up("(SELECT count(*) FROM e) / ((SELECT count(DISTINCT u) FROM e) * (SELECT count(DISTINCT i) FROM e))::DOUBLE", 9)} AS density""",
    "stats_groups": f"WITH {SPLIT} "
    + " UNION ALL ".join(
        f"""SELECT split, CASE WHEN t.n IS NULL THEN '0' WHEN t.n <= 5 THEN '1-5' WHEN t.n <= 25 THEN '6-25' ELSE '26+' END AS "group", count(DISTINCT s.{k}) AS n_keys, count(*) AS n_rows, '{kind}' AS kind
FROM split AS s LEFT JOIN (SELECT {k}, count(*) AS n FROM train GROUP BY {k}) AS t ON t.{k} = s.{k} GROUP BY 1, 2"""
        for kind, k in (("user", "user_id"), ("item", "item_id"))
    ),
    "stats_authors": f"""WITH {SPLIT}, rows AS (SELECT split, user_id, p_brand AS author FROM split JOIN part ON p_partkey = item_id), b AS (SELECT * FROM rows UNION ALL SELECT 'TOTAL', user_id, author FROM rows),
s AS (SELECT split, count(DISTINCT author) AS n_authors, count(DISTINCT user_id) AS u, count(DISTINCT (user_id, author)) AS p FROM b GROUP BY split)
SELECT split, n_authors, {v.half_up("p / u::DOUBLE", 6)} AS authors_per_user, {v.half_up("p / n_authors::DOUBLE", 6)} AS users_per_author, CASE WHEN split = 'TOTAL' THEN (SELECT CAST(sum(n_authors) AS BIGINT) FROM s WHERE split <> 'TOTAL') ELSE n_authors END AS sum_of_splits FROM s""",
    "stats_shares": f"WITH {SPLIT} SELECT coalesce(split, 'ALL') AS split, count(*) AS n, {v.half_up('count(*) / (SELECT count(*) FROM split)::DOUBLE', 6)} AS share FROM split GROUP BY ROLLUP (split)",
    "stats_train_only": f"WITH {SPLIT} SELECT count(DISTINCT user_id) AS n_users, count(*) AS n_rows FROM split WHERE user_id NOT IN (SELECT user_id FROM split WHERE split <> 'train')",
    "stats_ratings": f"WITH {v.INTERACTIONS} SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE rating = {r}) AS n_{r}' for r in range(1, 6))} FROM inter",
    "stats_labels": f"WITH {_CAND}, {_groups_sql(5, 25)} SELECT \"group\", count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg FROM cand JOIN groups USING (user_id) GROUP BY 1",
    "split_checks": f"""WITH {SPLIT} SELECT 'repeated_users' AS "check", count(*) AS bad FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated_items', count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unknown_users', count(*) FROM split WHERE user_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'unknown_items', count(*) FROM split WHERE item_id NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'pairs_in_two_splits', count(*) FROM (SELECT user_id, item_id FROM split GROUP BY 1, 2 HAVING count(DISTINCT split) > 1)""",
    "report_runs": f"""WITH {_RUNS} SELECT run, profile, lr, "group", n_users, {", ".join(f"{_HUNDRED(m)} AS {m}" for m in ("ndcg_5", "p_1", "rr"))} FROM runs
JOIN (VALUES ('popular', 'count', 0.0::DOUBLE), ('random', 'none', 0.0::DOUBLE), ('mixed', 'count', 0.01::DOUBLE)) AS c(run, profile, lr) USING (run)""",
    "report_best": f"""WITH {_RUNS}, long AS (SELECT run, "group", 'ndcg_5' AS metric, {_HUNDRED("ndcg_5")} AS value FROM runs UNION ALL SELECT run, "group", 'rr', {_HUNDRED("rr")} FROM runs)
SELECT *, value = max(value) OVER (PARTITION BY "group", metric) AS best FROM long""",
    "report_pivot": f"""WITH {_RUNS} SELECT "group", {", ".join(f"max(CASE WHEN run = '{r}' THEN {_HUNDRED('ndcg_5')} END) AS {r}" for r in ("popular", "random", "mixed"))} FROM runs GROUP BY 1""",
}
QUERIES = {
    f.__name__: f
    for f in (
        neg_uniform, neg_uniform_checks, neg_shortfall, neg_all, neg_genre, neg_genre_quota, neg_genre_proportional, neg_search, neg_cf_weighted,
        eval_user, eval_groups_threshold, eval_groups_ratio, eval_detail, eval_trec, eval_tiebreak, eval_graded, eval_query_micro_macro, loss_metrics,
        stats_counts, stats_describe, stats_histogram, stats_density, stats_groups, stats_authors, stats_shares, stats_train_only, stats_ratings, stats_labels, split_checks,
        report_runs, report_best, report_pivot,
    )
}
