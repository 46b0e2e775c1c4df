"""Every query that has SQL, held against DuckDB on the smallest tables; the others on invariants."""

import hashlib
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry_point
from recdata.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def walk(edges, start, side, per_item, per_user, total, weigh):
    """The frontier walk by plain loops: (users, items, rounds)."""
    degree = [Counter(e[k] for e in edges) for k in (0, 1)]
    seen, front, rounds, idle = [set(), set()], set(start), 0, 0
    seen[side] |= front
    while len(seen[0]) < total and rounds < 20 and idle < 2 and front:
        rounds += 1
        target = 1 - side
        reached = {e[target] for e in edges if e[side] in front} - seen[target]
        quota = len(front) * (per_user if target else per_item)
        quota = quota if target else min(quota, total - len(seen[0]))

        def draw(x, target=target, rounds=rounds):
            u = (int(hashlib.md5(f"{42 + rounds}|{x}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0
            return round(-math.log(u) / weigh(degree[target][x]), 12), x

        front = set(sorted(reached, key=draw)[:quota])
        seen[target] |= front
        idle = 0 if front else idle + 1
        side = target
    return seen[0], seen[1], rounds


@pytest.mark.parametrize(("name", "side", "weigh"), [("frontier_sample", 0, float), ("item_frontier_sample", 1, lambda d: 1.0 / d)])
def test_frontier_samples_equal_a_plain_walk(spark, name, side, weigh):
    edges = [(r["user_id"], r["item_id"]) for r in plans.QUERIES["dedupe_interactions"](spark, SF).where("rating >= 4").collect()]
    start = sorted({e[side] for e in edges}, key=lambda x: (hashlib.md5(f"42|{x}".encode()).hexdigest(), x))[:20]
    users, items, rounds = walk(edges, start, side, 2, 3, 200, weigh)
    got = [tuple(r) for r in plans.QUERIES[name](spark, SF).select("user_id", "item_id", "rounds").collect()]
    assert sorted(got) == sorted((u, i, rounds) for u, i in edges if u in users and i in items) and got


def test_proportional_negatives_are_unused(spark):
    inter = plans.QUERIES["dedupe_interactions"](spark, SF)
    got = plans.QUERIES["neg_genre_proportional"](spark, SF)
    assert got.join(inter, ["user_id", "item_id"], "left_semi").count() == 0
    assert got.count() == got.distinct().count() > 0


def test_als_learns(spark):
    """Held-in items score above unused ones in two disjoint groups of users and items."""
    from recdata.operators import models

    rows = [(u, i, 5) for u in range(30) for i in range(20) if u % 2 == i % 2 and (u + i) % 7]
    train = spark.createDataFrame(rows, "user_id long, item_id long, rating int")
    users, items = models.als_vectors(models.fit_als(train, rank=4, iterations=5))
    best = models.top_n(users, items, train, 1).collect()
    assert sum(r["user_id"] % 2 == r["item_id"] % 2 for r in best) > 0.9 * len(best)


@pytest.mark.parametrize("name", ["two_hop_sample", "density_sample", "frontier_sample", "item_frontier_sample"])
def test_samples_join_the_tables_once(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan  # the walk reads stored pairs
