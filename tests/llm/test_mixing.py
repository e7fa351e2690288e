import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factsheet.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, target string"


def plain_targets(size, cap=3):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = {}, sum(size.values())
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(full.values())
        target = full | {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > cap * size[s]]
        if not over:
            return target
        full |= {s: cap * size[s] for s in over}


def table(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1) * 8)), rng.choice(["a", "a", "a", "a", "b", "c", "é", None, ""]), "x") for i in range(n)]
    return spark.createDataFrame(rows + rows[:3] + [(None, None, "a", "x"), (7, "", "zz", "x")], SCHEMA)


def test_targets_sizes_and_words_taken(spark):
    df = table(spark)
    rows = mixing.mix(df, blocks=5000, shards=16).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(rows) == 605 and all(r.source_size == size[r.source] for r in rows)
    assert target == pytest.approx(plain_targets(size))
    for s in size:
        assert abs(taken[s] - target[s]) <= max(5, 0.01 * target[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(7), blocks=5000, shards=16).collect()))


def test_caps_and_shares(spark):
    df = spark.createDataFrame([(1, "w " * 5, "a", ""), (2, "w " * 1000, "b", ""), (3, "w " * 7, "c", "")], SCHEMA)
    got = {r.source: r for r in mixing.mix(df).collect()}
    assert (got["a"].target, got["b"].target, got["c"].target) == (15.0, 976.0, 21.0)
    assert (got["a"].taken, got["c"].taken) == (15, 21) and abs(got["b"].taken - 976) <= 1


def seats_by_quotients(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_seats_are_those_of_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    groups = {g: ([rng.choice([1, 2, 3, 500, 10_000]) * rng.random() + 0.01 for _ in range(rng.randint(1, 40))], rng.randint(0, 900)) for g in range(6)}
    rows = [(g, i, w, seats) for g, (weights, seats) in groups.items() for i, w in enumerate(weights)]
    got = mixing.apportion(spark.createDataFrame(rows, "g int, p int, w double, n long"), "w", "n", ["g"], ["p"]).orderBy("g", "p").collect()
    assert [r.quota for r in got] == [x for weights, seats in groups.values() for x in seats_by_quotients(weights, seats)]


def test_whole_documents_of_the_mix(spark):
    df = table(spark)
    rows = mixing.mixed_documents(df).collect()
    wanted = {(r.doc_id, r.size): r.taken / max(r.size, 1) for r in mixing.mix(df).collect()}
    seen = defaultdict(int)
    for r in rows:
        seen[(r.doc_id, len((r.text or "").split()))] += 1
    assert rows[0].__fields__ == df.columns and set(seen) <= set(wanted)
    for (doc, size), n in seen.items():
        if doc is not None and doc > 3:
            assert abs(n - wanted[doc, size]) < 1


def test_no_rows(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([(1, None, None, "")], SCHEMA)).count() == 0


def test_plan_is_native(spark):
    plan = queries.QUERIES["op8_mixing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_rows_without_id_are_spread(spark):
    rows = [(None, "a b c", "s")] * 1500 + [(None, f"w{i} x y", "s") for i in range(1500)] + [(i, "a b c", "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(24)
    mixed = mixing.mix(df, shards=16, seed=7)
    # a window's shard shows in the plan's first exchange of rows: count them by the same hash
    anonymous = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text"), F.spark_partition_id()))
    shard = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id"), F.lit(3).cast("long"), anonymous), F.lit(16))
    sizes = df.groupBy(shard.alias("shard")).count().toPandas()["count"]
    assert len(sizes) == 16 and sizes.max() < 2 * sizes.mean()
    assert mixed.agg(F.sum("taken")).first()[0] == pytest.approx(3 * 6000, rel=0.02) and mixed.count() == 6000
