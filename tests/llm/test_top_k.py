import math

import numpy as np
import pytest

import compare
from factsheet.llm import queries, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, k):
    v = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e in rows}
    out = set()
    for q in v:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("kind", ["random", "ties", "negative", "few"])
def test_against_all_pairs(spark, kind):
    rng = np.random.default_rng(5)
    n = 4 if kind == "few" else 700
    vectors = rng.normal(size=(n, 12))
    if kind == "ties":
        vectors = np.round(vectors / 2) / 4
    if kind == "negative":
        vectors = np.abs(vectors) * np.where(np.arange(n) % 10 == 0, -1, 1)[:, None]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {tuple(r) for r in top_k.search(df, every=10, rows=64, queries_at_once=16).collect()}
    assert got == plain(rows, 10, 5)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    df = queries.QUERIES["op3_top_k"](spark, folder)
    names, rows = compare.oracle_rows(compare.connect(folder), queries.ORACLES["op3_top_k"])
    assert compare.spark_rows(df.select(*sorted(df.columns))) == (names, rows)


def test_unusable_repeated_and_no_vectors(spark):
    bad = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1), (5, [1.0], 1), (6, [0.5, 0.5], 1)]
    df = spark.createDataFrame(bad, SCHEMA)
    assert {tuple(r) for r in top_k.search(df).collect()} == {(0, 1, 6, 256 * 128 + 512 * 128), (0, 2, 5, 65536)}
    assert top_k.search(df.limit(0)).count() == 0


def test_the_threshold_leaves_entries_out(spark):
    a, b = np.array([[10, 10]]), np.array([[9, 9], [1, 1], [-9, 30]])
    first, second = top_k.slices(a, b, 2)
    assert (first + second).tolist() == [[180, 20, 210]] and ((2 * first >= 180) | (2 * second >= 180)).tolist() == [[True, False, True]]


def test_vectors_of_one_id_all_stay(spark):
    rows = [(0, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [3.0, 0.0]), (50, [0.0, 1.0]), (50, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int, score long, query_id int")
    got = sorted(tuple(r) for r in top_k.search(df).collect() if r.query_id == 0)
    assert got == [(0, 1, 7, 196608), (0, 2, 50, 131072), (0, 3, 7, 65536), (0, 4, 50, 0)]
    many = [(i % 90, [float(np.float32(x)) for x in np.random.default_rng(i).normal(size=5)]) for i in range(400)]
    found = sorted(tuple(r) for r in top_k.search(spark.createDataFrame([(i, v, 0) for i, v in many], SCHEMA), rows=32).collect())
    v = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in many]
    expected = []
    for q in (0, 50):
        scores = sorted((-sum(a * b for a, b in zip(x, y)), c) for i, x in v if i == q for c, y in v if c != q)[:5]
        expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    assert found == expected
