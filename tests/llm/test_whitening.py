import math

import numpy as np
import pytest

from factsheet.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows):
    """Covariance and eigenvectors by the library, sums by Python's integers."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(x) for x in zip(*distinct)]
    z = np.array(distinct, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1]


def check(found, rows, components=4):
    kept, n, sums, values, vectors = plain(rows)
    trace = values.sum()
    values = values[:components][values[:components] > 1e-9 * values[0]]
    assert len(found) == len(kept) * len(values)
    by_key = {(r.vec_id, r.component): r for r in found.itertuples()}
    signs = {}
    for i, x in kept:
        for k, e in enumerate(values):
            r = by_key[i, k + 1]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            expected = (np.array(x) - np.array(sums) / n) @ vectors[:, k] / np.sqrt(e)
            if abs(expected) > 1e-3:
                signs.setdefault(k, np.sign(expected * r.whitened))
            assert r.whitened * signs.get(k, 1) == pytest.approx(expected, abs=1e-7)
            assert r.explained == pytest.approx(e / trace, rel=1e-9)
            assert 0 <= r.identity_error < 1e-9


def test_nulls_repeats_and_other_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5]]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # one vector in many rows counts once
    bad = [(200, None), (201, [None] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [math.nan] + [0.0] * 5), (204, [math.inf] + [0.0] * 5)]
    df = spark.createDataFrame(rows + bad + [(205, [1.0]), (206, [])], SCHEMA)
    check(whitening.whiten(df).toPandas(), rows + bad)
    extra = df.selectExpr("*", "1 AS component", "'x' AS whitened", "vec_id AS key", "2 AS n")
    check(whitening.whiten(extra).toPandas(), rows + bad)


def test_few_dimensions_equal_rows_and_an_empty_table(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, 0.0]), (None, [0.0, 0.0])]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert sorted(found["component"]) == [1] * 4 + [2] * 4 and found["vec_id"].isna().sum() == 2
    line = [(i, [float(i), 2.0 * i, -float(i)]) for i in range(9)]
    found = whitening.whiten(spark.createDataFrame(line, SCHEMA)).toPandas()
    assert set(found["component"]) == {1}
    check(found, line)
    for rows in ([], [(1, [1.0, 2.0])] * 3, [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_entries_beyond_a_long(spark):
    rows = [(i, [1e30 * (i - 2), float(i), 1e18]) for i in range(5)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert found["deviation"].isna().any() and np.isfinite(found["whitened"]).all()


def test_deviation_is_exact_or_null():
    model = whitening.Whitening(3, [1 << 40, 5], np.zeros((2, 0)), np.zeros(0), np.zeros(0))
    x = np.array([[1, 2], [(1 << 40) // 3, 2], [1 << 50, 0]], np.int64)
    expected = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, model.sums)) for row in x]
    assert model.deviation(x) == [v if v < 1 << 63 else None for v in expected]


@pytest.mark.parametrize("rank", [1, 3, 8])
def test_factors(rank):
    rng = np.random.default_rng(rank)
    b = rng.normal(size=(8, rank)) * 10.0 ** rng.integers(-3, 4, size=rank)
    a = b @ b.T
    order, l = whitening.pivoted_cholesky(a)
    assert np.allclose(l @ l.T, a[np.ix_(order, order)], rtol=0, atol=1e-12 * a.max())
    assert np.allclose(np.triu(l[: l.shape[1]], 1), 0) and (np.diff(np.abs(l.diagonal())) <= 1e-9 * l[0, 0]).all()
    values, vectors = whitening.jacobi(l)
    back = np.zeros_like(vectors)
    back[order] = vectors
    expected = np.linalg.eigvalsh(a)[::-1]
    assert np.allclose(values[:rank], expected[:rank], rtol=1e-9, atol=1e-13 * expected[0])
    assert np.allclose(a @ back[:, 0], values[0] * back[:, 0], rtol=1e-9, atol=1e-9 * values[0])
    assert np.allclose(vectors[:, :rank].T @ vectors[:, :rank], np.eye(min(rank, vectors.shape[1])), atol=1e-10)


def test_packed_rows_come_back():
    x = np.array([[0, 1, -2], [40_000, 0, 1], [1 << 40, 3, -(1 << 62)], [-(1 << 15), 0, (1 << 15) - 1]], np.int64)
    import pyarrow as pa

    packed = whitening.pack(x)
    assert [len(p) for p in packed] == [6, 12, 24, 6]
    assert (whitening.unpack(pa.array(packed, pa.binary()), 3) == x).all()


def test_whole_table(spark):
    found = queries.QUERIES["op11_whitening"](spark, "/root/testdata/sf0.01").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    check(found, [(r.vec_id, r.embedding) for r in rows])
