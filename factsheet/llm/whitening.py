"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from factsheet.llm.common import shared_folder

#: Rows of a scatter matrix that travel and are added up together.
_BLOCK = 64
_LONG = 1 << 63


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """``floor(256 * c)`` of finite entries as longs; what lies beyond a long becomes its nearest end."""
    return np.clip(np.floor(256.0 * vectors), -float(_LONG), float(_LONG - 1024)).astype(np.int64)


def pack(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 2, 4 or 8 bytes a number that holds it, so that equal rows are equal bytes."""
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    width = np.where((low >= -(1 << 15)) & (high < 1 << 15), 2, np.where((low >= -(1 << 31)) & (high < 1 << 31), 4, 8))
    out: list[bytes] = [b""] * len(x)
    for w in (2, 4, 8):
        rows = np.flatnonzero(width == w)
        data, step = x[rows].astype(f"<i{w}").tobytes(), w * x.shape[1]
        for k, row in enumerate(rows.tolist()):
            out[row] = data[k * step : (k + 1) * step]
    return out


def unpack(column: pa.Array, dims: int) -> np.ndarray:
    """The rows that ``pack`` made, as longs."""
    values = column.to_pylist()
    x = np.zeros((len(values), dims), np.int64)
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        by_size.setdefault(len(v), []).append(i)
    for size, rows in by_size.items():
        if size:
            x[rows] = np.frombuffer(b"".join(values[i] for i in rows), f"<i{size // dims}").reshape(len(rows), dims)
    return x


def sound(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of vectors: lengths, which are sound (not null, all entries there and finite), and all entries in a row.

    The entries of null vectors are left out, and those that are null are not a number.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    ends = np.cumsum(lengths)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    return lengths, present & (bad[ends] == bad[ends - lengths]), entries


def rows_of(lengths: np.ndarray, chosen: np.ndarray, entries: np.ndarray, dims: int) -> np.ndarray:
    """The chosen vectors, all ``dims`` long, as a matrix."""
    starts = (np.cumsum(lengths) - lengths)[chosen]
    return entries[starts[:, None] + np.arange(dims)] if len(starts) else np.zeros((0, dims))


def _vectors(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(f"`{column}`").cast("array<double>").alias("vector"))


def distinct_vectors(df: DataFrame, column: str) -> DataFrame:
    """``dims`` and ``packed`` of every sound vector of ``df``, each distinct one once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, good, entries = sound(batch.column("vector"))
            for dims in np.unique(lengths[good]).tolist():
                packed = pack(whole_numbers(rows_of(lengths, good & (lengths == dims), entries, dims)))
                yield pa.RecordBatch.from_pydict({"dims": pa.array([dims] * len(packed), pa.int32()), "packed": pa.array(packed, pa.binary())})

    return _vectors(df, column).mapInArrow(run, "dims int, packed binary").distinct()


def sums(rows: DataFrame, dims: int) -> list[int]:
    """The exact sum of each dimension of the packed rows: in longs within a batch where they hold it, decimals beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = [0] * dims
        for batch in batches:
            x = unpack(batch.column(0), dims)
            if not len(x):
                continue
            fits = max(-int(x.min()), int(x.max())) * len(x) < _LONG if dims else True
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0) if fits else x.astype(object).sum(axis=0))]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(dims), pa.int32()), "total": pa.array(map(str, total), pa.string())})

    added = rows.mapInArrow(run, "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["at"]: int(r["total"]) for r in added.collect()}
    return [found.get(i, 0) for i in range(dims)]


def scatter(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The sum over all rows of the outer products of their distance from ``mean``.

    Every task adds up its own rows and sends one matrix, in blocks of its rows; blocks are added where they meet.
    """
    dims = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            z = unpack(batch.column(0), dims) - mean
            total += z.T @ z
        blocks = [total[i : i + _BLOCK].tobytes() for i in range(0, dims, _BLOCK)]
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "part": pa.array(blocks, pa.binary())})

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.float64(0)
        for pdf in batches:
            for part in pdf["part"]:
                total = total + np.frombuffer(part)
        yield pd.DataFrame({"block": [key[0]], "part": [total.tobytes()]})

    added = rows.mapInArrow(run, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary")
    out = np.zeros((dims, dims))
    for r in added.collect():
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["part"]).reshape(-1, dims)
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``order`` and lower trapezoidal ``l`` with ``a[order][:, order] = l @ l.T``.

    Each step takes the largest diagonal entry that is left; the steps end where what is left is rounding.
    """
    n = len(a)
    rest, order, l = a.copy(), np.arange(n), np.zeros((n, n))
    least = n * np.finfo(float).eps * max(float(a.diagonal().max(initial=0.0)), 0.0)
    for k in range(n):
        p = k + int(rest.diagonal()[k:].argmax())
        if not rest[p, p] > least:
            return order, l[:, :k]
        if p != k:
            for m in (rest, l):
                m[[k, p]] = m[[p, k]]
            rest[:, [k, p]] = rest[:, [p, k]]
            order[[k, p]] = order[[p, k]]
        l[k, k] = np.sqrt(rest[k, k])
        l[k + 1 :, k] = rest[k + 1 :, k] / l[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(l[k + 1 :, k], l[k + 1 :, k])
    return order, l


def jacobi(l: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``l @ l.T``, falling, and its unit eigenvectors as columns.

    Pairs of columns are turned until all are at right angles to working precision. Then their squared norms are
    the eigenvalues and the columns at unit length the vectors. A round turns pairs that share no column, all at
    once; over a sweep's rounds every pair has its turn, as in a tournament.
    """
    g = np.array(l, dtype=np.float64)
    k = g.shape[1]
    ring = list(range(k + k % 2))
    half = len(ring) // 2
    # Columns that are nothing but rounding have no angle worth turning.
    tiny = np.finfo(float).eps * float(np.sqrt((g**2).sum(axis=0).max(initial=0.0)))
    for _ in range(sweeps if k > 1 else 0):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if a < k and b < k]
            p, q = (np.array(x) for x in zip(*pairs))
            u, v = g[:, p], g[:, q]
            alpha, beta, gamma = (u * u).sum(axis=0), (v * v).sum(axis=0), (u * v).sum(axis=0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            turn = (np.abs(gamma) > 1e-15 * size) & (np.minimum(alpha, beta) > tiny**2)
            if turn.any():
                worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max()))
                zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta**2))
                c = 1 / np.sqrt(1 + t**2)
                s = c * t
                g[:, p[turn]], g[:, q[turn]] = c * u[:, turn] - s * v[:, turn], s * u[:, turn] + c * v[:, turn]
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst < 1e-14:
            break
    squares = (g**2).sum(axis=0)
    falling = np.argsort(-squares, kind="stable")
    return squares[falling], g[:, falling] / np.sqrt(squares[falling])


@dataclass(frozen=True)
class Whitening:
    """What a fit keeps: rows ``n``, exact ``sums``, and of each component its vector (a column), eigenvalue and share of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Per row the exact sum of ``(n * x - S) ** 2`` over the dimensions; None where that is no long."""
        if not x.size:
            return [0] * len(x)
        top = self.n * max(-int(x.min()), int(x.max())) + max(map(abs, self.sums))
        if len(self.sums) * top**2 < _LONG:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < _LONG else None for v in exact]


def fit(rows: DataFrame, dims: int, components: int | None = None) -> Whitening:
    """Whitening of distinct packed rows (``packed``, all ``dims`` long): the ``components`` of the largest eigenvalues.

    Two passes: exact sums, then the scatter around their mean. The driver holds matrices of ``dims`` by ``dims``,
    whose size does not depend on the number of rows. There are no more components than eigenvalues above
    rounding, so none for equal rows or no rows.
    """
    rows = rows.select("packed")
    n, total = rows.count(), sums(rows, dims)
    mean = np.array([s / n for s in total]) if n else np.zeros(dims)
    whole = scatter(rows, mean)
    order, l = pivoted_cholesky(whole)
    squares, turned = jacobi(l)
    vectors = np.zeros_like(turned)
    vectors[order] = turned
    k = int((squares > dims * np.finfo(float).eps * squares.max(initial=0.0)).sum())
    k = k if components is None else min(k, components)
    return Whitening(n, total, vectors[:, :k], squares[:k] / max(n, 1), squares[:k] / max(float(whole.trace()), 1e-300))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity; 0 without components.

    Each task keeps count, mean and products around its own mean; two such are joined with the products of what
    their means differ by, so nothing is multiplied before it is centred.
    """
    dims, k = len(model.sums), len(model.values)

    def join(n: float, mean: np.ndarray, m2: np.ndarray, n2: float, mean2: np.ndarray, m22: np.ndarray) -> tuple:
        gap = mean2 - mean
        return n + n2, mean + gap * (n2 / (n + n2)), m2 + m22 + np.outer(gap, gap) * (n * n2 / (n + n2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (0.0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            w = model.project(unpack(batch.column(0), dims))
            if len(w):
                own = w.mean(axis=0)
                state = join(*state, float(len(w)), own, (w - own).T @ (w - own))
        if state[0]:
            yield pa.RecordBatch.from_pydict({"part": pa.array([np.concatenate([[state[0]], state[1], state[2].ravel()]).tobytes()], pa.binary())})

    if not k:
        return 0.0
    states = sorted(r["part"] for r in rows.select("packed").mapInArrow(run, "part binary").collect())
    state = (0.0, np.zeros(k), np.zeros((k, k)))
    for part in map(np.frombuffer, states):
        state = join(*state, float(part[0]), part[1 : k + 1], part[k + 1 :].reshape(k, k))
    return float(np.abs(state[2] / state[0] - np.eye(k)).max())


def whiten(embeddings: DataFrame, *, key: str = "vec_id", column: str = "embedding", components: int = 4) -> DataFrame:
    """Of every sound vector and each of the first ``components``: ``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    A vector that is null or holds a null or an entry that is not finite takes no part, nor does one of another
    length than most distinct vectors have (the longer, if two lengths are as frequent). Rows that repeat count
    once in the fit and have their own rows in the result; the key plays no part and may be null. There are fewer
    components where the vectors span fewer dimensions, and no rows if all are equal or the table is empty.
    Other columns, also of the result's names, are left out. The distinct vectors are kept in the shared folder.
    """
    spark = embeddings.sparkSession
    path = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    distinct_vectors(embeddings, column).write.parquet(path)
    stored = spark.read.parquet(path)
    common = stored.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = common[0]["dims"] if common else 0
    rows = stored.filter(F.col("dims") == dims)
    model = fit(rows, dims, components)
    error, k = identity_error(rows, model), len(model.values)
    source = embeddings.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").cast("array<double>").alias("vector"))
    of_key = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, good, entries = sound(batch.column("vector"))
            chosen = np.flatnonzero(good & (lengths == dims))
            x = whole_numbers(rows_of(lengths, chosen, entries, dims))
            deviation = np.repeat(np.array(model.deviation(x), object), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(np.repeat(chosen, k))),
                    pa.array(np.tile(np.arange(1, k + 1), len(chosen)), pa.int32()),
                    pa.array(deviation.tolist(), pa.int64()),
                    pa.array(model.project(x).ravel(), pa.float64()),
                    pa.array(np.tile(model.shares, len(chosen)), pa.float64()),
                ],
                names=["key", "component", "deviation", "whitened", "explained"],
            )

    found = source.mapInArrow(run, f"key {of_key}, component int, deviation long, whitened double, explained double")
    return found.select(
        F.col("key").alias(key), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error")
    )
