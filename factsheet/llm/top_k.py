"""Exact top-k inner products in three phases, with a uniform threshold over slices of the components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from factsheet.llm.common import checkpointed


def quantized(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id`` and ``v``, each component as ``floor(scale * x)``.

    Rows whose id, vector or any component is null or not finite are left out. Rows that are wholly equal, id and
    components, are one; rows of one id with different components all stay.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & usable).select("vec_id", whole.alias("v")).distinct()


def _matrix(vectors: list) -> np.ndarray:
    """Rows of one length: shorter vectors count as ending in zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows; in doubles where those are exact, which is faster."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def slices(a: np.ndarray, b: np.ndarray, parts: int) -> list[np.ndarray]:
    """Scores of all rows of ``a`` and ``b`` over each of ``parts`` slices of their components."""
    wide = min(a.shape[1], b.shape[1])
    cuts = np.linspace(0, wide, parts + 1).astype(int)
    return [_product(a[:, i:j], b[:, i:j]) for i, j in zip(cuts, cuts[1:])]


def _best(query: np.ndarray, vector: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best entries: higher score, then smaller id."""
    order = np.lexsort((vector, -score, query))
    q = query[order]
    begins = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(begins, np.diff([*begins, len(q)]))
    return order[rank < k]


def _unpack(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8").reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _packed(vectors: DataFrame, rows: int, slots: int) -> DataFrame:
    """Vectors in blocks of at most ``rows``, each a matrix with its ids, on ``slots`` of a join."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows]
                name = uuid.uuid4().int
                yield pd.DataFrame({"slot": [name % slots], "ids": [part["vec_id"].to_numpy("<i8").tobytes()], "m": [_matrix(list(part["v"])).astype("<i8").tobytes()]})

    return vectors.select("vec_id", "v").mapInPandas(run, "slot int, ids binary, m binary")


def _query_blocks(queries: DataFrame, blocks: int, slots: int) -> DataFrame:
    """Queries with their cutoffs in ``blocks`` blocks by a hash of their id, a copy of each on every slot."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(list(pdf["v"])).astype("<i8")
        return pd.DataFrame({"block": pdf["block"][:1], "q_ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "q": [m.tobytes()], "cutoffs": [pdf["cutoff"].to_numpy("<i8").tobytes()]})

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    packed = queries.withColumn("block", block).groupBy("block").applyInPandas(run, "block int, q_ids binary, q binary, cutoffs binary")
    return packed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))


#: Below any score that can be reached.
NO_CUTOFF = -(1 << 62)


def _entries(pairs: DataFrame, k: int, parts: int, first: bool) -> DataFrame:
    """Exact scores of the entries that a phase asks of each pair of blocks, at most ``k`` a query and block of vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, q_ids, cutoff = (np.frombuffer(x, dtype="<i8") for x in (row.ids, row.q_ids, row.cutoffs))
                scores = slices(_unpack(row.q, len(q_ids)), _unpack(row.m, len(ids)), parts)
                own = q_ids[:, None] == ids[None, :]
                wanted = np.zeros(own.shape, bool)
                for s in scores:
                    if not first:
                        wanted |= parts * s >= cutoff[:, None]
                    elif len(ids) > k + 1:
                        np.put_along_axis(wanted, np.argpartition(-s, k, axis=1)[:, : k + 1], True, axis=1)
                    else:
                        wanted[:] = True
                i, j = np.nonzero(wanted & ~own)
                score = sum(s[i, j] for s in scores)
                enough = score >= cutoff[i]
                i, j, score = i[enough], j[enough], score[enough]
                best = _best(i, ids[j], score, k)
                yield pd.DataFrame({"query_id": q_ids[i[best]], "vec_id": ids[j[best]], "score": score[best]})

    return pairs.mapInPandas(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, *, every: int = 50, k: int = 5, parts: int = 2, rows: int = 4096, queries_at_once: int = 1024, slots: int = 16) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` best other vectors of each whose id ``every`` divides.

    The components are cut into ``parts`` slices, each of which gives a list of partial scores.
    1. From each block of vectors come the best entries of each slice's list, with their whole scores.
    2. The k-th best of those is a safe cutoff: k vectors reach it. A vector that reaches cutoff c has c / parts
       or more in some slice, so each block collects the entries of at least that in any slice.
    3. Their other slices are resolved, and what reaches the cutoff is ranked; equal scores by smaller id.

    Queries meet the vectors in blocks of bounded size, by an equal join on block numbers. The cutoff travels
    with its query. An id with several vectors asks with each and has one ranking of all it finds; every vector of
    another id is a candidate of its own, so an id may be found more than once. Other columns play no part.
    Vectors of any length are compared over the shorter one's components. Fewer than ``k``
    others give all; without vectors, or without queries, there are no rows.
    """
    usable = checkpointed(quantized(vectors))
    asked = usable.filter(F.col("vec_id") % every == 0)  # with a query's cutoff for all of its vectors
    blocks = max(1, -(-asked.count() // queries_at_once))
    packed = checkpointed(_packed(usable, rows, slots))
    numbered = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def phase(queries: DataFrame, first: bool) -> DataFrame:
        pairs = numbered.join(_query_blocks(queries, blocks, slots), ["block", "slot"])
        return _entries(pairs.select("ids", "m", "q_ids", "q", "cutoffs"), k, parts, first)

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    gathered = phase(asked.withColumn("cutoff", F.lit(NO_CUTOFF)), True).withColumn("rank", F.row_number().over(best))
    cutoffs = gathered.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    ready = asked.join(cutoffs, "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(NO_CUTOFF)))
    found = phase(ready, False).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
