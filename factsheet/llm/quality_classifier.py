"""Quality classifier: n-gram indicators of word forms and of words, scaled by naive-Bayes log-count ratios, under a linear hinge loss."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from factsheet.llm.common import checkpointed, map_text, set_aside, spread_join, words

_FORM = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
#: Buckets that the counts of a task travel in at once.
_CHUNK = 4096


def word_hashes(distinct: Sequence[bytes]) -> np.ndarray:
    """Of each word, the hashes of its form, and of the word in lower case without the marks around it, side by side.

    A form is a word without its letters: runs of lower, upper case and digits as a, A and 0, other runs as one sign.
    All words are worked on as the lines of one text: a word holds no white space, and case goes sign by sign.
    """
    if not distinct:
        return np.zeros((0, 2), np.uint64)
    lines = b"\n".join(distinct)
    signs = np.frombuffer(lines.translate(_FORM), np.uint8)
    forms = signs[np.concatenate([[True], signs[1:] != signs[:-1]])].tobytes().split(b"\n")
    plain = lines.decode("utf-8", "replace").casefold()
    marks = "".join(c for c in set(plain) if not c.isalnum())
    bare = "\n".join([w.strip(marks) or w for w in plain.split("\n")]).encode().split(b"\n")
    return np.column_stack([np.fromiter(map(zlib.crc32, x), np.uint64, len(distinct)) for x in (forms, bare)])


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


def _ngrams(tokens: np.ndarray, owner: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each n-gram of up to ``longest`` tokens of one owner, and its owner: a polynomial modulo 2^64, and a mix of its bits."""
    found, owners, value = [], [], np.zeros(len(tokens), np.uint64)
    for n in range(1, longest + 1):
        if len(tokens) < n:
            break
        value = value[: len(tokens) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + tokens[n - 1 :] + np.uint64(n)
        whole = owner[: len(tokens) - n + 1] == owner[n - 1 :]
        found.append(value[whole])
        owners.append(owner[n - 1 :][whole])
    if not found:
        return value, owner
    return _mixed(np.concatenate(found)), np.concatenate(owners)


def form_buckets(buckets: int) -> int:
    """How many of the buckets, the first ones, are of forms."""
    return max(buckets // 4, 1)


def batch_features(texts: Sequence[str | None], buckets: int, longest: int = 3, longest_words: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text, each once, in order: of forms in the first quarter, of words in the rest; and their texts' places.

    A form's token is ``=`` for a word equal to the one before it. A line that equals an earlier one, and a
    text's order of length, are n-grams of their own. Distinct words of the batch are hashed once, and all texts' n-grams
    are made and sorted together.
    """
    quarter, per_text = form_buckets(buckets), [words(t) for t in texts]
    tokens = list(chain.from_iterable(per_text))
    sizes = np.fromiter(map(len, per_text), np.int64, len(per_text))
    owner = np.repeat(np.arange(len(per_text)), sizes)
    at = defaultdict(count().__next__)
    codes = np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))
    forms, plain_words = (x[codes] for x in word_hashes(list(at)).T)
    forms[1:][(codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])] = zlib.crc32(b"=")
    own = [(i, b"length%d" % n.bit_length()) for i, n in enumerate(sizes.tolist())]
    for i, text in enumerate(texts):
        lines = [x for x in (text or "").split("\n") if x.strip()]
        if len(set(lines)) < len(lines):
            own.append((i, b"line="))
    shapes, of_shapes = _ngrams(forms, owner, longest)
    found = [shapes % np.uint64(quarter), np.array([zlib.crc32(x) % quarter for _, x in own], np.uint64)]
    owners = [of_shapes, np.array([i for i, _ in own], np.int64)]
    if buckets > quarter:
        plain, of_plain = _ngrams(plain_words, owner, longest_words)
        found.append(plain % np.uint64(buckets - quarter) + np.uint64(quarter))
        owners.append(of_plain)
    bits = buckets.bit_length()
    keys = np.concatenate(owners) << bits | np.concatenate(found).astype(np.int64)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys & ((1 << bits) - 1)).astype(np.int32), keys >> bits


def features(text: str | None, buckets: int, longest: int = 3, longest_words: int = 2) -> np.ndarray:
    """The ``batch_features`` of one text."""
    return batch_features([text], buckets, longest, longest_words)[0]


def packed_features(texts: Sequence[str | None], buckets: int) -> list[bytes]:
    found, owner = batch_features(texts, buckets)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts))).tolist()
    return [pack(found[a:b]) for a, b in zip([0, *ends], ends)]


def indicators(text: str | None, buckets: int, longest: int = 3) -> list[int]:
    """The ``features`` as a list."""
    return features(text, buckets, longest).tolist()


def pack(found: np.ndarray) -> bytes:
    """Sorted numbers as their steps in two bytes each; a step of 65,535 or more is cut, and 65,535 says that it goes on."""
    more, rest = np.divmod(np.diff(found, prepend=0).astype(np.int64), 65535)
    out = np.full(len(found) + int(more.sum()), 65535, "<u2")
    out[np.arange(len(found)) + np.cumsum(more)] = rest
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, "<u2")
    return np.cumsum(steps, dtype=np.int64)[steps < 65535].astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Margin of a text: its ``weights`` over the lengths of its two vectors of ratios (``squares``), of forms and of words, plus the bias.

    Forms are the first ``forms`` buckets. Each vector is brought to the same length by itself, so that the many buckets of
    words do not drown the few of forms. ``slope`` and ``offset`` turn margins to log-odds. ``learnt`` says that both
    classes were there to learn from.
    """

    weights: np.ndarray
    squares: np.ndarray
    forms: int
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    learnt: bool = True

    def margin(self, found: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        part = 2 * owner + (found >= self.forms)
        total, square = (np.bincount(part, weights=x[found], minlength=2 * texts).reshape(texts, 2) for x in (self.weights, self.squares))
        return (total / np.sqrt(np.maximum(2 * square, 1e-24))).sum(axis=1) + self.bias

    def score(self, found: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(found, owner, texts) + self.offset, -500, 500)))


def scaled(row: np.ndarray, ratio: np.ndarray, forms: int) -> np.ndarray:
    """The ratios at a row's buckets: those of forms and those of words each as a vector of half the squared length 1."""
    values, cut = ratio[row], int(np.searchsorted(row, forms))
    for part in (values[:cut], values[cut:]):
        part /= max(float(np.sqrt(2 * (part @ part))), 1e-12)
    return values


def descend(
    rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, *, passes: int, seed: int, values: list[np.ndarray] | None = None
) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge loss plus half the squared norm, by dual coordinate descent.

    A row's features are its ``values``, of unit length (if none are given, ``ratio`` at its buckets, scaled), and a
    constant 1. The dual variable of a row lies between 0 and its ``cost``; each step solves for one of them and
    moves the weights with it.
    """
    rng, weights, bias, dual = np.random.default_rng(seed), np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    if values is None:
        values = [ratio[r] / max(float(np.linalg.norm(ratio[r])), 1e-12) for r in rows]
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(dual[i] - gradient / 2, 0.0), cost[i])
            if (step := (new - dual[i]) * y[i]) != 0:
                weights[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
    return weights, bias


def platt(margin: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, by Newton's steps on smoothed labels."""
    n1, n0 = good.sum(), (1 - good).sum()
    goal = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, at = np.column_stack([margin, np.ones_like(margin)]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (goal - p) - 1e-6 * at)
        at = at + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(max(at[0], 1e-6)), float(at[1])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def counted(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket, how many of ``rows`` (``found``, ``good``) have it: good ones, and all. Summed in each task, then by chunk."""
    chunks = -(-buckets // _CHUNK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, chunks * _CHUNK), "<i8")
        for pdf in batches:
            for found, good in zip(pdf["found"], pdf["good"]):
                at = unpack(found)
                sums[0, at] += good
                sums[1, at] += 1
        for i in range(chunks):
            part = sums[:, i * _CHUNK : (i + 1) * _CHUNK]
            if part.any():
                yield pd.DataFrame({"chunk": [i], "sums": [part.tobytes()]})

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * _CHUNK, "<i8")
        for pdf in batches:
            for data in pdf["sums"]:
                total += np.frombuffer(data, "<i8")
        yield pd.DataFrame({"chunk": [key[0]], "sums": [total.tobytes()]})

    good, every = np.zeros(chunks * _CHUNK), np.zeros(chunks * _CHUNK)
    parts = rows.select("found", "good").mapInPandas(run, "chunk int, sums binary").groupBy("chunk").applyInPandas(add, "chunk int, sums binary")
    for r in parts.collect():
        at = slice(r["chunk"] * _CHUNK, (r["chunk"] + 1) * _CHUNK)
        good[at], every[at] = np.frombuffer(r["sums"], "<i8").reshape(2, -1)
    return good[:buckets], every[:buckets]


def log_ratio(good: np.ndarray, every: np.ndarray, smooth: float) -> np.ndarray:
    """Naive-Bayes log ratio of each bucket's smoothed share of good rows to that of bad ones; 0 where it has not been seen."""
    p, q = smooth + good, smooth + every - good
    return np.where(every > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def learn(rows: list[np.ndarray], y: np.ndarray, good: np.ndarray, every: np.ndarray, forms: int, *, passes: int, cost: float, smooth: float, seed: int) -> Model:
    """The hinge loss on ``rows`` (``y`` 1 for good), with the ratios of the counts; costs give both classes the same weight."""
    ratio = log_ratio(good, every, smooth)
    values = [scaled(r, ratio, forms) for r in rows]
    share = min(max(float(y.mean()), 0.5 / len(y)), 1 - 0.5 / len(y))
    costs = cost * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    weights, bias = descend(rows, 2 * y - 1, ratio, costs, passes=passes, seed=seed, values=values)
    return Model(weights * ratio, ratio**2, forms, bias)


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return np.concatenate([*rows, np.zeros(0, np.int32)]), owner, len(rows)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    *,
    buckets: int,
    most_rows: int = 12_000,
    most_bytes: int = 1 << 27,
    folds: int = 3,
    passes: int = 12,
    cost: float = 1.0,
    smooth: float = 1.0,
    seed: int = 42,
) -> Model:
    """A model from the labelled rows of ``documents`` (``doc_id``, ``text``) that are not held out.

    The log-count ratios count every such row. The hinge loss is fitted on at most ``most_rows`` of them, the
    first by a seeded hash of ``doc_id``, and on a share whose packed features come to ``most_bytes`` on average; costs give both
    classes the same weight. The logistic curve goes through margins of rows that a model has not seen: each of
    ``folds`` parts of the sample is left out in turn, from the loss and from the counts. If only one class is
    labelled, or nothing is, every score is that class's smoothed share.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out())
    # Rows of one id go to several tasks, by the partition they come from.
    found = spread_join(texts, known.hint("merge"), "doc_id", [F.spark_partition_id()], copies=4).filter(F.col("quality").isNotNull())
    rows = found.select("doc_id", "text", (F.col("quality") > 0).cast("int").alias("good"))
    rows = checkpointed(map_text(rows, "found binary", lambda texts: [packed_features(texts, buckets)], ["doc_id", "good"]))
    good, every = counted(rows, buckets)
    drawn_hash = F.xxhash64(F.lit(seed), "doc_id")
    n, size = rows.agg(F.count("*"), F.sum(F.length("found"))).first()
    # Others would only travel to the driver to be left there.
    share = min(1.0, (1.1 * most_rows + 1000) / max(n, 1), most_bytes / max(size or 0, 1))
    near = rows.filter(drawn_hash < int((2 * share - 1) * 2.0**63)) if share < 1 else rows
    drawn = near.orderBy(drawn_hash, "found").limit(most_rows).select("found", "good").collect()
    y = np.array([r["good"] for r in drawn], dtype=np.float64)
    forms = form_buckets(buckets)
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(buckets), np.zeros(buckets), forms, offset=float(np.log(share / (1 - share))), learnt=False)
    sample = [unpack(r["found"]) for r in drawn]
    options = {"passes": passes, "cost": cost, "smooth": smooth, "seed": seed}
    margin, part = np.zeros(len(y)), np.zeros(len(y), np.int64)
    for label in (0, 1):  # each part has its share of either class
        part[y == label] = np.arange(int((y == label).sum())) % folds
    for k in range(folds):
        out, kept = np.flatnonzero(part == k), np.flatnonzero(part != k)
        if len(out) and len(kept):
            own = [np.bincount(_flat([sample[i] for i in chosen])[0], minlength=buckets) for chosen in (out[y[out] > 0], out)]
            model = learn([sample[i] for i in kept], y[kept], good - own[0], every - own[1], forms, **options)
            margin[out] = model.margin(*_flat([sample[i] for i in out]))
    whole = learn(sample, y, good, every, forms, **options)
    slope, offset = platt(margin, y)
    return replace(whole, slope=slope, offset=offset)


def _scored(documents: DataFrame, model: Model, buckets: int, keep: Sequence[str]) -> DataFrame:
    return map_text(documents, "score double", lambda texts: [model.score(*batch_features(texts, buckets), len(texts))], keep)


def classify(documents: DataFrame, labels: DataFrame, *, buckets: int = 1 << 18, least: float = 0.7, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 if the score is at least ``least``) of every document.

    Only the text is an input of the score; an empty or null one is scored by its few features and the bias.
    Rows are scored each; a ``doc_id`` labelled twice counts by its highest label; a row without ``doc_id`` is
    scored but not learnt from, and is not held out. Other columns play no part.
    """
    scored = _scored(documents, fit(documents, labels, buckets=buckets, **options), buckets, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame, *, buckets: int = 1 << 18, least: float = 0.7, **options) -> DataFrame:
    """The rows of ``documents`` with a score of at least ``least``, with their columns.

    Nothing is rejected if fewer than two classes were there to learn from: without labels, without labels of
    these documents, or with labels of one class.
    """
    model = fit(documents, labels, buckets=buckets, **options)
    if not model.learnt:
        return documents
    plain, columns = set_aside(documents, ["score"])
    scored = _scored(plain, model, buckets, plain.columns)
    return scored.filter(F.col("score") >= least).select(*columns)
