"""Quality rules: an isolation forest on the statistics that rules look at."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from factsheet.llm.common import checkpointed, map_text, set_aside, words

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\f\r"
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in SYMBOLS)
STATS = "n_words n_lines word_chars n_symbols n_dup_lines n_repeat_words n_same_words n_bare_words n_upper n_marks n_digits".split()


def repeated(tokens: Sequence[bytes], width: int) -> int:
    """Tokens inside windows of ``width`` that occur twice or more."""
    windows = list(zip(*[tokens[i:] for i in range(width)]))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    covered, until = 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            covered += i + width - max(i, until)
            until = i + width
    return covered


def statistics_of(text: str | None, window: int = 5) -> tuple[int, ...]:
    text = text or ""
    data, tokens = text.encode("utf-8", "replace"), words(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)] if tokens else []

    def bytes_in(these: bytes) -> int:
        return len(data) - len(data.translate(None, these))

    return (
        len(tokens),
        len(lines),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(tokens, window),
        sum(map(operator.eq, tokens, tokens[1:])),
        len(tokens) - len(data.translate(None, _SIGNS).split()),
        bytes_in(_UPPER),
        bytes_in(_MARKS),
        bytes_in(_DIGITS),
    )


def rule_statistics(documents: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` and the rule statistics of each whole text; a null text has none of anything."""
    added = ", ".join(f"{s} long" for s in STATS)
    return map_text(documents, added, lambda texts: list(zip(*map(statistics_of, texts))) or [[]] * len(STATS), keep)


def base_failed() -> Column:
    """The plain rules: under 10 words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features(stats: pd.DataFrame) -> np.ndarray:
    """Length, mean word, and rates per word, line or character, these as ``log(1 + 50 rate)``.

    Random values then fall between none and a few as often as between a few and many.
    """
    s = {k: stats[k].to_numpy(np.float64) for k in STATS}
    per_word, per_char = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    rates = [
        s["n_symbols"] / per_word,
        s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_repeat_words"] / per_word,
        s["n_same_words"] / per_word,
        s["n_bare_words"] / per_word,
        s["n_upper"] / per_char,
        s["n_marks"] / per_word,
        s["n_digits"] / per_char,
    ]
    return np.column_stack([np.log1p(s["n_words"]), s["word_chars"] / per_word, *[np.log1p(50 * r) for r in rates]])


def mean_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points, by which depths are scaled."""
    n = np.asarray(n, dtype=np.float64)
    more = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays; a leaf has feature -1 and, in ``at``, its depth and what is left to split of the good rows."""

    feature: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @staticmethod
    def grow(points: np.ndarray, good: np.ndarray, rng: np.random.Generator) -> Tree:
        """Split at random values of random features until good rows are alone, or there are none.

        Bad rows widen the ranges from which values are drawn; where only they are left a path ends.
        """
        limit = int(np.ceil(np.log2(max(len(points), 2))))
        nodes: list[list] = []

        def node(rows: np.ndarray, own: np.ndarray, depth: int) -> int:
            alike = int(own.sum())
            nodes.append([-1, depth + float(mean_depth(alike)), 0, 0])
            me = len(nodes) - 1
            if depth < limit and alike and len(rows) > 1:
                low, high = rows.min(0), rows.max(0)
                wide = np.flatnonzero(high > low)
                if len(wide):
                    f = int(rng.choice(wide))
                    cut = rng.uniform(low[f], high[f])
                    below = rows[:, f] < cut
                    nodes[me] = [f, cut, node(rows[below], own[below], depth + 1), node(rows[~below], own[~below], depth + 1)]
            return me

        node(points, good, 0)
        f, at, left, right = zip(*nodes)
        return Tree(np.array(f), np.array(at), np.array(left), np.array(right))

    def depth(self, points: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.at[at]
            value = points[rows, np.maximum(f, 0)]
            step = np.where(value < self.at[at], self.left[at], self.right[at])
            at = np.where(inner, step, at)


@dataclass(frozen=True)
class Forest:
    trees: tuple[Tree, ...]
    sample: int
    threshold: float = 1.0

    def score(self, points: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the paths, the nearer to 1."""
        if not self.trees:
            return np.zeros(len(points))
        return 2.0 ** (-np.mean([t.depth(points) for t in self.trees], axis=0) / mean_depth(self.sample))


def _scored(stats: DataFrame, forest: Forest, keep: Sequence[str]) -> DataFrame:
    schema = stats.select(*[F.col(f"`{c}`") for c in keep]).schema.add("anomaly", "double")

    def run(batches):
        for pdf in batches:
            yield pdf[list(keep)].assign(anomaly=forest.score(features(pdf)))

    return stats.mapInPandas(run, schema)


def fit(stats: DataFrame, labels: DataFrame, *, trees: int = 200, sample: int = 512, most_rows: int = 6_000, clean_loss: float = 0.002, seed: int = 42) -> Forest:
    """A forest on statistics of labelled documents, with the threshold that the labels ask for.

    The trees see at most ``most_rows`` labelled rows of either label, the first by a seeded hash of ``doc_id``;
    each tree sees ``sample``, half of either label as far as there are. Every labelled row that passes the
    plain rules is then scored, and counted by label in steps of 0.001. The
    threshold is the step with the best share of bad documents above it less share of good ones, among those
    that no more than ``clean_loss`` of the good documents exceed. Without labelled rows nothing is rejected.
    """
    good = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = checkpointed(stats.select("doc_id", *STATS).join(good, "doc_id"))
    chosen = F.xxhash64(F.lit(seed), "doc_id")
    points, good = [], []
    for label in (F.col("quality") > 0, F.col("quality") <= 0):
        own = labelled.filter(label & ~base_failed())
        # Others would only travel to the driver to be left there; the lowest hashes are among these.
        share = min(1.0, (1.1 * most_rows + 1000) / max(own.count(), 1))
        near = own.filter(chosen < int((2 * share - 1) * 2.0**63)) if share < 1 else own
        drawn = near.orderBy(chosen, *STATS).limit(most_rows).select(*STATS).toPandas()
        points.append(features(drawn))
        good.append(len(drawn))
    if good[0] < 2:
        return Forest((), sample)
    every, own = np.concatenate(points), np.arange(sum(good)) < good[0]
    rng = np.random.default_rng(seed)
    takes = [min(sample // 2, n) for n in good]

    def tree() -> Tree:
        rows = np.concatenate([rng.choice(good[0], takes[0], replace=False), good[0] + rng.choice(good[1], takes[1], replace=False) if good[1] else np.zeros(0, np.int64)])
        return Tree.grow(every[rows], own[rows], rng)

    forest = Forest(tuple(tree() for _ in range(trees)), takes[0])
    step = F.floor(F.col("anomaly") * 1000).cast("int")
    counted = _scored(labelled.filter(~base_failed()), forest, ["quality"]).groupBy("quality", step.alias("step")).count().collect()
    above = np.zeros((2, 1002))
    for r in counted:
        above[int(r["quality"] > 0), : r["step"] + 1] += r["count"]
    share = above / np.maximum(above[:, :1], 1)
    gain = np.where(share[1] <= clean_loss, share[0] - share[1], -1.0)
    return Forest(forest.trees, forest.sample, int(np.argmax(gain)) / 1000 if gain.max() > 0 else 1.0)


def verdicts(stats: DataFrame, forest: Forest, keep: Sequence[str]) -> DataFrame:
    """Adds ``anomaly``, ``base_failed`` and ``kept``: the plain rules passed and the anomaly below the threshold."""
    ruled = stats.withColumn("base_failed", base_failed())
    scored = _scored(ruled, forest, [*[c for c in keep if c not in ("base_failed", "kept", "anomaly")], "base_failed"])
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < forest.threshold))


def judge(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id``, the statistics, ``anomaly``, ``base_failed`` and ``kept`` of every document.

    An empty or null text fails the plain rules. Repeated rows are judged each; labels repeated for a ``doc_id``
    count once, by the highest. A document without ``doc_id`` is judged but teaches nothing. Other columns, and
    their names, play no part.
    """
    stats = checkpointed(rule_statistics(documents, keep=["doc_id"]))
    return verdicts(stats, fit(stats, labels, **options), ["doc_id", *STATS])


def kept_documents(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that are kept, with their columns; cases as in ``judge``. An empty table gives an empty one."""
    forest = fit(rule_statistics(documents, keep=["doc_id"]), labels, **options)
    plain, columns = set_aside(documents, ["kept"])

    def run(texts):
        stats = pd.DataFrame([statistics_of(t) for t in texts], columns=STATS)
        failed = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
        return [(~failed & (forest.score(features(stats)) < forest.threshold)).tolist()]

    return map_text(plain, "kept boolean", run).filter("kept").select(*columns)
