import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factsheet.llm import quality_classifier as qc, quality_rules as qr, queries

SF = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c d e a b c d e", "x x x x x x x x", "a\na\n \n \na", "#|<> é\u00a0ü\x0b&", "1 2 3 4 5 6 1 2 3 4 5 7 2 3 4 5 7", "word " * 40_000])
def test_statistics(text):
    got = dict(zip(qr.STATS, qr.statistics_of(text)))
    assert tuple(got[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain(text)


def test_rules_query_against_plain_counts_and_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").select("doc_id", "text", "quality")
    rows = queries.QUERIES["op6_quality_rules"](spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == 10_000
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    judged = [r for r in rows if r.quality is not None and not r.base_failed]
    good, bad = ([r.kept for r in judged if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2


def test_forest_isolates_what_stands_apart():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(40, 3)) + [0, 9, 0]])
    own = np.arange(340) < 300
    trees = tuple(qr.Tree.grow(points, own, rng) for _ in range(50))
    score = qr.Forest(trees, 300).score(points)
    assert score[300:].min() > np.quantile(score[:300], 0.95)


def frames(spark, n=60):
    rows = [(i, ("clean words in a line of text that goes on %d" % i if i % 3 else "junk### | %d | *** | ### | *** | ### | $$$ | ###" % i), "s", 1) for i in range(n)]
    rows += [(None, None, "s", 1), (1000, "", None, 1), (1, rows[1][1], "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, n, 2)] + [(2, 1), (None, 0), (4, None), (99_999, 0)], "doc_id long, quality int")
    return docs, labels


def test_rules_on_odd_tables(spark):
    docs, labels = frames(spark)
    got = qr.judge(docs, labels)
    assert got.count() == 63
    odd = {r.doc_id: r for r in got.filter("doc_id is null or doc_id = 1000").collect()}
    assert odd[None].base_failed and odd[1000].n_words == 0 and not odd[None].kept
    assert qr.kept_documents(docs, labels).columns == docs.columns
    assert qr.judge(docs, labels.limit(0)).filter("not kept and not base_failed").count() == 0
    assert qr.judge(docs.limit(0), labels).count() == 0
    assert qr.kept_documents(docs, labels).filter("source is null").count() == 0


def test_classifier_on_held_out_labels(spark):
    rows = queries.QUERIES["op10_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows) and len(rows) > 500
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_classifier_on_odd_tables(spark):
    docs, labels = frames(spark)
    got = {(r.doc_id, r.predicted) for r in qc.classify(docs, labels, buckets=512).filter("doc_id < 60").collect()}
    assert got == {(i, int(i % 3 > 0)) for i in range(60)}
    assert qc.classify(docs, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert qc.classify(docs, labels.filter("quality = 1"), buckets=512).filter("score <= 0.5").count() == 0
    assert qc.classify(docs.limit(0), labels).count() == 0
    assert qc.good_documents(docs, labels, buckets=512).columns == docs.columns


def test_held_out_labels_change_nothing(spark):
    docs, labels = frames(spark)
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = labels.withColumn("quality", F.when(hidden, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: sorted((str(r.doc_id), r.score) for r in qc.classify(docs, x, buckets=512).collect())
    assert score(labels) == score(flipped)


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(20, 5, replace=False)) for _ in range(80)]
    y = np.where([(r < 6).sum() > 1 for r in rows], 1.0, -1.0)
    ratio, cost = rng.uniform(0.5, 1.5, 20), np.full(80, 0.7)
    w, b = qc.descend(rows, y, ratio, cost, passes=400, seed=0)
    x = np.zeros((80, 21))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
        x[i, 20] = 1
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best = loss(np.append(w, b))
    assert all(loss(np.append(w, b) + rng.normal(size=21) * s) >= best - 1e-6 for s in (0.001, 0.01, 0.1) for _ in range(200))


@pytest.mark.parametrize("text", [None, "", "a a a", "A1-b\nA1-b", "w " * 50_000])
def test_indicators(text):
    found = qc.indicators(text, 1000)
    assert found == sorted(set(found)) and all(0 <= b < 1000 for b in found)


def test_without_two_classes_nothing_is_rejected(spark):
    docs, labels = frames(spark)
    others = labels.withColumn("doc_id", F.col("doc_id") + 10**6)
    for known in (labels.limit(0), labels.filter("quality = 1"), labels.filter("quality = 0"), others):
        kept = qc.good_documents(docs, known, buckets=512)
        assert kept.columns == docs.columns and kept.count() == docs.count()
    assert qc.good_documents(docs, labels, buckets=512).count() < docs.count()


def test_words_tell_documents_of_the_same_shape_apart(spark):
    rng = np.random.default_rng(3)
    good, bad = "river stone garden letter morning window bridge winter".split(), "casino bonus lottery jackpot viagra cheap winner prizes".split()
    text = lambda own: " ".join(rng.choice(own + "with that from this have been".split(), 20))
    docs = spark.createDataFrame([(i, text(bad if i % 2 else good)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, quality int")
    rows = qc.classify(docs, labels).filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == 1 - r.doc_id % 2 for r in rows]) > 0.95


def test_words_count_without_case_and_marks():
    first, second, other = (set(qc.indicators(x, 1 << 18)) for x in ("cheap pills now", "(Cheap) pills, now", "small hills now"))
    words = lambda x: {b for b in x if b >= 1 << 16}
    assert len(words(first)) == 5 and words(first) == words(second) and first != second
    assert first - words(first) == other - words(other) and len(words(first) & words(other)) == 1


@pytest.mark.parametrize("found", [[], [0], [0, 65534, 65535, 131069, 131070, 131071, 400_000], [65535], [262_143]])
def test_packed_numbers(found):
    assert qc.unpack(qc.pack(np.array(found, np.int32))).tolist() == found


def test_hashes_of_words_against_one_word_at_a_time():
    def plain(word):
        form = re.sub(rb"(.)\1+", rb"\1", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", re.sub(rb"[0-9]", b"0", word))), flags=re.S)
        folded = word.decode().casefold()
        return zlib.crc32(form), zlib.crc32((re.sub(r"^[\W_]+|[\W_]+$", "", folded) or folded).encode())

    text = "Cheap (cheap) aab112--X __init__ ... \u00c4\u00d6\u00dfe \u0130I \u03a3\u03c2 \u201cquoted\u201d a\u00a0b \u2028 \x1c \x00 a_b- \u0661\u0662 #1# \U0001f600ok \u00b2 -\u0301a"
    found = list(dict.fromkeys(qc.words(text)))
    assert qc.word_hashes(found).tolist() == [list(plain(w)) for w in found]
    assert qc.word_hashes([]).shape == (0, 2)


def test_distinct_words_cost_few_calls():
    texts, calls = [" ".join(f"W{i}x{j}." for j in range(100)) for i in range(300)], 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        qc.batch_features(texts, 1 << 18)
    finally:
        sys.setprofile(None)
    assert calls < 2 * 300 * 100
