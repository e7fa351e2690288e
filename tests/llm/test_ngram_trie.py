import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from factsheet.llm import ngram_trie as nt

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def plain(rows, prior):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    one, two, three = Counter(), Counter(), Counter()
    for i, t in rows:
        if not out(i):
            w = tokens(t)
            one.update(w)
            two.update(zip(["<start>", *w], w))
            three.update(zip(["<start>", *w], w, w[1:]))
    total, texts = sum(one.values()), sum(not out(i) for i, _ in rows)
    alone = lambda w: (one[w] + 1) / (total + len(one) + 1)
    result = []
    for i, t in rows:
        w = tokens(t)
        before = ["<start>", *w]
        seen = lambda v: texts if v == "<start>" else one[v]
        p2 = lambda v, x: (two[v, x] + prior * alone(x)) / (seen(v) + prior)
        p3 = lambda u, v, x: (three[u, v, x] + prior * p2(v, x)) / (two[u, v] + prior)
        score = math.log10(p2("<start>", w[0])) + sum(math.log10(p3(*x)) for x in zip(before, w, w[1:]))
        result.append((i, out(i), len(w), sum(one[x] > 0 for x in w), total, sum(math.log10(alone(x)) for x in w), score))
    return result


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], abs=1e-4 * a[2])  # a code is off by half a step at most


@pytest.mark.parametrize("size", [1_500, 2_000_000])
def test_against_plain_counts(spark, size):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    if size == 1_500:
        df = df.filter("doc_id < 60")
    got = [tuple(r) for r in nt.scored(df, tokens_a_bin=size).collect()]
    same(got, plain([(r.doc_id, r.text) for r in df.collect()], 8.0))
    held = [r for r in got if r[1]]
    assert size == 1_500 or sum(r[6] for r in held) > sum(r[5] for r in held)


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "A a é"), (3, "a b\x0bc"), (3, "a b\x0bc"), (4, "a " * 60_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    same([tuple(r) for r in nt.scored(df).collect()], plain(rows, 8.0))
    assert nt.scored(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=80).map(sorted))
def test_elias_fano_keeps_the_sequence(values):
    coded = nt.EliasFano.encode(np.array(values, np.int64))
    assert coded.decode().tolist() == values
    assert len(coded.high) * 8 <= 3 * len(values) + 16


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 12), st.integers(1, 30)), st.floats(1e-6, 1.0), max_size=60), st.lists(st.tuples(st.integers(0, 14), st.integers(1, 32)), min_size=1, max_size=60))
def test_trie_finds_what_is_there(entries, sought):
    keys = sorted(entries)
    trie = nt.Trie(*(np.array([k[i] for k in keys], np.int64) for i in (0, 1)), np.array([entries[k] for k in keys]))
    got = nt.dequantize(trie.find(*(np.array([k[i] for k in sought], np.int64) for i in (0, 1))))
    assert got == pytest.approx([entries.get(k, 0.0) for k in sought], rel=1e-3)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62)))
def test_packing(values):
    assert nt.unpack(nt.pack(np.array(values, np.int64))).tolist() == values


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, 2**40), max_size=150).map(sorted), st.lists(st.integers(0, 2**41), max_size=20), st.data())
def test_elias_fano_is_searched_in_place(values, other, data):
    coded = nt.EliasFano.encode(np.array(values, np.int64))
    begin = data.draw(st.integers(0, len(values)))
    end = data.draw(st.integers(begin, len(values)))
    sought = np.array(values + other, np.int64)
    at, found = coded.seek(sought, np.full(len(sought), begin), np.full(len(sought), end))
    for x, i, f in zip(sought.tolist(), at.tolist(), found.tolist()):
        assert f == (x in values[begin:end])
        assert not f or i == values.index(x, begin)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(1, 6), st.integers(1, 6)), st.floats(1e-6, 1.0), max_size=90), st.lists(st.tuples(st.integers(0, 5), st.integers(1, 7), st.integers(1, 7)), min_size=1, max_size=60))
def test_three_levels_without_decoding(entries, sought):
    keys = sorted(entries)
    trie = nt.Trie(*(np.array([k[i] for k in keys], np.int64) for i in range(3)), np.array([entries[k] for k in keys]))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(nt.EliasFano, "decode", None)
        got = nt.dequantize(trie.find(*(np.array([k[i] for k in sought], np.int64) for i in range(3))))
    assert got == pytest.approx([entries.get(k, 0.0) for k in sought], rel=1e-3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**40), st.integers(0, 9), st.integers(0, 9)), min_size=1).map(sorted), st.integers(2, 3))
def test_keys_come_back_from_steps(rows, n):
    keys = [np.array([r[i] for r in rows], np.int64) for i in range(n)]
    assert [k.tolist() for k in nt.unpack_keys(nt.pack_keys(keys))] == [k.tolist() for k in keys]


def test_a_frequent_context_is_spread_and_a_rare_one_is_not():
    last = np.arange(10_000)
    shard = lambda seen: np.bincount(nt.shard_of([np.full(10_000, 7), last], np.full(10_000, seen), 30_000_000, 48), minlength=48)
    assert (shard(100) > 0).sum() == 1
    assert shard(10_000_000).max() < 1.5 * 10_000 / 48


def test_contexts_that_no_learning_text_has_are_not_asked_about():
    keys = [np.array([1, 1, 2]), np.array([5, 6, 5])]
    grams = nt.Grams.of_bin(keys, np.array([1, 0, 0]), np.array([3, 3, 0]), np.arange(3), np.zeros(3, bool), 100, 4)
    assert sorted(grams.order.tolist()) == [0, 1]
    p, count, sole = grams.answered([], 8.0)
    assert count[2] == 0 and p[2] == 0 and sole[2]
