import random
import re

import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from factsheet.llm import queries, simhash
from factsheet.llm.components import components

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {x: find(x) for x in top}


def plain_groups(rows):
    prints = {i: plain_print(t) for i, t in rows}
    ids = sorted(prints)
    same = plain_components((a, b) for a in ids for b in ids if b >= a and (prints[a] ^ prints[b]).bit_count() <= 2)
    return {(i, f"{prints[i]:016x}", same[i]) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=5), st.lists(st.tuples(st.integers(0, 4), st.sets(st.integers(0, 63), max_size=3)), max_size=40))
def test_tree_finds_all_within_the_radius(centres, spots):
    values = list(dict.fromkeys([*centres, *[centres[c % len(centres)] ^ sum(1 << b for b in flips) for c, flips in spots]]))
    tree = simhash.BKTree(2)
    for i, v in enumerate(values):
        assert sorted(tree.add(v)) == [j for j in range(i) if (values[j] ^ v).bit_count() <= 2]


def test_any_two_within_the_radius_agree_on_a_mask():
    rng = random.Random(2)
    masks = simhash.masks(2)
    assert len(masks) == 15
    for _ in range(2000):
        bits = rng.sample(range(64), 2)
        assert any(not m & sum(1 << b for b in bits) for m in masks)


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(-5, 7), (3, 3), (2, 1), (2, 1)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {n: r for n, r in plain_components(links).items() if n != r}
    assert components(df.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {tuple(r) for r in queries.QUERIES["op5_simhash"](spark, SF).collect()}
    assert got == plain_groups(rows)
    assert len({g[2] for g in got}) < len(rows)


def cases(spark):
    long = "Some words that go on " * 30_000
    rows = [(5, None, "a"), (4, "", "b"), (9, " \n", "c"), (7, "One two", "d"), (3, "one TWO", "e"), (8, long, "f"), (2, long + "end", "g"), (2, long + "end", "g"), (None, "one two", "h"), (None, "alone here now", "i")]
    return spark.createDataFrame(rows, "doc_id long, text string, FP string")


def test_null_empty_long_and_repeated(spark):
    got = sorted([(r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(cases(spark)).collect()], key=str)
    assert got == sorted([(5, 4), (4, 4), (9, 4), (7, 3), (3, 3), (8, 2), (2, 2), (2, 2), (-1, 3), (-1, None)], key=str)
    assert simhash.near_duplicates(cases(spark).limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    got = simhash.representatives(cases(spark))
    assert got.columns == ["doc_id", "text", "FP"]
    assert sorted([r.FP for r in got.collect()]) == ["b", "e", "g", "i"]


@pytest.mark.parametrize("text", [None, "", "a", "A b", "é É x\x0by\u00a0z w", "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)
