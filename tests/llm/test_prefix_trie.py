import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factsheet.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The contract, on sequences of whole turns."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    original = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(original.get(c - c % 20, [])[:h] + seq[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        words = len(node[-1][1].encode().split()) if node else 0
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * words
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def some(seed, convs=120, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        if c % 17 == 3:
            continue  # an absent conversation, a base at times
        same = rng.random() < 0.3
        for t in range(rng.randrange(1, longest)):
            text = "a b c" if same else rng.choice(["x y", "x  y z", "", None, "é\tü", "x y"])
            rows.append((c, rng.choice([t, t, None]) if c % 5 == 1 else t, rng.choice(["user", "user", None]), text))
    return rows


@pytest.mark.parametrize("seed,shards", [(1, 1024), (2, 4), (3, 1), (4, 16)])
def test_equals_the_plain_trie(spark, seed, shards):
    rows = some(seed)
    # ties of turn and role go by digest in one and by text in the other
    rows = [r for r in rows if not (r[1] is None and any(o is not r and o[:3] == r[:3] for o in rows))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.trie(df, shards=shards, queue=3)) == plain(rows)


def test_hot_conversations_and_copies(spark):
    rows = [(c, t, "user", f"w{t} same") for c in range(0, 400, 2) for t in range(4)]
    rows += [(1, t, "user", f"long {t}") for t in range(700)]
    rows += [(c, 0, "system", f"own {c}") for c in range(401, 460)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.trie(df, shards=8, queue=10)) == plain(rows)


def test_a_long_conversation_is_cut(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_HOT", 10)
    rows = [(c, t, "user", f"{t % 3}") for c in (0, 20, 40) for t in range(5)] + [(7, t, "user", f"long {t}") for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.trie(df)) == plain(rows)


def test_nulls_repeats_turnless_and_extra_columns(spark):
    rows = [(20, 0, "a", "x"), (21, 0, "a", "x"), (21, 0, "a", "x"), (None, 0, "a", "x"), (23, None, None, None), (45, 1, "b", "y y"), (-7, 0, "a", "z")]
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], SCHEMA + ", depth int, SHARD string, pos int")
    expected = plain([r for r in rows if r[0] != -7])
    made = found(prefix_trie.trie(df.filter("conv_id IS NULL OR conv_id <> -7")))
    assert made == expected and any(r[3] > 1 for r in made)
    assert sum(1 for r in found(prefix_trie.trie(df)) if r[1] == 0) == 1
    empty = prefix_trie.trie(df.limit(0))
    assert empty.columns == COLUMNS and empty.count() == 0


def test_queue_gives_the_order_of_a_heap():
    rng = random.Random(6)
    queue, pending = prefix_trie.SpillingQueue(most=7, fan=3), []
    for _ in range(4000):
        if pending and rng.random() < 0.45:
            key = min(pending)
            assert queue.least() == key and queue.pop() == ("m", *key)
            pending.remove(key)
        else:
            key = (rng.randrange(50), rng.randrange(5))
            pending.append(key)
            queue.push(key, ("m", *key))
    while pending:
        key = min(pending)
        assert queue.pop() == ("m", *key)
        pending.remove(key)
    assert queue.least() is None


def test_packets_of_a_common_node_are_joined_in_order(spark, monkeypatch):
    ends = spark.range(5000).select((F.col("id") % 3 == 0).cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("x1"), F.lit(2).cast("bigint").alias("x2"), F.col("id").alias("conv_id"))
    made = {r.depth: r.ends_sha256 for r in prefix_trie.ends_digests(ends).collect()}
    for d in (0, 1):
        expected = ",".join(str(i) for i in range(5000) if (i % 3 == 0) == d)
        assert made[d] == hashlib.sha256(expected.encode()).hexdigest()


def test_whole_table(spark):
    made = found(queries.QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.01"))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert made == plain(rows)
