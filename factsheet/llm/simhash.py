"""SimHash near-duplicates: fingerprints linked by a search in BK-trees."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from factsheet.llm.common import checkpointed, map_text, set_aside, spread_join, words
from factsheet.llm.components import components
from factsheet.operators.joins import lookup

_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is in over half of the hashes of the text's shingles, repeats included."""
    tokens = [w.lower() for w in words(text)]
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*[tokens[i:] for i in range(width)])) if len(tokens) >= width else [b" ".join(tokens)]
    hashes = np.array([xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Values by Hamming distance: a child hangs from its parent under the distance between the two."""

    def __init__(self, radius: int) -> None:
        self.radius, self.values, self.children = radius, [], []

    def add(self, value: int) -> list[int]:
        """Places of the earlier values within the radius; then the value takes its place.

        A subtree under distance e holds only values at e from the node, so by the triangle inequality none
        within the radius unless e is within the radius of the node's own distance.
        """
        near, me = [], len(self.values)
        ahead = [0] if me else []
        home = 0
        while ahead:
            node = ahead.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= self.radius:
                near.append(node)
            edges = self.children[node]
            ahead.extend(edges[e] for e in range(max(d - self.radius, 0), d + self.radius + 1) if e in edges)
        self.values.append(value)
        self.children.append({})
        if me:
            while (d := (self.values[home] ^ value).bit_count()) in self.children[home]:
                home = self.children[home][d]
            self.children[home][d] = me
        return near


def spanning_links(values: Sequence[int], radius: int) -> list[tuple[int, int]]:
    """Links between values within the radius that connect all that such links connect, one fewer than values at most."""
    tree, parent, links = BKTree(radius), list(range(len(values))), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.add(value):
            a, b = top(i), top(j)
            if a != b:
                parent[a] = b
                links.append((value, values[j]))
    return links


def masks(radius: int, spare: int = 4) -> list[int]:
    """Bit masks of which any two values within ``radius`` agree on one: all but ``radius`` of ``radius + spare`` blocks."""
    cuts = np.linspace(0, 64, radius + spare + 1).round().astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, spare)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def linked(prints: DataFrame, radius: int) -> DataFrame:
    """``u``, ``v``: links between the distinct ``fp`` of ``prints`` that connect all within ``radius`` bits.

    Fingerprints that agree on a mask form a shard; each goes to one shard of every mask, and two within the
    radius meet in at least one. A shard has at most 2 to the number of its free bits, in practice only near
    copies, whatever share of the documents they come from. Its tree is built where its members, which are also
    its queries, are gathered; shards are many and grow with the data, so they are shuffled and not broadcast.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks(radius))])
    shards = prints.select("fp", F.explode(keys).alias("k")).groupBy("k").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1).select("fps")

    def run(batches):
        for batch in batches:
            links = [x for fps in batch.column("fps").to_pylist() for x in spanning_links([f & (2**64 - 1) for f in fps], radius)]
            yield pa.RecordBatch.from_arrays([pa.array([_signed(x[i]) for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return shards.mapInArrow(run, "u long, v long").distinct()


def fingerprints(documents: DataFrame, width: int, keep: Sequence[str] | None = None) -> DataFrame:
    return map_text(documents, "fp long", lambda texts: [[_signed(fingerprint(t, width)) for t in texts]], keep)


def groups(prints: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``n`` (documents), ``component_fp`` and ``component_id`` of every distinct ``fp``, kept in the shared folder."""
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(linked(nodes, radius)).select(F.col("node").alias("fp"), "root")
    placed = checkpointed(nodes.join(roots, "fp", "left").withColumn("component_fp", F.coalesce("root", "fp")).drop("root"))
    ids = placed.groupBy("component_fp").agg(F.min("first").alias("component_id"))
    return checkpointed(spread_join(placed, ids, "component_fp", ["fp"], copies=8).select("fp", "n", "component_fp", "component_id"))


def near_duplicates(documents: DataFrame, *, width: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest ``doc_id`` reachable, of every row.

    Null and empty texts have fingerprint zero and are linked like others. Repeated rows stay; a row without
    ``doc_id`` belongs to its component but never names it, and ``component_id`` is null where nobody can.
    """
    prints = checkpointed(fingerprints(documents, width, ["doc_id"]))
    found = lookup(prints, groups(prints, radius), "fp", "n", hot_rows=0)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(documents: DataFrame, *, width: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``documents`` for each component: the one with the smallest ``doc_id``; with its columns.

    Of rows that repeat that ``doc_id`` one stays; a component whose rows all lack a ``doc_id`` keeps one of them.
    """
    found = groups(checkpointed(fingerprints(documents, width, ["doc_id"])), radius)
    plain, columns = set_aside(documents, ["fp", "n", "component_fp", "component_id"])
    every = lookup(fingerprints(plain, width), found, "fp", "n", hot_rows=0)
    first = every.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return first.dropDuplicates(["component_fp"]).select(*columns)
