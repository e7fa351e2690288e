"""Trie of conversation prefixes, whose totals go from each node to its parent by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factsheet.llm.common import WORD, shared_folder
from factsheet.operators.joins import lookup
from factsheet.operators.ranges import Running, accumulate, ranges

#: A node: its depth, and two numbers that stand for the turns up to it, whatever conversation they are from.
NODE = ("depth", "x1", "x2")
#: Conversations are rebuilt on the first turns of the one that a group of as many shares.
GROUP = 20
#: Numbers in a packet of conversations that end at one node.
_PACKET = 1 << 15
_ROWS = 1 << 13
#: A group of rows beyond this, and beyond its share of all, is cut into ranges.
_HOT = 100_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and nothing is held on one machine."""
    path = f"{shared_folder(df.sparkSession)}/trie-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- paths ----------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``digest`` (of role and text, null as empty), ``words`` and ``pos`` (from 1) of each turn; no texts go on from here."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest")).alias("at"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    numbered = accumulate(slim, ["conv_id"], "at", [Running("pos", F.lit(1).cast("bigint"))], peers=False, hot_rows=_HOT)
    return numbered.select("conv_id", F.col("at.digest").alias("digest"), "words", "pos")


def rebuilt(numbered: DataFrame) -> DataFrame:
    """``conv_id``, ``pos``, ``digest`` and ``words`` of every rebuilt turn, and of a textless start of each conversation.

    ``pos`` is negative for what comes before a conversation's own turns, so that one cut of those serves here too.
    """
    own = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    # Every conversation has one first turn; a base has at most three turns to lend.
    heads = (
        numbered.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") <= 3))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct((F.col("pos") - 4).alias("pos"), "digest", "words"))).alias("heads"))
    )
    starts = numbered.filter("pos = 1").select("conv_id", base.alias("base"), own.alias("h")).join(heads, "base", "left")
    none = F.struct(F.lit(-9).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("words"))
    lent = F.coalesce(F.slice("heads", F.lit(1), F.col("h")), F.array().cast("array<struct<pos:bigint,digest:binary,words:bigint>>"))
    before = starts.select("conv_id", F.explode(F.concat(F.array(none), lent)).alias("t")).select("conv_id", "t.pos", "t.digest", "t.words")
    return numbered.filter(F.col("pos") > own).select("conv_id", "pos", "digest", "words").unionByName(before)


def paths(conversations: DataFrame) -> DataFrame:
    """A row for each conversation and each node on its way from the root: ``conv_id``, the node, its parent's numbers, ``words``.

    A node's numbers are the exclusive or of two hashes of each (depth, turn) up to it. So they are running figures,
    and a conversation of any length is cut into ranges like any other group.
    """
    numbered = stored(turns(conversations), "turns")
    cut = ranges(numbered, ["conv_id"], "pos", hot_rows=_HOT)
    placed = accumulate(rebuilt(numbered), ["conv_id"], "pos", [Running("place", F.lit(1).cast("bigint"))], peers=False, cut=cut)
    # The start is the first row of a conversation and stands for depth 0.
    deep = placed.withColumn("depth", F.col("place") - 1)
    # A constant before the others is a seed.
    hashes = {f"h{i}": F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "depth", "digest")).otherwise(F.lit(0).cast("bigint")) for i in (1, 2)}
    deep = deep.withColumns(hashes)
    figures = [Running(f"x{i}", F.col(f"h{i}"), F.bit_xor, lambda a, b: a.bitwiseXOR(b)) for i in (1, 2)]
    found = accumulate(deep, ["conv_id"], "pos", figures, peers=False, cut=cut)
    parents = [F.col(f"x{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"p{i}") for i in (1, 2)]
    return found.select("conv_id", *NODE, *parents, "words")


# --- time-forward processing ----------------------------------------------------------


class SpillingQueue:
    """A priority queue of pairs (key, message), lowest key first, that holds at most ``most`` of them in memory.

    When it is full its messages go, in order, to a file without a name, which is gone with the task. Runs
    are read back from their least key on, one message each; many are merged into one.
    """

    def __init__(self, most: int = 100_000, fan: int = 16) -> None:
        self.most, self.fan = most, fan
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []
        self.serial = 0

    def _run(self, messages: Iterable[tuple]) -> None:
        file = tempfile.TemporaryFile()
        for message in messages:
            pickle.dump(message, file, pickle.HIGHEST_PROTOCOL)
        file.seek(0)
        self._advance(file)

    def _advance(self, file) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(file), file))
        except EOFError:
            file.close()

    def push(self, key: tuple, message: tuple) -> None:
        self.serial += 1  # so that neither messages nor files are compared
        heapq.heappush(self.heap, (key, self.serial, message))
        if len(self.heap) > self.most:
            self._run(sorted(self.heap, key=itemgetter(0, 1)))
            self.heap = []
            if len(self.runs) > self.fan:
                runs, self.runs = self.runs, []
                self._run(heapq.merge(*[self._read(r) for r in runs], key=itemgetter(0, 1)))

    @staticmethod
    def _read(run: tuple) -> Iterator[tuple]:
        yield run[0]
        while True:
            try:
                yield pickle.load(run[1])
            except EOFError:
                run[1].close()
                return

    def least(self) -> tuple | None:
        """The lowest key."""
        tops = [x[0][0] for x in (self.heap[:1], [self.runs[0][0]] if self.runs else []) if x]
        return min(tops) if tops else None

    def pop(self) -> tuple:
        """The message of the lowest key."""
        if self.runs and (not self.heap or self.runs[0][0][:2] < self.heap[0][:2]):
            (_, _, message), file = heapq.heappop(self.runs)
            self._advance(file)
            return message
        return heapq.heappop(self.heap)[2]


NODES = "shard string, top boolean, depth bigint, x1 bigint, x2 bigint, p1 bigint, p2 bigint, conv_id bigint, n_convs bigint, words bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
TOTALS = "top boolean, depth bigint, x1 bigint, x2 bigint, p1 bigint, p2 bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def forward(nodes: Iterable[tuple], queue: SpillingQueue) -> Iterator[tuple]:
    """Rows of ``TOTALS`` for rows of ``NODES``, which come shard by shard, deepest first, then by their numbers.

    A node takes from the queue what its children sent, adds its own, and sends the sum to its parent, which comes
    later. Its row is complete, and given out, when the parent takes it, for only then is the parent's
    conversation known; the ``top`` of a shard, whose parent is elsewhere, is given out at once.
    """
    for _, shard in groupby(nodes, key=itemgetter(0)):
        for _, top, depth, x1, x2, p1, p2, conv, n_convs, words, children, leaves, saved in shard:
            key, saved = (-depth, x1, x2), saved + (n_convs - 1) * words
            while queue.least() == key:
                child = queue.pop()
                children, leaves, saved = children + 1, leaves + child[9], saved + child[10]
                yield (False, *child[:6], conv, *child[7:])
            row = (depth, x1, x2, p1, p2, conv, None, n_convs, children, leaves if children else 1, saved)
            if top:
                yield (True, *row)
            else:
                queue.push((1 - depth, p1, p2), row)
        if queue.least() is not None:
            raise ValueError("a shard ends before a node that its rows point to")


def processed(nodes: DataFrame, most: int) -> DataFrame:
    """``forward`` on every shard: Spark brings each to one task and sorts it, outside memory where it must."""
    names = [f.split()[0] for f in NODES.split(", ")]
    kinds = dict(f.split() for f in TOTALS.split(", "))
    arrow = {"boolean": pa.bool_(), "bigint": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[batch.column(n).to_pylist() for n in names]))
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*held), kinds.values())], names=list(kinds))

        for row in forward(rows, SpillingQueue(most)):
            held.append(row)
            if len(held) == _ROWS:
                yield made()
                held = []
        if held:
            yield made()

    # A shard is known by its top, so its name is as even as a hash.
    dealt = nodes.select(*names).repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "x1", "x2")
    return dealt.mapInArrow(run, TOTALS)


# --- conversations that end at a node ---------------------------------------------------


def ends_digests(ends: DataFrame) -> DataFrame:
    """Of each node where conversations end, ``ends_sha256``: of their decimal numbers, rising, joined by commas.

    A digest is taken in order. So that no task gets the members of a common node as rows, ranges of (node, number),
    evenly dealt, are first packed; a node's few packets then meet and are read one after the other.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((key, conv) for b in batches for *key, conv in zip(*[b.column(n).to_pylist() for n in (*NODE, "conv_id")]))
        out: list[tuple] = []
        for key, members in groupby(rows, key=itemgetter(0)):
            part: list[int] = []
            for _, conv in members:
                part.append(conv)
                if len(part) == _PACKET:
                    out.append((*key, part[0], ",".join(map(str, part))))
                    part = []
            if part:
                out.append((*key, part[0], ",".join(map(str, part))))
            if len(out) >= _ROWS or sum(len(x[4]) for x in out[-64:]) > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*NODE, "first", "members"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*NODE, "first", "members"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((key, members) for b in batches for *key, members in zip(*[b.column(n).to_pylist() for n in (*NODE, "members")]))
        out: list[tuple] = []
        for key, packets in groupby(rows, key=itemgetter(0)):
            digest, sep = hashlib.sha256(), b""
            for _, members in packets:
                digest.update(sep + members.encode())
                sep = b","
            out.append((*key, digest.hexdigest()))
            if len(out) == _ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*NODE, "ends_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*NODE, "ends_sha256"])

    node = "depth bigint, x1 bigint, x2 bigint"
    even = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    packets = even.mapInArrow(packed, f"{node}, first bigint, members string")
    return packets.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digested, f"{node}, ends_sha256 string")


# --- the whole ------------------------------------------------------------------------


def trie(conversations: DataFrame, *, shards: int = 1024, queue: int = 100_000) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, in the columns of the contract.

    A conversation ``c`` is rebuilt from the first ``h`` turns of ``c - c % 20`` (``h`` is the crc32 of its decimal number, modulo 4)
    and its own turns after its first ``h``. Turns are ordered by ``turn``, null first, then role, then a digest of the
    text; repeated rows are turns of their own. Null roles and texts are empty; a null ``conv_id`` takes no part; ``%`` has the sign of
    ``c``. A conversation rebuilt without turns is a member of the root alone. An empty table has no node. Other
    columns play no part.

    A node with more than one part in ``shards`` of all conversations is common, and so is the root. There are fewer than
    ``shards`` of them at any depth. Below them hang subtrees of few conversations, the shards: each is processed
    in one task, many side by side, and their tops' totals are added up for the common node above. Then the common nodes are
    processed as one more shard. A queue holds at most ``queue`` messages in memory. A conversation's nodes
    below the common ones are one path, where each total needs the one before, so they stay in one shard, in bounded memory.
    """
    rows = stored(paths(conversations), "paths")
    nodes = stored(
        rows.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2")),
        "nodes",
    )
    total = rows.filter("depth = 0").count()
    common = stored(nodes.filter((F.col("depth") == 0) | (F.col("n_convs") > total / shards)), "common")

    # Of each conversation the node where it ends, and its first that is not common.
    is_common = rows.join(common.select(*NODE, F.lit(True).alias("common")), list(NODE), "left")
    node = F.struct(*NODE)
    per_conv = stored(
        is_common.groupBy("conv_id").agg(
            F.max_by(node, "depth").alias("end"),
            F.min_by(F.when(F.col("common").isNull(), node), F.when(F.col("common").isNull(), F.col("depth"))).alias("top"),
            F.count("*").alias("nodes"),
        ),
        "conversations",
    )

    # All members of a node that is not common share their first such one, so any member tells the shard.
    rest = nodes.join(common.select(*NODE), list(NODE), "left_anti")
    tops = per_conv.select("conv_id", F.concat_ws(":", "top.depth", "top.x1", "top.x2").alias("shard"), F.col("top.depth").alias("top_depth"), "nodes")
    sharded = lookup(rest, tops, "conv_id", "nodes", how="inner")
    zero = {c: F.lit(0).cast("bigint") for c in ("n_children", "n_leaves", "saved_tokens")}
    below = stored(processed(sharded.withColumns(zero).withColumn("top", F.col("depth") == F.col("top_depth")), queue), "below")

    # What the tops send is added up before it meets their parent, which may have any number of them.
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    of_tops = below.filter("top")
    sent = of_tops.groupBy(*parent).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    given = common.join(sent, list(NODE), "left").fillna(0, list(zero))
    above = stored(processed(given.withColumn("shard", F.lit("common")).withColumn("top", F.col("depth") == 0), queue), "above")

    keyed = of_tops.withColumn("parent", F.struct(*parent))
    parents = above.select(F.struct(*NODE).alias("parent"), F.col("conv_id").alias("found"), F.col("n_children").alias("rows"))
    joined = lookup(keyed, parents, "parent", "rows", how="inner", hot_rows=0).withColumn("parent_conv_id", F.col("found"))
    names = ["conv_id", *NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = below.filter("NOT top").select(names).unionByName(joined.select(names)).unionByName(above.select(names))
    ends = ends_digests(per_conv.select("end.*", "conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(ends, list(NODE), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )
