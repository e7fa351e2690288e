"""Mix sources to target weights: seats by Sainte-Laguë, then seeded blocks. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factsheet.llm.common import WORD, checkpointed, set_aside


ADDED = ("size", "source_size", "target", "taken")


def apportion(parties: DataFrame, weight: str, seats: str, by: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Give each group's ``seats`` to its parties by highest quotients ``weight / (2 k + 1)``.

    ``parties`` has one row per party; ``ties`` orders equal quotients and names the party within its group.
    Adds ``quota``. A party without weight gets none. With m parties of total weight W and N seats, rounding
    at the final divisor puts a party's quota between w (N - m/2) / W - 1/2 and w (N + m/2) / W + 1/2, so only
    the quotients between those bounds are ranked: about three a party, however many seats there are.
    """
    group, w, n = Window.partitionBy(*by), F.col(weight), F.col(seats)
    half = F.count(F.lit(1)).over(group) / 2
    share = w / F.sum(weight).over(group)
    low = F.greatest(F.lit(0), F.ceil(share * (n - half) - 0.5) - 1).cast("long")
    high = (F.floor(share * (n + half) + 0.5) + 1).cast("long")
    bounds = parties.filter(w > 0).withColumn("_low", low).withColumn("_high", F.greatest(high, F.col("_low") + 1))
    left = bounds.withColumn("_left", n - F.sum("_low").over(group))
    quotients = left.withColumn("_k", F.explode(F.sequence("_low", F.col("_high") - 1)))
    ranked = quotients.withColumn(
        "_rank", F.row_number().over(group.orderBy((w / (2 * F.col("_k") + 1)).desc(), *ties, "_k"))
    )
    won = ranked.groupBy(*by, *ties).agg((F.first("_low") + F.count_if(F.col("_rank") <= F.col("_left"))).alias("quota"))
    return parties.join(won, [*by, *ties], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def targets(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Adds ``target``: the words of ``sources`` (``_src``, ``source``, ``words``), one row each, shared out anew.

    Weights repeat over the sources by code point, null last. No target is above ``cap`` times its source:
    with sources by the level at which they fill up, those that fill before the level that the others
    reach get their cap, and the others share the rest by weight.
    """
    every = Window.partitionBy()
    position = F.row_number().over(every.orderBy(F.col("source").isNull(), "source"))
    filling = every.orderBy("_fills", "_src")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(position - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("_cap", F.col("words") * cap)
        .withColumn("_fills", F.col("_cap") / F.col("_weight"))
        .withColumn("_rest", F.sum("words").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_level", F.col("_rest") / F.sum("_weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_full", F.col("_fills") <= F.col("_level"))
        .withColumn("_shared", F.max(F.when(~F.col("_full"), F.col("_level"))).over(every))
        .withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_weight") * F.col("_shared")).cast("double"))
        .select("_src", "words", "target")
    )


def mix(documents: DataFrame, *, weights: Sequence[int] = (1, 2, 3), cap: int = 3, blocks: int = 1 << 20, shards: int = 1024, shard_rows: int = 250_000, seed: int = 42) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and ``taken``, the words of it that the mix takes.

    A document's size is its number of words (null: 0). Documents go to shards of their source by a seeded hash and
    stand there in seeded order: to ``shards`` of them, or as many more as leave about ``shard_rows`` rows of the table in each; a shard's words in that order are cut into blocks of as many
    words each, the whole table into about ``blocks``. Blocks are apportioned to sources by target, then to the
    shards of a source. A shard with quota q of n blocks takes each of them ``q div n`` times, and the other
    ``q mod n`` evenly from a seeded start, so no document is taken more than ``cap`` times. Every sum runs over
    one shard, so a source that holds most rows is spread over all of them. Rows without ``doc_id`` are spread by their text
    and the partition they come from, so they fill no shard of their own. Only the table of sources, one row each, meets
    in one task: sources are meant to be few, as the weights that repeat over them are.

    A null source is a source; repeated rows are documents of their own; equal rows are alike, so reruns agree.
    Other columns stay, but for those of the added names, which are replaced, and those that begin with ``_``,
    which are dropped. An empty table gives an empty one; documents without words have ``taken`` 0.
    """
    documents = documents.drop(*[c for c in documents.columns if c.startswith("_") or c.lower() in ADDED])
    shards = max(shards, -(-documents.count() // shard_rows))
    anonymous = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text"), F.spark_partition_id()))
    start = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), anonymous)
    sized = (
        documents.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("_src", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")))
        .withColumn("_order", start)
        .withColumn("_shard", F.pmod(start, F.lit(shards)).cast("int"))
    )
    per_shard = checkpointed(sized.groupBy("_src", "_shard").agg(F.sum("size").alias("_words"), F.first("source").alias("source")))
    sources = targets(per_shard.groupBy("_src").agg(F.sum("_words").alias("words"), F.first("source").alias("source")), weights, cap)
    sources = sources.withColumn("_block", F.greatest(F.lit(1), F.ceil(F.sum("words").over(Window.partitionBy()) / blocks)).cast("long"))
    cut = per_shard.drop("source").join(sources, "_src").withColumn("_n", F.ceil(F.col("_words") / F.col("_block")).cast("long"))

    per_source = cut.groupBy("_src", "words", "target").agg(F.sum("_n").alias("_blocks"))
    wanted = per_source.withColumn("_wanted", F.coalesce(F.try_divide(F.col("_blocks") * F.col("target"), F.col("words")), F.lit(0.0)))
    wanted = wanted.withColumn("_seats", F.round(F.sum("_wanted").over(Window.partitionBy())).cast("long"))
    won = apportion(wanted, "_wanted", "_seats", (), ["_src"]).select("_src", F.col("quota").alias("_quota"))
    quotas = apportion(cut.join(won, "_src"), "_n", "_quota", ["_src"], ["_shard"]).select(
        "_src", "_shard", "_block", "_n", F.least("quota", F.col("_n") * cap).alias("_q"), F.col("words").alias("source_size"), "target"
    )

    shard = Window.partitionBy("_src", "_shard").orderBy("_order", "doc_id", "size")
    end = F.sum("size").over(shard.rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumn("_end", end).join(quotas, ["_src", "_shard"], "left")
    n, block = F.greatest("_n", F.lit(1)), F.col("_block")
    extra, first = F.col("_q") % n, F.pmod(F.xxhash64(F.lit(seed), "_src", "_shard"), n)

    def div(a: Column, b: Column) -> Column:
        return F.floor((a - a % b) / b)

    def taken_before(word: Column) -> Column:
        """Words that the extra blocks hold among a shard's first ``word`` words."""
        at = div(word, block)
        none, here, after = (div((first + x) * extra, n) for x in (F.lit(0), at, at + 1))
        return block * (here - none) + (after - here) * (word - at * block)

    every = F.col("size") * div(F.col("_q"), n)
    part = taken_before(F.col("_end")) - taken_before(F.col("_end") - F.col("size"))
    return placed.withColumn("taken", (every + part).cast("long")).drop("_src", "_shard", "_order", "_end", "_block", "_n", "_q")


def mixed_documents(documents: DataFrame, *, seed: int = 42, **options) -> DataFrame:
    """The mix as whole documents: each appears ``taken / size`` times, rounded up or down by a seeded draw.

    Same columns as ``documents``. A document without words, of which nothing is taken, goes.
    """
    plain, columns = set_aside(documents, [*ADDED, *[c for c in documents.columns if c.startswith("_")]])
    times = F.try_divide("taken", "size")
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.lit(1 << 30)) / (1 << 30)
    copies = (F.floor(times) + (draw < times - F.floor(times)).cast("int")).cast("int")
    rows = mix(plain, seed=seed, **options).withColumn("_copies", copies).filter(F.col("_copies") > 0)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*columns)
