"""Mixing sources to target weights by Sainte-Lague apportionment (native).

Targets are shares of a word budget by weight, stopped at ``max_epochs`` times a
source's size. The budget is cut into equal blocks of words and the blocks are
allotted to sources by highest quotients ``target / (2k - 1)``, then, within a
source, to its shards by highest quotients of their sizes. That gives an integer
quota per shard. A shard lines its documents up in a seeded random order, cuts the
line into equal blocks, takes whole rounds first and the rest of the quota as a run
of blocks from a seeded start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, scratch, small, temporary_tables, word_count


#: Shards that share out blocks at once.
RACK = 4096


def apportion(votes: DataFrame, group: Sequence[str], vote: str, seats: str, order: Sequence[Column], out: str) -> DataFrame:
    """Sainte-Lague seats for each row of ``votes``, as the column ``out``.

    Rows of a group (none: the whole table) share the seats in column ``seats``.
    Quotient ties go to the row that comes first by ``order``.

    With n rows and B seats the divisor lies between T/(B+n/2) and T/(B-n/2), for T
    votes in all, so every row's seats are known but for one or two. Only those are
    listed and ranked: about 4n rows, whatever B is.
    """
    all_of = Window.partitionBy(*group)
    total, n = F.sum(vote).over(all_of), F.count(F.lit(1)).over(all_of)
    v, b = F.col(vote).cast("double"), F.col(seats).cast("double")
    known = (
        votes.withColumn("__t", total.cast("double"))
        .withColumn("__n", n)
        .withColumn("__lo", F.when(F.col("__t") > 0, F.greatest(F.lit(0.0), F.floor(v * F.greatest(b - F.col("__n") / 2, F.lit(0.0)) / F.col("__t") + 0.5) - 1)).otherwise(0.0).cast("long"))
        .withColumn("__hi", F.when(F.col("__t") > 0, F.floor(v * (b + F.col("__n") / 2) / F.col("__t") + 0.5) + 1).otherwise(0.0).cast("long"))
        .withColumn("__left", F.col(seats) - F.sum("__lo").over(all_of))
        .withColumn("__id", F.row_number().over(all_of.orderBy(*order)))
    )
    contested = known.withColumn("__k", F.explode_outer(F.when(F.col("__hi") > F.col("__lo"), F.sequence(F.col("__lo") + 1, F.col("__hi")))))
    ranked = contested.withColumn("__r", F.row_number().over(all_of.orderBy((v / (2 * F.col("__k") - 1)).desc_nulls_last(), F.col("__id"), F.col("__k"))))
    won = F.count_if(F.col("__k").isNotNull() & (F.col("__r") <= F.col("__left")))
    return ranked.groupBy(*votes.columns, "__id", "__lo").agg((F.col("__lo") + won).cast("long").alias(out)).drop("__id", "__lo")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """Per source (rows: source, source_size): its target in words.

    Sources by code point, null last, weigh ``weights`` in turn. Stopping targets at
    the cap and resharing the excess by weight ends where every target is
    min(cap, level * weight); the level follows from running sums by cap / weight.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    s = s.withColumn("rank", F.row_number().over(by_ratio))
    first_free = F.min_by("level", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("rank"))).over(everything)
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(first_free, F.lit(float("inf"))) * F.col("weight"))).select("source", "sid", "source_size", "target")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, block_words: int = 64, shard_words: int = 1 << 18, seed: int = 20240607) -> DataFrame:
    """What a mix of ``share`` times the words of ``docs`` takes of each document.

    ``docs`` needs doc_id, text and source; other columns are not read. Returns a row
    for each row of ``docs``: doc_id, source, size (words of the whole text), source_size,
    target (of the source), taken (words the mix takes, repeats counted; at most
    ``max_epochs`` times size) and copies (how often the mix takes the document if it takes
    documents whole: its first word decides).

    A null text has size 0 and is taken 0 times; null is a source of its own, last in
    order; an empty table gives an empty result; repeated rows are separate documents.
    Equal seeds give equal results, however the rows are laid out.
    """
    keep: list[DataFrame] = []
    with temporary_tables(keep):
        sized = scratch(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
        totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        targets = scratch(source_targets(totals, weights, share, max_epochs), "mix-targets")
        blocks = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
        quotas = apportion(targets.withColumn("blocks", blocks), [], "target", "blocks", [F.col("sid")], "quota")
        quotas = scratch(quotas.select("source", "sid", "source_size", "target", "quota", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).alias("shards")), "mix-quotas")

        seeded = F.xxhash64(F.lit(seed), "doc_id", "size")
        rows = sized.join(quotas.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        rows = rows.withColumn("shard", F.pmod(seeded, F.col("shards")))
        shards = rows.groupBy("sid", "quota", "shard").agg(F.sum("size").alias("shard_size"))
        # Blocks go to racks of shards first, so that no window holds more rows than a rack has shards, or a source racks.
        shards = scratch(shards.withColumn("rack", F.floor(F.col("shard") / RACK)), "mix-shard-sizes")
        racks = shards.groupBy("sid", "quota", "rack").agg(F.sum("shard_size").alias("rack_size"))
        racks = apportion(racks, ["sid"], "rack_size", "quota", [F.col("rack")], "rack_quota").select("sid", "rack", "rack_quota")
        shards = apportion(shards.join(racks, ["sid", "rack"]), ["sid", "rack"], "shard_size", "rack_quota", [F.col("shard")], "shard_quota")
        m = F.greatest(F.lit(1), F.round(F.col("shard_size") / block_words)).cast("long")
        shards = shards.withColumn("m", m).withColumn("room", F.greatest(max_epochs * F.col("m") - F.col("shard_quota"), F.lit(0)))
        # What a shard cannot hold goes to others of its source, in proportion to their room.
        shards = scratch(shards.withColumn("over", F.greatest(F.col("shard_quota") - max_epochs * F.col("m"), F.lit(0))), "mix-quotas-of-shards")
        lost = shards.groupBy("sid").agg(F.sum("over").alias("lost")).filter("lost > 0")
        again = shards.groupBy("sid", "rack").agg(F.sum("room").alias("rack_room")).join(lost, "sid").filter("rack_room > 0")
        again = apportion(again, ["sid"], "rack_room", "lost", [F.col("rack")], "rack_more").select("sid", "rack", "rack_more")
        more = shards.filter("room > 0").select("sid", "rack", "shard", "room").join(again, ["sid", "rack"])
        more = apportion(more, ["sid", "rack"], "room", "rack_more", [F.col("shard")], "more").select("sid", "shard", "more")
        q = F.least(F.col("shard_quota") + F.coalesce("more", F.lit(0)), max_epochs * F.col("m"))
        shards = shards.join(more, ["sid", "shard"], "left")
        shards = scratch(shards.select("sid", "shard", "shard_size", "m", q.alias("q"), F.pmod(F.xxhash64(F.lit(seed), "sid", "shard"), F.col("m")).alias("start")), "mix-shards")
        keep += [sized, quotas, shards]

    line = Window.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), "doc_id", "size")
    placed = rows.join(shards, ["sid", "shard"]).withColumn("__end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    edge = lambda j: F.floor(j * F.col("shard_size") / F.col("m"))
    rest, stop = F.col("q") % F.col("m"), F.col("start") + F.col("q") % F.col("m")
    spans = [(edge(F.col("start")), edge(F.least(stop, F.col("m")))), (F.lit(0), F.when(stop > F.col("m"), edge(stop - F.col("m"))).otherwise(0))]
    begin, end = F.col("__end") - F.col("size"), F.col("__end")
    over = sum((F.greatest(F.lit(0), F.least(end, hi) - F.greatest(begin, lo)) for lo, hi in spans), F.lit(0))
    inside = F.lit(False)
    for lo, hi in spans:
        inside = inside | ((begin >= lo) & (begin < hi))
    rounds = F.floor(F.col("q") / F.col("m"))
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (rounds * F.col("size") + F.when(rest > 0, over).otherwise(0)).cast("long").alias("taken"),
        (rounds + (inside & (rest > 0) & (F.col("size") > 0)).cast("long")).cast("long").alias("copies"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: whole documents, each as often as ``mix_sources`` says (``copies``).

    Rows that share a doc_id (null too) are repeated alike, as often as the one taken least. Null texts
    have no words and go; an empty table stays empty; all columns stay, whatever their names.
    """
    its, copies, copy = fresh("id"), fresh("copies"), fresh("copy")
    taken = scratch(mix_sources(docs, **options).groupBy(F.col("doc_id").alias(its)).agg(F.min("copies").alias(copies)), "mix-copies")
    rows = docs.join(small(taken.filter(F.col(copies) > 0), 64), F.col("doc_id").eqNullSafe(F.col(its)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(its, copies, copy)
