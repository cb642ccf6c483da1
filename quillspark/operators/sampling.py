"""Reproducible stratified samples and their bookkeeping.

A stratum's sample is its k rows with the least md5 of seed and id: uniform without
replacement, the same however rows are laid out, and mergeable, so it can be kept up to date
as rows arrive. The plan filters by rank below the shuffle too, so a huge stratum sends only
k rows from each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_key(seed: int, id_col: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")))


def bottom_k(df: DataFrame, strata: Sequence[str], k: int, id_col: str, seed: int = 42) -> DataFrame:
    """At most ``k`` rows of each stratum, all of smaller ones."""
    order = Window.partitionBy(*strata).orderBy("__key", id_col)
    return df.withColumn("__key", sample_key(seed, id_col)).withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__key", "__r")


def population(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("population"))


def equal_cells(df: DataFrame, strata: Sequence[str], id_col: str, seed: int = 42) -> DataFrame:
    """Every cell cut to the size of the smallest.

    The smallest size is computed first, one number, so that the rank limit stands below the shuffle.
    """
    least = population(df, strata).agg(F.min("population")).first()[0]
    return bottom_k(df, strata, least or 0, id_col, seed).select(*df.columns)


def sampling_summary(df: DataFrame, category: str, year: str, categories: Sequence[str], years: tuple[int, int], k: int, equal: bool = False) -> DataFrame:
    """Every (category, year) of the grid, absent ones with 0: population_count, sampled_count, target_count, shortfall."""
    in_range = df.filter(F.col(year).between(*years))
    counts = population(in_range.filter(F.col(category).isin(*categories)), [category, year])  # no more rows than the grid has
    grid = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, categories))).alias("__c")).select("__c", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))).alias("__y"))
    cells = grid.join(F.broadcast(counts), (F.col("__c") == F.col(category)) & (F.col("__y") == F.col(year)), "left")
    cells = cells.select(F.col("__c").alias(category), F.col("__y").alias(year), F.coalesce("population", F.lit(0)).alias("population_count"))
    sampled = F.least(F.col("population_count"), F.lit(k).cast("long"))
    sampled = F.min(sampled).over(Window.partitionBy()) if equal else sampled
    return cells.select(category, year, "population_count", sampled.alias("sampled_count"), F.lit(k).cast("long").alias("target_count"), F.greatest(F.lit(0).cast("long"), F.lit(k).cast("long") - F.col("population_count")).alias("shortfall"))


def drop_duplicates_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row by ``order`` of each set of equal ``keys``, nulls being equal.

    Long keys are compared by a 256-bit digest, so they are not what is shuffled and sorted.
    """
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    first = Window.partitionBy("__d").orderBy(*order)
    return df.withColumn("__d", digest).withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__d", "__r")


def stage_log(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """step, rows_remaining, rows_dropped after each of ``steps``' conditions, in one pass over the rows."""
    alive, counts = F.lit(True), [F.count(F.lit(1)).alias("c0")]
    for i, (_, keep) in enumerate(steps, 1):
        alive = alive & F.coalesce(keep, F.lit(False))
        counts.append(F.count_if(alive).alias(f"c{i}"))
    names = ["start", *(name for name, _ in steps)]
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("step"), F.col(f"c{i}").alias("rows_remaining"), (F.col(f"c{max(i - 1, 0)}") - F.col(f"c{i}")).alias("rows_dropped")) for i, n in enumerate(names)))
    return df.agg(*counts).select(F.explode(rows).alias("r")).select("r.step", "r.rows_remaining", "r.rows_dropped")
