"""Reading reviews and stage tables."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import strip
from quillspark.sources.http import HttpLines

CORRUPT = "_corrupt_record"
REVIEW = T.StructType(
    [
        T.StructField("rating", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("helpful_vote", T.LongType()),
        T.StructField("verified_purchase", T.BooleanType()),
    ]
)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = REVIEW, strict: bool = False) -> DataFrame:
    """Line-delimited JSON with a declared schema. Lines that don't parse keep their text in CORRUPT, or fail if ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_jsonl_urls(spark: SparkSession, urls: Sequence[str], schema: T.StructType = REVIEW, timeout: float = 30.0, part_bytes: int = 64 << 20, retries: int = 3) -> DataFrame:
    """Line-delimited JSON from HTTP addresses, plain or gzip, a task for each range of a file whose server takes ranges.

    Executors stream the lines, so no file passes the driver or a local disk. An address that cannot
    be read fails the job with its name; lines that don't parse keep their text in CORRUPT.
    """
    spark.dataSource.register(HttpLines)
    got = spark.read.format("http_lines").options(urls="\n".join(urls), timeout=timeout, part_bytes=part_bytes, retries=retries).load()
    fields = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return got.filter(F.trim("line") != "").select(F.from_json("line", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")


def read_hub(spark: SparkSession, name: str, config: str | None = None, split: str = "full", schema: T.StructType = REVIEW, shards: int = 64) -> DataFrame:
    """A table of a public dataset hub, streamed by ``shards`` tasks. Needs the package ``datasets``; without it ImportError, so that ``open_first`` goes on."""
    import datasets  # noqa: F401

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datasets import load_dataset
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            part = load_dataset(name, config, split=split, streaming=True).shard(num_shards=shards, index=i)
            for rows in part.iter(batch_size=4096):
                yield pa.RecordBatch.from_pydict({f.name: rows[f.name] for f in fields}, schema=fields)

    return spark.range(0, shards, 1, shards).mapInArrow(stream, schema)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def open_first(attempts: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The first of ``attempts`` that can be opened.

    A source that is missing, or whose package is, fails when it is opened and the next is
    tried; errors while rows are read later are not caught.
    """
    failed: list[Exception] = []
    for attempt in attempts:
        try:
            df = attempt()
            _ = df.schema
            return df
        except (PySparkException, OSError, ImportError, ValueError) as e:
            logging.getLogger("quillspark").warning("source failed: %s", str(e).splitlines()[0] if str(e) else type(e).__name__)
            failed.append(e)
    raise RuntimeError(f"none of {len(attempts)} sources could be opened") from (failed[-1] if failed else None)


def open_reviews(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Reviews from the first readable path: Parquet, else line-delimited JSON."""
    attempts: list[Callable[[], DataFrame]] = []
    for p in paths:
        if not p.rstrip("/").endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz")):
            attempts.append(lambda p=p: read_parquet(spark, p))
        attempts.append(lambda p=p: read_jsonl(spark, p))
    return open_first(attempts)


def epoch_year(millis: Column) -> Column:
    """UTC calendar year of epoch milliseconds (sessions run in UTC)."""
    return F.year(F.timestamp_millis(millis)).cast("int")


def year_range(df: DataFrame, start: int, end: int, column: str = "year") -> DataFrame:
    return df.filter(F.col(column).between(start, end))


def parse_reviews(raw: DataFrame, category: str | Column, year_start: int | None = None, year_end: int | None = None) -> DataFrame:
    """Review records: trimmed, defaults filled, blank texts and missing times dropped.

    With a range of years the bounds are also put on the raw timestamp, where a Parquet
    scan can use them.
    """
    rows = raw.filter(F.col("timestamp").isNotNull())
    if year_start is not None and year_end is not None:
        millis = lambda y: F.unix_millis(F.make_timestamp(F.lit(y), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
        rows = rows.filter((F.col("timestamp") >= millis(year_start)) & (F.col("timestamp") < millis(year_end + 1)))
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    return rows.select(
        (F.lit(category) if isinstance(category, str) else category).alias("category"),
        epoch_year(F.col("timestamp")).alias("year"),
        F.col("rating").cast("double").alias("rating"),
        strip(F.coalesce(F.col("title"), F.lit(""))).alias("title"),
        text.alias("text"),
        F.coalesce(F.col("helpful_vote").cast("long"), F.lit(0)).alias("helpful_vote"),
        F.coalesce(F.col("verified_purchase"), F.lit(False)).alias("verified_purchase"),
        F.col("timestamp"),
    ).filter(F.col("text") != "")


def fixed_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)
