"""A stratified sample that is kept up to date while rows arrive, in keyed state.

Each stratum's state is the k rows with the least keys so far and the number of rows seen. The least k of a
union are among the least of its parts, so this equals sampling everything at once, however rows are cut into batches. State
is versioned and restored by Spark; ``latest_sample`` and ``latest_population`` read it where the query left it, so nothing else is written.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillspark.operators.sampling import sample_key
from quillspark.sources.readers import CORRUPT, REVIEW

#: The state store that holds more than one state for a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_review_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Line-delimited JSON files as they appear in ``folder``."""
    return spark.readStream.schema(REVIEW).option("maxFilesPerTrigger", max_files).option("columnNameOfCorruptRecord", CORRUPT).json(folder)


class BottomK(StatefulProcessor):
    """Keeps the ``k`` rows of a key that come first by __key, then by the id; gives out how many rows were seen and kept."""

    def __init__(self, k: int, schema: StructType, id_col: str):
        self.k, self.schema, self.id_at = k, schema, schema.names.index(id_col)
        self.key_at = schema.names.index("__key")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sample = handle.getListState("sample", self.schema)
        self.seen = handle.getValueState("seen", StructType([StructField("n", LongType())]))

    def _order(self, row: tuple) -> tuple:
        i = row[self.id_at]
        return (row[self.key_at], i is not None, i)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = list(map(tuple, self.sample.get())) if self.sample.exists() else []
        seen, n = self.seen.get()[0] if self.seen.exists() else 0, 0

        def counted() -> Iterator[tuple]:
            nonlocal n
            for r in rows:
                n += 1
                yield tuple(r)

        least = heapq.nsmallest(self.k, (r for part in (held, counted()) for r in part), key=self._order)
        self.sample.put(least)
        self.seen.update((seen + n,))
        yield Row(stratum=",".join(map(str, key)), seen=seen + n, kept=len(least))

    def close(self) -> None:
        pass


_OUT = StructType([StructField("stratum", StringType()), StructField("seen", LongType()), StructField("kept", LongType())])


def sample_stream(stream: DataFrame, strata: Sequence[str], k: int, id_col: str, checkpoint: str, seed: int = 42, event_time: str | None = None, late: str = "0 seconds", unique: bool = False) -> StreamingQuery:
    """Sample all rows of ``stream`` into the state of ``checkpoint``; returns the query, which stops when the input that is there is used up.

    Run it again with the same checkpoint to go on with what has arrived since. With ``event_time``, rows later than ``late`` behind the
    newest are left out; with ``unique`` too, ids that come again within that time are (else repeated ids are rows each).
    """
    if unique and not event_time:
        raise ValueError("repeated ids are told within a watermark: name event_time")
    if event_time:
        stream = stream.withWatermark(event_time, late)
    if unique:
        stream = stream.dropDuplicatesWithinWatermark([*strata, id_col])
    spark, keyed = stream.sparkSession, stream.withColumn("__key", sample_key(seed, id_col))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        counts = keyed.groupBy(*strata).transformWithState(BottomK(k, keyed.schema, id_col), _OUT, "Update", "None")
        return counts.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("operatorId", 0).option("stateVarName", name).load(checkpoint)


def latest_sample(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows of the sample as the last batch left it."""
    rows = _state(spark, checkpoint, "sample").select("list_element.*")
    return rows.drop("__key")


def latest_population(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The strata and how many rows of each were seen."""
    return _state(spark, checkpoint, "seen").select("key.*", F.col("value.n").alias("population"))
