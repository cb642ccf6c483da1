"""The streamed sample against the batch sample: repeats, restarts, nulls, late rows, duplicates within the watermark."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from quillspark.operators import sampling
from quillspark.streaming import sampling as streaming

SCHEMA = "rating double, text string, timestamp bigint"


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    path = folder / f"{name}.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (1.7e9 + name, 1.7e9 + name))  # files arrive in this order


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def test_streamed_sample_equals_batch_sample_with_repeats_over_restarts(spark, tmp_path):
    rows = [{"rating": float(i % 5) if i % 7 else None, "text": f"t{i % 40}", "timestamp": i % 40} for i in range(120)]
    folder, state = tmp_path / "in", str(tmp_path / "state")
    for part in range(2):
        write(folder, part, rows[part * 40 : part * 40 + 40])
    streaming.sample_stream(read(spark, folder), ["rating"], 4, "timestamp", state).awaitTermination()
    write(folder, 2, rows[80:])
    streaming.sample_stream(read(spark, folder), ["rating"], 4, "timestamp", state).awaitTermination()
    whole = spark.createDataFrame([(r["rating"], r["text"], r["timestamp"]) for r in rows], SCHEMA)
    want = sampling.bottom_k(whole, ["rating"], 4, "timestamp")
    by = lambda df: sorted(map(tuple, df.select("rating", "text", "timestamp").collect()), key=repr)
    assert by(streaming.latest_sample(spark, state)) == by(want)
    seen = {r.rating: r.population for r in streaming.latest_population(spark, state).collect()}
    assert seen == {r.rating: r.population for r in sampling.population(whole, ["rating"]).collect()}


def test_late_rows_and_duplicates_within_the_watermark(spark, tmp_path):
    at = lambda minute: dt.datetime(2020, 1, 1, 0, minute).isoformat()
    folder, state = tmp_path / "in", str(tmp_path / "state")
    write(folder, 0, [{"g": "a", "id": 1, "t": at(0)}, {"g": "a", "id": 1, "t": at(1)}, {"g": "a", "id": 2, "t": at(30)}])
    write(folder, 1, [{"g": "a", "id": 3, "t": at(31)}, {"g": "a", "id": 2, "t": at(32)}])
    write(folder, 2, [{"g": "a", "id": 9, "t": at(2)}])  # half an hour late
    stream = spark.readStream.schema("g string, id bigint, t timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    streaming.sample_stream(stream, ["g"], 10, "id", state, event_time="t", late="10 minutes", unique=True).awaitTermination()
    got = streaming.latest_sample(spark, state).select("id").collect()
    assert sorted(r.id for r in got) == [1, 2, 3]


def test_registered_query_is_the_batch_sample(spark):
    from quillspark.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    by = lambda name: sorted(map(tuple, QUERIES[name](spark, d).select("id", "grp", "yr").collect()))
    assert by("streaming_sample") == by("reservoir")
