"""Importance resampling towards a target distribution, by hashed word n-grams.

A text's features are its runs of one to three words. Each is hashed to one of a fixed number of
buckets; a bucket's gain is the log ratio of its smoothed shares in the target and in the corpus, and
a document's weight is the sum over its features. Gumbel noise seeded by doc_id turns the weights into
a draw without replacement: the highest scores are taken.

Words become whole numbers by a dictionary of the slice of texts at hand, so an n-gram is a tuple of
ids. Only a slice's distinct tuples are spelled out again as bytes and hashed, each once; their buckets
are joined back to all places by the ids. (A dictionary of the whole corpus would move every
occurrence of every n-gram: some three rows a word.) Each document's buckets are written once, sorted,
as gaps, so that the texts are read a single time.

Nulls: a null text has no words, hence no features and weight 0; a null doc_id is hashed as an empty
one and comes last among ties. An empty text is the same as a null one; texts of any length are taken
whole. Rows that repeat are documents each, with equal scores and adjacent ranks. Empty tables give
empty results; an empty target gives the same formula with T = 0. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import flat_bytes, lean, scratch, slices, temporary_tables

BUCKETS = 10_000
LONGEST = 3
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42

#: Bytes of text whose words share one dictionary.
SLICE = 3 << 20
#: Words whose n-grams are numbered at once, so that one very long text takes bounded memory.
RUN = 1 << 19

#: What a byte is in a word: A-Z as a-z; 0 ends a word.
_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[:0x80] = [ord(chr(b).lower()) if chr(b).isalnum() else 0 for b in range(0x80)]


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of all texts end to end as ids, the words that the ids stand for, and where each text's words begin (and the last end)."""
    data, at = flat_bytes(texts)
    data = _BYTE[data]
    inside = data != 0
    first = inside.copy()
    if len(data):
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        first[1:] &= ~inside[:-1] | edge[1:-1]
    begin, kept = np.flatnonzero(first), data[inside]
    # Without what stands between words, each begins where the one before it ends.
    places = np.append(np.cumsum(inside)[begin] - 1, len(kept))
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(kept)]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary, np.searchsorted(begin, at)


def _hashed(spelled: pa.Array, buckets: int) -> np.ndarray:
    parts = (spelled.slice(i, 1 << 16).to_pylist() for i in range(0, len(spelled), 1 << 16))
    return np.fromiter((zlib.crc32(x) for part in parts for x in part), np.uint32, len(spelled)) % np.uint32(buckets)


def feature_buckets(codes: np.ndarray, words: pa.Array, at: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For every feature of every text its bucket and the number of its text.

    ``at`` says where each text's words begin. An n-gram's id is made of the id of all but its last
    word and that of its last word, numbered anew for each length, so ids stay below words times words.
    """
    text = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(codes))  # words from here to the text's end
    single = _hashed(words, buckets)
    found, owners = [single[codes]], [text]
    for begin in range(0, len(codes), RUN):
        starts = np.arange(begin, min(begin + RUN, len(codes)))
        spelled, ids = words, codes[starts].astype(np.int64)
        for n in range(2, longest + 1):
            keep = left[starts] >= n
            starts, ids = starts[keep], ids[keep]
            pairs, ids = np.unique(ids * len(words) + codes[starts + n - 1], return_inverse=True)
            head, last = pairs // len(words), pairs % len(words)
            spelled = pc.binary_join_element_wise(spelled.take(pa.array(head)), words.take(pa.array(last)), pa.scalar(b" ", pa.large_binary()))
            found.append(_hashed(spelled, buckets)[ids])
            owners.append(text[starts])
    return np.concatenate(found), np.concatenate(owners)


def _gaps(bucket: np.ndarray, owner: np.ndarray, n_texts: int, buckets: int) -> pa.Array:
    """Each text's buckets in rising order, each as the difference from the one before, two bytes apiece."""
    whole = np.sort(owner * buckets + bucket)
    of = whole // buckets
    gaps = np.diff(whole % buckets, prepend=0)
    new = np.diff(of, prepend=-1) != 0
    gaps[new] = (whole % buckets)[new]
    ends = np.searchsorted(of, np.arange(n_texts + 1)) * 2
    return pa.Array.from_buffers(pa.binary(), n_texts, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(gaps.astype(np.uint16))])


def _buckets_of(gaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows end to end, and where each row's begin (and the last end)."""
    places = np.frombuffer(gaps.buffers()[1], np.int32)[gaps.offset : gaps.offset + len(gaps) + 1].astype(np.int64) if len(gaps) else np.zeros(1, np.int64)
    data = gaps.buffers()[2]
    steps = np.frombuffer(data, np.uint16, count=(places[-1] - places[0]) // 2, offset=places[0]).astype(np.int64) if data is not None else np.empty(0, np.int64)
    at = (places - places[0]) // 2
    sums = np.cumsum(steps)
    before = np.concatenate([[0], sums])[at[:-1]]
    return sums - np.repeat(before, np.diff(at)), at


def featurize(df: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_words, n_features and gaps: the buckets of a text's features as sorted differences."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in two bytes")
    given = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            codes, words, at = word_codes(b.column(len(keep)))
            bucket, owner = feature_buckets(codes, words, at, buckets, longest)
            counts = np.bincount(owner, minlength=b.num_rows)
            columns = [*b.columns[: len(keep)], pa.array(np.diff(at)), pa.array(counts.astype(np.int64)), _gaps(bucket, owner, b.num_rows, buckets)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "n_features", "gaps"])

    return given.mapInArrow(lean(run), f"{schema}, n_words bigint, n_features bigint, gaps binary".removeprefix(", "))


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """How many features fall in each bucket, summed in each task before they are brought together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(_buckets_of(b.column(0))[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    return features.select("gaps").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of every bucket; two tables of at most ``buckets`` rows are collected."""
    s, t = ([0] * buckets for _ in range(2))
    for held, counts in ((s, corpus), (t, target)):
        for bucket, n in counts.collect():
            held[bucket] = n
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``features`` with weight, the sum of the gains of a document's features, in place of gaps."""
    names = [c for c in features.columns if c != "gaps"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema.fields if f.name != "gaps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, at = _buckets_of(b.column(len(names)))
            sums = np.concatenate([[0], np.cumsum(gain[bucket])])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(sums[at[1:]] - sums[at[:-1]])], names=[*names, "weight"])

    return features.select(*names, "gaps").mapInArrow(run, f"{schema}, weight bigint")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Noise that depends on the seed and the id alone, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def _ordered(scored: DataFrame, least_words: int) -> DataFrame:
    """``scored`` in the order of the draw, with at: the number of a row's range and, in the low 33 bits, of the row in it."""
    spread = scored.withColumn("spread", F.monotonically_increasing_id())  # so that a row that repeats doesn't fill one range
    order = [F.col("n_words") < least_words, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("spread")]
    return spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread").withColumn("at", F.monotonically_increasing_id())


def _drawn(dealt: DataFrame, percent: int, least_words: int) -> DataFrame:
    """rank of the highest scores: a row's place in its range after all rows of the ranges before."""
    spark = dealt.sparkSession
    dealt = dealt.withColumns({"range": F.shiftright("at", 33), "place": F.col("at").bitwiseAND((1 << 33) - 1) + 1}).drop("at")
    enough = F.col("n_words") >= least_words
    sizes = sorted(dealt.groupBy("range").agg(F.count(F.lit(1)), F.count(F.when(enough, 1))).collect())  # a row for each range
    before = [sum(r[1] for r in sizes[:i]) for i in range(len(sizes))]
    take = percent * sum(r[2] for r in sizes) // 100
    starts = spark.createDataFrame([(r[0], b) for r, b in zip(sizes, before, strict=True)], "range bigint, before bigint")
    rank = F.col("before") + F.col("place")
    ranked = dealt.join(F.broadcast(starts), "range").withColumn("rank", F.when(enough & (rank <= take), rank))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; rank is null for what is not drawn."""
    keep: list[DataFrame] = []
    with temporary_tables(keep):
        features = scratch(featurize(docs, buckets=buckets, longest=longest), "resampling-features", "zstd")
        aims = featurize(target, buckets=buckets, longest=longest, keep=())
        gain = gains(bucket_counts(features, buckets), bucket_counts(aims, buckets), buckets)
        scored = scratch(weigh(features, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resampling-scores")
        dealt = scratch(_ordered(scored, least_words), "resampling-order")
        keep.append(dealt)
    return _drawn(dealt, percent, least_words)
