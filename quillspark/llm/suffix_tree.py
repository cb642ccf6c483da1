"""Language-model scoring with a probabilistic suffix tree over words.

A text is a start, its words and an end. The root is the add-one unigram distribution. A
context is the run of up to DEPTH symbols before a token; it is a candidate if it is
frequent enough, and is retained if its next-symbol distribution diverges from that of its longest
retained suffix by more than its parameters cost (minimum description length). A retained
context gives each frequent successor its count less DISCOUNT; what is left goes to the suffix's
distribution in proportion. Each token is scored in the longest retained suffix of what precedes it.

Words are 63-bit hashes, and a run of symbols is named by a hash built up from left to right, so no
table is needed to name the runs of a text. Runs are counted over the whole training corpus:
each task adds up the runs of a slice of text, cuts the sums into buckets and sends these as
packed arrays; a bucket's sums are added in one array. The number of buckets follows the
size of the text, so a bucket stays small at any size. Contexts and successors need the same
number of occurrences at every size, so the tree grows with the corpus. The tree is made by
joins and is a table of runs. Where it was counted to fit in MODEL_BYTES, it is
broadcast to the scoring tasks. Beyond that its most frequent words, contexts and runs are, and
only what the rest may have is joined with it, key by key: the logarithm of a token's
probability is a sum of that of the root, the back-off weight of each retained context, and the
lift of each run of the tree, and none of these depends on another. Both give the same scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import lean, mix, release, scratch, slices, small, temporary_tables, whole_groups, word_hashes

#: Symbols of the longest context.
DEPTH = 3
#: Occurrences that contexts and successors need.
LEAST_CONTEXT, LEAST_SUCCESSOR = 64, 4
DISCOUNT = 0.75
#: Bytes of text that are counted at once, and scored at once (with the tree beside them).
SLICE, SCORED = 3 << 20, 1 << 20
#: Bytes of text whose runs share a bucket.
BUCKET = 8 << 20
#: A tree of no more bytes is broadcast, as are the candidate contexts; of the words that can follow one, twice as many.
MODEL_BYTES = 48 << 20

_U = np.uint64
#: The symbols at both ends of a text; words have hashes of 63 bits.
START, END = -1, -2
_WORD = _U((1 << 63) - 1)
#: What tells keys of runs and of contexts from those of words, and from each other.
_RUN, _CONTEXT = 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D


def join_runs(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The name of a run and one more symbol."""
    return mix(left.view(_U) * _U(0x9E3779B97F4A7C15) + word.view(_U), 21).view(np.int64)


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; one without an id is not."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@dataclass
class Runs:
    """Texts end to end, each from its start to its end symbol."""

    symbols: np.ndarray
    place: np.ndarray
    #: Where each text's start stands, and the end of all.
    at: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Runs:
        words, first = word_hashes(texts)
        n = len(texts)
        at = first + 2 * np.arange(n + 1)
        symbols = np.empty(len(words) + 2 * n, np.int64)
        inner = np.ones(len(symbols), bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        symbols[inner] = (words & _WORD).view(np.int64)
        symbols[at[:-1]], symbols[at[1:] - 1] = START, END
        return cls(symbols, np.arange(len(symbols)) - np.repeat(at[:-1], np.diff(at)), at)

    def only(self, chosen: np.ndarray) -> Runs:
        """Some of the texts."""
        keep = np.repeat(chosen, np.diff(self.at))
        return Runs(self.symbols[keep], self.place[keep], np.concatenate([[0], np.cumsum(np.diff(self.at)[chosen])]))

    def names(self, length: int) -> np.ndarray:
        """Name of the run of ``length`` symbols that ends at each place; meaningless where ``place`` < length - 1."""
        name = self.symbols
        for _ in range(length - 1):
            name = join_runs(_earlier(name), self.symbols)
        return name


def _earlier(values: np.ndarray) -> np.ndarray:
    """What stands one place before."""
    return np.concatenate([values[:1], values[:-1]])


class Lookup:
    """Sorted hashes with values. Their leading bits say where to look, so a key takes a few steps; that index is made anew where it arrives."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        names = keys.view(_U)
        order = np.argsort(names, kind="stable")
        self.names, self.values, self.first = names[order], [v[order] for v in values], None
        self.shift = _U(64 - max(8, len(keys).bit_length() - 2))

    @property
    def keys(self) -> np.ndarray:
        return self.names.view(np.int64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"first": None}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it isn't there."""
        out = np.full(len(keys), -1)
        if not len(self.names):
            return out
        if self.first is None:
            heads = np.arange(1 << int(64 - self.shift), dtype=_U) << self.shift
            self.first = np.append(np.searchsorted(self.names, heads), len(self.names)).astype(np.int32)
            del heads
            release()
        asked = keys.view(_U) if keys.flags.c_contiguous else np.ascontiguousarray(keys).view(_U)
        head = (asked >> self.shift).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.names[at] == asked[left]
            out[left[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            left, at, end = left[more], at[more] + 1, end[more]
        return out

    def get(self, keys: np.ndarray, which: int, default: float) -> np.ndarray:
        at = self.find(keys)
        return np.where(at >= 0, self.values[which][at], default) if len(self.names) else np.full(len(keys), default)


def _counted(docs: DataFrame, buckets: int, runs_of: Callable[[Runs], tuple[np.ndarray, np.ndarray]], least: int, names: tuple[Callable, Callable] | None = None) -> DataFrame:
    """key, context, symbol, n: how often runs occur in the training texts, if at least ``least`` times.

    ``runs_of`` gives contexts and symbols of all runs to count; a run of one symbol has no context (an
    empty array) and is its own key. Both may be numbers that stand for names; then ``names`` turns
    each back, and they are sent as four bytes.
    """
    kind = np.int32 if names else np.int64

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            chosen = np.array([not held_out(i) for i in b.column("doc_id").to_pylist()], bool)
            runs = Runs.of(b.column("text"))
            context, symbol = runs_of(runs if chosen.all() else runs.only(chosen))
            alone = not len(context)
            if names:  # in order of contexts, whose differences are small and pack well
                pair, n = np.unique(context << 32 | symbol, return_counts=True)
                context, symbol = pair >> 32, pair & 0xFFFFFFFF
            else:
                _, first, n = np.unique(symbol if alone else join_runs(context, symbol), return_index=True, return_counts=True)
                context, symbol = (np.zeros(len(first), np.int64) if alone else context[first]), symbol[first]
            bucket = (mix((symbol * 8 + (context & 7)).view(_U), 31) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            dealt = bucket[order]
            begin = np.flatnonzero(np.diff(dealt, prepend=-1))  # however many buckets there are, only those met cost anything
            full = dealt[begin]
            parts = np.split(order, begin[1:]) if len(begin) else []
            step = lambda x: np.diff(x, prepend=0).astype(kind).tobytes()
            columns = [pa.array(full, pa.int64()), pa.array([step(context[o]) for o in parts], pa.binary()), pa.array([symbol[o].astype(kind).tobytes() for o in parts], pa.binary()), pa.array([n[o].astype(np.int32).tobytes() for o in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "context", "symbol", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ("bucket",)):
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                rows = {c: t.column(c).slice(lo, hi - lo).to_pylist() for c in ("context", "symbol", "n")}
                context = np.concatenate([np.cumsum(np.frombuffer(x, kind), dtype=np.int64) for x in rows["context"]])
                symbol, n = np.frombuffer(b"".join(rows["symbol"]), kind).astype(np.int64), np.frombuffer(b"".join(rows["n"]), np.int32)
                key = context << 32 | symbol if names else np.where(context == 0, symbol, join_runs(context, symbol))
                order = np.argsort(key, kind="stable")
                begin = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1 if len(order) else 0))
                total = np.add.reduceat(n[order].astype(np.int64), begin)
                kept = total >= least
                first = order[begin[kept]]
                context, symbol = context[first], symbol[first]
                if names:
                    context, symbol = names[0](context), names[1](symbol)
                key = np.where(context == 0, symbol, join_runs(context, symbol))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, context, symbol, total[kept])], ["key", "context", "symbol", "n"])

    sent = docs.select("doc_id", "text").mapInArrow(lean(send), "bucket bigint, context binary, symbol binary, n binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(add), "key bigint, context bigint, symbol bigint, n bigint")


def _arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of a table whose size was counted."""
    rows = df.select(*columns).toArrow()
    return [rows.column(c).to_numpy() for c in columns]


@dataclass
class Tree:
    """``words``: key, n of all training tokens. ``runs``: key, n, lift, mass, left of the tree's runs.

    A run that follows a retained context has its occurrences n, and as lift the logarithm of its probability over what
    its context would leave to the suffix; one that is a retained context its
    mass (occurrences before a token) and what of it is left to its suffix. A run can be both, and is null where it is not.
    """

    words: DataFrame
    runs: DataFrame
    total: int
    distinct: int
    depth: int

    def root(self, n: np.ndarray) -> np.ndarray:
        return (n + 1) / (self.total + self.distinct + 1)


def _chain(words: np.ndarray, length: int) -> np.ndarray:
    """Names of the last ``length`` symbols of each row but the last one, and that one."""
    name = words[:, -length].copy()
    for k in range(length - 1, 0, -1):
        name = join_runs(name, words[:, -k].copy())
    return name


def _with_suffixes(rows: DataFrame, depth: int) -> DataFrame:
    """``rows`` (words: the symbols of a run) with key, and r1, c1, ...: the run's last symbols, 2, 3, ... of them, and these without the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("words").flatten().to_numpy(zero_copy_only=False).reshape(-1, depth + 1)
            more = [pa.array(x) for d in range(1, depth) for x in (_chain(words, d + 1), _chain(words[:, :-1], d))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_chain(words, depth + 1)), *more], [*b.schema.names, "key", *(f"{c}{d}" for d in range(1, depth) for c in "rc")])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "key bigint", *(f"{c}{d} bigint" for d in range(1, depth) for c in "rc")])
    return rows.mapInArrow(run, schema)


def retained(runs: DataFrame, contexts: DataFrame, tree: Tree, frequent: DataFrame, depth: int) -> DataFrame:
    """The tree's rows of the ``runs`` (context, words, n) whose contexts (key, mass) pass the divergence test, and of these contexts."""
    masses = contexts.select(F.col("key").alias("__m"), "mass")
    seen = runs.groupBy("context").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("seen")).join(small(masses, 32), F.col("context") == F.col("__m")).drop("__m")
    seen = scratch(seen.withColumn("left", F.col("mass") - F.col("seen") + DISCOUNT * F.col("kinds")), f"seen-{depth}")
    rows = _with_suffixes(runs.join(small(seen.select("context", "mass", "left"), 48), "context").select("context", "mass", "left", "n", "words"), depth)
    p = (F.coalesce("__n", F.lit(0)) + 1) / F.lit(float(tree.total + tree.distinct + 1))
    rows = rows.withColumn("last", F.element_at("words", -1)).drop("words")
    rows = rows.join(small(frequent.select(F.col("key").alias("__k"), F.col("n").alias("__n")), 32), F.col("last") == F.col("__k"), "left").withColumn("p", p).drop("last", "__k", "__n")
    for d in range(1, depth):  # with all shallower contexts, as the longest retained suffix is the parent
        rows = _deeper(rows, tree, "p", f"r{d}", f"c{d}", hint=True).drop(f"r{d}", f"c{d}")
    rows = scratch(rows, f"shallower-{depth}")
    gain = F.sum(F.col("n") * F.log((F.col("n") - DISCOUNT + F.col("left") * F.col("p")) / (F.col("mass") * F.col("p"))))
    tested = seen.join(rows.groupBy("context").agg(gain.alias("gain")), "context")
    unseen = F.col("mass") - F.col("seen")
    whole = F.col("gain") + F.when(unseen > 0, unseen * F.log(F.col("left") / F.col("mass"))).otherwise(0.0)
    cost = 0.5 * math.log(max(tree.total, 2)) * F.col("kinds")
    good = scratch(tested.filter((whole > cost) & (F.col("left") > 0)).select("context", "left", "mass"), f"contexts-{depth}")
    lift = F.log10((F.col("n") - DISCOUNT + F.col("left") * F.col("p")) / (F.col("left") * F.col("p")))
    successors = rows.join(small(good.select("context"), 16), "context")
    as_run = successors.select("key", F.col("n").cast("long").alias("n"), lift.alias("lift"), F.lit(None).cast("double").alias("mass"), F.lit(None).cast("double").alias("left"))
    return as_run.unionByName(good.select(F.col("context").alias("key"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("lift"), F.col("mass").cast("double").alias("mass"), "left"))


def _deeper(rows: DataFrame, tree: Tree, p: str, run: str, context: str, hint: bool = False) -> DataFrame:
    """``rows`` with the probability in column ``p`` replaced where the run's context is retained."""
    told = small if hint else lambda df, _: df
    kept = tree.runs.filter("n is not null").select(F.col("key").alias("__r"), F.col("n").alias("__kept"))
    left = tree.runs.filter("mass is not null").select(F.col("key").alias("__c"), F.col("mass").alias("__mass"), F.col("left").alias("__left"))
    rows = rows.join(told(kept, 32), F.col(run) == F.col("__r"), "left").join(told(left, 32), F.col(context) == F.col("__c"), "left")
    deeper = (F.coalesce(F.col("__kept") - DISCOUNT, F.lit(0.0)) + F.col("__left") * F.col(p)) / F.col("__mass")
    return rows.withColumn(p, F.coalesce(deeper, p)).drop("__r", "__c", "__kept", "__mass", "__left")


def train(docs: DataFrame) -> Tree:
    """The tree of the training documents among ``docs``."""
    keep: list[DataFrame] = []
    with temporary_tables(keep):
        spark = docs.sparkSession
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
        buckets = 1 + size // BUCKET
        words = scratch(_counted(docs, buckets, lambda r: (np.empty(0, np.int64), r.symbols), 1).select("key", "n"), "unigrams")
        sums = words.filter(F.col("key") != START).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        tree = Tree(words, spark.createDataFrame([], "key bigint, n bigint, lift double, mass double, left double"), sums["n"], sums["v"], 0)

        # Of each frequent run: key, mass (how often a token follows) and words (its symbols). Nothing follows an end.
        contexts = words.filter((F.col("n") >= LEAST_CONTEXT) & (F.col("key") != END)).select("key", F.col("n").alias("mass"), F.array("key").alias("words"))
        # No other words can follow a context often enough.
        frequent = scratch(words.filter((F.col("n") >= LEAST_SUCCESSOR) & (F.col("key") != START)), "frequent-words")
        many = frequent.count()
        follow = spark.sparkContext.broadcast(Lookup(*_arrays(frequent, "key"))) if many * 8 <= 2 * MODEL_BYTES else None
        contexts = scratch(contexts, "candidates-1")
        for depth in range(1, DEPTH + 1):
            known = contexts.count()
            if not known:
                break
            shared = names = None
            if follow is not None and known * 8 <= MODEL_BYTES:  # other runs need not be sent, and these have numbers
                shared = spark.sparkContext.broadcast(Lookup(*_arrays(contexts, "key")))
                names = (lambda x, t=shared: t.value.keys[x], lambda x, t=follow: t.value.keys[x])

            def runs_of(r: Runs, depth: int = depth, shared=shared, follow=follow) -> tuple[np.ndarray, np.ndarray]:
                at = np.flatnonzero(r.place >= depth)
                context, symbol = r.names(depth)[at - 1], r.symbols[at]
                if shared is None:
                    return context, symbol
                context = shared.value.find(context)
                at = np.flatnonzero(context >= 0)
                symbol = follow.value.find(symbol[at])
                return context[at][symbol >= 0], symbol[symbol >= 0]

            found = _counted(docs, buckets, runs_of, LEAST_SUCCESSOR, names)
            joined = found.join(small(contexts.select(F.col("key").alias("context"), "words"), 16 + 16 * depth), "context")
            joined = scratch(joined.select("context", F.concat("words", F.array("symbol")).alias("words"), "n"), f"runs-{depth}")
            if shared is not None:
                shared.unpersist()
            more = scratch(retained(joined, contexts, tree, frequent, depth), f"retained-{depth}")
            last = tree
            tree = Tree(words, scratch(last.runs.unionByName(more).groupBy("key").agg(F.max("n").alias("n"), F.max("lift").alias("lift"), F.max("mass").alias("mass"), F.max("left").alias("left")), f"tree-{depth}"), last.total, last.distinct, depth)
            deeper = joined.filter((F.col("n") >= LEAST_CONTEXT) & (F.element_at("words", -1) != END))
            contexts = scratch(_with_suffixes(deeper.select("words", F.col("n").alias("mass")), depth).select("key", "mass", "words"), f"candidates-{depth + 1}")
        if follow is not None:
            follow.unpersist()
        keep += [words, *([tree.runs] if tree.depth else [])]
    return tree


def _most_frequent(table: DataFrame, often: str = "n") -> tuple[DataFrame, int]:
    """The rows of ``table`` with at least some number of occurrences, and that number: as many as fit in a third of MODEL_BYTES."""
    counted = table.groupBy(F.least(F.floor(F.log2(often)), F.lit(62)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("rows")).collect()
    rows = {r["k"]: r["rows"] for r in counted}
    k, held = 63, 0
    while k > 0 and (held + rows.get(k - 1, 0)) * 16 <= MODEL_BYTES // 3:
        k -= 1
        held += rows.get(k, 0)
    return table.filter(F.col(often) >= (1 << k)), 1 << k


def score(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and score all (doc_id, text; other columns are not read).

    Returns for each row of ``docs``: doc_id, held_out, n_tokens (words and the end), n_known (seen in
    training), train_tokens, base_score (add-one unigram) and score (suffix tree), both
    log10 of the probability of the text. A null or empty text is its end alone; rows
    without a doc_id are trained on; repeated rows count each; an empty table gives an empty result.
    """
    return score_with(docs, train(docs))


def score_with(docs: DataFrame, tree: Tree) -> DataFrame:
    """``score`` with a tree that is there."""
    spark = docs.sparkSession
    often, floor = _most_frequent(tree.words)
    successors, states = tree.runs.filter("n is not null"), tree.runs.filter("mass is not null")
    if floor > LEAST_SUCCESSOR or successors.count() * 12 + states.count() * 24 > MODEL_BYTES:
        return _score_by_join(docs, tree)
    shared = spark.sparkContext.broadcast((Lookup(*_arrays(often, "key", "n")), Lookup(*_arrays(successors.select("key", F.col("n").cast("int").alias("n")), "key", "n")), Lookup(*_arrays(states, "key", "mass", "left"))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    total, distinct, depth = tree.total, tree.distinct, tree.depth
    every = total + distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, successors, states = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches, SCORED):
            ids = b.column("doc_id").to_pylist()
            r = Runs.of(b.column("text"))
            n = words.get(r.symbols, 0, 0)
            token, at = r.place > 0, r.at[:-1]
            rare = token & (n == 0)
            p = (n + 1) / every
            gain = p.copy()
            name = r.symbols
            for d in range(1, depth + 1):
                at_d = np.flatnonzero(r.place >= d)
                state = states.find(name[at_d - 1])
                name = join_runs(_earlier(name), r.symbols)
                at_d, state = at_d[state >= 0], state[state >= 0]
                kept = np.maximum(successors.get(name[at_d], 0, 0) - DISCOUNT, 0.0)
                gain[at_d] = (kept + states.values[1][state] * gain[at_d]) / states.values[0][state] if len(state) else 0.0
            base = np.where(token, np.log10(p), 0.0)
            best = np.where(token, np.log10(gain), 0.0)
            n_rare = np.add.reduceat(rare.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(n_rare)])
            sums = lambda v, at=at: np.add.reduceat(v, at) if len(at) else np.empty(0)
            length = np.diff(r.at) - 1
            columns = [
                pa.array(np.arange(row, row + len(ids))),
                b.column("doc_id"),
                pa.array([held_out(i) for i in ids], pa.bool_()),
                pa.array(length, pa.int64()),
                pa.array(length - n_rare, pa.int64()),
                pa.array(sums(base), pa.float64()),
                pa.array(sums(best), pa.float64()),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(r.symbols[rare])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "tree", "rare"])
            row += len(ids)

    out = f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, tree double, rare array<bigint>"
    scored = scratch(docs.select("doc_id", "text").mapInArrow(lean(run), out), "suffix-scores")
    if floor > 1:
        rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
        rare = rare.join(tree.words.filter(F.col("n") < floor), "key")
        # These have fewer occurrences than a successor needs, so their probability in the tree is in proportion to that at the root.
        rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log_p"), F.sum("times").alias("known"))
        scored = scored.drop("rare").join(rare, "row", "left")
    else:
        scored = scored.withColumns({"log_p": F.lit(0.0), "known": F.lit(0)})
    log_p = F.coalesce("log_p", F.lit(0.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + log_p).alias("base_score"),
        (F.col("tree") + log_p).alias("score"),
    )


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of each key in a filter of ``bits`` bits, a power of two."""
    return [mix(keys.view(_U), salt) & _U(bits - 1) for salt in (61, 62)]


def _filter_of(keys: DataFrame) -> np.ndarray:
    """Which places of a filter the ``keys`` (key) take, as the bits of whole numbers; it has 8 bits a key or more, up to two thirds of MODEL_BYTES."""
    bits = 64
    n = keys.count()
    while bits < 8 * n and bits * 2 <= MODEL_BYTES * 8 * 2 // 3:
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = np.concatenate(_places(b.column("key").to_numpy(), bits))
            place.sort()
            slot = (place >> _U(6)).astype(np.int64)
            begin = np.flatnonzero(np.diff(slot, prepend=-1))
            value = np.bitwise_or.reduceat(_U(1) << (place & _U(63)), begin) if len(begin) else np.empty(0, _U)
            yield pa.RecordBatch.from_arrays([pa.array(slot[begin]), pa.array(value.view(np.int64))], ["slot", "value"])

    slots = scratch(keys.mapInArrow(lean(run), "slot bigint, value bigint").groupBy("slot").agg(F.bit_or("value").alias("value")), "suffix-filter")
    slot, value = _arrays(slots, "slot", "value")
    out = np.zeros(bits // 64, np.int64)
    out[slot] = value
    return out


def _may_have(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys a filter may have been made of."""
    values = bitmap.view(_U)
    one, two = _places(keys, len(values) * 64)
    return ((values[one >> _U(6)] >> (one & _U(63))) & (values[two >> _U(6)] >> (two & _U(63))) & _U(1)).astype(bool)


def _score_by_join(docs: DataFrame, tree: Tree) -> DataFrame:
    """``score_with`` for trees of any size: what the most frequent words, contexts and runs do not tell is joined with the tree.

    Keys that no rare run or context can have, by a filter of their bits, are not asked for.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    depth, total, every = tree.depth, tree.total, tree.total + tree.distinct + 1
    states = tree.runs.filter("mass is not null").select("key", F.col("mass").alias("n"), F.log10(F.col("left") / F.col("mass")).alias("value"))
    runs = tree.runs.filter("n is not null").select("key", "n", F.col("lift").alias("value"))
    often, least_word = _most_frequent(tree.words)
    often_states, least_state = _most_frequent(states)
    often_runs, least_run = _most_frequent(runs)
    told = lambda t, least, sign: t.filter(F.col("n") < least).select(F.col("key").bitwiseXOR(F.lit(sign)).alias("key"), F.lit(0.0).alias("base"), "value", F.lit(0).alias("known"))
    hidden = told(runs, least_run, _RUN).unionByName(told(states, least_state, _CONTEXT))
    root = F.log10(F.col("n") + 1)
    rest = hidden.unionByName(tree.words.filter(F.col("n") < least_word).select("key", root.alias("base"), root.alias("value"), F.lit(1).alias("known")))
    shared = spark.sparkContext.broadcast((Lookup(*_arrays(often, "key", "n")), Lookup(*_arrays(often_states, "key", "value")), Lookup(*_arrays(often_runs, "key", "value")), _filter_of(hidden)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, states, runs, bitmap = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches, SCORED):
            ids = b.column("doc_id").to_pylist()
            r = Runs.of(b.column("text"))
            n = words.get(r.symbols, 0, 0)
            token = r.place > 0
            rare = token & (n == 0)
            base = np.where(token, np.log10((n + 1) / every), 0.0)
            best, name = base.copy(), r.symbols
            asked_at, asked = [np.flatnonzero(rare)], [r.symbols[rare]]
            for d in range(1, depth + 1):
                at = np.flatnonzero(r.place >= d)
                context, name = name[at - 1], join_runs(_earlier(name), r.symbols)
                state = states.find(context)
                best[at[state >= 0]] += states.values[0][state[state >= 0]]
                sign = context ^ np.int64(_CONTEXT)
                ask = (state < 0) & _may_have(bitmap, sign)
                asked_at.append(at[ask])
                asked.append(sign[ask])
                at = at[(state >= 0) | ask]  # the others have no retained context, so no run of the tree
                found = runs.find(name[at])
                best[at[found >= 0]] += runs.values[0][found[found >= 0]]
                at = at[found < 0]
                sign = name[at] ^ np.int64(_RUN)
                ask = _may_have(bitmap, sign)
                asked_at.append(at[ask])
                asked.append(sign[ask])
            place, keys = np.concatenate(asked_at), np.concatenate(asked)
            order = np.argsort(place, kind="stable")
            offsets = np.searchsorted(place[order], r.at).astype(np.int32)
            sums = lambda v, at=r.at[:-1]: np.add.reduceat(v, at) if len(at) else np.empty(0, v.dtype)
            length = np.diff(r.at) - 1
            columns = [
                pa.array(np.arange(row, row + len(ids))),
                b.column("doc_id"),
                pa.array([held_out(i) for i in ids], pa.bool_()),
                pa.array(length, pa.int64()),
                pa.array(length - sums(rare.astype(np.int64)), pa.int64()),
                pa.array(sums(base), pa.float64()),
                pa.array(sums(best), pa.float64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[order])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "tree", "asked"])
            row += len(ids)

    out = f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, tree double, asked array<bigint>"
    scored = scratch(docs.select("doc_id", "text").mapInArrow(lean(run), out), "suffix-scores")
    more = scored.select("row", F.explode("asked").alias("key")).join(rest, "key").groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("value").alias("more"), F.sum("known").alias("known"))
    more = scratch(more, "suffix-rest")
    none = F.lit(0.0)
    return (
        scored.drop("asked")
        .join(more, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", none)).alias("base_score"),
            (F.col("tree") + F.coalesce("more", none)).alias("score"),
        )
    )
