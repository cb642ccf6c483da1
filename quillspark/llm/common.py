"""What the operators of this subpackage share: inputs, patterns, scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts is a run of characters other than these.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Broadcasting by hint is allowed up to this many bytes; above it joins shuffle.
BROADCAST_BYTES = 64 << 20
#: Whether Spark deletes the shuffle files of a query at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(tag: str) -> str:
    """A column name that no table of a user has."""
    return f"__{tag}_{uuid.uuid4().hex}"


def quoted(df: DataFrame) -> list[str]:
    """The columns of ``df`` as references, whatever characters their names have."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is what ``spark.checkpoint.dir`` names. Where that is unset, a local
    session gets a temporary folder; a cluster is refused, as its executors
    would not share one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(df: DataFrame, tag: str, compression: str = "snappy", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage (a lost executor costs no recomputation) and gives the
    planner the true size, so that small tables are broadcast by Spark itself. The shuffle
    files of the write go as soon as it is done; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quillspark/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression, partitionBy=list(partition_by) or None)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    for made in _OPEN:
        made.append(table)
    return table


_OPEN: list[list[DataFrame]] = []


@contextlib.contextmanager
def temporary_tables(keep: list[DataFrame]) -> Iterator[None]:
    """Tables that ``scratch`` writes inside are deleted at the end, but for those that have been put into ``keep``."""
    made: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN[:] = [x for x in _OPEN if x is not made]
    kept = {t.scratch_path for t in keep}
    discard(*(t for t in made if t.scratch_path not in kept))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``scratch`` wrote, once nothing that is still to run reads them."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit in ``limit`` bytes, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *forget: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving memory back to the system when a partition is done.

    Workers outlive their tasks; without this an idle one holds what its largest batch took.
    ``forget`` are functions of a module that empty its caches.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for f in forget:
            f()
        release()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of about ``limit`` bytes, so that few texts are Python objects at once."""
    for b in batches:
        step = max(1, b.num_rows * limit // max(b.nbytes, 1))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def with_starts(df: DataFrame, lengths: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of all lengths before each one of the array column ``lengths``.

    Sums run over chunks of about the square root of their number, then within each: a fold that
    appends to its result copies it each time, so no array built this way is longer than a chunk.
    """
    zero = F.lit(0).cast("bigint")
    n, step = F.size(lengths), F.greatest(F.ceil(F.sqrt(F.size(lengths))), F.lit(1)).cast("int")
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(1), n, step), lambda i: F.slice(lengths, i, step))).otherwise(F.array().cast("array<array<bigint>>"))
    df = df.withColumn("__cut", cut)
    add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    begin = lambda at: F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))
    totals = F.transform("__cut", lambda c: F.aggregate(c, zero, lambda a, x: a + x))
    offsets = F.aggregate(totals, begin(zero), add, lambda s: s["out"])
    return df.withColumn(out, F.flatten(F.zip_with("__cut", offsets, lambda c, at: F.aggregate(c, begin(at), add, lambda s: s["out"])))).drop("__cut")


_U = np.uint64


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = x + _U(salt)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Bytes hashed at once; words longer than LONG_WORD are hashed one by one.
HASH_BLOCK, LONG_WORD = 4 << 20, 256
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte, the same for A-Z and a-z.
_LETTER = mix(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(_U), 77)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64."""
    n = HASH_BLOCK + 1
    return tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(n - 1, b, _U), dtype=_U)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (and the last ends); null counts as empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)), at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts end to end, A-Z lower-cased, and the place of each text's first word (and of the end).

    A word's hash is a polynomial in its bytes, read off running sums over the whole batch,
    so there is no loop over words. Such sums are weak for crafted long words; these are
    hashed one by one.
    """
    data, at = flat_bytes(texts)
    inside = ~_BLANK[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, (power, inverse), k = np.empty(len(begin), _U), _powers(), 0
    while k < len(begin):
        upto = max(k + 1, int(np.searchsorted(end, begin[k] + HASH_BLOCK, side="right")))
        b, e = begin[k:upto] - begin[k], end[k:upto] - begin[k]
        if e[-1] <= HASH_BLOCK:
            sums = np.zeros(e[-1] + 1, _U)
            np.cumsum(_LETTER[data[begin[k] : end[upto - 1]]] * power[: e[-1]], out=sums[1:])
            out[k:upto] = mix((sums[e] - sums[b]) * inverse[b], 9) + (e - b).astype(_U)
        k = upto
    for i in np.flatnonzero(end - begin > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes().lower())
    return out, np.searchsorted(begin, at)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``keys`` (whole numbers) as tables that cut no group, with the starts of the groups (and the end)."""
    held: list[pa.RecordBatch] = []

    def changes(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        k = np.stack([t.column(c).to_numpy() if isinstance(t, pa.Table) else t.column(c).to_numpy(zero_copy_only=False) for c in keys], 1)
        return np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1

    def give(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        return t, np.concatenate([[0], changes(t), [t.num_rows]])

    for b in batches:
        if not b.num_rows:
            continue
        at = changes(b)
        new = bool(held) and any(held[-1].column(c)[-1] != b.column(c)[0] for c in keys)
        cut = int(at[-1]) if len(at) else 0
        if cut or new:
            yield give([*held, *([b.slice(0, cut)] if cut else [])])
            held = []
        held.append(b.slice(cut))
    if held:
        yield give(held)


class Forest:
    """Union-find over 0..n-1 that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, others: np.ndarray) -> None:
        """Join x with each of ``others``; one link for each tree that is new to x."""
        top = self.root(x)
        for y in others[np.unique(self.up[others], return_index=True)[1]].tolist():
            other = self.root(y)
            if other != top:
                self.links.append((x, y))
                low, high = min(top, other), max(top, other)
                self.up[high] = top = low

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            higher = up[up]
            if (higher == up).all():
                return up
            up = self.up = higher
