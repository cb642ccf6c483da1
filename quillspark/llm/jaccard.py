"""N-gram Jaccard join by count-vector R-trees, exact, with its connected groups.

A document is the set of its distinct shingles (runs of some words). Documents with
equal sets form a class; classes are joined.

Two sets of sizes s and t with Jaccard j or more differ in at most (s+t)(1-j)/(1+j)
shingles, at 0.9 a 19th. Shingles are hashed into one group more than that (and some spare), so two
linked sets hold exactly the same shingles in some group: the content of a group, hashed,
is a block of the index, and linked classes meet in a block whatever their other words
are. A passage that many documents share seldom makes a block, as a group mixes shingles
of the whole text.

In each block an R-tree indexes the classes as points: the counts of their shingles in
DIMENSIONS or more further hash groups, more for larger sets (trees see them folded to fewer). The sum of coordinate minima of a point and the upper
corner of a box bounds the overlap with all points below, and of two points with each
other. Pairs that the bound lets through are joined by union-find, and a block gives a
spanning forest of them: never more rows than members. The components of all forests
(bundles) are closed under all links.

Each bundle's sets are then brought together once, whatever the number of blocks they
met in; there an R-tree proposes pairs, each is verified on the sets, and only counts and
components leave the task. Bundles of more than BUNDLE shingles are dealt over many
tasks: see ``_large_bundles``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Forest, discard, fresh, lean, mix, quoted, scratch, slices, small, temporary_tables, whole_groups, word_hashes
from quillspark.llm.graph import components

@dataclass(frozen=True)
class Rule:
    """What a link is: sets of shingles of ``size`` words with a Jaccard of ``percent`` or more."""

    size: int
    percent: int

    @property
    def numerator(self) -> int:
        """Links hold denominator * overlap >= numerator * (s + t)."""
        return self.percent

    @property
    def denominator(self) -> int:
        return 100 + self.percent


#: Of the query op4_jaccard_join.
CONTRACT = Rule(3, 90)
#: Least dimensions of a point, and shingles for each beyond: of what a tree searches, and of the points that its pairs must pass.
DIMENSIONS, TREE_SHINGLES, POINT_SHINGLES = 64, 20, 5
#: Size classes grow by half; a pair meets in the class of its larger set.
EDGES = [1]
while EDGES[-1] < 1 << 40:
    EDGES.append(max(EDGES[-1] + 1, EDGES[-1] * 3 // 2))
_EDGES = np.array(EDGES)
#: Members of a block that one task compares at once.
PART = 1024
#: Blocks of a class that are tried first.
FIRST_BLOCKS = 2
#: Shingles in the sets of a bundle that one task verifies.
BUNDLE = 1 << 20
#: The blocks of all sets move in so many parts, one after the other, as together they are near twice the input.
BLOCK_PARTS = 4
LEAF, FANOUT = 32, 16

_U = np.uint64


def text_shingles(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text, sorted distinct 64-bit hashes of its shingles; of its whole word sequence if that is shorter."""
    h, at = word_hashes(texts)
    flat = np.full(max(len(h) - size + 1, 0), size, _U)
    for i in range(size):
        flat = mix(flat * _U(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i], 1)
    out = []
    for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - b >= size:
            out.append(np.unique(flat[b : e - size + 1]))
            continue
        whole = np.full(int(e > b), e - b, _U)
        for i in range(b, e):
            whole = mix(whole * _U(0x9E3779B97F4A7C15) + h[i], 1)
        out.append(whole)
    return out


def shingles(text: str | None, size: int = CONTRACT.size) -> np.ndarray:
    return text_shingles(pa.array([text], pa.string()), size)[0]


def _max_difference(top: int, rule: Rule) -> int:
    return 2 * top * (rule.denominator - 2 * rule.numerator) // rule.denominator


def spare(differences: int) -> int:
    """Groups more than ``differences`` can spoil; a set with no more empty groups than this skips them."""
    return 2 + differences // 8


def signatures(s: np.ndarray, rule: Rule = CONTRACT) -> np.ndarray:
    """Block keys of a set: for its size class, and for the next if a larger partner may be there."""
    n, out = len(s), []
    if not n:
        return np.empty(0, np.int64)
    largest = n * (rule.denominator - rule.numerator) // rule.numerator
    own, top = np.searchsorted(_EDGES, [n, largest], side="right")
    place, value = mix(s, 2), mix(s, 3)
    for level in range(own, top + 1):
        k = _max_difference(EDGES[level] - 1, rule)
        if not k:
            continue
        groups = k + 1 + spare(k)
        g = place % _U(groups)
        content = np.zeros(groups, _U)
        np.add.at(content, g, value)
        held = np.bincount(g.astype(np.int64), minlength=groups) > 0
        ids = np.arange(groups, dtype=_U)
        if groups - held.sum() <= spare(k):
            ids, content = ids[held], content[held]
        out.append(mix(content * _U(3) + mix(ids + _U(level << 32), 4), 5))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def width(n: int, shingles: int = POINT_SHINGLES) -> int:
    """Dimensions of the point of a set of ``n``.

    With 20 shingles in a dimension sets with nothing in common come to 0.87 of their size, beside the 0.89 of a Jaccard of
    0.8, and enough of them pass by chance to chain a corpus into one bundle; with 5 they come to 0.75, six deviations below.
    """
    return max(DIMENSIONS, 1 << max(-(-n // shingles) - 1, 0).bit_length())


def folded(points: np.ndarray, dimensions: int) -> np.ndarray:
    """``points`` of many dimensions as such of ``dimensions``, a part of them."""
    return points.reshape(len(points), -1, dimensions).sum(1, dtype=np.int32) if points.shape[1] > dimensions else points


def counts(s: np.ndarray, dimensions: int | None = None) -> np.ndarray:
    """The point of a set: how many of its shingles fall into each dimension (at most 255 counted). Halves of a point add up to the point of half the width."""
    dimensions = dimensions or width(len(s))
    n = np.bincount((mix(s, 6) % _U(dimensions)).astype(np.int64), minlength=dimensions)
    return np.minimum(n, 255).astype(np.uint8)


class Points:
    """The points of many rows, of several widths, given out at the least width of those asked for."""

    def __init__(self, column: list[bytes]):
        self.widths = np.array([len(x) for x in column], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.widths)])[:-1]
        self.flat = np.frombuffer(b"".join(column), np.uint8)

    def take(self, rows: np.ndarray, dimensions: int) -> np.ndarray:
        """Points of ``rows``, none narrower than ``dimensions``."""
        out = np.empty((len(rows), dimensions), np.int32)
        for w in np.unique(self.widths[rows]).tolist():
            which = np.flatnonzero(self.widths[rows] == w)
            p = self.flat[self.begins[rows[which]][:, None] + np.arange(w)]
            out[which] = folded(p, dimensions)
        return out


def _names(s: np.ndarray) -> tuple[int, int]:
    """Two hashes that name a set."""
    return int(mix(s, 7).sum(dtype=_U).view(np.int64)), int(mix(s, 8).sum(dtype=_U).view(np.int64))


def features(docs: DataFrame, rule: Rule) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, th (hash of the text), n (set size), k1 and k2 (hashes of the set), point, blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = text_shingles(b.column("text"), rule.size)
            names = [_names(s) for s in sets]
            keys = [signatures(s, rule) for s in sets]
            at = np.cumsum([0, *map(len, keys)])
            blocks = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            columns = [b.column("doc_id"), b.column("th"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)), pa.array([counts(s).tobytes() for s in sets], pa.binary()), blocks]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n", "k1", "k2", "point", "blocks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, th bigint, n bigint, k1 bigint, k2 bigint, point binary, blocks array<bigint>")


class RTree:
    """Bulk-loaded R-tree over count vectors with set sizes; boxes keep upper corners and size ranges."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rest: np.ndarray, rule: Rule = CONTRACT):
        self.rule = rule
        self.points, self.sizes, self.rest = points, sizes, rest
        order = np.argsort(sizes, kind="stable")
        runs = [order]
        while len(runs[0]) > LEAF * FANOUT:  # tile by the widest dimension in turn
            runs = [part for run in runs for part in self._halves(run)]
        leaves = [run[i : i + LEAF] for run in runs for i in range(0, len(run), LEAF)]
        self.leaves = leaves
        self.levels = [self._boxes([points[x].max(0) for x in leaves], [sizes[x].min() for x in leaves], [sizes[x].max() for x in leaves], [rest[x].max() for x in leaves])]
        while len(self.levels[-1][0]) > FANOUT:
            top, lo, hi, rest_hi = self.levels[-1]
            cut = [slice(i, i + FANOUT) for i in range(0, len(lo), FANOUT)]
            self.levels.append(self._boxes([top[c].max(0) for c in cut], [lo[c].min() for c in cut], [hi[c].max() for c in cut], [rest_hi[c].max() for c in cut]))

    def _halves(self, run: np.ndarray) -> list[np.ndarray]:
        p = self.points[run]
        run = run[np.argsort(p[:, int(np.argmax(p.max(0) - p.min(0)))], kind="stable")]
        return [run[: len(run) // 2], run[len(run) // 2 :]]

    @staticmethod
    def _boxes(*columns: list) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c) for c in columns)

    def search(self, point: np.ndarray, size: int, rest: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices whose overlap with the point may be enough, and the bounds of these overlaps."""
        num, den = self.rule.numerator, self.rule.denominator
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, lo, hi, rest_hi = (x[nodes] for x in self.levels[depth])
            bound = np.minimum(top, point).sum(1, dtype=np.int64) + np.minimum(rest_hi, rest)
            smallest = np.maximum(lo, -(-size * num // (den - num)))
            nodes = nodes[(den * bound >= num * (size + smallest)) & (lo * num <= size * (den - num)) & (hi * (den - num) >= size * num)]
            if depth:
                below = len(self.levels[depth - 1][0])
                nodes = np.concatenate([np.arange(x * FANOUT, min(below, (x + 1) * FANOUT)) for x in nodes]) if len(nodes) else nodes
        if not len(nodes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.concatenate([self.leaves[x] for x in nodes])
        bound = np.minimum(self.points[at], point).sum(1, dtype=np.int64) + np.minimum(self.rest[at], rest)
        ok = den * bound >= num * (size + self.sizes[at])
        return at[ok], bound[ok]


def block_forest(grp: np.ndarray, sizes: np.ndarray, points: np.ndarray, rule: Rule, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of places that join all members of a block whose bounds allow a link; members of one ``grp`` are joined already.

    With ``side`` only pairs of different sides are tried.
    """
    n = len(grp)
    rest = sizes - points.sum(1, dtype=np.int64)
    few = folded(points, min(points.shape[1], width(int(sizes.min()), TREE_SHINGLES)))
    tree, forest = RTree(few, sizes, rest, rule), Forest(n)
    first = np.unique(grp, return_index=True, return_inverse=True)[1:]
    forest.up = first[0][first[1]]
    for x in range(n):
        if (forest.up == forest.up[0]).all():
            break
        at, _ = tree.search(few[x], int(sizes[x]), int(rest[x]))
        at = at[forest.up[at] != forest.up[x]]
        if side is not None:
            at = at[side[at] != side[x]]
        if few is not points and len(at):
            bound = np.minimum(points[at], points[x]).sum(1, dtype=np.int64) + np.minimum(rest[at], rest[x])
            at = at[rule.denominator * bound >= rule.numerator * (sizes[x] + sizes[at])]
        if len(at):
            forest.join(x, at)
    return forest.links


def _forests(members: DataFrame, keys: tuple[str, ...], rule: Rule) -> DataFrame:
    """Edges a, b of the forests of all groups of ``members``: keys, k1, grp, n, point, and side where keys are part pairs."""
    sided = "side" in members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, keys):
            k1, grp, n = (t.column(c).to_numpy() for c in ("k1", "grp", "n"))
            side = t.column("side").to_numpy() if sided else None
            points = Points(t.column("point").to_pylist())
            found: set[tuple[int, int]] = set()
            size = np.diff(starts)
            twos = starts[:-1][size == 2]
            common = np.minimum(points.widths[twos], points.widths[twos + 1])
            for w in np.unique(common).tolist():  # most blocks are pairs: one bound
                p = twos[common == w]
                for some in np.array_split(p, 1 + len(p) * w // (1 << 20)):
                    q, a, b = some + 1, points.take(some, w), points.take(some + 1, w)
                    bound = np.minimum(a, b).sum(1, dtype=np.int64) + np.minimum(n[some] - a.sum(1), n[q] - b.sum(1))
                    ok = (rule.denominator * bound >= rule.numerator * (n[some] + n[q])) & (grp[some] != grp[q])
                    ok &= True if side is None else side[some] != side[q]
                    found.update(zip(k1[some[ok]].tolist(), k1[q[ok]].tolist(), strict=True))
            for b, e in zip(starts[:-1][size > 2].tolist(), starts[1:][size > 2].tolist(), strict=True):
                rows = np.arange(b, e)
                links = block_forest(grp[b:e], n[b:e], points.take(rows, int(points.widths[rows].min())), rule, None if side is None else side[b:e])
                found.update((int(k1[b + x]), int(k1[b + y])) for x, y in links)
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "a bigint, b bigint")


def _grouped(members: DataFrame, edges: DataFrame, tag: str) -> DataFrame:
    """``members`` of the blocks that still hold several components of ``edges``, with grp."""
    groups = scratch(components(edges), f"{tag}-groups").select(F.col("node").alias("k1"), F.col("component").alias("grp"))
    members = members.drop("grp").join(small(groups, 32), "k1", "left").withColumn("grp", F.coalesce("grp", "k1"))
    members = scratch(members, f"{tag}-members")
    mixed = members.groupBy("block").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo <> hi")
    mixed = scratch(mixed.select("block", F.ceil(F.col("rows") / PART).cast("int").alias("parts")), f"{tag}-mixed")
    return scratch(members.join(small(mixed, 32), "block"), f"{tag}-mixed-members")


def _in_parts(members: DataFrame, tag: str) -> DataFrame:
    """``members`` with part: blocks of more than PART members are cut by a hash."""
    sizes = members.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).filter("parts > 1")
    cut = members.drop("parts").join(small(scratch(sizes, f"{tag}-large-blocks"), 32), "block", "left")
    return cut.withColumn("part", F.pmod(F.xxhash64("k1"), F.coalesce("parts", F.lit(1))).cast("int"))


def bundles(members: DataFrame, rule: Rule) -> DataFrame:
    """k1, bundle: the components of all pairs that share a block and pass its bound. ``members``: block, k1, n, point.

    The least blocks of each class come first (near copies have most blocks in common, and so
    these); then the blocks that still hold several components. Of blocks with more than
    PART members, first the parts are searched each for itself, then one member of each
    component, and what is still apart by pairs of parts.
    """
    ranked = members.groupBy("k1").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    first = members.join(ranked, "k1").filter("block = lo or block = hi").drop("lo", "hi").withColumn("grp", F.col("k1"))
    edges = scratch(_forests(_in_parts(first, "first"), ("block", "part"), rule), "edges-1")
    rest = _grouped(members, edges, "first")

    large = rest.filter("parts > 1")
    if not large.isEmpty():
        one = large.groupBy("block", "grp", "parts").agg(F.min("k1").alias("k1")).join(large.select("block", "k1", "n", "point"), ["block", "k1"])
        edges = scratch(edges.unionByName(_forests(_in_parts(one, "second"), ("block", "part"), rule)), "edges-2")
        rest = _grouped(members, edges, "second")
        large = rest.filter("parts > 1").withColumn("mine", F.pmod(F.xxhash64("k1"), F.col("parts")).cast("int"))
        cut = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cut = cut.select("block", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "k1", "grp", "n", "point")
        within = cut.filter("i = j").drop("side")
        across = _forests(cut.filter("i <> j"), ("block", "i", "j"), rule).unionByName(_forests(within, ("block", "i"), rule))
        edges = edges.unionByName(across)
    edges = scratch(edges.unionByName(_forests(rest.filter("parts = 1"), ("block",), rule)), "edges-3")
    return components(edges).select(F.col("node").alias("k1"), F.col("component").alias("bundle"))


def set_links(sets: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """For each of some different sets, how many others it links to, and the place of one in its component."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, local = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    points = np.stack([counts(s, width(int(sizes.min()), TREE_SHINGLES)) for s in sets])
    rest = sizes - points.sum(1, dtype=np.int64)
    tree, forest = RTree(points, sizes, rest, rule), Forest(m)
    links, marked = np.zeros(m, np.int64), np.zeros(len(flat) + 1, bool)
    mine = [local[at[x] : at[x + 1]] for x in range(m)]
    for x in range(m):
        near, _ = tree.search(points[x], int(sizes[x]), int(rest[x]))
        near = near[near > x]
        if not len(near):
            continue
        marked[mine[x]] = True
        for k in range(0, len(near), PART):
            some = near[k : k + PART]
            hits = marked[np.concatenate([mine[y] for y in some.tolist()])]
            common = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), dtype=np.int64)
            linked = some[rule.denominator * common >= rule.numerator * (sizes[x] + sizes[some])]
            links[linked] += 1
            links[x] += len(linked)
            if len(linked):
                forest.join(x, linked)
        marked[mine[x]] = False
    return links, forest.roots()


_LABELS = "k1 bigint, k2 bigint, component_id bigint, n_links bigint"


def _in_one_task(members: DataFrame, rule: Rule) -> DataFrame:
    """Labels of the classes of bundles that fit a task: bundle, k1, k2, class_id, s (a row for each class, or repeats of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ("bundle",)):
            k1, k2 = (t.column(c).to_numpy() for c in ("k1", "k2"))
            own = t.column("class_id").to_pylist()
            values = t.column("s").combine_chunks() if isinstance(t.column("s"), pa.ChunkedArray) else t.column("s")
            at, flat = values.offsets.to_numpy(), values.values.to_numpy().view(_U)
            out: list[tuple] = []
            for b, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                rows = [r for r in range(b, e) if r == b or k1[r] != k1[r - 1] or k2[r] != k2[r - 1]]
                links, roots = set_links([flat[at[r] : at[r + 1]] for r in rows], rule)
                least: dict[int, int | None] = {}
                for r, root in zip(rows, roots.tolist(), strict=True):
                    ids = [x for x in (least.get(root), own[r]) if x is not None]
                    least[root] = min(ids) if ids else None
                out += [(int(k1[r]), int(k2[r]), least[root], n) for r, root, n in zip(rows, roots.tolist(), links.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["k1", "k2", "component_id", "n_links"])

    return members.repartition("bundle").sortWithinPartitions("bundle", "k1", "k2").mapInArrow(lean(run), _LABELS)


def _large_bundles(members: DataFrame, rule: Rule) -> DataFrame:
    """Labels of the classes of bundles beyond BUNDLE, over many tasks.

    With a = denominator and b = denominator - 2 * numerator, sets x and y link if
    a * |x ^ y| <= b * (|x| + |y|). A bundle's centre holds the shingles of more than half of
    its sets, and x has the weight a * |x ^ centre| - b * |x|. If the weights of two add up to no
    more than 0, they link for certain: so all sets of weight 0 or less (the near ones) link
    with each other, and are counted without being compared. Far sets are compared with all
    others, by parts of PART, on their differences from the centre, which give |x ^ y|
    exactly. A bundle of copies of one text has few far sets.
    """
    a, b = rule.denominator, rule.denominator - 2 * rule.numerator
    members = scratch(members.groupBy("bundle", "k1", "k2", "class_id").agg(F.first("s").alias("s")), "large-sets")
    sized = members.groupBy("bundle").agg(F.count(F.lit(1)).alias("m"))
    common = members.select("bundle", F.explode("s").alias("v")).groupBy("bundle", "v").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(scratch(sized, "large-sizes")), "bundle").filter("2 * c > m")
    centres = scratch(common.groupBy("bundle").agg(F.sort_array(F.collect_list("v")).alias("centre")), "large-centres")
    placed = members.join(small(centres, 1 << 20), "bundle", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<bigint>")))
    apart = F.array_union(F.array_except("s", "centre"), F.array_except("centre", "s"))
    placed = placed.select("bundle", "k1", "k2", "class_id", F.size("s").cast("bigint").alias("n"), apart.alias("d"))
    placed = placed.withColumn("near", a * F.size("d") - b * F.col("n") <= 0)
    placed = scratch(placed, "large-differences")
    parts = placed.groupBy("bundle").agg(F.count_if("near").alias("nears"), F.count_if(~F.col("near")).alias("fars"), F.min(F.when(F.col("near"), F.col("k1"))).alias("head"))
    parts = F.broadcast(scratch(parts.withColumns({"p_near": F.ceil(F.col("nears") / PART).cast("int"), "p_far": F.ceil(F.col("fars") / PART).cast("int")}), "large-parts"))
    rows = placed.join(parts, "bundle")
    upto = lambda p: F.explode(F.when(F.col(p) > 0, F.sequence(F.lit(0), F.col(p) - 1)))
    mine = lambda p: F.pmod(F.xxhash64("k1", "k2"), F.greatest(F.col(p), F.lit(1))).cast("int")
    cells = ("bundle", "kind", "i", "j")
    columns = (*cells, "side", "k1", "k2", "n", "d")
    far = rows.filter("not near").withColumn("mine", mine("p_far"))
    among = far.withColumn("other", upto("p_far")).select("bundle", F.lit(0).alias("kind"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), *columns[5:])
    to_near = far.withColumn("other", upto("p_near")).select("bundle", F.lit(1).alias("kind"), F.col("mine").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), *columns[5:])
    near = rows.filter("near").withColumn("mine", mine("p_near")).withColumn("other", upto("p_far"))
    near = near.select("bundle", F.lit(1).alias("kind"), F.col("other").alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side"), *columns[5:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, cells):
            kind, i, j, side, k1, k2, n = (t.column(c).to_numpy() for c in ("kind", "i", "j", "side", "k1", "k2", "n"))
            values = t.column("d").combine_chunks() if isinstance(t.column("d"), pa.ChunkedArray) else t.column("d")
            at, flat = values.offsets.to_numpy(), values.values.to_numpy()
            out: list[np.ndarray] = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                names, local = np.unique(flat[at[lo] : at[hi]], return_inverse=True)
                d = np.diff(at[lo : hi + 1])
                own, size, s = local.reshape(-1), n[lo:hi], side[lo:hi]
                begin = at[lo:hi] - at[lo]
                whole = bool(kind[lo] == 0 and i[lo] == j[lo])
                marked, forest, links = np.zeros(len(names) + 1, bool), Forest(hi - lo), np.zeros(hi - lo, np.int64)
                hits_of = np.repeat(np.arange(hi - lo), d)
                for x in range(hi - lo):
                    others = np.arange(hi - lo) > x if whole else (s != s[x]) & (s[x] == 0)
                    if not others.any():
                        continue
                    marked[own[begin[x] : begin[x] + d[x]]] = True
                    common = np.bincount(hits_of[marked[own]], minlength=hi - lo)
                    marked[own[begin[x] : begin[x] + d[x]]] = False
                    linked = np.flatnonzero(others & (a * (d[x] + d - 2 * common) <= b * (size[x] + size)))
                    links[linked] += 1
                    links[x] += len(linked)
                    if len(linked):
                        forest.join(x, linked)
                out.append(np.stack([k1[lo:hi], k2[lo:hi], links, k1[lo:hi][forest.roots()]], 1))
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, c]) for c in range(4)], ["k1", "k2", "links", "to"])

    dealt = among.unionByName(to_near).unionByName(near).repartition(*cells).sortWithinPartitions(*cells)
    found = scratch(dealt.mapInArrow(lean(run), "k1 bigint, k2 bigint, links bigint, to bigint"), "large-links")
    star = rows.filter("near and k1 <> head").select(F.col("k1").alias("a"), F.col("head").alias("b"))
    groups = components(found.filter("k1 <> to").select(F.col("k1").alias("a"), F.col("to").alias("b")).unionByName(star))
    added = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    labels = rows.select("k1", "k2", "class_id", F.when(F.col("near"), F.col("nears") - 1).otherwise(0).alias("certain")).join(added, ["k1", "k2"], "left")
    labels = labels.join(groups.select(F.col("node").alias("k1"), "component"), "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    labels = scratch(labels, "large-labels")
    least = labels.groupBy("component").agg(F.min("class_id").alias("component_id"))
    return labels.join(least, "component").select("k1", "k2", "component_id", (F.col("certain") + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"))


def shared_blocks(sets: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """block, k1 of those ``blocks``, of one part of all, that sets of several k1 have: one shuffle, in order of both, and a look at the neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, k1, last = np.empty(0, np.int64), np.empty(0, np.int64), False  # the last row so far, and whether its block has had another
        for b in batches:
            if not b.num_rows:
                continue
            block, k1 = (np.concatenate([x, b.column(c).to_numpy()]) for x, c in ((block, "block"), (k1, "k1")))
            new = np.concatenate([[True], (block[1:] != block[:-1]) | (k1[1:] != k1[:-1])])
            block, k1 = block[new], k1[new]
            like = block[1:] == block[:-1]
            told = np.concatenate([like, [False]]) | np.concatenate([[last], like])
            yield pa.RecordBatch.from_arrays([pa.array(block[:-1][told[:-1]]), pa.array(k1[:-1][told[:-1]])], ["block", "k1"])
            block, k1, last = block[-1:], k1[-1:], bool(told[-1])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(k1)], ["block", "k1"])

    keyed = sets.select("k1", F.explode("blocks").alias("block")).filter(F.pmod("block", F.lit(parts)) == part)
    return keyed.select("block", "k1").repartition("block").sortWithinPartitions("block", "k1").mapInArrow(lean(run), "block bigint, k1 bigint")


def near_groups(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """Groups of ``docs`` (doc_id bigint, text; other columns are not read) connected by similarity: links of ``rule``.

    Returns a row for each row of ``docs``: doc_id, th (hash of the text), n_shingles, class_id (smallest doc_id with
    an equal set), component_id (smallest doc_id reachable by links, itself included) and
    n_links (other classes that its class links to; every link is verified and counted).
    Documents without words have no shingles, are linked with nothing and are their own
    component. Rows that share a doc_id are documents of their own; a row without one takes
    part, and where nothing it reaches has an id, its component_id is null. An empty table
    gives an empty result.
    """
    keep: list[DataFrame] = []
    with temporary_tables(keep):
        table = scratch(features(docs, rule), "shingle-features")
        sets = table.filter("n > 0")
        classes = scratch(sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("point").alias("point")), "classes")
        copies = small(scratch(classes.filter("rows > 1").select("k1", "k2", "class_id", F.lit(True).alias("copied")), "copied-classes"), 48)
        told = sets.select("doc_id", "k1", "k2", "blocks").join(copies, ["k1", "k2"], "left")
        # Of equal sets one goes on; those of one document's repeats are told apart by nothing, so they are put together in each task first.
        again = told.filter("copied and (class_id is null or doc_id = class_id)").select("k1", "k2", "blocks").dropDuplicates(["k1", "k2"])
        once = told.filter("copied is null").select("k1", "k2", "blocks").unionByName(again)
        members = [scratch(shared_blocks(once, i, BLOCK_PARTS).join(classes.select("k1", "n", "point"), "k1"), "members") for i in range(BLOCK_PARTS)]
        members = docs.sparkSession.read.schema(members[0].schema).parquet(*(m.scratch_path for m in members))
        features_of, table = table, scratch(table.select("doc_id", "th", "n", "k1", "k2"), "document-sets")
        discard(features_of)  # blocks and points are most of all that is written
        bundled = scratch(bundles(members, rule), "bundles")

        wanted = classes.select("k1", "k2", "class_id", "n").join(small(bundled, 32), "k1")
        wanted = wanted.join(scratch(wanted.groupBy("bundle").agg((F.sum("n") > BUNDLE).alias("large")), "bundle-sizes"), "bundle")
        wanted = scratch(wanted.select("bundle", "k1", "k2", "class_id", "large"), "bundle-classes")
        repeated = small(scratch(table.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-documents"), 32)
        labels = _in_one_task(_with_sets(docs, wanted.filter("not large"), repeated, rule), rule)
        large = wanted.filter("large")
        if not large.isEmpty():
            labels = labels.unionByName(_large_bundles(_with_sets(docs, large, repeated, rule), rule))
        labels = classes.select("k1", "k2", "class_id", "rows").join(scratch(labels, "link-labels"), ["k1", "k2"], "left").filter("rows > 1 or n_links > 0")
        labels = scratch(labels.select("k1", "k2", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), "n_links"), "labels")
        keep += [table, labels]
    out = table.select("doc_id", "th", "n", "k1", "k2").join(small(labels, 48), ["k1", "k2"], "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        "th",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _with_sets(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, rule: Rule) -> DataFrame:
    """``wanted`` (bundle, k1, k2, class_id) with s, the set of each class.

    Rows that repeat a document (ids in ``repeated``, and those without) are put together by text before their
    sets are made, in each task first, so a class comes once, or once for each of its texts that share the id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = text_shingles(b.column("text"), rule.size)
            names = [_names(s) for s in sets]
            at = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["k1", "k2", "s"])

    ids = small(wanted.filter("class_id is not null").select(F.col("class_id").alias("doc_id")).distinct(), 32)
    texts = docs.select("doc_id", "text")
    known = texts.join(ids, "doc_id", "left_semi")
    more = known.join(repeated, "doc_id", "left_semi").unionByName(texts.filter("doc_id is null and text is not null"))
    texts = known.join(repeated, "doc_id", "left_anti").unionByName(more.distinct())
    return texts.mapInArrow(lean(run), "k1 bigint, k2 bigint, s array<bigint>").join(small(wanted.drop("large"), 48), ["k1", "k2"])


def drop_near_copies(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """``docs`` with one document left of each group: that with the smallest doc_id; others are unchanged.

    Of rows of a group that share this doc_id, the one with the least hash of its text stays,
    and of rows equal in both, the one with the least hash of all its columns. Rows without a doc_id go if their
    group has one, else stay; so do texts without words. An empty table gives an empty result.
    """
    keep: list[DataFrame] = []
    with temporary_tables(keep):
        found = scratch(near_groups(docs, rule), "near-groups")
        kept = found.filter("doc_id is not null and component_id = doc_id and n_shingles > 0")
        again = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("th").alias("least")).filter("rows > 1")
        again = scratch(again, "repeated-ids")
        gone = found.filter("component_id is not null and (doc_id is null or component_id <> doc_id)").select("doc_id", "th")
        gone = gone.unionByName(kept.join(small(again, 48), "doc_id").filter("th <> least").select("doc_id", "th"))
        its, sign, place = fresh("doc_id"), fresh("th"), fresh("r")
        gone = scratch(gone.distinct().withColumnsRenamed({"doc_id": its, "th": sign}), "gone")
        keep += [again, gone]
    same = F.col("doc_id").eqNullSafe(F.col(its)) & (F.xxhash64("text") == F.col(sign))
    left = docs.join(small(gone, 48), same, "left_anti")
    if again.isEmpty():
        return left
    ids = small(again.select("doc_id"), 32)
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*quoted(docs)))
    once = left.join(ids, "doc_id", "left_semi").select(*quoted(docs)).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return left.join(ids, "doc_id", "left_anti").select(*quoted(docs)).unionByName(once)
