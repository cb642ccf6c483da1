"""Language identification by character n-grams.

A text is reduced to lower-case letters with single spaces between, its runs of two and three
characters are hashed to BUCKETS, and every language has an array of whole-number weights for them:
the logarithm of how often its training text has a bucket, on a scale where an unseen one counts nothing.
Sums of weights, tempered because runs overlap, give a posterior; below ``least`` the language is unknown (null).
Texts mostly in a script that one language is written in by far the most are told by the script.

``Profiles.column`` does all this in the JVM. ``Profiles.batched`` gives the same answers from arrays over Arrow
batches, where a run is named by the places of its characters in the batch's alphabet and each distinct one is
hashed once; it is the way for tables. ``Profiles.train`` counts likewise.

The profiles that come with the library are counted from its seed texts; ``Profiles.train`` counts them from a table.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ORDERS = (2, 3)
BUCKETS = 1 << 15
#: Weights are SCALE * ln(1 + rate / FLOOR), a rate being the occurrences in PER runs of a length.
SCALE, FLOOR, PER = 32, 0.1, 1000
#: Languages whose weights share a long, and the bits of each.
PACKED, BITS = 3, 21
#: What the scores are divided by for the posterior, and the least posterior of an answer.
TEMPER, LEAST = 2.0, 0.6
#: Characters whose runs are looked at together, and languages that a task counts at once.
SLICE, HELD = 1 << 20, 64
#: Scripts and the language taken for each; the first that holds more than half of the letters decides.
SCRIPTS = {"Cyrillic": "ru", "Greek": "el", "Arabic": "ar", "Hebrew": "he", "Thai": "th", "Devanagari": "hi", "Hangul": "ko", "Hiragana": "ja", "Katakana": "ja", "Han": "zh"}


def letters(text: Column) -> Column:
    """Lower-case letters, one space for all else between them and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def buckets(said: Column) -> Column:
    """The buckets of all runs of ``letters``, in one pass for each length."""
    runs = F.concat(*(F.regexp_extract_all(said, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)) for n in ORDERS))
    return F.transform(runs, lambda g: (F.crc32(g.cast("binary")) % BUCKETS).cast("int"))


def plain_letters(text: str) -> str:
    """``letters`` of a string on the driver."""
    return f" {' '.join(''.join(c if c.isalpha() else ' ' for c in text.lower()).split())} "


def run_buckets(said: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Where each of some ``letters`` begins, and for each length the buckets of the distinct runs and which of them stands at each place.

    Texts are told apart by null characters; runs that hold one are none and have the bucket BUCKETS.
    """
    gap = "\0" * max(ORDERS)
    codes = np.frombuffer((gap.join(said) + gap).encode("utf-32-le"), np.uint32)
    begin = np.cumsum([0, *(len(t) + len(gap) for t in said[:-1])])
    number = np.zeros(int(codes.max()) + 1, np.int64)
    alphabet = np.flatnonzero(np.bincount(codes))
    number[alphabet] = np.arange(len(alphabet))
    number, base, out = number[codes], len(alphabet), []
    for n in ORDERS:
        name = np.zeros(len(codes), np.int64)
        for k in range(n):  # what would stand beyond the end is the null character, which is number 0
            name[: len(codes) - k] = name[: len(codes) - k] * base + number[k:]
            name[len(codes) - k :] *= base
        if base**n <= 1 << 22:
            there = np.zeros(base**n, bool)
            there[name] = True
            distinct = np.flatnonzero(there)
            place = np.empty(base**n, np.int32)
            place[distinct] = np.arange(len(distinct))
            place = place[name]
        else:
            distinct, place = np.unique(name, return_inverse=True)
        signs = [[chr(c) for c in alphabet[distinct // base ** (n - 1 - k) % base].tolist()] for k in range(n)]
        grams = map("".join, zip(*signs, strict=True))
        out.append((np.array([BUCKETS if "\0" in g else zlib.crc32(g.encode()) % BUCKETS for g in grams], np.int64), place))
    return begin, out


def sliced(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of texts of about SLICE characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= SLICE:
            yield held
            held, n = [], 0
    if held:
        yield held


def weights_of(counts: Mapping[tuple[int, int], int]) -> list[int]:
    """Weights of all buckets from counts by (length of the run, bucket)."""
    totals: Counter[int] = Counter()
    for (n, _), c in counts.items():
        totals[n] += c
    out = [0] * BUCKETS
    for (n, bucket), c in sorted(counts.items()):
        out[bucket] += round(SCALE * math.log1p(c * PER / totals[n] / FLOOR))
    return out


class Profiles:
    """Weights by language. Of equally likely languages none is taken."""

    def __init__(self, weights: Mapping[str, list[int]], least: float = LEAST):
        self.weights, self.least = dict(sorted(weights.items())), least

    @classmethod
    def of_texts(cls, texts: Mapping[str, str | Iterable[str]], least: float = LEAST) -> Profiles:
        """From texts on the driver; meant for small ones."""
        found = {}
        for lang, given in texts.items():
            counts: Counter[tuple[int, int]] = Counter()
            for text in [given] if isinstance(given, str) else given:
                said = plain_letters(text)
                counts.update((n, zlib.crc32(said[i : i + n].encode()) % BUCKETS) for n in ORDERS for i in range(len(said) - n + 1))
            found[lang] = weights_of(counts)
        return cls(found, least)

    @classmethod
    def train(cls, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = LEAST) -> Profiles:
        """From all labelled rows, counted in Spark; what is collected is a count for each language, length and bucket at most."""
        said = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), letters(F.col(text_col)).alias("said"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}

            def give() -> Iterator[pa.RecordBatch]:
                for lang, c in held.items():
                    n, bucket = np.nonzero(c[:, :BUCKETS])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.array(ORDERS)[n]), pa.array(bucket), pa.array(c[n, bucket])], ["lang", "n", "bucket", "count"])
                held.clear()

            for b in batches:
                langs = b.column("lang").to_pylist()
                for lang in sorted(set(langs)):
                    if lang not in held:
                        if len(held) == HELD:
                            yield from give()
                        held[lang] = np.zeros((len(ORDERS), BUCKETS + 1), np.int64)
                    its = b.column("said").filter(pa.array([x == lang for x in langs]))
                    for texts in sliced(t.as_py() for t in its):
                        for row, (bucket, place) in enumerate(run_buckets(texts)[1]):
                            np.add.at(held[lang][row], bucket, np.bincount(place, minlength=len(bucket)))
            yield from give()

        counted = said.mapInArrow(count, "lang string, n bigint, bucket bigint, count bigint").groupBy("lang", "n", "bucket").agg(F.sum("count").alias("count"))
        found: dict[str, dict[tuple[int, int], int]] = {}
        for r in counted.toLocalIterator():
            found.setdefault(r["lang"], {})[r["n"], r["bucket"]] = r["count"]
        return cls({lang: weights_of(c) for lang, c in found.items()}, least)

    def posterior(self, text: Column) -> Column:
        """Struct of lang and p, the likeliest language and its posterior; null for null and where languages tie or nothing is known."""
        if not self.weights:
            return F.lit(None).cast("struct<lang:string,p:double>")
        langs = list(self.weights)
        # The weights of PACKED languages share a long, so one pass over the runs sums them all; a part is short enough for no sum to overflow its bits.
        most = max(max(w) for w in self.weights.values())
        part = max(1, ((1 << BITS) - 1) // max(most, 1))
        packs = []
        for i in range(0, len(langs), PACKED):
            packed = [sum(w << BITS * k for k, w in enumerate(ws)) for ws in zip(*(self.weights[x] for x in langs[i : i + PACKED]), strict=True)]
            packs.append(F.split(F.lit(",".join(map(str, packed))), ",").cast("array<bigint>"))
        zero = F.lit(0).cast("bigint")

        def sums_of(ids: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1)), F.lit(part)), lambda i: F.slice(ids, i, F.lit(part)))
            total = lambda table: lambda c: F.aggregate(c, zero, lambda a, b: a + F.get(table, b))
            return F.array(*(F.transform(parts, total(table)) for table in packs))

        def likeliest(sums: Column) -> Column:
            score = lambda k: F.aggregate(sums[k // PACKED], zero, lambda a, x: a + F.shiftright(x, BITS * (k % PACKED)).bitwiseAND((1 << BITS) - 1))
            return F.array(*(F.struct(score(k).alias("score"), F.lit(lang).alias("lang")) for k, lang in enumerate(langs)))

        def answer(found: Column) -> Column:
            top = F.array_max(found)
            whole = F.aggregate(found, F.lit(0.0), lambda a, x: a + F.exp((x["score"] - top["score"]) / (SCALE * TEMPER)))
            tied = F.size(F.filter(found, lambda x: x["score"] == top["score"])) > 1
            return F.when((top["score"] > 0) & ~tied, F.struct(top["lang"].alias("lang"), (1 / whole).alias("p")))

        # Lambdas name what would else be evaluated again for each language.
        summed = F.transform(F.array(buckets(letters(text))), sums_of)
        return F.transform(F.transform(summed, likeliest), answer)[0]

    def column(self, text: Column) -> Column:
        """The language of ``text``, null if unknown; all in the JVM."""
        return self._by_script(text, F.transform(F.array(self.posterior(text)), lambda x: F.when(x["p"] >= self.least, x["lang"]))[0])

    def batched(self, text: Column) -> Column:
        """``column`` from arrays over Arrow batches."""
        if not self.weights:
            return self._by_script(text, F.lit(None).cast("string"))
        langs, least = np.array(list(self.weights), object), self.least
        # The last column is that of what is no run.
        weights = np.array([[*w, 0] for w in self.weights.values()], np.int32)

        def answers(texts: list[str]) -> np.ndarray:
            begin, runs = run_buckets(texts)
            scores = np.zeros((len(langs), len(texts)), np.int64)
            for k, w in enumerate(weights):
                for bucket, place in runs:
                    scores[k] += np.add.reduceat(w[bucket][place], begin, dtype=np.int64)
            top = scores.max(0)
            p = 1 / np.exp((scores - top) / (SCALE * TEMPER)).sum(0)
            known = (top > 0) & ((scores == top).sum(0) == 1) & (p >= least)
            return np.where(known, langs[scores.argmax(0)], None)

        @F.pandas_udf(StringType())
        def likeliest(said: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(said), said.index, object)
            there = said[said.notna()]
            if len(there):
                out[there.index] = np.concatenate([answers(t) for t in sliced(there)])
            return out

        return self._by_script(text, likeliest(letters(text)))

    @staticmethod
    def _by_script(text: Column, found: Column) -> Column:
        """``found``, but the script's language where the letters tell it."""
        return F.when(F.rlike(text, F.lit(r"[^\x00-\x{024F}]")), F.coalesce(script_language(text), found)).otherwise(found)


def script_language(text: Column) -> Column:
    """The language of the script that most letters are in, null if it is Latin or another."""
    said = F.regexp_replace(text, r"[^\p{L}]+", "")
    share = lambda script: F.regexp_count(said, F.lit(rf"\p{{Is{script}}}")) / F.nullif(F.length(said), F.lit(0))
    kana = share("Hiragana") + share("Katakana")
    rules = F.when((kana > 0) & (kana + share("Han") > 0.5), "ja")
    for script, lang in SCRIPTS.items():
        rules = rules.when(share(script) > 0.5, lang)
    return rules


@functools.cache
def default_profiles() -> Profiles:
    """Profiles of the seed texts."""
    from quillspark.functions.seeds import SEEDS

    return Profiles.of_texts(SEEDS)


class ColumnDetector:
    """Takes the language from a column that is already there."""

    def __init__(self, name: str = "lang"):
        self.name = name

    def column(self, text: Column) -> Column:
        return F.col(self.name)

    batched = column


def keep_language(df: DataFrame, text_col: str, detector: Profiles | ColumnDetector, language: str = "en", ascii_least: float = 0.85) -> DataFrame:
    """Rows in ``language``: first the cheap share of ASCII, then the detector on what is left."""
    from quillspark.functions.text import ascii_ratio

    return df.filter(ascii_ratio(F.col(text_col)) >= ascii_least).filter(detector.batched(F.col(text_col)) == language)
