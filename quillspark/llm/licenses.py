"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of BLOCK_WORDS words, or of the power of two that holds the template
twice; windows overlap by half and together cover the whole text, so a notice stands whole in one. A template matches a block that holds at least THRESHOLD of its
distinct words. Words of the templates are ordered by how many documents of the corpus
hold them, rarest first. Of a template with n words that needs a of them, one of
the first n - a + 1 must be in any matching block (prefix filter), the block must have a
words at all (length filter), and from the first common word on, both sides must still
have a words left (positional filter). What survives is verified by intersection.

Templates come with the operator or as a table (template, label, text). Where their counted bytes are within
TEMPLATE_BYTES they are the small side and no rows are shuffled but word counts; beyond that blocks and templates are
joined on the words of the prefixes. Both ways give the same matches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import lean, scratch, slices, temporary_tables

# Phrases that name a license.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notices by which licenses are applied to works, and texts of short licenses, with the label of each.
TEMPLATES = {
    "apache-line": ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    "apache-notice": (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to "
        "in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "bsd-line": ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    "bsd-text": (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution this software is provided by "
        "the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied "
        "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
        "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited "
        "to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any "
        "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of "
        "the use of this software even if advised of the possibility of such damage",
    ),
    "cc-by-line": ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    "gpl-line": ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    "gpl-notice": (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 2 of the license or at your option any later version this program is "
        "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
        "fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu "
        "general public license along with this program",
    ),
    "isc-line": ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "isc-text": (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event "
        "shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss "
        "of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with "
        "the use or performance of this software",
    ),
    "mit-line": ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    "mit-text": (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
        "to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
        "from out of or in connection with the software or the use or other dealings in the software",
    ),
    "mpl-line": ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    "unlicense-text": (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any "
        "means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest "
        "in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
        "to this software under copyright law",
    ),
    "zlib-text": (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
        "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
        "commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this "
        "software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product "
        "an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly "
        "marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any "
        "source distribution",
    ),
}
#: Words of the shortest blocks; a template is sought in blocks of the least power of two that holds it twice.
BLOCK_WORDS = 64
THRESHOLD = 0.8
#: Bytes of templates that every task may hold.
TEMPLATE_BYTES = 8 << 20
#: Score of a document that names a license but holds no notice.
PHRASE_SCORE = 0.5

_APART = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased: runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_APART).split() if text else []


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(word index, label) of every place where a phrase's words stand consecutively."""
    line, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        needle, at, index, last = f" {phrase} ".encode(), 0, 0, 0
        while (at := line.find(needle, at)) >= 0:
            index, last = index + line.count(b" ", last, at), at
            found.append((index, label))
            at += 1
    return found


def block_words(notice: str) -> int:
    """Length of the blocks in which a template is sought."""
    return max(BLOCK_WORDS, 1 << (2 * len(notice.split()) - 1).bit_length())


@dataclass(frozen=True)
class Index:
    """Templates as word ranks in the global order, with the prefix index into them."""

    rank: dict[bytes, int]
    templates: dict[str, tuple[int, ...]]
    need: dict[str, int]
    prefix: dict[bytes, tuple[str, ...]]

    @classmethod
    def build(cls, frequency: dict[bytes, int], templates: dict[str, str], threshold: float = THRESHOLD) -> Index:
        sets = {name: {w.encode() for w in notice.split()} for name, notice in templates.items()}
        order = sorted(set().union(*sets.values()), key=lambda w: (frequency.get(w, 0), w))
        rank = {w: i for i, w in enumerate(order)}
        ordered = {name: sorted(rank[w] for w in s) for name, s in sets.items()}
        need = {name: math.ceil(threshold * len(s)) for name, s in sets.items()}
        prefix: dict[bytes, tuple[str, ...]] = {}
        for name, ranks in ordered.items():
            for r in ranks[: len(ranks) - need[name] + 1]:
                prefix[order[r]] = (*prefix.get(order[r], ()), name)
        return cls(rank, {k: tuple(v) for k, v in ordered.items()}, need, prefix)

    @classmethod
    def by_length(cls, frequency: dict[bytes, int], templates: dict[str, tuple[str, str]] | None = None) -> dict[int, Index]:
        """An index for each length of blocks."""
        notices = {name: notice for name, (_, notice) in (templates or TEMPLATES).items()}
        lengths = sorted({block_words(n) for n in notices.values()})
        return {length: cls.build(frequency, {k: n for k, n in notices.items() if block_words(n) == length}) for length in lengths}

    def block_matches(self, block: Iterable[bytes]) -> dict[str, float]:
        """Containment of every template that the block matches."""
        held = set(block)
        labels = {label for w in held & self.prefix.keys() for label in self.prefix[w]}
        if not labels:
            return {}
        ranks = sorted(self.rank[w] for w in held & self.rank.keys())
        mine, found = set(ranks), {}
        for label in labels:
            template, need = self.templates[label], self.need[label]
            if len(ranks) < need:
                continue
            i = next(i for i, r in enumerate(template) if r in mine)
            if min(len(template) - i, sum(r >= template[i] for r in ranks)) < need:
                continue
            common = sum(r in mine for r in template)
            if common >= need:
                found[label] = common / len(template)
        return found

    def matches(self, words: list[bytes], block_words: int = BLOCK_WORDS) -> dict[str, float]:
        """Best containment of every template that some block of the text matches."""
        step, prefix = block_words // 2, self.prefix
        last = max(0, math.ceil((len(words) - block_words) / step))
        blocks: set[int] = set()
        for i, w in enumerate(words):
            if w in prefix:
                blocks.update((min(i // step, last), min(max(i // step - 1, 0), last)))
        best: dict[str, float] = {}
        for b in blocks:
            for label, share in self.block_matches(words[b * step : b * step + block_words]).items():
                best[label] = max(best.get(label, 0.0), share)
        return best


def word_frequency(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None) -> dict[bytes, int]:
    """In how many documents each word of the templates stands (a table bounded by the templates' size)."""
    wanted = frozenset(w.encode() for _, notice in (templates or TEMPLATES).values() for w in notice.split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                n.update(wanted.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(lean(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counted.collect()}


def _named(templates: DataFrame | None) -> dict[str, tuple[str, str]] | None:
    """The templates by name, in words as texts are cut into; None if they are too many for a task. Those without words match nothing."""
    if templates is None:
        return TEMPLATES
    rows = templates.filter("template is not null and text is not null").groupBy("template").agg(F.min(F.struct("label", "text")).alias("t")).select("template", "t.label", "t.text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    if size > TEMPLATE_BYTES:
        return None
    cut = {r["template"]: (r["label"], b" ".join(words_of(r["text"])).decode("utf-8", "surrogatepass")) for r in rows.collect()}
    return {name: t for name, t in cut.items() if t[1]}


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Licenses of each row of ``docs`` (doc_id and text; other columns are not read).

    ``templates`` (template, label, text) is sought in place of the operator's own; of rows that share a name the least is taken.
    Returns doc_id, n_words, places (array of word, label: where phrases stand, by word),
    templates (array of label, template, containment, by template) and score: the best containment, or PHRASE_SCORE
    if that is higher and a phrase stands in the text; else 0. A null or empty text has no
    words; texts of any length are cut into blocks whole; repeated rows are scanned each; an empty table gives an empty result.
    """
    named = _named(templates)
    if named is None:
        return _scan_by_join(docs, templates)
    return _scan_with(docs, Index.by_length(word_frequency(docs, named), named) if named else {}, named)


def _scan_with(docs: DataFrame, indexes: dict[int, Index], named: dict[str, tuple[str, str]]) -> DataFrame:
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    match = pa.struct([("label", pa.string()), ("template", pa.string()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, places, templates, scores = [], [], [], []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                at = sorted(phrase_places(words))
                best = {name: share for length, index in indexes.items() for name, share in index.matches(words, length).items()}
                n.append(len(words))
                places.append([{"word": i, "label": label} for i, label in at])
                templates.append([{"label": named[k][0], "template": k, "containment": v} for k, v in sorted(best.items())])
                scores.append(max([PHRASE_SCORE if at else 0.0, *best.values()]))
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, pa.list_(place)), pa.array(templates, pa.list_(match)), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "places", "templates", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words bigint, places array<struct<word:bigint,label:string>>, templates array<struct<label:string,template:string,containment:double>>, score double"
    return docs.select("doc_id", "text").mapInArrow(lean(run), out)


def _word_list(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _scan_by_join(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """``scan`` for templates of any number: blocks are joined with templates on the words of the prefixes, then verified on their sets."""
    keep: list[DataFrame] = []
    with temporary_tables(keep):
        rows = scratch(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "license-documents")
        least = templates.filter("template is not null and text is not null").groupBy("template").agg(F.min(F.struct("label", "text")).alias("t"))
        sought = least.select("template", "t.label", _word_list(F.col("t.text")).alias("w")).filter("size(w) > 0")
        twice = F.pow(F.lit(2.0), F.ceil(F.log2(2 * F.size("w")))).cast("bigint")
        sought = sought.select("template", "label", F.array_distinct("w").alias("words"), F.greatest(F.lit(BLOCK_WORDS), twice).alias("length"))
        sought = scratch(sought.withColumn("need", F.ceil(THRESHOLD * F.size("words")).cast("int")), "license-templates")
        known = sought.select(F.explode("words").alias("word")).distinct()
        in_text = rows.select("row", F.explode(F.array_distinct(_word_list(F.col("text")))).alias("word"))
        frequency = in_text.join(known, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        ranked = sought.select("template", "length", "need", F.size("words").alias("size"), F.explode("words").alias("word")).join(frequency, "word", "left")
        order = Window.partitionBy("template").orderBy(F.coalesce("n", F.lit(0)), "word")
        prefix = ranked.withColumn("r", F.row_number().over(order)).filter("r <= size - need + 1").select("word", "length", "template")
        prefix = scratch(prefix, "license-prefixes")
        lengths = sought.select("length").distinct()

        # Blocks with a word of some prefix of their length, by where each such word stands.
        said = rows.select("row", F.size(_word_list(F.col("text"))).alias("n_words"), F.posexplode(_word_list(F.col("text"))).alias("at", "word"))
        hits = said.join(prefix, "word").select("row", "n_words", "at", "length", "template")
        step = F.col("length") / 2
        last = F.greatest(F.ceil((F.col("n_words") - F.col("length")) / step), F.lit(0))
        first = F.floor(F.col("at") / step)
        both = F.array_distinct(F.array(F.least(first, last), F.least(F.greatest(first - 1, F.lit(0)), last)))
        pairs = hits.select("row", "length", "template", F.explode(both).alias("block")).distinct()
        held = rows.select("row", _word_list(F.col("text")).alias("w")).join(pairs, "row")
        block = F.array_distinct(F.slice("w", (F.col("block") * F.col("length") / 2 + 1).cast("int"), F.col("length").cast("int")))
        held = held.select("row", "template", block.alias("held")).join(sought.select("template", "label", "words", "need"), "template").filter(F.size("held") >= F.col("need"))
        common = F.size(F.array_intersect("held", "words"))
        found = held.select("row", "template", "label", common.alias("c"), "need", F.size("words").alias("of")).filter("c >= need")
        best = found.groupBy("row", "template", "label").agg(F.max(F.col("c") / F.col("of")).alias("containment"))
        best = scratch(best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("template", "label", "containment"))).alias("m")), "license-matches")
        plain = scratch(_scan_with(rows.select(F.struct("row", "doc_id").alias("doc_id"), "text"), {}, {}), "license-phrases")
        keep += [best, plain]
    matched = F.transform(F.coalesce("m", F.array().cast("array<struct<template:string,label:string,containment:double>>")), lambda x: F.struct(x["label"], x["template"], x["containment"]))
    whole = plain.drop("templates").join(best, F.col("doc_id.row") == F.col("row"), "left").withColumn("templates", matched)
    score = F.greatest(F.col("score"), F.coalesce(F.array_max("templates.containment"), F.lit(0.0)))
    return whole.select("doc_id.doc_id", "n_words", "places", "templates", score.alias("score"))
