"""Templates from a table: whole long licenses, held in tasks and joined by shuffle, against plain Python."""

import math
import random

import pytest

from quillspark.llm import licenses

from .brute import prose


def long_template(seed, n):
    return " ".join(random.Random(seed).choices([f"Clause{i}" for i in range(400)] + ["the", "of", "and"], k=n))


TEMPLATES = [("short", "a", "Permission is hereby granted, free of charge, to any person."), ("long", "b", long_template(1, 3000)), ("other", "b", long_template(2, 1200)), ("none", "c", "--- !!!"), ("null", "d", None), ("short", "z", "zzz never taken, the label is larger")]


def changed(text, share, seed):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"x{r.random()}" for w in text.split())


def texts():
    out = [None, "", "nothing here", prose(1, 500)]
    for k in range(6):
        t = TEMPLATES[k % 3][2]
        out += [prose(k, 200 * k) + " " + t.upper() + " " + prose(k + 9, 300), prose(k, 50) + " " + changed(t, 0.05 * k, k) + " the mit license", t[: len(t) // 2]]
    return out + out[4:6]


def brute(text, notice):
    w, t = licenses.words_of(text), set(licenses.words_of(notice))
    length = licenses.block_words(b" ".join(licenses.words_of(notice)).decode())
    blocks = [w[k : k + length] for k in range(0, max(1, (math.ceil(max(0, len(w) - length) / (length // 2))) * (length // 2) + 1), length // 2)]
    return max(len(t & set(b)) for b in blocks) / len(t)


@pytest.mark.parametrize("way", ["held", "joined"])
def test_tables_of_templates(spark, monkeypatch, way):
    if way == "joined":
        monkeypatch.setattr(licenses, "TEMPLATE_BYTES", 0)
    said = texts()
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1) for i, t in enumerate(said)], "doc_id bigint, text string, row int").repartition(3)
    table = spark.createDataFrame(TEMPLATES, "template string, label string, text string")
    got = licenses.scan(docs, table).collect()
    assert len(got) == len(said)
    for r in got:
        text = said[5 if r.doc_id is None else r.doc_id]
        want = {n: brute(text, t) for n, label, t in TEMPLATES[:3]}
        # A block matches with ceil(threshold * size) words.
        want = {n: s for n, s in want.items() if round(s * (size := len(set(licenses.words_of(dict((x[0], x[2]) for x in TEMPLATES[:3])[n]))))) >= math.ceil(licenses.THRESHOLD * size)}
        assert {m.template: m.containment for m in r.templates} == pytest.approx(want), r.doc_id
        assert [m.label for m in r.templates] == ["a" if m.template == "short" else "b" for m in r.templates]
        named = "mit license" in (text or "")
        assert r.score == pytest.approx(max([licenses.PHRASE_SCORE if named else 0.0, *want.values()]))
    assert licenses.scan(docs.limit(0), table).collect() == []
    assert all(not r.templates for r in licenses.scan(docs, table.limit(0)).collect())
