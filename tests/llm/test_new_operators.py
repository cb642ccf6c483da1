"""Centroid clustering, HTML extraction and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import drake, extraction, resampling

from .brute import prose

# --- centroid clustering


def plain_clusters(rows, k, rounds, dimension):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) and -(2**17) <= x < 2**17 for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            if mine := [v for (_, v), a in zip(kept, at, strict=True) if a == j]:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    done = [(i, *near(v)[::-1]) for i, v in kept]
    return sorted(((i, c, d, sum(x[2] for x in done if x[1] == c), sum(x[2] for x in done), centroids[c]) for i, c, d in done), key=repr)


def clusters(df, **more):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in drake.cluster(df, **more).collect()), key=repr)


@pytest.mark.parametrize("kind", ["spread", "lattice"])
def test_clusters_are_those_of_a_plain_search(spark, kind):
    r = random.Random(kind)
    # On a lattice of few points distances tie all the time.
    one = (lambda: r.gauss(0, 1)) if kind == "spread" else lambda: float(r.randint(-1, 1))
    rows = [(i, [one() for _ in range(4)]) for i in range(400)] + [(1000 + i, [0.5] * 4) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    assert clusters(df, dimension=4, rounds=6) == plain_clusters(rows, 8, 6, 4)


def test_vectors_that_take_no_part_and_repeats(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("-inf"), 1.0]), (7, [1e30, 0.0]), (None, [5.0, 5.0]), (8, [-0.0001, 0.0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id bigint, embedding array<double>, cluster string").withColumnsRenamed({})
    got = clusters(df, dimension=2)
    assert got == plain_clusters(rows, 8, 10, 2) and len(got) == 4
    assert clusters(df.filter("vec_id = 2"), dimension=2) == []


def test_bounds_save_comparisons(spark):
    r = np.random.default_rng(0)
    v = np.repeat(r.standard_normal((8, 16)) * 4, 100, axis=0) + 0.1 * r.standard_normal((800, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = drake.cluster(df, dimension=16).first()
    assert got.n_distances < 0.5 * 800 * 8 * 11


# --- HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body class="no-sidebar">
<header class="site-header"><h1>The Site</h1><ul class="menu"><li><a href="/">Home</a></ul></header>
<div id="cookie-notice">We use cookies. <button>OK</button></div>
<div class="wrap"><div class="main-content post-%d"><h2>A title &amp; more</h2><p>First   para with
 <a href="x">a link</a>, &lt;b&gt; and &eacute;.<div class="ad-box">Buy now!</div><p>Second<br>line<script>if (a < b) "</p>"</script> goes on.
<ul><li>one<li>two</ul><form><label>Name</label><input></form><!-- a <p>comment</p> --><table><tr><td>a<td>b</table>%s</div>
<div class="comments"><h3>Comments</h3><p>A reader says a whole lot of things here, more than the article itself does, and goes on and on about it.</div>
<aside>An aside</aside></div><footer>(c) us</footer></body></html>"""
TEXT = "A title & more\nFirst para with a link, <b> and é.\nSecond line goes on.\none\ntwo\na\nb"


def test_what_stays_of_a_page():
    page = PAGE % (7, "")
    path, score = extraction.vote(page)
    assert path == "/body.no-sidebar/div.wrap/div.main-content.post-9" and score > 0
    assert extraction.extract(page, path) == (TEXT, True)
    assert extraction.extract(page, "/body/elsewhere") == (TEXT, False)
    assert extraction.extract("", None) == ("", False) and extraction.vote("<nav>menu</nav>") is None
    assert extraction.extract("plain words", None)[0] == "plain words"
    assert extraction.extract("<p>one<p>two &am", None)[0] == "one\ntwo &am"
    assert extraction.extract("<article><header><h1>T</h1></header><p>x y</p><div hidden>no</div><article class='comment'>no</article></article>", None)[0] == "T\nx y"
    assert extraction.extract("<body><div class='page-sidebar'><article><p>in a badly named box</p></article></div></body>", None)[0] == "in a badly named box"
    assert extraction.extract("<body><div class='page-header'>Site name and slogan</div><article><div class='header'><h2>T</h2></div><p class='meta'>By A</p><p>x y z</p><ol class='commentlist'><li>no</ol></article></body>", None)[0] == "T\nBy A\nx y z"
    body = "<div class='text'><p>" + prose(1, 80) + "</p><p>" + prose(2, 80) + "</p></div>"
    titled = f"<body><div id='page'><h1>A title</h1>{body}<div class='sidebar'>no</div></div><div class='links'>{'<a href=x>elsewhere</a> ' * 99}</div></body>"
    assert extraction.extract(titled, extraction.vote(titled)[0]) == ("A title\n" + prose(1, 80) + "\n" + prose(2, 80), True)
    # A page that breaks off ends its last element; on a whole page an unclosed menu is no menu.
    assert extraction.extract("<body><article><p>said</p></article><footer>(c)", None)[0] == "said"
    assert extraction.extract("<body><nav><div><p>said here</p></div></body></html>", None)[0] == "said here"


def test_host_paths_outvote_a_page(spark):
    few = PAGE.replace("comments", "talk") % (3, "")  # without its mark, the talk below has more prose
    longer = PAGE.replace("comments", "talk")
    rows = [(i, f"https://www.a.example/{i}", longer % (i, "<p>" + prose(i, 60))) for i in range(20)]
    rows += [(100, "https://WWW.a.example:80/x", few), (100, "https://WWW.a.example:80/x", few), (101, "http://other.example/", few), (102, None, None), (103, "no url", ""), (None, "http://z.example", "<p>" + "long " * 100_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, url string, html string, path string, host string")
    got = {(r.page_id, r.url): r for r in extraction.main_text(df).collect()}
    assert extraction.main_text(df).count() == len(rows)
    assert (got[100, rows[20][1]].text, got[100, rows[20][1]].by_host) == (TEXT, True)
    assert got[101, "http://other.example/"].text.startswith("Comments\nA reader")
    assert got[5, rows[5][1]].text == TEXT + "\n" + prose(5, 60)
    assert got[102, None].text == "" and got[103, "no url"].n_chars == 0
    assert got[None, "http://z.example"].n_chars == 5 * 100_000 - 1
    assert extraction.main_text(df.limit(0)).collect() == []


def test_hosts_joined_by_shuffle_give_the_same(spark, monkeypatch):
    rows = [(i, f"https://h{i % 3}.example/{i}", PAGE % (i, "<p>" + prose(i, 40))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = sorted(map(tuple, extraction.main_text(df).collect()))
    monkeypatch.setattr(extraction, "small", lambda d, n: d)
    assert sorted(map(tuple, extraction.main_text(df).collect())) == want


@pytest.mark.parametrize("page", ["<" * 200_000, "<a '" * 99_999, "<p>" * 100_000, "<div>" * 50_000 + "</section>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<!--" * 50_000, '<div class="' + "a" * 500_000 + '">' + "<div>" * 1000, "<table>" + "<tr><td>" * 50_000, "<script>" * 50_000])
def test_hostile_markup_takes_linear_time(page):
    began = time.time()
    extraction.extract(page, "/div")
    assert time.time() - began < 10


# --- importance resampling


def features(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_draw(rows, target):
    s, t = [0] * 10_000, [0] * 10_000
    docs = [(i, *features(x)) for i, x in rows]
    for held, many in ((s, [f for _, _, f in docs]), (t, [features(x)[1] for x in target])):
        for f in many:
            for b in f:
                held[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), (w := sum(gain[b] for b in f)), w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(drawn[: 5 * len(drawn) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def test_draws_are_those_of_plain_python(spark, documents, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 20_000)
    monkeypatch.setattr(resampling, "RUN", 1000)  # the long text is numbered in parts
    target = [prose(3, 200), "Ünïcode A-b_c 4x4 z", None, ""]
    more = spark.createDataFrame([(300 + i, t) for i, t in enumerate(["Ünïcode a-b_c 4X4 z", "one", "a b", "\x00 \x7f -- !!", "É é İ K"])], "doc_id bigint, text string")
    docs = documents.unionByName(more, allowMissingColumns=True)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    want = plain_draw([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], target)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_ranks_and_empty_tables(spark):
    df = spark.createDataFrame([(i % 30, prose(i % 30, 25), 1) for i in range(900)], "doc_id bigint, text string, rank int")
    got = resampling.resample(df, df.limit(3)).collect()
    assert len(got) == 900 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 46))
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(-r.score, r.doc_id) for r in ranked] == sorted((-r.score, r.doc_id) for r in got)[:45]
    assert resampling.resample(df.limit(0), df).collect() == []
    nothing = resampling.resample(df, df.limit(0)).collect()
    assert len(nothing) == 900 and len({r.weight for r in nothing if r.doc_id == 4}) == 1


def test_ids_of_slices_of_arrow_arrays():
    texts = pa.array(["no", "The cat", None, "the CAT sat", ""]).slice(1)
    codes, words, at = resampling.word_codes(texts)
    assert [words[i].as_py() for i in codes.tolist()] == [b"the", b"cat", b"the", b"cat", b"sat"] and at.tolist() == [0, 2, 2, 5, 5]
