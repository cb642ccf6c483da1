"""HTTP sources, p values and interactions of many groups."""

import gzip
import http.server
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import special
from quillspark.operators import trend
from quillspark.sources import readers
from quillspark.sources.http import HttpLines, HttpReader, Part


@pytest.fixture
def address():
    plain = b'{"rating": 5.0, "title": "a", "text": "x"}\n\nnot json\n'

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = {"/a.jsonl": plain, "/b.jsonl.gz": gzip.compress(b'{"rating": 1.0}\n')}.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_jsonl_over_http(spark, address):
    rows = readers.read_jsonl_urls(spark, [f"{address}/a.jsonl", f"{address}/b.jsonl.gz"]).orderBy("rating").collect()
    assert sorted((r.rating, r.title) for r in rows if r.rating) == [(1.0, None), (5.0, "a")]
    assert [r[readers.CORRUPT].strip() for r in rows if r[readers.CORRUPT]] == ["not json"]
    with pytest.raises(Exception, match="cannot read .*missing"):
        readers.read_jsonl_urls(spark, [f"{address}/missing"], timeout=5).collect()


@pytest.fixture
def ranges():
    """A server that takes ranges, fails every third request and breaks off long answers."""
    body = "".join(f'{{"rating": {i % 5}.0, "text": "line {i} \u00e9{"x" * (i % 97)}"}}\n' for i in range(3000)).encode() + b'{"rating": 9.0}'
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Accept-Ranges", "bytes")
            self.end_headers()

        def do_GET(self):
            asked.append(self.headers.get("Range"))
            if len(asked) % 3 == 0:
                self.send_error(503)
                return
            begin = int(self.headers["Range"].removeprefix("bytes=").rstrip("-"))
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {begin}-{len(body) - 1}/{len(body)}")
            self.send_header("Content-Length", str(len(body) - begin))
            self.end_headers()
            self.wfile.write(body[begin : begin + 90_000])  # then the connection ends

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/r.jsonl", body, asked
    server.shutdown()


@pytest.mark.parametrize("part", [5_000, 60_000, 1 << 20])
def test_ranges_of_a_file_are_read_by_several_tasks(spark, ranges, part):
    url, body, asked = ranges
    spark.dataSource.register(HttpLines)
    read = spark.read.format("http_lines").options(urls=url, part_bytes=part, retries=5).load()
    rows = read.orderBy("at").collect()
    assert [r.line for r in rows] == body.decode().split("\n")
    assert all(body[r.at : r.at + 10].decode("utf-8", "replace")[:9] == r.line[:9] for r in rows)
    assert read.rdd.getNumPartitions() == -(-len(body) // part)


def test_ranges_shorter_than_lines_lose_nothing():
    lines = [b"", b"aaaa", b"b" * 50, b"", b"", b"cc", b"d"]
    body = b"\n".join(lines)
    for size in (1, 2, 3, 7, 60, 100):
        reader = HttpReader({"urls": "x"})
        reader._chunks = lambda part: iter([body[max(part.begin - 1, 0) :][i : i + 5] for i in range(0, len(body), 5)])
        got = [x for b in range(0, len(body), size) for x in reader._lines(Part("x", b, min(b + size, len(body))))]
        at = [sum(len(y) + 1 for y in lines[:k]) for k in range(len(lines))]
        assert got == list(zip(at, lines, strict=True)), size


def test_hub_without_its_package(spark):
    pytest.importorskip("pyarrow")
    try:
        import datasets  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            readers.read_hub(spark, "any")


def test_normal_and_chi_square_tails(spark):
    z = [0.0, 1e-9, 0.3, -1.0, 1.96, 1.9999, 2.0, 2.5, -4.0, 8.0, 20.0, 37.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(special.two_sided_p(F.col("z")).alias("p"), special.chi_square_1_p(F.col("z") * F.col("z")).alias("q")).collect()
    for x, r in zip(z, got, strict=True):
        assert r.p == pytest.approx(math.erfc(abs(x) / math.sqrt(2)), rel=1e-9, abs=1e-300)
        assert r.q == pytest.approx(r.p, rel=1e-9)


def test_interaction_of_three_groups_equals_least_squares(spark):
    r = np.random.default_rng(0)
    rows = [(g, float(x), float(k * x + b + r.normal())) for g, k, b in (("a", 1, 0), ("b", 2, 1), ("c", -1, 3)) for x in r.uniform(0, 5, 40)]
    got = trend.ols_interaction(spark.createDataFrame(rows, "g string, x double, y double"), "y", "x", "g").collect()
    assert [t.term for t in got] == ["Intercept", "C(g)[T.b]", "C(g)[T.c]", "x", "x:C(g)[T.b]", "x:C(g)[T.c]"]
    x, y = np.array([v for _, v, _ in rows]), np.array([v for *_, v in rows])
    b, c = (np.array([float(g == k) for g, *_ in rows]) for k in "bc")
    design = np.stack([np.ones_like(x), b, c, x, x * b, x * c], 1)
    coef = np.linalg.solve(design.T @ design, design.T @ y)
    rest = y - design @ coef
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * (rest @ rest) / (len(y) - 6))
    assert [t.coef for t in got] == pytest.approx(coef.tolist()) and [t.se for t in got] == pytest.approx(se.tolist())
    assert got[0].r2 == pytest.approx(1 - rest @ rest / ((y - y.mean()) @ (y - y.mean()))) and got[0].dof == len(y) - 6


def test_figures_are_saved_in_both_formats(tmp_path):
    from quillspark.operators import figures

    class Figure:
        def savefig(self, path, **options):
            assert options == {"bbox_inches": "tight"}
            open(path, "w").close()

    paths = figures.save_figure(Figure(), str(tmp_path / "new"), "kde")
    assert [p.rsplit(".", 1)[1] for p in paths] == ["pdf", "png"] and all((tmp_path / "new" / f"kde.{k}").exists() for k in ("pdf", "png"))


def test_logging_writes_to_a_file_and_leaves_other_loggers_alone(tmp_path):
    import logging

    from quillspark.session import setup_logging

    root = list(logging.getLogger().handlers)
    try:
        log = setup_logging(str(tmp_path / "run.log"), level="DEBUG")
        log.debug("one")
        setup_logging(str(tmp_path / "run.log")).info("two")
        for h in log.handlers:
            h.flush()
        lines = (tmp_path / "run.log").read_text().splitlines()
        assert [x.rsplit(" - ", 1)[1] for x in lines] == ["one", "two"] and "[DEBUG] quillspark" in lines[0]
        assert logging.getLogger().handlers == root and logging.getLogger("py4j").level == logging.WARNING
    finally:
        setup_logging()
