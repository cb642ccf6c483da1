"""The opN_ queries on the smallest test tables against plain Python: columns, digests and span strings."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from quillspark.llm import licenses, queries, sql
from quillspark.llm.queries import tokenizer_file

from .brute import brute_components, shingle_set, split
from .test_documents import COLUMNS, base_pii, base_secrets, base_statistics

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{DIR}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], t["source"], strict=True))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def run(spark, name):
    return queries.queries()[name](spark, DIR).collect()


def test_op1(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op1_quality_rules")}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        s = base_statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        assert (*(got[i][c] for c in COLUMNS), got[i].base_failed) == (*s, failed)
        assert not (failed and got[i].kept)
    assert 0.5 < sum(r.kept for r in got.values()) / len(got) < 1


def test_op2_and_op3(spark, docs):
    for name, base, kinds in (("op2_personal_data", base_pii, ("email", "ip", "card", "phone")), ("op3_secret_scan", base_secrets, ("assign", "access", "hex"))):
        got = {r.doc_id: r for r in run(spark, name)}
        for i, t, _ in docs:
            want = base(t or "")
            r = got[i]
            assert r.base_sha256 == sha(",".join(want))
            assert [r[f"n_{k}"] for k in kinds] == [sum(s.startswith(f"{k}:") for s in want) for k in kinds]
            spans = r.spans.split(",") if r.spans else []
            assert [s for s in spans if s.split(":")[0] in kinds] == want
            if name == "op2_personal_data":
                assert len(r.scores.split(",")) == len(spans) or not spans


def test_op4(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op4_jaccard_join")}
    rows = [(i, t) for i, t, _ in docs]
    assert {i: r.component_id for i, r in got.items()} == brute_components(rows)
    sets = {i: shingle_set(t) for i, t in rows}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    distinct = set(sets.values())
    assert {i: r.n_links for i, r in got.items()} == {i: sum(1 for x in distinct if x and s and x != s and 100 * len(s & x) >= 90 * len(s | x)) for i, s in sets.items()}


def test_op5(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op5_source_mixing")}
    again = {r.doc_id: r.taken for r in run(spark, "op5_source_mixing")}
    assert again == {i: r.taken for i, r in got.items()}
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for i, t, source in docs:
        r = got[i]
        assert r.size == len(split(t or "")) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
        size[source] += r.size
        target[source] = r.target
    assert {i: r.source_size for i, r in got.items()} == {i: size[s] for i, _, s in docs}
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 128 for s in target)


def test_op6(spark, docs):
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    bag = lambda t: [*split((t or "").lower() if (t or "").isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t)), None]
    seen = collections.Counter(w for i, t, _ in docs if not out(i) for w in bag(t))
    total, distinct = sum(seen.values()), len(seen)
    for r in run(spark, "op6_suffix_tree_scoring"):
        b = bag(next(t for i, t, _ in docs if i == r.doc_id))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(b), sum(seen[w] > 0 for w in b), total)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in b), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_op7(spark):
    t = pq.read_table(f"{DIR}/embeddings.parquet").to_pydict()
    ok = [(i, np.array(v, float)) for i, v in zip(t["vec_id"], t["embedding"], strict=True) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, v = np.array([i for i, _ in ok]), np.stack([x for _, x in ok])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    got = collections.defaultdict(list)
    for r in sorted(run(spark, "op7_nearest_neighbours"), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    hits = n = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        best = [x for x in np.lexsort((ids, -s.round(12))) if x != q][:5]
        found = got.pop(int(ids[q]))
        assert [x for _, x in found] == sorted((x for _, x in found), reverse=True) and len(found) == 5
        hits, n = hits + len({int(ids[x]) for x in best} & {i for i, _ in found}), n + 5
    assert not got and hits / n >= 0.9


def test_op9(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    got = {r.doc_id: r for r in run(spark, "op9_sentencepiece")}
    for i, t, _ in docs:
        ids = library.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_op10(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op10_license_scan")}
    for i, t, _ in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and 0 <= r.score <= 1
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.execute(sql.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in run(spark, name))
    assert got == collections.Counter(tuple(map(plain, r)) for r in want.fetchall())
