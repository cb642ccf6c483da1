"""Neighbours, conversations and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from quillspark.llm import chat, neighbours

from .brute import brute_components, prose

# --- neighbours


def brute_nearest(ids, vectors, asked, k):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    out = {}
    for q in asked:
        score = np.round(unit @ unit[q], 12)
        others = [i for i in range(len(ids)) if ids[i] != ids[q]]
        out[int(ids[q])] = [int(ids[i]) for i in sorted(others, key=lambda i: (-score[i], ids[i]))[:k]]
    return out


def test_recall_and_scores(spark, monkeypatch):
    for name, value in (("CELL_ROWS", (64, 256)), ("SAMPLE", 300), ("TOGETHER", 7), ("LEAF", 16)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(0)
    v = r.standard_normal((1500, 32)).astype(np.float32)
    v[100:500] = v[100]  # copies, more than a cell holds: ties go to the smaller id
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for x in neighbours.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.vec_id)
        a, b = v[x.query_id].astype(float), v[x.vec_id].astype(float)
        assert x.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
    want = brute_nearest(np.arange(1500), v.astype(float), range(0, 1500, 50), 5)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert got.keys() == want.keys() and hits / (5 * len(want)) >= 0.9
    assert all(len(x) == 5 for x in got.values())
    assert got[100] == [101, 102, 103, 104, 105] and got[150] == [100, 101, 102, 103, 104]


def test_close_neighbours_take_few_comparisons(spark, monkeypatch):
    for name, value in (("CELL_ROWS", (128, 128)), ("SAMPLE", 1024), ("LEAF", 16)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(1)
    v = np.repeat(r.standard_normal((150, 32)), 10, axis=0) + 0.02 * r.standard_normal((1500, 32))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    want = brute_nearest(np.arange(1500), v, range(0, 1500, 50), 5)
    assert sum(x.vec_id in want[x.query_id] for x in got) / 150 >= 0.9
    assert sum(x.verified for x in got if x["rank"] == 1) < 0.5 * 30 * 1500


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (50, [0.0, 2.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as score", "2 as rank")
    got = [(x.query_id, x["rank"], x.vec_id) for x in neighbours.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6), (0, 2, 50), (50, 1, 6), (50, 2, 0), (50, 3, 0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_chi_square_quantile_of_many_degrees():
    assert neighbours.chi_square_quantile(0.95, 16) == pytest.approx(26.296, rel=1e-4)


# --- conversations


def test_escapes_are_reversible_and_hide_markers(spark):
    r = random.Random(6)
    bits = ["\\", "#", "##", "###", "<", "/turn>", "</turn>", "</turn>\n", "\n", ": ", "### user: ", "é", "$1", ""]
    said = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string").withColumn("e", chat.escape(chat.F.col("t")))
    for x in df.withColumn("u", chat.unescape(chat.F.col("e"))).collect():
        assert x.u == x.t and "</turn>" not in x.e and "###" not in x.e


def test_conversations_read_back(spark):
    r = random.Random(7)
    bits = ["hi", " ", "\\", "### assistant: x", "</turn>\n", "\n", "é🎉", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", "a:b\\", None]), "".join(r.choice(bits) for _ in range(r.randint(0, 6))) if r.random() > 0.1 else None) for c in range(30) for t in range(r.randint(1, 9))]
    rows += [(40, t, "assistant", f"turn {t}") for t in range(700)] + [(41, 0, "user", "same"), (41, 0, "user", "same"), (None, 0, "user", "x"), (42, None, "user", "first"), (42, -3, "assistant", "second")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'clash' as n", "'clash' as message_id", "'clash' as chunk")
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    for x in chat.format_conversations(df).collect():
        turns = [(role, text) for _, _, role, text in sorted(want.pop(x.conv_id))]
        assert [(m.role, m.text) for m in x.messages] == turns and x.n_turns == len(turns)
        assert x.loss_text == "".join(text for role, text in turns if role == "assistant")
        for (role, text), t in zip(turns, x.turns, strict=True):
            masked = x.formatted[t.loss_start : t.loss_end]
            assert re.sub(r"\\(\\)?", r"\1", masked) == (text if role == "assistant" else "")
        assert x.turns[-1].end == len(x.formatted)
    assert not want
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_many_rows_of_one_turn_and_a_long_text(spark):
    rows = [(1, 0, "assistant", f"row {i:05d}") for i in range(20_000)] + [(2, 0, "user", "w " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {x.conv_id: x for x in chat.format_conversations(df).collect()}
    assert got[1].loss_text == "".join(t for _, _, _, t in rows[:-1]) and got[1].turns[-1].end == len(got[1].formatted)
    assert got[2].messages[0].text == rows[-1][3]


def test_the_log_of_a_table_needs_the_fold(spark):
    df = spark.createDataFrame([(1, 0, "user", "x" * 450), (1, 1, "assistant", "answer")], "conv_id int, turn int, role string, text string")
    log = chat.conversation_events(df).collect()
    assert collections.Counter(e.kind for e in log) == {"message": 2, "delta": 6, "edit": 1, "regenerate": 1}
    assert "".join(e.text for e in log if e.turn == 1) != "answer"


def test_events_fold(spark):
    log = [
        (1, "m1", 0, 1, "message", "user", "he"), (1, "m1", 0, 2, "delta", "user", "llo"),
        (1, "m2", 1, 5, "message", "assistant", "wrong"), (1, "m2", 1, 8, "delta", "assistant", "!"), (1, "m2", 1, 7, "regenerate", "assistant", None), (1, "m2", 1, 9, "delta", None, " ok"),
        (1, "m3", 2, 10, "message", "user", "a"), (1, "m3", None, 12, "edit", None, "b"), (1, "m3", None, 11, "delta", None, "lost"), (1, "m3", None, 13, "noise", None, "x"),
        (1, "m4", 3, 14, "delta", "assistant", "only "), (1, "m4", 3, 15, "delta", "assistant", "deltas"),
    ]
    df = spark.createDataFrame(log, "conv_id int, message_id string, turn int, seq int, kind string, role string, text string")
    got = {x.message_id: (x.turn, x.role, x.text) for x in chat.fold_events(df).collect()}
    assert got == {"m1": (0, "user", "hello"), "m2": (1, "assistant", "! ok"), "m3": (2, "user", "b"), "m4": (3, "assistant", "only deltas")}


# --- the pipeline


def test_pipeline_equals_its_operators_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    from quillspark.llm import quality, secrets
    from quillspark.llm.queries import tokenizer_file

    rows = [(i, prose(i, 60 + i % 40), "en", f"src{i % 3}", 1) for i in range(90)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "src0", 1) for i in range(10)]
    rows += [(200, " ".join(w + "$$#%" for w in rows[0][1].split()), "en", "src0", 1), (201, "too short", "en", "src1", 1), (202, rows[40][1] + " password=hunter22222", "en", "src1", 1), (203, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    assert {200, 201, 203}.isdisjoint(good) and len(good) >= 95
    kept = [(i, t) for i, t, *_ in rows if i in good]
    group = brute_components(kept)
    alive = {i: secrets.redact_text(t) for i, t in kept if group[i] == i}
    assert not alive.keys() & set(range(100, 110))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    for x in got:
        ids = library.encode(alive[x.doc_id])
        assert list(x.ids) == ids and x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    source = {i: s for i, _, _, s, _ in rows}
    taken, size = collections.Counter(), collections.Counter()
    for x in got:
        taken[source[x.doc_id]] += len(alive[x.doc_id].split())
    for i, t in alive.items():
        size[source[i]] += len(t.split())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)
    assert max(collections.Counter(x.doc_id for x in got).values()) <= 2
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "SentencePiece encoding and decoding"]


def test_stages_keep_columns_and_survive_nothing(spark, documents):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, "").columns == documents.columns
        assert stage(spark, documents.limit(0), "").count() == 0
