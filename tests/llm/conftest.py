import pytest

from .brute import prose


@pytest.fixture(scope="session")
def documents(spark):
    """A small corpus with the awkward cases: nulls, blanks, repeats, a long text, clashing column names."""
    rows = []
    for i in range(120):
        text = prose(i, 60 + i)
        if i % 9 == 0:
            text = " ".join(w + "$$#" for w in text.split())
        if i % 10 == 1:
            text = prose(i - 1, 60 + i - 1) + " extra"
        rows.append((i, text, ["en", "de", None][i % 3], [None, "src0", "src1"][i % 3 if i % 4 else 1], len(text)))
    rows += [(200, None, "en", "src0", None), (201, "", "en", "src0", 0), (202, " \n\t ", None, None, 4), (203, prose(7, 30_000), "en", "src0", 1), (5, rows[5][1], rows[5][2], rows[5][3], rows[5][4]), (None, prose(3, 63), "en", "src0", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("size", "taken", "rows", "id", "n", "block", "u", "v", "grp", "bin", "component_id", "kept", "pii", "spans", "key", "row", "word")}).cache()
