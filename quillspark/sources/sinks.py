"""Writing stage tables and small result tables."""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_QUILLSPARK_CONFIG"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder, a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='quillspark-')).rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_stage(df: DataFrame, path: str, fingerprint: str) -> DataFrame:
    """Write a stage table with the fingerprint of its configuration, and read it back."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(fingerprint,)], "fingerprint string").coalesce(1).write.mode("overwrite").text(f"{path}/{MARK}")
    return spark.read.parquet(path)


def stage_is_current(spark: SparkSession, path: str, fingerprint: str) -> bool:
    """Whether a complete stage table made with this configuration is there, in any file system Spark reads."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/{MARK}")
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")) and fs.exists(mark)
    return bool(done) and [r.value for r in spark.read.text(f"{path}/{MARK}").collect()] == [fingerprint]


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table as CSV files with a header in the folder ``path``."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def to_plain(value: Any) -> Any:
    """``value`` for JSON: rows become objects, NaN and infinities null."""
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=False)
    if isinstance(value, dict):
        return {k: to_plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(result: Any, path: str) -> None:
    """A nested result of Python values and rows as indented JSON on the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(to_plain(result), f, indent=2, ensure_ascii=False, allow_nan=False)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON string, for results too large for the driver."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


_ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escape(text: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in text)


def to_latex(df: DataFrame, caption: str, label: str, formats: dict[str, str | Callable[[Any], str]] | None = None, headers: dict[str, str] | None = None) -> str:
    """A small table as a LaTeX float. Integers get thousands separators; ``formats`` overrides per column; nulls show as --."""
    formats, headers = formats or {}, headers or {}

    def show(column: str, value: Any) -> str:
        if value is None or isinstance(value, float) and math.isnan(value):
            return "--"
        how = formats.get(column)
        if callable(how):
            return how(value)
        if how is not None:
            return format(value, how)
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return latex_escape(str(value))
        return f"{value:,}" if isinstance(value, int) else f"{value:.4f}"

    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "double", "float", "short")}
    body = [" & ".join(show(c, r[c]) for c in df.columns) + r" \\" for r in df.collect()]
    return "\n".join(
        [
            r"\begin{table}[ht]",
            r"\centering",
            rf"\caption{{{latex_escape(caption)}}}",
            rf"\label{{{label}}}",
            rf"\begin{{tabular}}{{{''.join('r' if c in numeric else 'l' for c in df.columns)}}}",
            r"\hline",
            " & ".join(latex_escape(headers.get(c, c)) for c in df.columns) + r" \\",
            r"\hline",
            *body,
            r"\hline",
            r"\end{tabular}",
            r"\end{table}",
            "",
        ]
    )
