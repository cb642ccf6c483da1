"""Sessions with the settings the operators rely on, and logging."""

from __future__ import annotations

import logging
import logging.config

from pyspark.sql import SparkSession


def get_session(app: str = "quillspark", **settings: str) -> SparkSession:
    """A session in UTC with adaptive planning; ``settings`` (dots as double underscores) win."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def setup_logging(log_file: str | None = None, level: str = "INFO", quiet: tuple[str, ...] = ("py4j",)) -> logging.Logger:
    """The logger of this package, set to write to standard error and, appending, to ``log_file``.

    Only this package's logger is configured, so that an application keeps its own; those
    named by ``quiet`` speak from warnings on.
    """
    sinks = {"console": {"class": "logging.StreamHandler", "formatter": "line"}}
    if log_file:
        sinks["file"] = {"class": "logging.FileHandler", "formatter": "line", "filename": log_file, "encoding": "utf-8"}
    logging.config.dictConfig(
        {
            "version": 1,
            "disable_existing_loggers": False,
            "formatters": {"line": {"format": "%(asctime)s [%(levelname)s] %(name)s - %(message)s"}},
            "handlers": sinks,
            "loggers": {"quillspark": {"level": level, "handlers": list(sinks), "propagate": False}} | {name: {"level": "WARNING"} for name in quiet},
        }
    )
    return logging.getLogger("quillspark")
