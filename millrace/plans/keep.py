"""Intermediate results that several steps of one query read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``); only a session on one machine may do without that setting."""
    _ensure(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/millrace-{name}-{uuid.uuid4().hex}"


def _ensure(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no shared folder for intermediate results")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-millrace-"))


def kept(frame: DataFrame) -> DataFrame:
    """The frame computed once, as compressed files in the session's shared folder (``spark.checkpoint.dir``).

    Only a session on one machine may do without that setting; elsewhere it is an error.
    """
    place = folder(frame.sparkSession, "kept")
    frame.write.parquet(place)
    return frame.sparkSession.read.schema(frame.schema).parquet(place)
