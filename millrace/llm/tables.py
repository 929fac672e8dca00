"""Reading the given tables and keeping intermediate ones in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a longest run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; columns that the table has besides are not read."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``, or the checkpoint folder set on
    its context. Only a session on one machine (``local[n]``) may do without; elsewhere an
    unset folder is an error, since executors could not see a local one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            folder = given.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            folder = tempfile.mkdtemp(prefix="spark-millrace-")
            context.setCheckpointDir(folder)
        else:
            raise ValueError("spark.checkpoint.dir names no shared folder for intermediate tables")
    return f"{folder.rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read back.

    This computes it once and cuts its lineage; the table outlives lost executors.
    """
    spark = frame.sparkSession
    path = shared_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_of(column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def widened(schema: T.StructType, *columns: str) -> T.StructType:
    """The schema with more columns, each given as "name type"; the schema itself stays as it is."""
    return T.StructType([*schema.fields, *(field for c in columns for field in T.StructType.fromDDL(c).fields)])
