"""Reading, stored intermediate tables and word expressions shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the space and U+0009 to U+000D.
SPACES = " \t\n\u000b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add, whatever their case."""
    lost = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lost])


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, as in tests on one machine, a new one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    The rows are fixed from then on, a lost executor costs a re-read and no derivation, and joins are planned by the real size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A side of so many rows of a few numbers may be broadcast: some tens of MB. Larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """``df`` (a few numbers a row), to be broadcast if its rows, which are counted, are at most ``BROADCAST_ROWS``."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` evaluated once, also where ``body`` uses it inside lambda functions."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
