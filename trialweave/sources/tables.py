"""Schemas, readers and sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Input schema of the driver's event table and of stored trials.
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
TRIALS = "Name STRING, Date DATE, SessionNum INT, TrialNumber INT, DV DOUBLE, DVstr STRING, calcStimulusTime DOUBLE, " \
    "LeftRewarded BOOLEAN, ChoiceCorrect INT, ChoiceLeft INT, valid BOOLEAN"
TRACES = "ShortName STRING, set_name STRING, trace_id STRING, frame BIGINT, v DOUBLE"

# Codes of stimulated or recorded brain regions, and the names shown for three of them.
BRAIN_REGIONS = {
    1: "V1_L", 2: "V1_R", 3: "V1_Bi", 4: "ALM_L", 5: "ALM_R", 6: "ALM_Bi", 7: "PPC_L", 8: "PPC_R", 9: "PPC_Bi",
    10: "POR_L", 11: "POR_R", 12: "POR_Bi", 13: "M2_L", 14: "M2_R", 15: "M2_Bi", 16: "RSP_L", 17: "RSP_R", 18: "RSP_Bi",
    19: "S1_L", 20: "S1_R", 21: "S1_Bi", 22: "M1_L", 23: "M1_R", 24: "M1_Bi", 100: "Pulses",
}
REGION_ALIASES = {"ALM_Bi": "LFC", "M2_Bi": "MFC", "Pulses": "0% Evidence"}


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Stored trials; NaN in measured columns becomes NULL."""
    df = spark.read.schema(TRIALS).parquet(path)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("DV", "calcStimulusTime")})


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(path)


def region_names(spark: SparkSession) -> DataFrame:
    """Dimension table of the fixed region codes (25 rows)."""
    rows = [(c, n, REGION_ALIASES.get(n, n)) for c, n in BRAIN_REGIONS.items()]
    return spark.createDataFrame(rows, "code INT, region STRING, shown STRING")


_STORED: dict[tuple[str, str], T.StructType] = {}


def shared_dir(spark: SparkSession) -> str | None:
    """Folder named by ``spark.checkpoint.dir``, which every executor sees; None where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else None


def stored(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per application to the shared folder and read from there; a plain view without that folder.

    Readers get column pruning, filter push-down and real sizes for join planning, and a lost executor costs a re-read rather
    than the derivation. The key names the source, which must not change within an application.
    """
    folder = shared_dir(spark)
    if folder is None:
        return build()
    app = spark.sparkContext.applicationId
    path = f"{folder}/trialweave/{app}/{hashlib.md5(key.encode()).hexdigest()}"
    if (app, key) not in _STORED:
        df = build()
        df.write.mode("overwrite").parquet(path)
        _STORED[app, key] = df.schema
    return spark.read.schema(_STORED[app, key]).parquet(path)


def output_dir(spark: SparkSession) -> str:
    """Where results of the application go by default: the shared folder, else the warehouse."""
    folder = shared_dir(spark) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{folder}/trialweave/{spark.sparkContext.applicationId}"


def cached_or_compute(spark: SparkSession, key: str, build: Callable[[], DataFrame], folder: str) -> DataFrame:
    """Read the table stored under ``key`` in ``folder``; compute and store it first when absent."""
    path = f"{folder}/cache_{hashlib.md5(key.encode()).hexdigest()}"
    build().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


#: Folders of a result sink: subjects are dealt to them by a hash.
RESULT_FOLDERS = 64


def result_folder(by: Column) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(RESULT_FOLDERS)).cast("int")


def write_results(df: DataFrame, path: str, by: str = "Name", files_per_folder: int = 1, rows_per_file: int = 5_000_000):
    """Rows by subject in ``RESULT_FOLDERS`` folders (``folder``), a subject's rows in one of them and in order of the subject.

    The number of files grows with the rows and not with the subjects; a folder's rows may be spread over several files.
    """
    dealt = df.withColumns({"folder": result_folder(F.col(by)), "__f": F.pmod(F.xxhash64(*df.columns), F.lit(files_per_folder))})
    dealt = dealt.repartition("folder", "__f").drop("__f").sortWithinPartitions("folder", by)
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("folder").parquet(path)


def read_results(spark: SparkSession, path: str, schema: str, by: str = "Name", only: str | None = None) -> DataFrame:
    """Stored results, or those of the subject ``only``, for which one folder is read."""
    df = spark.read.schema(f"{schema}, folder INT").parquet(path)
    if only is not None:
        df = df.where((F.col("folder") == result_folder(F.lit(only))) & (F.col(by) == only))
    return df.drop("folder")
