"""Prediction log (S6): entries {timestamp, user, area, input, result}, added batch by batch.

A log folder holds one folder a batch, and in it one a day and part of the users. A batch is written as a whole under its
name, so writing it again (a replayed micro-batch, a repeated job) replaces it instead of doubling it; other batches are
never touched. A reader of one user's entries reads one part of the users, of some days one folder a day.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INPUT_TYPE = T.StructType(
    [
        T.StructField("area", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("date_year", T.IntegerType()),
        T.StructField("date_month", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("victim_age", T.IntegerType()),
        T.StructField("victim_sex", T.StringType()),
    ]
)
TOP_TYPE = T.ArrayType(T.StructType([T.StructField("crim", T.StringType()), T.StructField("probabilitat", T.DoubleType())]))
RESULT_TYPE = T.StructType(
    [
        T.StructField("prediction", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("top_3", TOP_TYPE),
        T.StructField("severity", T.StringType()),
        T.StructField("severity_confidence", T.DoubleType()),
    ]
)
LOG_SCHEMA = T.StructType(
    [
        T.StructField("log_id", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("area", T.StringType()),
        T.StructField("input", INPUT_TYPE),
        T.StructField("result", RESULT_TYPE),
    ]
)
#: The folders of a log, outermost first.
FOLDERS = T.StructType([T.StructField("batch", T.StringType()), T.StructField("day", T.DateType()), T.StructField("user_part", T.IntegerType())])
USER_PARTS = 8


def user_part(user: Column) -> Column:
    """The part of the users that a name lies in."""
    return F.pmod(F.xxhash64(user), F.lit(USER_PARTS)).cast("int")


def entries(scored: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Log entries of scored requests: one schema, whether a batch or a stream scored them.

    ``scored`` carries request_id, user_name, area, lat, lon, year, month, day_of_week, hour, age, sex and a scorer's
    columns; a scorer without ``top_3`` logs none. ``timestamp`` is the time of the entry (default: now).
    """
    given = {"area": "area", "lat": "lat", "lon": "lon", "date_year": "year", "date_month": "month", "day_of_week": "day_of_week", "hour": "hour", "victim_age": "age", "victim_sex": "sex"}
    at = F.current_timestamp() if timestamp is None else timestamp
    cast = lambda fields, names: F.struct(*[(F.col(names.get(f.name, f.name)) if names.get(f.name, f.name) in scored.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    return scored.select(
        F.col("request_id").cast("long").alias("log_id"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("user_name").cast("string").alias("user_name"),
        F.col("area").cast("string").alias("area"),
        cast(INPUT_TYPE, given).alias("input"),
        cast(RESULT_TYPE, {}).alias("result"),
    )


def append_log(log: DataFrame, path: str, batch: str) -> None:
    """Write ``log`` as the batch of that name, in place of an earlier one.

    Rows are dealt by day and part of the users; a part that holds most of the rows is split by size. An entry without a
    readable timestamp lies in a folder for those.
    """
    dealt = log.select(*LOG_SCHEMA.fieldNames(), F.to_date(F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss"))).alias("day"), user_part(F.col("user_name")).alias("user_part"))
    dealt.hint("rebalance", "day", "user_part").write.mode("overwrite").partitionBy("day", "user_part").parquet(f"{path}/batch={batch}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole log with its schema and folders (empty when the folder does not exist)."""
    schema = T.StructType([*LOG_SCHEMA.fields, *FOLDERS.fields])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # a missing log is an empty log
            raise
        return spark.createDataFrame([], schema)
