"""Route-candidate source (S7): routes a road router returned, stored as JSON lines.

A route is (trip_id, route_seq, kind, cand_idx, distance [m], duration [s],
path ARRAY<STRUCT<lon, lat>>) - the GeoJSON line geometry in travel order.
The router itself is an external service; its answers are an input table here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
ROUTE_SCHEMA = T.StructType(
    [
        T.StructField("trip_id", T.LongType()),
        T.StructField("route_seq", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("cand_idx", T.IntegerType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("path", T.ArrayType(POINT)),
    ]
)


def write_routes(routes: DataFrame, path: str) -> None:
    routes.select(*ROUTE_SCHEMA.fieldNames()).write.mode("overwrite").json(path)


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an explicit schema (no inference pass)."""
    return spark.read.schema(ROUTE_SCHEMA).json(path)
