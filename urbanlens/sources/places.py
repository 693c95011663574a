"""Place lookup (S8, P19): typed addresses -> coordinates through a gazetteer table.

The external geocoding service is replaced by a left equi-join on the
normalised address key; results outside the city box are rejected as the
service client does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanlens.functions import coords, text, vocab

NOT_FOUND = vocab.PLACE_NOT_FOUND
OUTSIDE = vocab.PLACE_OUTSIDE


def place_lookup(requests: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Per request: address key, search text, found flag, coordinates (inside the box only), error text.

    Each distinct key is looked up once (the gazetteer is reduced to one
    entry per key first); requests sharing a key share the answer.
    """
    gz = gazetteer.groupBy("address_key").agg(F.min(F.struct("lat", "lon")).alias("g"))
    req = requests.select("request_id", "address", text.address_key(F.col("address")).alias("address_key"),
                          text.search_text(F.col("address")).alias("search_text"))
    j = req.join(gz, "address_key", "left")
    lat, lon = F.col("g.lat"), F.col("g.lon")
    inside = lat.isNotNull() & coords.in_city_box(lat, lon)
    return j.select(
        "request_id", "address_key", "search_text",
        F.coalesce(inside, F.lit(False)).alias("found"),
        F.when(inside, lat).alias("lat"),
        F.when(inside, lon).alias("lon"),
        F.when(lat.isNull(), F.lit(NOT_FOUND)).when(~inside, F.lit(OUTSIDE)).alias("error"),
    )
