"""urbanlens: Spark-native analytics over geolocated, timestamped incident records.

Every operator is a ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions``, ``Window`` and ``pyspark.ml``; no session is created
inside the library (see :mod:`urbanlens.session` for the one helper that does).
"""

__all__ = ["session"]
