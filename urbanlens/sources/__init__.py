"""Incident sources and sinks: CSV scan, curated parquet, route and log tables, place lookup, stand-in inputs."""
