"""Spark-first corpus topic engine: ingest, clean, link, cluster, cover, explore, publish."""
