"""News-trend analytics on Spark: ingest, clean, cluster, score, decay and serve, as DataFrame transformations."""
