"""Session analytics on Spark: ingest, search, recall, graph, rollups and stores as DataFrame functions."""
