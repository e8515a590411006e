"""A Spark-first engine for chunking, indexing, retrieving and evaluating text."""
