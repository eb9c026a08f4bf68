"""foliolake: a Spark-first engine for scanned-document processing data."""
