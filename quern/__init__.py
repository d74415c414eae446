"""quern: a Spark-first engine that prepares and measures text corpora."""
