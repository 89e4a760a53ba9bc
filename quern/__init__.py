"""quern: a Spark-first engine for retrieval over text corpora."""
