"""Document analytics on Spark: cells, retrieval, cited arithmetic, verification, evaluation and training sets."""
