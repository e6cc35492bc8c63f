"""Document retrieval on Spark: reading, chunking, stores, indexes and retrieval as DataFrame plans."""
