"""Relational operators: chunking, indexes, retrieval, merging of overlaps, crawling."""
