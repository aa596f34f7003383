"""Hybrid retrieval over text on Spark: chunk, embed, index, search by batches, fuse, re-rank, evaluate."""
