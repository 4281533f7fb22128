"""Training-data operators: cleaning, deduplication, mixing, search and encoding of large text corpora."""
