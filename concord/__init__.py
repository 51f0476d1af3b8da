"""Search, statistics and lexicon operators for text corpora, planned as Spark DataFrames."""
