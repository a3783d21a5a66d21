"""A Spark engine for document corpora: search, graphs, statistics, evaluation."""
