"""Evidence analytics on Apache Spark: corpora, retrieval, gates, graphs and statistics as DataFrame operators."""
