"""Evidence analytics on Spark: text rules, retrieval, rewriting and the analyses store."""
