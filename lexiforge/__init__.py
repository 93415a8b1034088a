"""Corpus analytics on Spark: DataFrame-to-DataFrame operators, sources, search, alerts and evaluation."""
