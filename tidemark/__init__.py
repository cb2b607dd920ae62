"""Tidemark: DataFrame operators for corpora of event sequences on Apache Spark."""
