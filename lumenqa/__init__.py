"""Spark-native retrieval, judging, curation and evaluation analytics over question-answer corpora."""
