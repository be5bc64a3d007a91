"""Spark-first engine for building, curating and evaluating speech-transcript and text corpora."""
