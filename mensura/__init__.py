"""Spark jobs for measured values in scientific text: corpus, extraction, evaluation."""
