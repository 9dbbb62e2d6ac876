"""Candidate matching analytics as Spark DataFrame operators."""
