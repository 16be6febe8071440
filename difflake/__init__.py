"""Spark jobs over code patches, model responses, run logs and scores."""
