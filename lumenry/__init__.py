"""Lumenry: a schedule-extraction and training-data engine expressed as Spark jobs."""
