"""Spark jobs over panels of sensor readings, and operators for training corpora."""
