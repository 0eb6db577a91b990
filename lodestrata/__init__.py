"""Compositional geo-analytics and training-data preparation as Spark plans."""
