"""Metamorphic testing of text models as Spark DataFrame jobs."""
