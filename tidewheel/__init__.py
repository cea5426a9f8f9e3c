"""Payload inspection, labelled datasets and their evaluation as Spark DataFrame plans."""
