"""Governed binary classification on Spark tables and streams."""
