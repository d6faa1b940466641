"""Quantitative research, risk and execution analytics as Spark DataFrame operators."""
