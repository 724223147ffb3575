"""Differential-abundance analysis of compositional count tables as Spark DataFrame operators."""

__version__ = "0.1.0"
