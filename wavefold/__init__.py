"""Wavefold: layered analytics over many ordered signals, on Spark DataFrames."""

__version__ = "0.1.0"
