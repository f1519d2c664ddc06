"""Data-quality rules on Spark DataFrames: fused row checks, integrity checks, profiles, streams."""

__version__ = "0.1.0"
