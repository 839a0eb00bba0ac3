"""cellweave: time-series analytics over stacks of rasters, on PySpark."""

__version__ = "0.1.0"
