"""Format-aware lossless compression of columns, arrays and byte streams on PySpark DataFrames."""

__version__ = "0.1.0"
