"""Document-to-quiz analytics and corpus processing on PySpark DataFrames."""

__version__ = "0.1.0"
