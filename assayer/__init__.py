"""Table-in, table-out data quality, cleaning and model assessment on Spark."""

__version__ = "0.1.0"
