"""Query and data-processing engine for large genetic association statistics, on Spark."""

__version__ = "0.1.0"
