"""DataFrame operators for assistant-usage and engineering-text analytics on Spark."""

__version__ = "0.1.0"
