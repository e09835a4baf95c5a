"""barloom: market-bar ingestion, validation and publication on Spark."""

__version__ = "0.1.0"
