"""pairloom: DataFrame operators for text pairs, vectors and events on Spark."""

__version__ = "0.1.0"
