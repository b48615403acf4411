"""Vector analytics on Spark: exact and approximate nearest-neighbour graphs, and the operators around them."""

__version__ = "0.1.0"
