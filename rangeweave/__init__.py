"""rangeweave: self-similarity analysis and coding of one-dimensional signals on Spark."""
