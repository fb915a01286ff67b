"""The story engine: plain Python and numpy, without Spark."""
