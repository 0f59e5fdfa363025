"""Check and measure message relays with Spark DataFrames and Structured Streaming."""
