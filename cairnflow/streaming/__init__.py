"""The same transformations on Structured Streaming."""
