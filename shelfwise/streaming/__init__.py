"""Change capture and refresh of the stock tables with Structured Streaming."""
