"""The same jobs driven by Structured Streaming."""
