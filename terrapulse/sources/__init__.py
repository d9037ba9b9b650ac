"""Readers that normalise landed files to the input contracts, and table sinks."""
