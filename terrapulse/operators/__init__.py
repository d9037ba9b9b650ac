"""DataFrame-to-DataFrame operators (joins, windows, aggregations)."""
