"""Query workload: the library applied to the driver tables, with oracle SQL."""
