"""Analytics over timestamped, embedded media: search, ranking, gating, sessions and evaluation on Spark."""
