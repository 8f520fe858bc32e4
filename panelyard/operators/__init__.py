"""Panel shaping, moments, tests, fits, resampling and replication summaries."""
