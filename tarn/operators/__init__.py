"""DataFrame operators: alignment, time series, aggregates, metrics, pixels, chips, geography, graphs."""
