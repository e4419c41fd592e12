"""eddyline: events in gridded time series, found and followed with Spark DataFrames."""
