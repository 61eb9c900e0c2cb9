"""opsframe: observability analytics on DataFrames."""
