"""Source-traced entity tables for many topics at once, on DataFrames."""
