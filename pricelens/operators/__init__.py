"""DataFrame operators: each takes and returns DataFrames, with no actions inside."""
