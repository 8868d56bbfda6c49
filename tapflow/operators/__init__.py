"""DataFrame operators. Each takes and returns DataFrames with logical column
names; compose them with ``DataFrame.transform`` or plain calls."""
