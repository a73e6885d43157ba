"""Analytics over stacks of co-registered raster time-series, expressed with Spark DataFrames."""
