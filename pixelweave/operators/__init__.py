"""Operators over raster time-series: plain functions from DataFrames to DataFrames."""
