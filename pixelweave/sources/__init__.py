"""Readers and writers of rasters, stacks and network lists."""
