"""Colour statistics of multi-band time series, as Spark DataFrame transformations."""
