"""Histograms of a stream of objects."""
