"""Spark jobs over tables of timed captions: features, evidence windows, segments, reports."""
