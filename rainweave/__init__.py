"""Rainfall sensor fusion as DataFrame-to-DataFrame functions on Spark."""
