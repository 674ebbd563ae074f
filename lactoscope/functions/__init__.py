"""Scalar expressions of the model, all native Spark columns."""
