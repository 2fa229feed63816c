"""Scalar, aggregate, window, vector and geography functions as builders of Columns."""
