"""Scalar functions as column builders; all stay inside generated code."""
