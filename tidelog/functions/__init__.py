"""Scalar functions of the storage formats."""
