"""Operators of a training-data pipeline; each module holds one and states its results for odd input."""
