"""Datasets and their operators."""

from quern.operators.dataset import Dataset, Explode, Single, explode

__all__ = ["Dataset", "Explode", "Single", "explode"]
