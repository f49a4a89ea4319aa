"""Relational operators around the geometry frame."""

from ..frame import asof

__all__ = ["asof"]
