"""Marketplace analytics as PySpark DataFrame plans."""

from bazaarlens.sources.marketplace import Marketplace

__all__ = ["Marketplace"]
