"""Buyer savings of one line against the list price. The two reports treat gaps differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.functions.ratios import filled


def savings_strict(quantity: Column, unit: Column, package: Column, price: Column) -> Column:
    """Partial only for a quantity above 0; any missing price gives NULL."""
    return F.when(quantity > 0, unit * quantity - price).otherwise(package - price)


def savings_lenient(quantity: Column, unit: Column, package: Column, price: Column) -> Column:
    """Partial for every known quantity, 0 included; a missing price counts as 0."""
    partial = filled(quantity) * filled(unit)
    return F.when(quantity.isNull(), filled(package) - filled(price)).otherwise(partial - filled(price))
