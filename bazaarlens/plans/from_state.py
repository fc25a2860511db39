"""Reports that look back over all history, from a state that is kept by month."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from bazaarlens.session import shared_folder
from bazaarlens.sources.marketplace import Marketplace
from bazaarlens.state.activity import ActivityState


def built_state(mk: Marketplace, folder: str | None = None) -> ActivityState:
    """A state of all sales and invoices, in a folder or the shared one of this marketplace: the months that it lacks or
    whose rows have changed are built."""
    state = ActivityState(mk.spark, folder or shared_folder(mk.spark, "activity", mk.name))
    state.update(mk)
    return state


def from_state(report: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A report (marketplace, ..., state=) that first brings the state it reads up to date."""
    return lambda mk, *args: report(mk, *args, state=built_state(mk))
