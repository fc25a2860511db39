"""Plans without a day are about today, in the reader's zone."""

import datetime as dt

import pytest

from bazaarlens.functions import dates
from bazaarlens.plans import overview, snapshot
from shop import row, shop


class Clock(dt.datetime):
    """One hour into the first of April in UTC: still March in Los Angeles, April in Tokyo."""

    @classmethod
    def now(cls, tz=None):
        return dt.datetime(1998, 4, 1, 1, tzinfo=dt.timezone.utc).astimezone(tz)


@pytest.mark.parametrize("zone,sales", [(None, 100), ("America/Los_Angeles", 100), ("Asia/Tokyo", 0)])
def test_zone_of_the_admin_tile(spark, monkeypatch, zone, sales):
    mk = shop(spark, sales=[{}], invoices=[{}], invoice_items=[{}], carts=[{}], users=[{}])
    monkeypatch.setattr(dates.dt, "datetime", Clock)
    found = overview.admin_metrics(mk, **({"zone": zone} if zone else {}))
    monkeypatch.undo()
    assert row(found)["total_sales"] == sales


def test_tiles_without_a_day(spark, monkeypatch):
    mk = shop(spark, sales=[{"seller_signed_on": dt.datetime(1998, 3, 31, 12)}])
    monkeypatch.setattr(dates, "today", lambda zone: dt.date(1998, 3, 31) if zone == "UTC" else dt.date(1998, 4, 1))
    assert row(snapshot.mtd_aov(mk))["aov_current"] == 100
    assert row(snapshot.mtd_aov(mk, zone="Asia/Tokyo"))["aov_current"] == 0
    assert row(snapshot.mtd_aov(mk, dt.date(1998, 3, 31)))["aov_current"] == 100
