"""Dense numbers and bitmaps: counts that add up over months are those of COUNT DISTINCT."""

import datetime as dt

from pyspark.sql import functions as F

from bazaarlens.plans import distinct_spans
from bazaarlens.state.distinct import DistinctState, Numbers, bitmaps, count_distinct_numbers
from test_state import LATE, SALES, market


def test_numbers_are_dense_and_stay(spark, tmp_path):
    numbers = Numbers(spark, str(tmp_path))
    assert numbers.table().count() == 0
    first = spark.range(1000).select((F.col("id") % 600).alias("k")).repartition(7)
    numbers.extend(F.col("k"), first.union(spark.sql("SELECT CAST(NULL AS BIGINT)")))
    before = {r.key: r.number for r in numbers.table().collect()}
    assert sorted(before.values()) == list(range(1, 601))
    numbers.extend(F.col("k"), first)
    numbers.extend(F.col("id"), spark.range(590, 700))
    after = {r.key: r.number for r in numbers.table().collect()}
    assert sorted(after.values()) == list(range(1, 701)) and before.items() <= after.items()


def test_bitmaps_across_buckets(spark):
    rows = spark.range(200_000).select((F.col("id") * 7 % 99_991 + 1).alias("number"), (F.col("id") % 3).alias("g"))
    parts = bitmaps(rows, "g")
    assert parts.count() == 3 * 4
    want = {r.g: r.n for r in rows.groupBy("g").agg(F.count_distinct("number").alias("n")).collect()}
    assert {r.g: r["keys"] for r in count_distinct_numbers(parts, "g").collect()} == want
    assert count_distinct_numbers(parts).first()["keys"] == rows.select("number").distinct().count()


def test_months_merged_one_by_one(spark, tmp_path):
    start, end = dt.date(1998, 1, 1), dt.date(1998, 6, 1)
    before, after = market(spark, SALES), market(spark, SALES + LATE)
    state = DistinctState(spark, str(tmp_path))
    for m in (3, 1, 3):
        state.refresh(before, dt.date(1998, m, 1), dt.date(1998, m + 1, 1))
    state.update(after)
    found = distinct_spans.stores_and_invoices(after, start, end, (1, 2, 4), state).collect()
    rows = after.table("sales", "invoice_id", "buyer_id", "seller_id", "invoice_status", "seller_signed_on").collect()
    booked = [r for r in rows if r.invoice_status in ("COMPLETED", "PENDING") and r.seller_signed_on]
    assert len(found) == 18
    for f in found:
        mine = [r for r in booked if f.first_month <= r.seller_signed_on.date().replace(day=1) <= f.last_month]
        assert f.stores == len({s for r in mine for s in (r.buyer_id, r.seller_id) if s is not None})
        assert f.invoices == len({r.invoice_id for r in mine if r.invoice_id is not None})
