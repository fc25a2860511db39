"""Positions, shares of totals, and report sets that are published as a whole."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators.positions import with_position
from bazaarlens.operators.shares import with_total
from bazaarlens.plans.investor import FACTS
from bazaarlens.sinks import workbook
from bazaarlens.sinks.published import ReportSet, Sheet
from shop import shop

RANGE = (dt.date(1998, 1, 1), dt.date(1998, 4, 30))


def market(spark, *more):
    sales = [{}, {"invoice_id": 2, "buyer_id": 3, "subtotal": "1234.56"}, {"invoice_id": 3, "seller_signed_on": dt.datetime(1998, 1, 5)}]
    sales += more
    items = [{"invoice_item_id": str(r.get("invoice_id", 1)), "invoice_id": r.get("invoice_id", 1)} for r in sales]
    return shop(spark, sales=sales, invoice_items=items, posts=[{}], drugs=[{}])


def test_positions(spark):
    rows = spark.range(5000).select((F.col("id") * 37 % 1000).alias("v"), (F.col("id") % 3).alias("g"), F.col("id").alias("i"))
    # half of the rows in one group, and a group without name
    rows = rows.withColumn("g", F.when(F.col("i") % 2 == 0, 7).when(F.col("g") > 0, F.col("g"))).repartition(5)
    order = [F.desc("v"), F.asc("i")]
    found = with_position(rows, order).collect()
    want = sorted(((r.v, r.g, r.i) for r in rows.collect()), key=lambda r: (-r[0], r[2]))
    assert [tuple(r)[1:] for r in sorted(found, key=lambda r: r.position)] == want
    assert sorted(r.position for r in found) == list(range(1, 5001))
    for r in with_position(rows, order, ["g"]).collect():
        assert r.position == 1 + sum(1 for v, g, i in want if g == r.g and (-v, i) < (-r.v, r.i)) if r.v > 990 else True
    assert with_position(rows.limit(0), order).count() == 0
    plan = with_position(rows, order)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0]


def test_shares(spark):
    rows = spark.createDataFrame(
        [(1, "a", 10), (1, "b", None), (2, "a", None), (2, "b", None), (None, "a", 3), (None, "c", 1)] + [(9, str(i), 2) for i in range(500)],
        "k int, n string, v bigint",
    )
    got = {(r.k, r.n): r.total for r in with_total(rows, "v", ["k"]).collect()}
    assert got[1, "b"] == 10 and got[2, "a"] is None and got[None, "c"] == 4 and got[9, "7"] == 1000 and len(got) == 506
    assert {r.total for r in with_total(rows, "v").collect()} == {1014}
    assert with_total(rows.where("k = 2"), "v").first().total is None
    assert with_total(rows.limit(0), "v", ["k"]).count() == 0
    text = with_total(rows, "v")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text


def test_a_set_is_published_as_a_whole(spark, tmp_path):
    first = workbook.publish_kpi_report(market(spark), str(tmp_path), *RANGE)
    before = [r.asDict() for r in first.sheet("Buyers KPI").collect()]
    want = [r.asDict() for r in workbook.kpi_sheets(market(spark), *RANGE)["Buyers KPI"].collect()]
    assert [{k: v for k, v in r.items() if k != "position"} for r in before] == want
    assert [r["position"] for r in before] == list(range(1, len(before) + 1))
    # a repeat changes nothing
    manifest = first.manifest()
    assert workbook.publish_kpi_report(market(spark), str(tmp_path), *RANGE).manifest() == manifest
    # neither does a failure after the first sheet
    broken = spark.range(3).select(F.raise_error(F.lit("no data")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no data"):
        first.publish({"Buyers KPI": Sheet(spark.range(9).toDF("x"), [F.asc("x")]), "Sellers KPI": Sheet(broken, [F.asc("x")])})
    assert first.manifest() == manifest and [r.asDict() for r in first.sheet("Buyers KPI").collect()] == before
    assert first.verify() == []
    # a change is a new edition
    sale = {"invoice_id": 4, "buyer_id": 8, "seller_signed_on": dt.datetime(1998, 2, 5)}
    again = workbook.publish_kpi_report(market(spark, sale), str(tmp_path), *RANGE)
    assert {r["edition"] for r in again.manifest()} == {2} and again.sheet("Buyers KPI").count() == len(before) + 1


def test_sheets_of_one_pass(spark, tmp_path):
    mk = market(spark)
    published = workbook.publish_investor_report(mk, str(tmp_path), *RANGE)
    names = [sheet for sheet, _, _ in FACTS.values()]
    assert [r["sheet"] for r in published.manifest()] == names and published.verify() == []
    for name, frame in workbook.investor_sheets(mk, *RANGE).items():
        rows = published.sheet(name).collect()
        assert [tuple(r)[1:] for r in rows] == [tuple(r) for r in frame.orderBy(F.asc_nulls_last("Store ID")).collect()]
        assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    with pytest.raises(ValueError):
        published.publish_together(spark.createDataFrame([("x", 1)], "sheet string, a int"), ["y"], "sheet", [F.asc("a")])
    assert published.manifest()[0]["edition"] == 1
    with pytest.raises(KeyError):
        published.sheet("none")


def test_damage_is_seen(spark, tmp_path):
    held = ReportSet(spark, str(tmp_path))
    held.publish({"a": Sheet(spark.range(5).toDF("x"), [F.asc("x")]), "b": Sheet(spark.range(5).toDF("x"), [F.asc("x")])})
    spark.range(3).selectExpr("id AS position", "id AS x").write.mode("append").parquet(held.manifest()[1]["path"])
    assert held.verify() == ["b"]
