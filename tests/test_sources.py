"""The relations derived from the test tables, row for row against their SQL definition."""

import pytest
from pyspark.sql import functions as F

from bazaarlens.sources.order_tables import marketplace_from_orders
from bazaarlens.sources.schema import RELATIONS, schema
from checks.oracle import VIEWS
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
# relation -> (columns, the same columns of the SQL view)
SAME = {
    "sales": (
        ["invoice_id", "buyer_id", "seller_id", "subtotal", "fee_percent", "invoice_status", "created_at",
         "seller_signed_on"],
        "invoice_id, buyer, seller, subtotal, fee, status, created, signed",
    ),
    "invoice_items": (
        ["invoice_item_id", "invoice_id", "post_id", "status", "created_at"],
        "item_id, invoice_id, post_id, CASE WHEN included THEN 'INCLUDED' ELSE 'REMOVED' END, created",
    ),
    "posts": (
        ["post_id", "seller_id", "ndc", "price", "partial_quantity", "status", "created_at"],
        "post_id, seller, ndc, price, qty, status, created",
    ),
    "drugs": (
        ["ndc_upc_hri", "drug_group", "display_name", "display_packaging", "package_price", "unit_price"],
        "ndc, grp, display, pack, package_price, unit_price",
    ),
    "stores": (["store_id", "doing_business_as", "created_at"], "store_id, name, created"),
}
VIEW_OF = {"invoice_items": "items"}


@pytest.mark.parametrize("relation", SAME)
def test_relation(spark, relation):
    columns, theirs = SAME[relation]
    view = VIEW_OF.get(relation, relation)
    names = ", ".join(columns)
    sql = f"WITH {view} AS ({VIEWS[view]}), given({names}) AS (SELECT {theirs} FROM {view}) SELECT * FROM given"
    found = marketplace_from_orders(spark, FOLDER).table(relation, *columns)
    assert differences(found, connect(FOLDER), sql) is None


@pytest.mark.parametrize("relation", RELATIONS)
def test_declared_schema(spark, relation):
    declared = schema(relation, ids="string")
    found = marketplace_from_orders(spark, FOLDER).table(relation, *declared.names).schema
    assert [(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in declared]


def test_sums_at_the_next_scale(spark):
    mk = marketplace_from_orders(spark, "/root/testdata/sf0.01")
    sales = mk.table("sales", "invoice_id", "subtotal", "seller_signed_on")
    totals = sales.agg(F.count_distinct("invoice_id"), F.sum("subtotal"), F.count("seller_signed_on")).first()
    assert [str(v) for v in totals] == ["58785", "3024008733.97", "39499"]


def test_unasked_columns_cost_no_join(spark):
    mk = marketplace_from_orders(spark, FOLDER)
    plan = mk.table("invoice_items", "invoice_id", "post_id", "status")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    plan = mk.table("stores", "store_id", "address_id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
