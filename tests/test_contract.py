"""The contract of the relations: planted violations of every kind are found, and nothing else."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazaarlens import Marketplace
from bazaarlens.sources.contract import CONTRACT, violations
from bazaarlens.sources.order_tables import marketplace_from_orders
from bazaarlens.sources.schema import RELATIONS
from shop import shop

SOUND = {
    "sales": [{"invoice_id": i, "buyer_id": 1, "seller_id": 2} for i in (1, 2, 3)],
    "invoices": [{"invoice_id": i} for i in (1, 2, 3)],
    "invoice_items": [{"invoice_item_id": str(i), "invoice_id": 1 + i % 3, "post_id": 1} for i in range(9)],
    "posts": [{}, {"post_id": 2, "ndc": None}],
    "drugs": [{}], "stores": [{}, {"store_id": 2, "address_id": None}], "addresses": [{}], "funding_accounts": [{}],
    "users": [{}], "monthly_sales_goal": [{}], "carts": [{}],
}


def found(mk, **more):
    return {(r.relation, r.column, r.rule): (r.rows, r.example) for r in violations(mk, **more).collect()}


def planted(**more):
    return {name: rows + more.get(name, []) for name, rows in SOUND.items()}


def test_sound(spark):
    assert found(shop(spark, **SOUND)) == {}


def test_planted(spark):
    mk = shop(spark, **planted(
        sales=[{"invoice_id": 3, "invoice_status": "VOID"}, {"invoice_id": 4, "buyer_id": 9, "fee_percent": 101},
               {"invoice_id": None, "subtotal": -1}, {"invoice_id": 5, "seller_id": 8, "buyer_id": 9, "subtotal": None}],
        invoice_items=[{"invoice_item_id": "0", "invoice_id": 77}] * 2 + [{"invoice_item_id": "x", "post_id": None, "status": "?"}],
        posts=[{"post_id": 3, "seller_id": 8, "status": "GONE", "price": None}],
        stores=[{"store_id": 3, "address_id": 5, "created_at": None}, {"store_id": 3, "funding_id": None}],
        monthly_sales_goal=[{}],
    ))
    assert found(mk) == {
        ("sales", "invoice_id", "unique"): (1, "3"),
        ("sales", "invoice_status", "domain"): (1, "VOID"),
        ("sales", "buyer_id", "orphan"): (2, "9"),
        ("sales", "seller_id", "orphan"): (1, "8"),
        ("sales", "fee_percent", "range"): (1, "101.00"),
        ("sales", "subtotal", "range"): (1, "-1.00"),
        ("sales", "subtotal", "required"): (1, None),
        ("sales", "invoice_id", "required"): (1, None),
        ("invoice_items", "invoice_item_id", "unique"): (2, "0"),
        ("invoice_items", "invoice_id", "orphan"): (2, "77"),
        ("invoice_items", "post_id", "required"): (1, None),
        ("invoice_items", "status", "domain"): (1, "?"),
        ("posts", "seller_id", "orphan"): (1, "8"),
        ("posts", "status", "domain"): (1, "GONE"),
        ("stores", "store_id", "unique"): (1, "3"),
        ("stores", "address_id", "orphan"): (1, "5"),
        ("stores", "created_at", "required"): (1, None),
        ("monthly_sales_goal", "month_year", "unique"): (1, "1998-03-01"),
    }


def test_types_and_missing_columns(spark):
    mk = shop(spark, **SOUND)
    frames = {n: mk.table(n) for n in RELATIONS}
    frames["sales"] = frames["sales"].withColumn("buyer_id", F.col("buyer_id").cast("int")).drop("fee_percent")
    rows = violations(Marketplace.from_frames(spark, frames)).collect()
    assert [tuple(r) for r in rows] == [
        ("sales", "buyer_id", "type", None, None, "int, declared bigint"),
        ("sales", "fee_percent", "type", None, None, "missing"),
    ]


def test_no_rows(spark):
    assert found(shop(spark)) == {}


def test_a_hot_reference_is_combined_before_the_shuffle(spark):
    mk = shop(spark, **SOUND)
    text = violations(mk, {"sales": CONTRACT["sales"]})._jdf.queryExecution().executedPlan().toString()
    first = text[text.index("hashpartitioning(domain"):]
    assert "partial_count" in first.split("Generate")[0]


def test_derived_relations(spark):
    """The test tables keep the contract."""
    assert found(marketplace_from_orders(spark, "/root/testdata/sf0.001"), ids="string") == {}
