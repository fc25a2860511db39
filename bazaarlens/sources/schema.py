"""Relations of a two-sided marketplace, declared so that no read infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = "decimal(18,2)"
#: Columns whose ids are whole numbers in a stored marketplace and texts of two keys in a derived one.
IDS = ("invoice_id", "post_id")

RELATIONS = {
    # one row per invoice
    "sales": "invoice_id bigint, buyer_id bigint, seller_id bigint, subtotal decimal(18,2), "
    "fee_percent decimal(5,2), invoice_status string, created_at timestamp_ntz, seller_signed_on timestamp_ntz",
    "invoices": "invoice_id bigint, buyer_id bigint, seller_id bigint, invoice_status string, created_at timestamp_ntz",
    "invoice_items": "invoice_item_id string, invoice_id bigint, post_id bigint, status string, "
    "created_at timestamp_ntz",
    "posts": "post_id bigint, seller_id bigint, ndc bigint, price decimal(18,2), partial_quantity decimal(18,2), "
    "status string, created_at timestamp_ntz",
    "drugs": "ndc_upc_hri bigint, drug_name string, drug_group string, display_name string, "
    "display_packaging string, package_price decimal(18,2), unit_price decimal(18,2)",
    "stores": "store_id bigint, doing_business_as string, address_id int, funding_id bigint, created_at timestamp_ntz",
    "addresses": "address_id int, state string",
    "funding_accounts": "funding_id bigint, funding_status string, created_at timestamp_ntz",
    "carts": "subtotal decimal(18,2)",
    "users": "id bigint, email string, last_sign_in_at timestamp_ntz",
    "monthly_sales_goal": "month_year date, sales_goal decimal(28,2)",
}


def schema(relation: str, ids: str = "bigint") -> T.StructType:
    """The declared columns of a relation; `ids` is the type of invoice and post ids, bigint or string."""
    fields = T.StructType.fromDDL(RELATIONS[relation])
    kind = T.StructType.fromDDL(f"id {ids}")["id"].dataType
    return T.StructType([T.StructField(f.name, kind if f.name in IDS else f.dataType) for f in fields])
