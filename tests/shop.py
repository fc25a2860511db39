"""Small hand-made marketplaces: every row names only the columns a case is about."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from bazaarlens import Marketplace
from bazaarlens.sources.schema import RELATIONS, schema

T0 = dt.datetime(1998, 3, 10, 12)
DEFAULTS = {
    "sales": {"invoice_id": 1, "buyer_id": 1, "seller_id": 2, "subtotal": 100, "fee_percent": 5,
              "invoice_status": "COMPLETED", "created_at": T0, "seller_signed_on": T0},
    "invoices": {"invoice_id": 1, "buyer_id": 1, "seller_id": 2, "invoice_status": "COMPLETED", "created_at": T0},
    "invoice_items": {"invoice_item_id": "a", "invoice_id": 1, "post_id": 1, "status": "INCLUDED", "created_at": T0},
    "posts": {"post_id": 1, "seller_id": 2, "ndc": 1, "price": 20, "partial_quantity": None, "status": "ACTIVE",
              "created_at": dt.datetime(1998, 3, 1)},
    "drugs": {"ndc_upc_hri": 1, "drug_name": "n", "drug_group": "g", "display_name": "N", "display_packaging": "p",
              "package_price": 50, "unit_price": 5},
    "stores": {"store_id": 1, "doing_business_as": "s", "address_id": 1, "funding_id": 1, "created_at": T0},
    "addresses": {"address_id": 1, "state": "CA"},
    "funding_accounts": {"funding_id": 1, "funding_status": "VERIFIED", "created_at": T0},
    "carts": {"subtotal": 1},
    "users": {"id": 1, "email": "a@shop.example", "last_sign_in_at": T0},
    "monthly_sales_goal": {"month_year": dt.date(1998, 3, 1), "sales_goal": 10},
}


def shop(spark, **relations) -> Marketplace:
    frames = {}
    for name in RELATIONS:
        shape = schema(name)
        rows = []
        for given in relations.get(name, []):
            row = {**DEFAULTS[name], **given}
            rows.append(tuple(
                Decimal(str(row[f.name])) if f.dataType.typeName() == "decimal" and row[f.name] is not None
                else row[f.name] for f in shape.fields
            ))
        frames[name] = spark.createDataFrame(rows, shape)
    return Marketplace.from_frames(spark, frames)


def rows(frame) -> list[dict]:
    return [
        {k: float(v) if isinstance(v, Decimal) else v for k, v in r.asDict().items()} for r in frame.collect()
    ]


def row(frame) -> dict:
    found = rows(frame)
    assert len(found) == 1, found
    return found[0]
