"""Sell-through on relations in which every key repeats: each report counts rows as plain joins do."""

import datetime as dt

import duckdb
import pytest

from bazaarlens.plans import sell_through as reports
from bazaarlens.sources.schema import RELATIONS
from shop import shop

START, END = dt.date(1998, 1, 1), dt.date(1998, 6, 30)
VIEWS = """
    WITH p AS (SELECT * FROM posts WHERE status IN ('ACTIVE', 'SOLDOUT', 'RESERVED', 'DEACTIVATED', 'EXPIRED')
               AND created_at BETWEEN '1998-01-01' AND '1998-06-30' AND post_id IS NOT NULL),
    s AS (SELECT i.post_id, b.* FROM invoice_items i JOIN sales b USING (invoice_id)
          WHERE b.invoice_status IN ('COMPLETED', 'PENDING') AND i.status = 'INCLUDED'),
    homes AS (SELECT store_id, doing_business_as, state FROM stores JOIN addresses USING (address_id)),
    """
# made, sold, days, revenue of signed lines; named as in the reports
RATES = """count(*) AS "Posts Made", count(seller_signed_on) AS "Posts Sold",
    round(100.0 * count(seller_signed_on) / count(*), 2) AS "STR (%)", round(avg(days), 2) AS "Avg Days to Sale" """
SQL = {
    "drug_analysis": VIEWS + f"""l AS (SELECT d.*, s.seller_signed_on, s.subtotal, extract('day' FROM s.seller_signed_on - p.created_at) AS days
          FROM p JOIN drugs d ON ndc = ndc_upc_hri LEFT JOIN s USING (post_id))
        SELECT drug_group AS "Drug Category", ndc_upc_hri AS "NDC", display_name AS "Drug Name", display_packaging AS "Packaging", {RATES},
          round(coalesce(sum(subtotal) FILTER (seller_signed_on IS NOT NULL), 0), 2) AS "Total Revenue",
          round(avg(subtotal) FILTER (seller_signed_on IS NOT NULL), 2) AS "Avg Revenue Per Sale"
        FROM l GROUP BY drug_group, ndc_upc_hri, drug_name, display_name, display_packaging HAVING count(seller_signed_on) >= 1""",
    "seller_stores": VIEWS + f"""l AS (SELECT p.seller_id, h.*, p.created_at, s.seller_signed_on, s.subtotal, extract('day' FROM s.seller_signed_on - p.created_at) AS days
          FROM p JOIN drugs ON ndc = ndc_upc_hri JOIN homes h ON seller_id = store_id LEFT JOIN s USING (post_id))
        SELECT seller_id AS "Seller ID", doing_business_as AS "Store Name", state AS "State", {RATES},
          round(avg(subtotal), 2) AS "Avg Revenue Per Sale", round(coalesce(sum(subtotal), 0), 2) AS "Total Revenue",
          min(created_at) AS "First Post Date", max(created_at) AS "Last Post Date"
        FROM l GROUP BY 1, 2, 3 HAVING count(seller_signed_on) >= 1""",
    "state_analysis": VIEWS + f"""l AS (SELECT drug_group, b.state AS buyer_state, h.state AS seller_state, s.seller_signed_on, s.subtotal,
            extract('day' FROM s.seller_signed_on - p.created_at) AS days
          FROM p JOIN drugs ON ndc = ndc_upc_hri JOIN homes h ON p.seller_id = h.store_id LEFT JOIN s USING (post_id)
          LEFT JOIN homes b ON s.buyer_id = b.store_id)
        SELECT drug_group AS "Drug Category", buyer_state AS "Buyer State", seller_state AS "Seller State", {RATES},
          round(coalesce(sum(subtotal) FILTER (seller_signed_on IS NOT NULL), 0), 2) AS "Total Revenue",
          round(avg(subtotal) FILTER (seller_signed_on IS NOT NULL), 2) AS "Avg Revenue Per Sale"
        FROM l GROUP BY 1, 2, 3 HAVING count(seller_signed_on) >= 1""",
    "benchmark_markets": VIEWS + """m AS (SELECT h.state, drug_group, ndc, count(*) AS total, count(DISTINCT s.post_id) AS sold,
            count(DISTINCT p.seller_id) AS sellers, count(DISTINCT s.buyer_id) FILTER (b.state = h.state) AS buyers
          FROM p JOIN drugs ON ndc = ndc_upc_hri JOIN homes h ON p.seller_id = h.store_id LEFT JOIN s USING (post_id)
          LEFT JOIN homes b ON s.buyer_id = b.store_id GROUP BY 1, 2, 3)
        SELECT state AS "State", drug_group AS "Drug Category", ndc AS "NDC", total AS "Total Posts", sold AS "Total Sold",
          round(100.0 * sold / total, 2) AS "STR (%)", sellers AS "Seller Stores", buyers AS "Buyer Stores (Same State)",
          round(CASE WHEN buyers > 0 THEN sellers / buyers END, 2) AS "Seller:Buyer Ratio"
        FROM m WHERE total >= 1 AND sold / total >= 0.0001""",
    "buyer_state_summary": VIEWS + """l AS (SELECT state, s.buyer_id, subtotal FROM p JOIN s USING (post_id) JOIN homes ON buyer_id = store_id)
        SELECT state AS "Buyer State", count(*) AS "Total Purchases", count(DISTINCT buyer_id) AS "Unique Buyer Stores",
          round(sum(subtotal), 2) AS "Total Purchase Revenue" FROM l GROUP BY 1""",
    "seller_state_summary": VIEWS + """l AS (SELECT state, p.seller_id, subtotal FROM p JOIN s USING (post_id) JOIN homes h ON p.seller_id = h.store_id)
        SELECT state AS "Seller State", count(*) AS "Total Sales", count(DISTINCT seller_id) AS "Unique Seller Stores",
          round(sum(subtotal), 2) AS "Total Sales Revenue" FROM l GROUP BY 1""",
    "buyer_stores": """WITH l AS (SELECT s.buyer_id, t.doing_business_as, a.state, coalesce(seller_signed_on, s.created_at) AS bought,
            CASE WHEN partial_quantity > 0 THEN unit_price * partial_quantity - price ELSE package_price - price END AS saved
          FROM invoice_items i JOIN sales s USING (invoice_id) JOIN posts p ON p.post_id = i.post_id JOIN drugs ON ndc = ndc_upc_hri
          JOIN stores t ON buyer_id = store_id LEFT JOIN addresses a ON a.address_id = t.address_id
          WHERE s.invoice_status IN ('COMPLETED', 'PENDING') AND i.status = 'INCLUDED' AND price IS NOT NULL)
        SELECT buyer_id AS "Buyer ID", doing_business_as AS "Store Name", state AS "State", count(*) AS "Posts Bought",
          round(avg(saved), 2) AS "Avg Savings Per Post", round(sum(saved), 2) AS "Total Savings",
          min(bought) AS "First Purchase", max(bought) AS "Last Purchase"
        FROM l WHERE bought BETWEEN '1998-01-01' AND '1998-06-30' GROUP BY 1, 2, 3""",
}
ARGS = {"benchmark_markets": (1, 0.0001), "buyer_state_summary": (), "seller_state_summary": ()}


def relations(times):
    t = dt.datetime(1998, 1, 3)
    sales = [{"invoice_id": i, "buyer_id": 1 + i % 6, "seller_id": 20 + i % 4, "subtotal": 7 * i, "created_at": t + dt.timedelta(days=i),
              "seller_signed_on": None if i % 13 == 0 else t + dt.timedelta(days=2 * i, hours=i % 24),
              "invoice_status": ("COMPLETED", "PENDING", "NOT_STARTED")[i % 5 % 3]} for i in range(1, 60)]
    items = [{"invoice_item_id": f"{i}-{k}", "invoice_id": i, "post_id": 1 + (i * k) % 25, "status": "REMOVED" if i % 8 == 0 else "INCLUDED"}
             for i in range(1, 63) for k in (1, 2, 2)]
    posts = [{"post_id": p, "seller_id": 20 + p % 5, "ndc": p % 4, "price": None if p % 7 == 0 else 2 * p, "created_at": t + dt.timedelta(days=p),
              "partial_quantity": (None, 0, 3)[p % 3], "status": "DRAFT" if p % 11 == 0 else "ACTIVE"} for p in range(1, 35)]
    # one listing under another seller and product, one store in two places, one product under two names
    posts += [dict(posts[4], seller_id=21, ndc=2), dict(posts[5], created_at=t)]
    stores = [{"store_id": s, "doing_business_as": f"n{s}", "address_id": None if s == 5 else s % 3} for s in [*range(1, 6), *range(20, 25)]]
    stores += [dict(stores[1], address_id=0), dict(stores[7], doing_business_as="other")]
    addresses = [{"address_id": a, "state": f"S{a % 2}"} for a in range(3)] + [{"address_id": 1, "state": "S9"}]
    drugs = [{"ndc_upc_hri": d, "drug_name": f"d{d}", "drug_group": f"g{d % 2}", "display_name": f"D{d}"} for d in range(3)]
    drugs += [dict(drugs[0], drug_group="g7"), dict(drugs[1], drug_name="alias")]
    return {"sales": sales * times, "invoice_items": items, "posts": posts * times, "stores": stores * times,
            "addresses": addresses * times, "drugs": drugs * times}


@pytest.fixture(scope="module", params=[1, 2])
def both(spark, request):
    mk = shop(spark, **relations(request.param))
    con = duckdb.connect()
    for name in RELATIONS:
        con.register(name, mk.table(name).toArrow())
    return mk, con


def cells(row):
    return tuple(round(float(v), 2) if type(v).__name__ in ("Decimal", "float", "int") and not isinstance(v, bool) else v for v in row)


@pytest.mark.parametrize("name", SQL)
def test_report_counts_rows_as_joins_do(both, name):
    mk, con = both
    frame = getattr(reports, name)(mk, START, END, *ARGS.get(name, () if name.endswith("summary") else (1,)))
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(map(cells, cursor.fetchall()), key=repr)
    assert sorted((cells(r) for r in frame.select(*[f"`{n}`" for n in names]).collect()), key=repr) == want
    assert want


def test_posts_that_several_sellers_share_count_once_in_a_market(spark):
    """And posts of one seller, which are counted without making them distinct, once in each of the seller's markets."""
    posts = [{"post_id": p, "seller_id": s, "ndc": n} for p, s, n in (
        (1, 2, 1), (1, 3, 1), (1, 4, 1), (2, 2, 1), (2, 2, 1), (3, 3, 1), (4, None, 1), (4, 2, 1), (5, 2, None), (5, None, 1), (6, 4, 1))]
    made = shop(
        spark, posts=posts, drugs=[{}, {}],
        sales=[{"invoice_id": i, "buyer_id": 10 + i} for i in range(1, 7)],
        invoice_items=[{"invoice_item_id": str(i), "invoice_id": i, "post_id": i} for i in range(1, 6)],
        stores=[{"store_id": s, "address_id": a} for s, a in ((2, 1), (3, 1), (4, 2), (2, 2))],
        addresses=[{"address_id": 1, "state": "CA"}, {"address_id": 2, "state": "NY"}],
    )
    found = {r["State"]: r for r in reports.benchmark_markets(made, START, END, 1, 0.0).collect()}
    # CA: posts 1, 2, 4 of seller 2 and 1, 3 of seller 3; NY: 1, 2, 4 of seller 2 and 1, 6 of seller 4. Products twice.
    assert {s: (r["Total Posts"], r["Total Sold"], r["Seller Stores"]) for s, r in found.items()} == {
        "CA": (12, 4, 2), "NY": (12, 3, 2)}
