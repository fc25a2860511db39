"""DuckDB SQL for every registered query, on the same Parquet tables.

The SQL states each report directly on the derived marketplace relations (FIXTURES.md) and shares
no code with the Spark plans. Decimals leave as DOUBLE after exact rounding.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace
from zoneinfo import ZoneInfo

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


@dataclass(frozen=True)
class Args:
    as_of: dt.date
    start: dt.date
    end: dt.date
    now: dt.datetime
    churn_days: int
    min_sales: int
    min_posts: int
    min_rate: float
    sub_start: dt.date
    sub_end: dt.date
    days_start: dt.date
    days_end: dt.date
    zone: str


VIEWS = {
    "sales": f"""
        SELECT concat_ws('-', l_orderkey, l_suppkey) AS invoice_id, o_custkey AS buyer, l_suppkey AS seller,
          CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))), 2)
            AS DECIMAL(18,2)) AS subtotal,
          CASE WHEN l_orderkey % 17 <> 0 THEN CAST(max(CAST(l_tax AS DECIMAL(4,2))) * 100 AS DECIMAL(5,2)) END AS fee,
          CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'PENDING' ELSE 'NOT_STARTED' END AS status,
          o_orderdate AS created,
          CASE WHEN o_orderstatus <> 'O'
            THEN o_orderdate + to_days(CAST(l_orderkey % 10 AS INTEGER)) + to_hours(l_orderkey % 24) END AS signed
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        GROUP BY l_orderkey, l_suppkey, o_custkey, o_orderstatus, o_orderdate""",
    "booked": "SELECT *, CAST(date_trunc('month', signed) AS DATE) AS m FROM sales WHERE status <> 'NOT_STARTED'",
    "done": "SELECT *, CAST(date_trunc('month', signed) AS DATE) AS m FROM sales WHERE status = 'COMPLETED'",
    "items": f"""
        SELECT concat_ws('-', l_orderkey, l_suppkey, l_partkey, l_linenumber,
            CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS item_id,
          concat_ws('-', l_orderkey, l_suppkey) AS invoice_id, concat_ws('-', l_partkey, l_suppkey) AS post_id,
          l_returnflag <> 'R' AS included, o_orderdate AS created
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "sold": """
        SELECT b.*, i.item_id, i.post_id FROM booked b JOIN items i ON i.invoice_id = b.invoice_id AND i.included""",
    "posts": f"""
        SELECT concat_ws('-', l_partkey, l_suppkey) AS post_id, l_suppkey AS seller, l_partkey AS ndc,
          CASE WHEN l_partkey % 23 <> 0 THEN min(CAST(l_extendedprice AS DECIMAL(18,2))) END AS price,
          CAST(CASE l_partkey % 3 WHEN 1 THEN 0 WHEN 2 THEN any_value(p_size) END AS DECIMAL(18,2)) AS qty,
          CASE l_partkey % 6 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'SOLDOUT' WHEN 2 THEN 'RESERVED'
            WHEN 3 THEN 'DEACTIVATED' WHEN 4 THEN 'EXPIRED' ELSE 'DRAFT' END AS status,
          min(o_orderdate) - to_days(CAST(l_partkey % 60 AS INTEGER)) - INTERVAL 7 HOUR AS created
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
        GROUP BY l_partkey, l_suppkey""",
    "drugs": """
        SELECT p_partkey AS ndc, p_type AS grp, p_brand || ' ' || p_name AS display, CAST(p_size AS VARCHAR) AS pack,
          CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 20 AS DECIMAL(18,2)) AS package_price,
          CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price
        FROM part""",
    "stores": """
        SELECT c_custkey AS store_id, c_name AS name, n_name AS state, c_mktsegment <> 'BUILDING' AS funded,
          coalesce(first_order, TIMESTAMP '1995-01-01') - to_days(CAST(c_custkey % 45 AS INTEGER)) AS created
        FROM customer JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "legs": """
        SELECT buyer AS store_id, invoice_id, status, created, signed, true AS bought, false AS sold FROM sales
        UNION ALL
        SELECT seller, invoice_id, status, created, signed, false, true FROM sales""",
    # one row per post and sale, and per unsold post
    "lines": """
        SELECT p.post_id, p.ndc, p.seller, p.created AS listed, s.buyer, s.signed, s.subtotal,
          extract('day' FROM s.signed - p.created) AS days
        FROM live p LEFT JOIN sold s ON s.post_id = p.post_id""",
}
NEEDS = {
    "booked": ["sales"], "done": ["sales"], "sold": ["booked", "items"], "legs": ["sales"],
    "lines": ["live", "sold"], "live": ["posts"],
}


def with_views(args: Args, body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """The body behind the views it names, each after the ones it needs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    texts = dict(VIEWS)
    texts["live"] = f"SELECT * FROM posts WHERE status <> 'DRAFT' AND created BETWEEN {ts(args.start)} AND {ts(args.end)}"
    parts = [f"{n} AS ({texts[n]})" for n in ordered] + [f"{n} AS ({t})" for n, t in (extra or {}).items()]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


def ts(day: dt.date) -> str:
    return f"TIMESTAMP '{day.isoformat()} 00:00:00'"


def d(day: dt.date) -> str:
    return f"DATE '{day.isoformat()}'"


def rnd(expr: str, digits: int) -> str:
    """Exact half-up rounding of a DOUBLE quotient."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def div(num: str, den: str) -> str:
    return f"({dbl(num)} / nullif({dbl(den)}, 0))"


def zdiv(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0::DOUBLE ELSE {div(num, den)} END"


def pct(part: str, whole: str) -> str:
    return rnd(f"100 * {div(part, whole)}", 2)


def plain(expr: str) -> str:
    """Two decimals without a leading zero."""
    value = f"round(CAST(coalesce({expr}, 0) AS DECIMAL(38,10)), 2)"
    return f"regexp_replace(CAST(CAST({value} AS DECIMAL(38,2)) AS VARCHAR), '^(-?)0\\.', '\\1.')"


def month_name(day: dt.date) -> str:
    return f"rpad(strftime({d(day)}, '%B'), 9, ' ')"


def bounds(day: dt.date) -> str:
    """The month starts and elapsed time around a day."""
    return (
        f"SELECT date_trunc('month', {ts(day)}) AS m0, date_trunc('month', {ts(day)}) - INTERVAL 1 MONTH AS m1, "
        f"date_trunc('month', {ts(day)}) + INTERVAL 1 MONTH AS m2, {ts(day)} AS today, "
        f"{ts(day)} - date_trunc('month', {ts(day)}) AS gone"
    )


def local_bounds(day: dt.date, zone: str) -> str:
    """The same with days that begin in a zone, as moments in UTC."""

    def begin(local: dt.date) -> str:
        moment = dt.datetime.combine(local, dt.time(), ZoneInfo(zone)).astimezone(dt.timezone.utc)
        return f"TIMESTAMP '{moment.replace(tzinfo=None).isoformat(sep=' ')}'"

    m0 = day.replace(day=1)
    m1, m2 = (m0 - dt.timedelta(days=1)).replace(day=1), (m0 + dt.timedelta(days=31)).replace(day=1)
    gone = f"{begin(m1 + (day - m0))} - {begin(m1)}"
    return f"SELECT {begin(m0)} AS m0, {begin(m1)} AS m1, {begin(m2)} AS m2, {begin(day)} AS today, {gone} AS gone"


def calendar(args: Args, name: str = "m") -> str:
    return (
        f"SELECT CAST(unnest(range(date_trunc('month', {ts(args.start)}), "
        f"date_trunc('month', {ts(args.end)}) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS {name}"
    )


def days(args: Args) -> str:
    return (
        f"SELECT CAST(unnest(range({ts(args.start)}, {ts(args.end)} + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day"
    )


REVENUE = "CAST(coalesce(fee, 0) * coalesce(subtotal, 0) AS DECIMAL(30,4))"
TO_MIDNIGHT_NOW = "signed >= m0 AND signed <= today"
TO_MIDNIGHT_BEFORE = "signed >= m1 AND signed < m1 + gone"
FULL_DAY_NOW = "signed >= m0 AND signed < today + INTERVAL 1 DAY"
FULL_DAY_BEFORE = "signed >= m1 AND signed < m1 + gone + INTERVAL 1 DAY"
HAS_ITEM = "EXISTS (SELECT 1 FROM items i WHERE i.invoice_id = s.invoice_id AND i.included)"


def hundredth(expr: str) -> str:
    return f"(CAST({expr} AS DECIMAL(34,4)) * CAST(0.01 AS DECIMAL(2,2)))"


# ---- overview, signups, churn ----


def admin_metrics(a: Args, moments: str | None = None) -> str:
    body = f"""
    SELECT {dbl("coalesce((SELECT sum(subtotal) FROM sales, t WHERE created >= m0 AND created < m2 AND status <> 'NOT_STARTED'), 0)")} AS total_sales,
      {dbl("coalesce((SELECT sum(subtotal) FROM sales, t WHERE created >= m0 AND created < m2 AND status = 'NOT_STARTED'), 0)")} AS pending_sales,
      {dbl("coalesce((SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders WHERE o_orderstatus = 'O'), 0)")} AS pending_carts,
      (SELECT count(*) FROM (
        SELECT user_id, max(ts) - to_days(CAST(9437 + 20 * (user_id % 5) AS INTEGER)) AS seen FROM events
        WHERE user_id % 11 <> 0 AND user_id % 7 <> 0 GROUP BY user_id), t
        WHERE seen >= m0 AND seen < m2) AS active_users,
      (SELECT count(DISTINCT item_id) FROM items i JOIN done USING (invoice_id), t
        WHERE i.created >= m0 AND i.created < m2) AS posts_sold,
      {dbl("coalesce((SELECT sum(subtotal) FROM sales, t WHERE created >= m1 AND created < m0 AND status <> 'NOT_STARTED'), 0)")} AS prev_total_sales,
      (SELECT count(DISTINCT item_id) FROM items i JOIN done USING (invoice_id), t
        WHERE i.created >= m1 AND i.created < m0) AS prev_posts_sold"""
    return with_views(a, body, "sales", "done", "items", extra={"t": moments or bounds(a.as_of)})


def monthly_goal(a: Args) -> str:
    # The zone is eight hours behind UTC in winter.
    local = f"(TIMESTAMP '{a.now.isoformat(sep=' ')}' - INTERVAL 8 HOUR)"
    return f"""SELECT {dbl("sum(CAST(o_totalprice AS DECIMAL(18,2)))")} AS sales_goal FROM orders
    WHERE date_trunc('month', o_orderdate) = date_trunc('month', {local}) HAVING count(*) > 0"""


def new_customers(a: Args) -> str:
    body = f"""
    SELECT day AS customer_date, count(store_id) AS new_customers FROM ({days(a)})
    LEFT JOIN (SELECT store_id, CAST(min(created) AS DATE) AS first FROM legs WHERE status = 'COMPLETED' GROUP BY 1)
      ON first = day GROUP BY day"""
    return with_views(a, body, "legs")


def new_signups(a: Args) -> str:
    body = f"""SELECT day AS signup_date, count(store_id) AS new_store_signups
    FROM ({days(a)}) LEFT JOIN stores ON CAST(created AS DATE) = day GROUP BY day"""
    return with_views(a, body, "stores")


def _churn_views(a: Args) -> dict[str, str]:
    t = (f"SELECT {ts(a.as_of)} - to_days({a.churn_days - 1}) AS cur, {ts(a.as_of)} - to_days({2 * a.churn_days - 1}) AS old")
    events = """
      SELECT store_id, CASE WHEN bought THEN 'b' ELSE 's' END AS kind, invoice_id AS id, signed AS moment
      FROM legs WHERE status = 'COMPLETED'
      UNION ALL SELECT seller, 'p', post_id, created FROM posts"""
    kinds = ", ".join(
        f"coalesce(bool_or(kind = '{k}' AND moment < cur), false) AS past_{k}, "
        f"count(DISTINCT id) FILTER (kind = '{k}' AND moment >= cur) AS now_{k}"
        for k in "bsp"
    )
    return {"t": t, "ev": events, "flags": f"SELECT store_id, {kinds} FROM ev, t WHERE moment >= old GROUP BY store_id"}


def churn_rates(a: Args) -> str:
    rates = {
        "Seller Churn (%)": ("past_s", "now_s = 0 AND now_p = 0"),
        "Buyer Churn (%)": ("past_b", "now_b = 0"),
        "Overall Churn (%)": ("(past_b OR past_s OR past_p)", "now_b + now_s + now_p = 0"),
        "One-timer (%)": ("(past_b OR past_s OR past_p)", "now_b + now_s = 1"),
        "One-time Buyer (%)": ("past_b", "now_b = 1"),
        "One-time Seller (%)": ("(past_s OR past_p)", "now_s = 1"),
    }
    cells = ", ".join(
        f'{pct(f"count(*) FILTER ({base} AND {hit})", f"count(*) FILTER ({base})")} AS "{n}"'
        for n, (base, hit) in rates.items()
    )
    body = f"SELECT {cells} FROM stores JOIN flags USING (store_id)"
    return with_views(a, body, "legs", "posts", "stores", extra=_churn_views(a))


def churn_flags(a: Args) -> str:
    body = """SELECT store_id, past_b AS past_purchase, past_s AS past_sale, past_p AS past_post,
      now_b AS purchases, now_s AS sales, now_p AS posts FROM flags"""
    return with_views(a, body, "legs", "posts", extra=_churn_views(a))


# ---- month to date ----


def mtd_activation(a: Args) -> str:
    body = f"""
    SELECT count(*) AS total_new_stores, count(*) FILTER (f >= m0 AND f < m2) AS activated_stores,
      coalesce({rnd(div("count(*) FILTER (f >= m0 AND f < m2)", "count(*)"), 4)}, 0) AS activation_rate
    FROM stores LEFT JOIN (SELECT store_id, min(signed) AS f FROM legs WHERE status <> 'NOT_STARTED' GROUP BY 1)
      USING (store_id), t WHERE created >= m0 AND created < m2"""
    return with_views(a, body, "stores", "legs", extra={"t": bounds(a.as_of)})


def mtd_active_posts(a: Args) -> str:
    new, old = "count(*) FILTER (created >= m0)", "count(*) FILTER (NOT created >= m0)"
    body = f"""SELECT count(*) AS active_now, {old} AS active_last_month,
      coalesce({rnd(div(new, old), 4)}, 0) AS current_vs_last_month_pct
    FROM posts, t WHERE status = 'ACTIVE'"""
    return with_views(a, body, "posts", extra={"t": bounds(a.as_of)})


def _two(a: Args, source: str, measure: str, now: str, before: str, *views: str, moments: str | None = None) -> str:
    body = f"""
    SELECT n AS {now}, p AS {before}, {rnd(zdiv("n - p", "p"), 4)} AS current_vs_last_month_pct
    FROM (SELECT {measure} FILTER ({TO_MIDNIGHT_NOW}) AS n, {measure} FILTER ({TO_MIDNIGHT_BEFORE}) AS p FROM {source}, t)"""
    return with_views(a, body, *views, extra={"t": moments or bounds(a.as_of)})


def mtd_active_stores(a: Args, moments: str | None = None) -> str:
    source = "(SELECT * FROM legs WHERE status <> 'NOT_STARTED')"
    names = ("active_stores_now", "active_stores_last_month")
    return _two(a, source, "count(DISTINCT store_id)", *names, "legs", moments=moments)


def mtd_items_sold(a: Args) -> str:
    return _two(a, "sold", "count(item_id)", "items_sold_now", "items_sold_last_month", "sold")


def mtd_total_invoices(a: Args) -> str:
    return _two(a, "booked", "count(DISTINCT invoice_id)", "mtd_completed_invoices", "last_month_completed_invoices", "booked")


def mtd_aov(a: Args) -> str:
    body = f"""
    SELECT {rnd("n", 2)} AS aov_current, {rnd("p", 2)} AS aov_last_month, {rnd(zdiv("n - p", "p"), 4)} AS growth_pct
    FROM (SELECT coalesce({div(f"sum(subtotal) FILTER ({FULL_DAY_NOW})", f"count(*) FILTER ({FULL_DAY_NOW})")}, 0) AS n,
      coalesce({div(f"sum(subtotal) FILTER ({FULL_DAY_BEFORE})", f"count(*) FILTER ({FULL_DAY_BEFORE})")}, 0) AS p
      FROM booked, t)"""
    return with_views(a, body, "booked", extra={"t": bounds(a.as_of)})


def mtd_avg_days(a: Args) -> str:
    body = f"""
    SELECT n AS avg_days_to_sell_now, p AS avg_days_to_sell_last_month,
      {rnd(zdiv("n - p", "p"), 4)} AS avg_days_to_sell_change_pct
    FROM (SELECT {rnd(f"avg(g) FILTER ({TO_MIDNIGHT_NOW})", 2)} AS n, {rnd(f"avg(g) FILTER ({TO_MIDNIGHT_BEFORE})", 2)} AS p
      FROM (SELECT s.signed, extract('day' FROM s.signed - p.created) AS g FROM sold s JOIN posts p USING (post_id)), t)"""
    return with_views(a, body, "sold", "posts", extra={"t": bounds(a.as_of)})


def _month_money(status: str, value: str, name: str) -> Callable[[Args], str]:
    def build(a: Args) -> str:
        body = f"""SELECT {month_name(a.as_of)} AS month_name, {dbl(f"round({value}, 2)")} AS {name}
        FROM sales, t WHERE status = '{status}' AND {FULL_DAY_NOW}"""
        return with_views(a, body, "sales", extra={"t": bounds(a.as_of)})

    return build


def weighted_take_rate(a: Args) -> str:
    body = f"""SELECT {month_name(a.as_of)} AS month_name,
      {rnd(div(hundredth(f"sum({REVENUE})"), "sum(subtotal)"), 4)} AS weighted_take_rate_mtd
    FROM sold, t WHERE {FULL_DAY_NOW}"""
    return with_views(a, body, "sold", extra={"t": bounds(a.as_of)})


def revenue_mix(a: Args) -> str:
    body = f"""
    SELECT {month_name(a.as_of)} AS month_name, kind AS seller_type, {dbl(f"round({hundredth('coalesce(r, 0)')}, 2)")} AS revenue_mtd,
      {pct("coalesce(r, 0)", "(SELECT sum(r) FROM g)")} AS pct_of_total
    FROM (SELECT unnest(['Existing', 'New']) AS kind) LEFT JOIN g USING (kind)"""
    groups = f"""
    SELECT CASE WHEN f >= m0 AND f < m2 THEN 'New' ELSE 'Existing' END AS kind, sum({REVENUE}) AS r
    FROM sold LEFT JOIN (SELECT seller, min(signed) AS f FROM done GROUP BY 1) USING (seller), t
    WHERE status = 'COMPLETED' AND {FULL_DAY_NOW} GROUP BY 1"""
    return with_views(a, body, "sold", "done", extra={"t": bounds(a.as_of), "g": groups})


def gmv_retention_mtd(a: Args) -> str:
    sellers = """SELECT seller, sum(subtotal) FILTER (signed >= m0 AND signed < m2) AS n,
      sum(subtotal) FILTER (signed >= m1 AND signed < m0) AS p FROM sold, t WHERE status = 'COMPLETED' GROUP BY 1"""
    body = f"""SELECT {rnd(zdiv("sum(n) FILTER (p IS NOT NULL)", "sum(p)"), 4)} AS gmv_retention_pct_current_month
    FROM ({sellers})"""
    return with_views(a, body, "sold", extra={"t": bounds(a.as_of)})


# ---- monthly tables ----


def marketplace_report(a: Args) -> str:
    body = f"""
    SELECT strftime(c.m, '%Y-%m') AS "Month", coalesce(np, 0) AS "New Posts", coalesce(its, 0) AS "Items Sold",
      coalesce(days, 0) AS "Avg Days to Sale", coalesce(inv, 0) AS "Invoice Count"
    FROM ({calendar(a)}) c
    LEFT JOIN (SELECT CAST(date_trunc('month', created) AS DATE) AS m, count(*) AS np FROM posts GROUP BY 1) USING (m)
    LEFT JOIN (SELECT m, count(*) AS inv FROM booked GROUP BY 1) USING (m)
    LEFT JOIN (SELECT m, count(DISTINCT item_id) AS its FROM sold GROUP BY 1) USING (m)
    LEFT JOIN (SELECT m, {rnd("avg(extract('day' FROM s.signed - p.created))", 2)} AS days
      FROM sold s JOIN posts p USING (post_id) GROUP BY 1) USING (m)"""
    return with_views(a, body, "sold", "posts")


def _revenue_views() -> dict[str, str]:
    return {
        "base": "SELECT DISTINCT invoice_id, seller, fee, m, subtotal FROM booked",
        "firsts": "SELECT seller, min(m) AS f FROM booked GROUP BY 1",
        "sm": "SELECT seller, m, sum(subtotal) AS g FROM base GROUP BY 1, 2",
        "kept": """SELECT x.m, sum(x.g) AS k FROM sm x
          WHERE EXISTS (SELECT 1 FROM sm y WHERE y.seller = x.seller AND y.m = x.m - INTERVAL 1 MONTH) GROUP BY 1""",
        "prev": "SELECT CAST(m + INTERVAL 1 MONTH AS DATE) AS m, sum(g) AS p FROM sm GROUP BY 1",
        "per": f"""SELECT m, sum(subtotal) AS gmv, {hundredth("sum(subtotal * fee)")} AS net,
          {hundredth("sum(subtotal * fee) FILTER (f = m)")} AS fresh,
          {hundredth("sum(subtotal * fee) FILTER (f < m)")} AS old, count(DISTINCT invoice_id) AS orders
          FROM base JOIN firsts USING (seller) GROUP BY m""",
        "raw": "SELECT m, count(*) AS n FROM booked GROUP BY 1",
    }


def revenue_report(a: Args) -> str:
    cells = {
        "GMV ($)": "gmv",
        "Net Revenue ($)": "net",
        "Weighted Take Rate (%)": f"100 * ({zdiv('net', 'gmv')})",
        "Revenue from New Sellers ($)": "fresh",
        "Revenue from Existing Sellers ($)": "old",
        "GMV Retention (%)": f"100 * ({zdiv('k', 'p')})",
        "Avg Order Value ($)": div("gmv", "orders"),
    }
    columns = ", ".join(f'{plain(e)} AS "{n}"' for n, e in cells.items())
    body = f"""SELECT strftime(c.m, '%Y-%m') AS "Month", {columns}, coalesce(n, 0) AS "Total Invoices"
    FROM ({calendar(a)}) c LEFT JOIN per USING (m) LEFT JOIN kept USING (m) LEFT JOIN prev USING (m) LEFT JOIN raw USING (m)"""
    return with_views(a, body, "booked", extra=_revenue_views())


def user_store_report(a: Args) -> str:
    extra = {
        "act": """SELECT store_id, CAST(date_trunc('month', signed) AS DATE) AS m, bought, sold
          FROM legs WHERE status <> 'NOT_STARTED'""",
        "firsts": "SELECT store_id, min(m) AS f FROM act GROUP BY 1",
        "signup": "SELECT *, CAST(date_trunc('month', created) AS DATE) AS m FROM stores",
        "ns": "SELECT m, count(*) AS signups FROM signup GROUP BY 1",
        "ob": """SELECT m, count(*) AS onboards FROM signup
          WHERE funded AND date_trunc('month', created + to_days(CAST(store_id % 40 AS INTEGER))) = m GROUP BY 1""",
        "nc": "SELECT f AS m, count(*) AS customers FROM firsts GROUP BY 1",
        "ca": "SELECT m, count(*) AS activations FROM signup JOIN firsts USING (store_id) WHERE f = m GROUP BY 1",
        "au": """SELECT m, count(DISTINCT store_id) AS st, count(DISTINCT store_id) FILTER (bought) AS bu,
          count(DISTINCT store_id) FILTER (sold) AS se FROM act GROUP BY 1""",
    }
    share = {k: f"coalesce({pct(k, 'signups')}, 0)" for k in ("onboards", "activations")}
    body = f"""
    SELECT strftime(c.m, '%Y-%m') AS "Month", coalesce(signups, 0) AS "New Sign-ups", coalesce(onboards, 0) AS "New Onboards",
      {share["onboards"]} AS "New Onboards Percent", coalesce(customers, 0) AS "New Customers",
      coalesce(activations, 0) AS "Activations", {share["activations"]} AS "Activations Percent",
      coalesce(st, 0) AS "Active Stores", coalesce(bu, 0) AS "Active Buyers", coalesce(se, 0) AS "Active Sellers"
    FROM ({calendar(a)}) c LEFT JOIN ns USING (m) LEFT JOIN ob USING (m) LEFT JOIN nc USING (m)
    LEFT JOIN ca USING (m) LEFT JOIN au USING (m)"""
    return with_views(a, body, "legs", "stores", extra=extra)


# ---- sell-through ----


def benchmark_markets(a: Args) -> str:
    groups = """
    SELECT st.state, grp, ndc, count(*) AS posts, count(DISTINCT l.post_id) FILTER (buyer IS NOT NULL) AS sold,
      count(DISTINCT l.seller) AS sellers, count(DISTINCT buyer) FILTER (b.state = st.state) AS buyers
    FROM lines l JOIN drugs USING (ndc) JOIN stores st ON st.store_id = l.seller
    LEFT JOIN stores b ON b.store_id = buyer GROUP BY 1, 2, 3"""
    body = f"""SELECT state AS "State", grp AS "Drug Category", ndc AS "NDC", posts AS "Total Posts", sold AS "Total Sold",
      {pct("sold", "posts")} AS "STR (%)", sellers AS "Seller Stores", buyers AS "Buyer Stores (Same State)",
      {rnd(div("sellers", "buyers"), 2)} AS "Seller:Buyer Ratio"
    FROM ({groups}) WHERE posts >= {a.min_posts} AND sold / posts >= {a.min_rate}"""
    return with_views(a, body, "lines", "drugs", "stores")


def _state_summary(role: str, names: tuple[str, str, str, str]) -> Callable[[Args], str]:
    def build(a: Args) -> str:
        body = f"""SELECT state AS "{names[0]}", count(*) AS "{names[1]}", count(DISTINCT {role}) AS "{names[2]}",
          {dbl("round(sum(subtotal), 2)")} AS "{names[3]}"
        FROM lines JOIN stores ON store_id = {role} WHERE buyer IS NOT NULL GROUP BY 1"""
        return with_views(a, body, "lines", "stores")

    return build


STRICT = "CASE WHEN qty > 0 THEN unit_price * qty - price ELSE package_price - price END"
FILLED_LENIENT = (
    "CASE WHEN qty IS NULL THEN coalesce(package_price, 0) ELSE qty * coalesce(unit_price, 0) END - coalesce(price, 0)"
)
LENIENT = "CASE WHEN qty IS NULL THEN package_price ELSE qty * unit_price END - coalesce(price, 0)"


def buyer_stores(a: Args) -> str:
    lines = f"""SELECT s.buyer, {STRICT} AS gain, coalesce(s.signed, s.created) AS moment
      FROM sold s JOIN posts USING (post_id) JOIN drugs USING (ndc) WHERE price IS NOT NULL
      AND coalesce(s.signed, s.created) BETWEEN {ts(a.start)} AND {ts(a.end)}"""
    months = "epoch(max(moment) - min(moment)) / (86400 * 30.44::DOUBLE)"
    body = f"""SELECT buyer AS "Buyer ID", any_value(name) AS "Store Name", any_value(state) AS "State",
      count(*) AS "Posts Bought", {rnd(div("sum(gain)", "count(*)"), 2)} AS "Avg Savings Per Post",
      {dbl("round(sum(gain), 2)")} AS "Total Savings", min(moment) AS "First Purchase", max(moment) AS "Last Purchase",
      {rnd(div("sum(gain)", months), 2)} AS "Avg Monthly Savings"
    FROM ({lines}) JOIN stores ON store_id = buyer GROUP BY buyer HAVING count(*) >= {a.min_sales}"""
    return with_views(a, body, "sold", "posts", "drugs", "stores")


def _rates() -> str:
    return f"""count(*) AS "Posts Made", count(signed) AS "Posts Sold", {pct("count(signed)", "count(*)")} AS "STR (%)",
      {rnd("avg(days)", 2)} AS "Avg Days to Sale" """


SIGNED_MONEY = f"""{dbl("round(coalesce(sum(subtotal) FILTER (signed IS NOT NULL), 0), 2)")} AS "Total Revenue",
      {rnd(div("sum(subtotal) FILTER (signed IS NOT NULL)", "count(signed)"), 2)} AS "Avg Revenue Per Sale" """


def drug_analysis(a: Args) -> str:
    body = f"""SELECT grp AS "Drug Category", ndc AS "NDC", display AS "Drug Name", pack AS "Packaging", {_rates()}, {SIGNED_MONEY}
    FROM lines JOIN drugs USING (ndc) GROUP BY grp, ndc, display, pack HAVING count(signed) >= {a.min_sales}"""
    return with_views(a, body, "lines", "drugs")


def seller_stores(a: Args) -> str:
    months = "epoch(max(listed) - min(listed)) / (86400 * 30.44::DOUBLE)"
    body = f"""SELECT l.seller AS "Seller ID", any_value(name) AS "Store Name", any_value(state) AS "State", {_rates()},
      {rnd(div("sum(subtotal)", "count(subtotal)"), 2)} AS "Avg Revenue Per Sale",
      {dbl("round(coalesce(sum(subtotal), 0), 2)")} AS "Total Revenue",
      {rnd(div("round(coalesce(sum(subtotal), 0), 2)", months), 2)} AS "Avg Monthly Revenue",
      min(listed) AS "First Post Date", max(listed) AS "Last Post Date"
    FROM lines l JOIN stores ON store_id = seller JOIN drugs USING (ndc) GROUP BY l.seller HAVING count(signed) >= {a.min_sales}"""
    return with_views(a, body, "lines", "stores", "drugs")


def state_analysis(a: Args) -> str:
    body = f"""SELECT grp AS "Drug Category", b.state AS "Buyer State", st.state AS "Seller State", {_rates()}, {SIGNED_MONEY}
    FROM lines l JOIN drugs USING (ndc) JOIN stores st ON st.store_id = l.seller LEFT JOIN stores b ON b.store_id = l.buyer
    GROUP BY 1, 2, 3 HAVING count(signed) >= {a.min_sales}"""
    return with_views(a, body, "lines", "drugs", "stores")


# ---- key figures ----


def _kpi(a: Args, role: str) -> tuple[str, dict[str, str]]:
    label = "Buyer" if role == "buyer" else "Seller"
    inv = f"""SELECT s.* FROM booked s WHERE signed BETWEEN {ts(a.start)} AND {ts(a.end)} AND {HAS_ITEM}"""
    firsts = f"SELECT {role}, min(m) AS f FROM inv GROUP BY 1"
    # Lines are counted per invoice over all its sale rows, and stand with each of these rows again.
    priced = "JOIN posts USING (post_id) LEFT JOIN drugs USING (ndc)" if role == "buyer" else ""
    gain = f"sum({FILLED_LENIENT})" if role == "buyer" else "0"
    units = f"""SELECT inv.m, sum(x.units) AS units, sum(x.gain) AS gain FROM inv LEFT JOIN (
        SELECT inv.invoice_id, count(*) AS units, {gain} AS gain FROM inv
        JOIN items i ON i.invoice_id = inv.invoice_id AND i.included {priced} GROUP BY 1) x USING (invoice_id)
      GROUP BY 1"""
    months = f"""SELECT m, sum(subtotal) AS gmv, count(*) AS n, count(DISTINCT {role}) AS act,
      count(DISTINCT {role}) FILTER (f = m) AS fresh, sum(subtotal) FILTER (f = m) AS g_new,
      sum(subtotal) FILTER (f < m) AS g_old, sum({REVENUE}) AS net FROM inv JOIN firsts USING ({role}) GROUP BY m"""
    count = (lambda e: dbl(e)) if role == "seller" else (lambda e: e)
    last = (
        f"""{dbl(f"round({hundredth('net')}, 2)")} AS "Net Revenue ($)" """
        if role == "seller"
        else f"""{dbl("round(coalesce(gain, 0), 2)")} AS "Total Savings ($)" """
    )
    body = f"""SELECT strftime(m, '%b %Y') AS "Month", {dbl("gmv")} AS "GMV ($)", n AS "Total Transactions",
      CAST(coalesce(units, 0) AS BIGINT) AS "Units {'Sold' if role == 'seller' else 'Bought'}",
      {count("act")} AS "Active {label}s", {count("fresh")} AS "New {label}s", {count("act - fresh")} AS "Repeat {label}s",
      {dbl("coalesce(g_new, 0)")} AS "GMV from New ($)", {dbl("coalesce(g_old, 0)")} AS "GMV from Repeat ($)",
      {rnd(div("gmv", "n"), 2)} AS "Avg Order Value ($)", {last}
    FROM mon LEFT JOIN un USING (m)"""
    return body, {"inv": inv, "firsts": firsts, "un": units, "mon": months}


def kpi(role: str) -> Callable[[Args], str]:
    def build(a: Args) -> str:
        body, extra = _kpi(a, role)
        return with_views(a, body, "booked", "items", *(["posts", "drugs"] if role == "buyer" else []), extra=extra)

    return build


# ---- investor ----

FACTS = {
    "rev_by_buyer": ("buyer", f"sum(round({hundredth(REVENUE)}, 2))"),
    "rev_by_seller": ("seller", f"sum(round({hundredth(REVENUE)}, 2))"),
    "buyer_spend": ("buyer", "sum(subtotal)"),
    "seller_earnings": ("seller", "sum(subtotal)"),
    "buyer_txn": ("buyer", "count(*)"),
    "seller_txn": ("seller", "count(*)"),
}


def _long(a: Args, fact: str) -> str:
    role, value = FACTS[fact]
    return f"""SELECT {role} AS store_id, m AS sale_month, CAST({value} AS DECIMAL(18,2)) AS value
      FROM booked s WHERE signed BETWEEN {ts(a.start)} AND {ts(a.end)} AND {HAS_ITEM} GROUP BY 1, 2"""


def fact(name: str) -> Callable[[Args], str]:
    def build(a: Args) -> str:
        body = f"SELECT store_id, sale_month, {dbl('value')} AS value FROM lng"
        return with_views(a, body, "booked", "items", extra={"lng": _long(a, name)})

    return build


def labels(a: Args) -> list[tuple[str, dt.date]]:
    out, day = [], a.start.replace(day=1)
    while day <= a.end:
        out.append((f"{MONTHS[day.month - 1]} {day.year}", day))
        day = (day + dt.timedelta(days=32)).replace(day=1)
    return out


def _wide(a: Args, show: Callable[[str], str]) -> str:
    cells = [(label, f"coalesce(sum(value) FILTER (sale_month = {d(day)}), 0)") for label, day in labels(a)]
    cells.append(("Total", "sum(value)"))
    return ", ".join(f'{show(e)} AS "{n}"' for n, e in cells)


def pivot(name: str) -> Callable[[Args], str]:
    def build(a: Args) -> str:
        body = f"""SELECT store_id AS "Store ID", {_wide(a, dbl)} FROM lng GROUP BY store_id"""
        return with_views(a, body, "booked", "items", extra={"lng": _long(a, name)})

    return build


def ir_months(a: Args) -> str:
    body = """SELECT CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS sale_month
      FROM (SELECT date_trunc('month', min(signed)) AS lo, date_trunc('month', max(signed)) AS hi FROM booked)"""
    return with_views(a, f"SELECT sale_month, strftime(sale_month, '%b %Y') AS pretty FROM ({body})", "booked")


# ---- sheets ----


def shown(expr: str, digits: int) -> str:
    return f"format('{{:,.{digits}f}}', {dbl(f'round(CAST({expr} AS DECIMAL(38,10)), {digits})')})"


def shown_by_value(expr: str) -> str:
    return f"CASE WHEN ({expr}) = floor({expr}) THEN {shown(expr, 0)} ELSE {shown(expr, 2)} END"


MONEY_COLUMNS = ("GMV ($)", "GMV from New ($)", "GMV from Repeat ($)", "Avg Order Value ($)", "Net Revenue ($)", "Total Savings ($)")


def _kpi_columns(role: str) -> list[str]:
    label, unit = ("Buyer", "Bought") if role == "buyer" else ("Seller", "Sold")
    return ["GMV ($)", "Total Transactions", f"Units {unit}", f"Active {label}s", f"New {label}s", f"Repeat {label}s",
            "GMV from New ($)", "GMV from Repeat ($)", "Avg Order Value ($)",
            "Total Savings ($)" if role == "buyer" else "Net Revenue ($)"]


def kpi_formatted(role: str) -> Callable[[Args], str]:
    def build(a: Args) -> str:
        body, extra = _kpi(a, role)
        cells = ", ".join(
            f'{shown(chr(34) + c + chr(34), 2 if c in MONEY_COLUMNS else 0)} AS "{c}"' for c in _kpi_columns(role)
        )
        views = ["booked", "items", *(["posts", "drugs"] if role == "buyer" else [])]
        return with_views(a, f'SELECT "Month", {cells} FROM ({body})', *views, extra=extra)

    return build


def investor_formatted(name: str) -> Callable[[Args], str]:
    def build(a: Args) -> str:
        wide = f"SELECT store_id, {_wide(a, lambda e: e)} FROM lng GROUP BY store_id"
        columns = [label for label, _ in labels(a)] + ["Total"]
        cells = ", ".join(f'{shown_by_value(chr(34) + c + chr(34))} AS "{c}"' for c in columns)
        body = f"""SELECT {shown("store_id", 0)} AS "Store ID", {cells} FROM ({wide})"""
        return with_views(a, body, "booked", "items", extra={"lng": _long(a, name)})

    return build


def _digits(value: str) -> str:
    n = f"length(CAST(CAST(floor(abs({value})) AS HUGEINT) AS VARCHAR))"
    return f"({n} + ({n} - 1) // 3 + 1)"


def widths_kpi(role: str) -> Callable[[Args], str]:
    def build(a: Args) -> str:
        body, extra = _kpi(a, role)
        rows = ["SELECT 1 AS position, 'Month' AS column_name, CAST(greatest(5, max(length(\"Month\"))) + 2 AS DOUBLE) AS width FROM k"]
        for i, c in enumerate(_kpi_columns(role), start=2):
            size = f"coalesce(max({_digits(chr(34) + c + chr(34))}), 0) + {3 if c in MONEY_COLUMNS else 0}"
            rows.append(f"SELECT {i}, '{c}', CAST(greatest({len(c)}, {size}) + 2 AS DOUBLE) FROM k")
        views = ["booked", "items", *(["posts", "drugs"] if role == "buyer" else [])]
        return with_views(a, " UNION ALL ".join(rows), *views, extra={**extra, "k": body})

    return build


def widths_investor(name: str) -> Callable[[Args], str]:
    def build(a: Args) -> str:
        columns = ["Store ID"] + [label for label, _ in labels(a)] + ["Total"]
        rows = []
        for i, c in enumerate(columns, start=1):
            q = f'"{c}"'
            size = f"coalesce(max({_digits(q)} + CASE WHEN {q} = floor({q}) THEN 0 ELSE 3 END), 0)"
            rows.append(f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, CAST(greatest({len(c)}, {size}) + 0.5 AS DOUBLE) AS width FROM k")
        wide = f"""SELECT store_id AS "Store ID", {_wide(a, lambda e: e)} FROM lng GROUP BY store_id"""
        return with_views(a, " UNION ALL ".join(rows), "booked", "items", extra={"lng": _long(a, name), "k": wide})

    return build


def report_set(a: Args) -> str:
    sheets = {
        "rev_by_buyer": "Platform Rev by Buyer", "rev_by_seller": "Platform Rev by Seller", "buyer_spend": "Buyer Spend",
        "seller_earnings": "Seller Earnings", "buyer_txn": "Buyer Transactions", "seller_txn": "Seller Transactions",
    }
    extra = {f"l_{k}": _long(a, k) for k in sheets}
    body = " UNION ALL ".join(
        f"SELECT {i} AS position, '{s}' AS sheet, count(DISTINCT store_id) AS stores, {dbl('sum(value)')} AS total FROM l_{k}"
        for i, (k, s) in enumerate(sheets.items(), start=1)
    )
    return with_views(a, body, "booked", "items", extra=extra)


def investor_rows(a: Args) -> str:
    facts = ["rev_by_buyer", "rev_by_seller", "buyer_spend", "seller_earnings", "buyer_txn", "seller_txn"]
    names = ["Platform Rev by Buyer", "Platform Rev by Seller", "Buyer Spend", "Seller Earnings", "Buyer Transactions",
             "Seller Transactions"]
    body = " UNION ALL ".join(
        f"SELECT {i} AS position, '{s}' AS sheet, store_id, sale_month, {dbl('value')} AS value FROM l_{k}"
        for i, (k, s) in enumerate(zip(facts, names, strict=True), start=1)
    )
    return with_views(a, body, "booked", "items", extra={f"l_{k}": _long(a, k) for k in facts})


def kpi_pair(a: Args) -> str:
    parts = [
        f"SELECT {i} AS position, '{name}' AS sheet, * FROM ({kpi(role)(a)})"
        for i, (name, role) in enumerate({"Buyers KPI": "buyer", "Sellers KPI": "seller"}.items(), start=1)
    ]
    return " UNION ALL BY NAME ".join(parts)


def report_names(a: Args) -> str:
    body = """SELECT 'Stores_KPI_Monthly_' || strftime(min(signed), '%b%y') || '_' || strftime(max(signed), '%b%y') AS report
      FROM booked"""
    return with_views(a, body, "booked")


# ---- operators on their own ----


def m_period(now: str, before: str) -> Callable[[Args], str]:
    def build(a: Args) -> str:
        body = f"""SELECT count(*) FILTER ({now}) AS sales_now, count(*) FILTER ({before}) AS sales_before,
          {dbl(f"sum(subtotal) FILTER ({now})")} AS gmv_now, {dbl(f"sum(subtotal) FILTER ({before})")} AS gmv_before
        FROM booked, t"""
        return with_views(a, body, "booked", extra={"t": bounds(a.as_of)})

    return build


def m_trailing(a: Args) -> str:
    now, old = f"{ts(a.as_of)} - to_days({a.churn_days - 1})", f"{ts(a.as_of)} - to_days({2 * a.churn_days - 1})"
    body = f"""SELECT count(*) FILTER (signed >= {now}) AS sales_now,
      count(*) FILTER (signed >= {old} AND signed < {now}) AS sales_before,
      {dbl(f"sum(subtotal) FILTER (signed >= {now})")} AS gmv_now,
      {dbl(f"sum(subtotal) FILTER (signed >= {old} AND signed < {now})")} AS gmv_before FROM done"""
    return with_views(a, body, "done")


def m_store_activity(a: Args) -> str:
    body = """SELECT store_id, CAST(date_trunc('month', signed) AS DATE) AS month, bool_or(bought) AS bought, bool_or(sold) AS sold
      FROM legs WHERE status <> 'NOT_STARTED' GROUP BY 1, 2"""
    return with_views(a, body, "legs")


def m_first(a: Args) -> str:
    return with_views(a, "SELECT seller AS seller_id, min(signed) AS first FROM booked GROUP BY 1", "booked")


def m_first_in_range(a: Args) -> str:
    body = f"""SELECT buyer AS buyer_id, min(signed) AS first FROM booked
      WHERE signed BETWEEN {ts(a.sub_start)} AND {ts(a.sub_end)} GROUP BY 1"""
    return with_views(a, body, "booked")


def m_distinct(a: Args) -> str:
    body = f"""SELECT count(DISTINCT store_id) FILTER ({FULL_DAY_NOW}) AS keys_now,
      count(DISTINCT store_id) FILTER ({FULL_DAY_BEFORE}) AS keys_before
    FROM legs, t WHERE status <> 'NOT_STARTED'"""
    return with_views(a, body, "legs", extra={"t": bounds(a.as_of)})


def m_days_spine(a: Args) -> str:
    body = """SELECT CAST(date_trunc('month', created) AS DATE) AS month, count(*) AS posts FROM posts GROUP BY 1"""
    full = f"""SELECT c.m AS month, coalesce(posts, 0) AS posts
      FROM (SELECT CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS m FROM
        (SELECT date_trunc('month', min(created)) AS lo, date_trunc('month', max(created)) AS hi FROM posts)) c
      LEFT JOIN ({body}) x ON x.month = c.m"""
    return with_views(a, full, "posts")


def m_split(a: Args) -> str:
    body = f"""SELECT m AS month, {dbl("coalesce(sum(subtotal) FILTER (f = m), 0)")} AS new_gmv,
      {dbl("coalesce(sum(subtotal) FILTER (f < m), 0)")} AS existing_gmv
    FROM booked JOIN (SELECT seller, min(m) AS f FROM booked GROUP BY 1) USING (seller) GROUP BY 1"""
    return with_views(a, body, "booked")


def m_retention(a: Args) -> str:
    body = f"""SELECT kept.m AS month, {dbl("k")} AS retained_gmv, {dbl("p")} AS previous_gmv,
      {rnd(zdiv("k", "p"), 4)} AS retention FROM kept JOIN prev USING (m)"""
    return with_views(a, body, "booked", extra=_revenue_views())


def m_activation(a: Args) -> str:
    body = """SELECT CAST(date_trunc('month', created) AS DATE) AS month, count(*) AS activations FROM stores
      JOIN (SELECT store_id, min(signed) AS f FROM legs WHERE status <> 'NOT_STARTED' GROUP BY 1) USING (store_id)
      WHERE date_trunc('month', created) = date_trunc('month', f) GROUP BY 1"""
    return with_views(a, body, "stores", "legs")


def m_onboarding(a: Args) -> str:
    body = """SELECT CAST(date_trunc('month', created) AS DATE) AS month, count(*) AS onboards FROM stores
      WHERE funded AND date_trunc('month', created) = date_trunc('month', created + to_days(CAST(store_id % 40 AS INTEGER)))
      GROUP BY 1"""
    return with_views(a, body, "stores")


def m_sold_items(a: Args) -> str:
    body = f"SELECT post_id, count(*) AS items, {dbl('sum(subtotal)')} AS gmv FROM sold GROUP BY 1"
    return with_views(a, body, "sold")


def m_sell_through(a: Args) -> str:
    body = f"""SELECT seller AS seller_id, state AS buyer_state, count(*) AS made, count(signed) AS sold,
      CAST(coalesce(sum(days), 0) AS BIGINT) AS days, {dbl("coalesce(sum(subtotal), 0)")} AS subtotal
    FROM lines LEFT JOIN stores ON store_id = buyer GROUP BY 1, 2"""
    return with_views(a, body, "lines", "stores")


def m_savings(value: str, guard: str) -> Callable[[Args], str]:
    def build(a: Args) -> str:
        body = f"""SELECT ndc, count({value}) AS lines, {dbl(f"sum({value})")} AS savings
        FROM sold s JOIN posts USING (post_id) JOIN drugs USING (ndc) {guard} GROUP BY 1"""
        return with_views(a, body, "sold", "posts", "drugs")

    return build


def m_take_rate(a: Args) -> str:
    body = f"""SELECT m AS month, {rnd(div(hundredth(f"sum({REVENUE})"), "sum(subtotal)"), 4)} AS take_rate FROM booked GROUP BY 1"""
    return with_views(a, body, "booked")


def m_order_value(a: Args) -> str:
    body = f"""SELECT m AS month, {rnd(div("sum(subtotal)", "count(DISTINCT invoice_id)"), 2)} AS order_value FROM booked GROUP BY 1"""
    return with_views(a, body, "booked")


def m_days(a: Args) -> str:
    body = f"""SELECT ndc, {rnd("avg(extract('day' FROM s.signed - p.created))", 2)} AS avg_days
      FROM sold s JOIN posts p USING (post_id) GROUP BY 1"""
    return with_views(a, body, "sold", "posts")


def m_monthly_rate(a: Args) -> str:
    months = "epoch(max(signed) - min(signed)) / (86400 * 30.44::DOUBLE)"
    body = f"SELECT buyer AS buyer_id, {rnd(div('sum(subtotal)', months), 2)} AS per_month FROM booked GROUP BY 1"
    return with_views(a, body, "booked")


def m_spine_fill(a: Args) -> str:
    body = f"SELECT c.m AS month, count(invoice_id) AS sales FROM ({calendar(a)}) c LEFT JOIN done USING (m) GROUP BY 1"
    return with_views(a, body, "done")


def m_label_lookup(a: Args) -> str:
    # The calendar covers the sub-range only: other months have no label and leave the sums.
    body = f"""SELECT strftime(sale_month, '%b %Y') AS label, {dbl("sum(value)")} AS value FROM lng
      WHERE sale_month BETWEEN date_trunc('month', {ts(a.sub_start)}) AND {ts(a.sub_end)} GROUP BY 1"""
    return with_views(a, body, "booked", "items", extra={"lng": _long(a, "buyer_spend")})


ORACLES: dict[str, Callable[[Args], str]] = {
    "r01_admin_metrics": admin_metrics,
    "r02_monthly_goal": monthly_goal,
    "r03_new_customers": new_customers,
    "r04_new_signups": new_signups,
    "r05_churn": churn_rates,
    "r06_mtd_activation": mtd_activation,
    "r07_mtd_active_posts": mtd_active_posts,
    "r08_mtd_active_stores": mtd_active_stores,
    "r09_mtd_aov": mtd_aov,
    "r10_mtd_avg_days": mtd_avg_days,
    "r11_mtd_items_sold": mtd_items_sold,
    "r12_mtd_total_invoices": mtd_total_invoices,
    "r13_completed_gmv": _month_money("COMPLETED", "sum(subtotal)", "gmv_mtd"),
    "r14_completed_revenue": _month_money("COMPLETED", hundredth(f"sum({REVENUE})"), "total_platform_revenue_mtd"),
    "r15_pending_gmv": _month_money("PENDING", "sum(subtotal)", "total_pending_amount"),
    "r16_pending_revenue": _month_money("PENDING", hundredth(f"sum({REVENUE})"), "total_platform_revenue_pending"),
    "r17_weighted_take_rate": weighted_take_rate,
    "r18_revenue_mix": revenue_mix,
    "r19_gmv_retention_mtd": gmv_retention_mtd,
    "r20_marketplace_report": marketplace_report,
    "r21_revenue_report": revenue_report,
    "r22_user_store_report": user_store_report,
    "r23_benchmark_markets": benchmark_markets,
    "r24_buyer_state_summary": _state_summary(
        "buyer", ("Buyer State", "Total Purchases", "Unique Buyer Stores", "Total Purchase Revenue")),
    "r25_buyer_stores": buyer_stores,
    "r26_drug_analysis": drug_analysis,
    "r27_seller_state_summary": _state_summary(
        "seller", ("Seller State", "Total Sales", "Unique Seller Stores", "Total Sales Revenue")),
    "r28_seller_stores": seller_stores,
    "r29_state_analysis": state_analysis,
    "r30_kpi_buyers": kpi("buyer"),
    "r31_kpi_sellers": kpi("seller"),
    "r32_ir_months": ir_months,
    "r33_ir_buyer_spend": fact("buyer_spend"),
    "r34_ir_seller_earnings": fact("seller_earnings"),
    "r35_ir_buyer_txn": fact("buyer_txn"),
    "r36_ir_seller_txn": fact("seller_txn"),
    "r37_ir_rev_by_buyer": fact("rev_by_buyer"),
    "r38_ir_rev_by_seller": fact("rev_by_seller"),
    "t01_month_labels": m_label_lookup,
    **{f"t02_pivot_{name}": pivot(name) for name in FACTS},
    "t05_report_set": report_set,
    "t05_investor_rows": investor_rows,
    "t05_kpi_pair": kpi_pair,
    "t06_kpi_buyers_formatted": kpi_formatted("buyer"),
    "t06_kpi_sellers_formatted": kpi_formatted("seller"),
    "t07_investor_formatted": investor_formatted("buyer_spend"),
    "t07_investor_counts_formatted": investor_formatted("seller_txn"),
    **{
        f"t07_{name}_formatted": investor_formatted(name)
        for name in ("seller_earnings", "buyer_txn", "rev_by_buyer", "rev_by_seller")
    },
    **{
        f"t08_{name}_widths": widths_investor(name)
        for name in ("seller_earnings", "buyer_txn", "seller_txn", "rev_by_buyer", "rev_by_seller")
    },
    "t08_kpi_sellers_widths": widths_kpi("seller"),
    "t08_kpi_widths": widths_kpi("buyer"),
    "t08_investor_widths": widths_investor("buyer_spend"),
    "t09_report_name": report_names,
    "m01_mtd_to_midnight": m_period(TO_MIDNIGHT_NOW, TO_MIDNIGHT_BEFORE),
    "m02_mtd_full_day": m_period(FULL_DAY_NOW, FULL_DAY_BEFORE),
    "m03_calendar_month": m_period("signed >= m0 AND signed < m2", "signed >= m1 AND signed < m0"),
    "m04_trailing_pair": m_trailing,
    "m05_distinct_in_periods": m_distinct,
    "m06_store_activity": m_store_activity,
    "m07_first_activity": m_first,
    "m08_first_activity_in_range": m_first_in_range,
    "m09_split_new_existing": m_split,
    "m10_gmv_retention": m_retention,
    "m11_cohort_activation": m_activation,
    "m12_onboarding": m_onboarding,
    "m13_churn_flags": churn_flags,
    "m14_sold_items": m_sold_items,
    "m15_sell_through": m_sell_through,
    "m16_savings_strict": m_savings(STRICT, "WHERE price IS NOT NULL"),
    "m17_savings_lenient": m_savings(LENIENT, ""),
    "m18_take_rate": m_take_rate,
    "m19_avg_order_value": m_order_value,
    "m20_days_to_sale": m_days,
    "m21_monthly_rate": m_monthly_rate,
    "m22_month_spine": m_days_spine,
    "m23_spine_fill": m_spine_fill,
}

# The reports from a kept state are the reports.
ORACLES |= {
    f"{name}_kept": ORACLES[name]
    for name in (
        "r03_new_customers", "r06_mtd_activation", "r18_revenue_mix", "r21_revenue_report", "r22_user_store_report",
    )
}


def every_day(report: Callable[[Args], str]) -> Callable[[Args], str]:
    """The report of each day of the range by itself."""

    def build(a: Args) -> str:
        count = (a.days_end - a.days_start).days + 1
        days = [a.days_start + dt.timedelta(days=i) for i in range(count)]
        return " UNION ALL ".join(f"SELECT {d(day)} AS as_of, * FROM ({report(replace(a, as_of=day))})" for day in days)

    return build


ORACLES |= {
    "r05_churn_by_day": every_day(churn_rates),
    "r08_active_stores_by_day": every_day(mtd_active_stores),
    "r09_aov_by_day": every_day(mtd_aov),
    "r10_avg_days_by_day": every_day(mtd_avg_days),
    "r11_items_sold_by_day": every_day(mtd_items_sold),
    "r12_total_invoices_by_day": every_day(mtd_total_invoices),
}


def _spans(a: Args) -> str:
    return f"""SELECT CAST(last_month - to_months(months - 1) AS DATE) AS first_month, last_month, months FROM (
        SELECT CAST(unnest(generate_series(date_trunc('month', {d(a.sub_start)}), date_trunc('month', {d(a.sub_end)}),
          INTERVAL 1 MONTH)) AS DATE) AS last_month), (VALUES (1), (3), (12)) AS v(months)"""


IN_SPAN = "signed >= first_month AND signed < last_month + INTERVAL 1 MONTH AND status IN ('COMPLETED', 'PENDING')"


def distinct_spans(a: Args) -> str:
    body = f"""SELECT first_month, last_month, months,
        (SELECT count(DISTINCT store) FROM (SELECT buyer AS store, * FROM sales UNION ALL SELECT seller, * FROM sales) WHERE {IN_SPAN}) AS stores,
        (SELECT count(DISTINCT invoice_id) FROM sales WHERE {IN_SPAN}) AS invoices
        FROM spans"""
    return with_views(a, body, "sales", extra={"spans": _spans(a)})


def buyers_by_state_spans(a: Args) -> str:
    body = f"""SELECT first_month, last_month, months, state, count(DISTINCT buyer) AS buyers
        FROM spans JOIN sales ON {IN_SPAN} JOIN stores ON store_id = buyer GROUP BY ALL"""
    return with_views(a, body, "sales", "stores", extra={"spans": _spans(a)})


ORACLES |= {"p47_distinct_spans": distinct_spans, "p48_buyers_by_state_spans": buyers_by_state_spans}


def contract(a: Args) -> str:
    def rule(relation: str, column: str, name: str, rows: str, example: str, source: str) -> str:
        return (
            f"SELECT '{relation}' AS relation, '{column}' AS \"column\", '{name}' AS rule, CAST({rows} AS BIGINT) AS rows, "
            f"min(CAST({example} AS VARCHAR)) AS example FROM {source}"
        )

    nothing = "NULL"
    checks = [
        rule("sales", "buyer_id", "orphan", "count(*)", "buyer", "sales WHERE buyer NOT IN (SELECT seller FROM posts)"),
        rule("sales", "seller_id", "orphan", "count(*)", "seller", "sales WHERE seller NOT IN (SELECT store_id FROM stores)"),
        rule("sales", "seller_signed_on", "required", "count(*)", nothing, "sales WHERE signed IS NULL"),
        rule("sales", "fee_percent", "required", "count(*)", nothing, "sales WHERE fee IS NULL"),
        rule("sales", "fee_percent", "range", "count(*)", "fee", "sales WHERE fee NOT BETWEEN 0 AND 7"),
        rule("sales", "invoice_status", "domain", "count(*)", "status", "sales WHERE status = 'NOT_STARTED'"),
        rule("sales", "invoice_id", "unique", "sum(n - 1)", "invoice_id", "(SELECT invoice_id, count(*) AS n FROM sales GROUP BY 1) WHERE n > 1"),
        rule("posts", "seller_id", "unique", "sum(n - 1)", "seller", "(SELECT seller, count(*) AS n FROM posts GROUP BY 1) WHERE n > 1"),
        rule("posts", "price", "required", "count(*)", nothing, "posts WHERE price IS NULL"),
        rule("posts", "status", "domain", "count(*)", "status", "posts WHERE status = 'DRAFT'"),
    ]
    return with_views(a, f"SELECT * FROM ({' UNION ALL '.join(checks)}) WHERE rows > 0", "sales", "posts", "stores")


def shares(a: Args) -> str:
    body = f"""SELECT seller AS seller_id, m AS month, {dbl("gmv")} AS gmv, {dbl("total")} AS total,
        {dbl(rnd(f"100 * {div('gmv', 'total')}", 4))} AS share_pct
        FROM (SELECT *, sum(gmv) OVER (PARTITION BY m) AS total FROM (SELECT seller, m, sum(subtotal) AS gmv FROM booked GROUP BY 1, 2))"""
    return with_views(a, body, "booked")


def ranked_sellers(a: Args) -> str:
    body = f"""SELECT row_number() OVER (ORDER BY gmv DESC, seller) AS position, seller AS seller_id, {dbl("gmv")} AS gmv
        FROM (SELECT seller, sum(subtotal) AS gmv FROM booked GROUP BY 1)"""
    return with_views(a, body, "booked")


ORACLES |= {"p01_contract": contract, "p60_share_of_month": shares, "p62_ranked_sellers": ranked_sellers}

ORACLES |= {
    "r01_admin_metrics_local": lambda a: admin_metrics(a, local_bounds(a.as_of, a.zone)),
    "r08_mtd_active_stores_local": lambda a: mtd_active_stores(a, local_bounds(a.as_of, a.zone)),
}
