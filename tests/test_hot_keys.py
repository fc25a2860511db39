"""Reduced forms against brute force, with a third or more of all rows under one key."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators.churn import churn_flags
from bazaarlens.operators.periods import trailing_pair
from bazaarlens.operators.retention import gmv_retention
from bazaarlens.operators.sell_through import sell_through, with_matches
from bazaarlens.plans import investor, kpi, ops
from shop import rows, shop

DAY0 = dt.datetime(1998, 1, 1)
RANGE = (dt.date(1998, 1, 1), dt.date(1998, 12, 31))


def hot(rng, n, count=200):
    """Key 1 takes about half of the draws."""
    return [1 if rng.random() < 0.5 else rng.randint(1, n) for _ in range(count)]


@pytest.fixture(scope="module")
def facts():
    rng = random.Random(7)
    sales = [
        {"invoice_id": i, "buyer_id": b, "seller_id": s, "subtotal": rng.randint(1, 999),
         "seller_signed_on": None if rng.random() < 0.1 else DAY0 + dt.timedelta(days=rng.randint(0, 200), hours=i % 24)}
        for i, (b, s) in enumerate(zip(hot(rng, 12), hot(rng, 9)))
    ]
    items = [
        {"invoice_item_id": str(i), "invoice_id": rng.randint(0, 199), "post_id": p,
         "status": "INCLUDED" if rng.random() < 0.8 else "REMOVED"}
        for i, p in enumerate(hot(rng, 60, 400))
    ]
    posts = [
        {"post_id": i, "seller_id": i % 5, "ndc": i % 3, "created_at": DAY0 + dt.timedelta(days=i % 30, hours=13)}
        for i in range(1, 81)
    ]
    return sales, items, posts


def test_sell_through_equals_the_outer_join(spark, facts):
    sales, items, posts = facts
    state = {s["buyer_id"]: ["CA", "TX", None][s["buyer_id"] % 3] for s in sales}
    by_id = {s["invoice_id"]: s for s in sales}
    sold = defaultdict(list)
    for item in items:
        if item["status"] == "INCLUDED":
            sold[item["post_id"]].append(by_id[item["invoice_id"]])
    expected = defaultdict(lambda: [0, 0, 0, 0])
    for post in posts:
        for sale in sold[post["post_id"]] or [None]:
            group = expected[(post["seller_id"], state[sale["buyer_id"]] if sale else None)]
            group[0] += 1
            if sale:
                group[3] += sale["subtotal"]
                if sale["seller_signed_on"]:
                    group[1] += 1
                    span = sale["seller_signed_on"] - post["created_at"]
                    group[2] += int(span.total_seconds() / 86400)
    mk = shop(spark, sales=sales, invoice_items=items, posts=posts)
    states = spark.createDataFrame(list(state.items()), "buyer_id bigint, buyer_state string")
    lines = (
        mk.table("invoice_items").where("status = 'INCLUDED'").drop("created_at")
        .join(mk.table("sales"), "invoice_id").join(states, "buyer_id", "left")
        .select("post_id", "buyer_state", "seller_signed_on", "subtotal")
    )
    listed = mk.table("posts", "post_id", "created_at", "seller_id")
    found = sell_through(listed, lines, ["seller_id"], ["buyer_state"])
    assert {
        (r["seller_id"], r["buyer_state"]): [r["made"], r["sold"], r["days"], r["subtotal"]] for r in rows(found)
    } == dict(expected)


def test_a_hot_post_is_split(spark):
    """Half of all sales are of one post: its join partition is read in pieces."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        ids = spark.range(0, 40000, 1, 8)
        day = F.lit("1998-02-01 00:00:00").cast("timestamp_ntz")
        lines = ids.select(
            F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id")).alias("post_id"),
            F.when(F.col("id") % 3 > 0, day).alias("seller_signed_on"),
            (F.col("id") % 100).cast("decimal(18,2)").alias("subtotal"),
        )
        listed = ids.select(
            F.col("id").alias("post_id"), (F.col("id") % 7).alias("seller_id"),
            F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        )
        found = sell_through(listed, lines, ["seller_id"])
        got = {r["seller_id"]: (r["made"], r["sold"]) for r in rows(found)}
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    made, sold = Counter(i % 7 for i in range(0, 40000, 2)), Counter()
    for i in range(40000):
        seller = 1 if i % 2 == 0 else i % 7
        made[seller] += 1
        sold[seller] += i % 3 > 0
    assert got == {s: (made[s], sold[s]) for s in made}


def test_churn_flags_equal_distinct_counts(spark, facts):
    sales, _, posts = facts
    as_of, days = dt.date(1998, 3, 31), 30
    pair = trailing_pair(as_of, days)
    now, old = (dt.datetime.combine(d, dt.time()) for d in (pair.current.start, pair.previous.start))
    seen, past = defaultdict(set), set()

    def note(store, kind, key, moment):
        if moment and moment >= now:
            seen[store, kind].add(key)
        elif moment and moment >= old:
            past.add((store, kind))

    for s in sales:
        note(s["buyer_id"], "purchase", s["invoice_id"], s["seller_signed_on"])
        note(s["seller_id"], "sale", s["invoice_id"], s["seller_signed_on"])
    for p in posts:
        note(p["seller_id"], "post", p["post_id"], p["created_at"])
    mk = shop(spark, sales=sales, posts=posts)
    found = rows(churn_flags(mk.table("sales"), mk.table("posts"), pair))
    for r in found:
        for kind in ("purchase", "sale", "post"):
            assert r[f"{kind}s"] == len(seen[r["store_id"], kind])
            assert r[f"past_{kind}"] == ((r["store_id"], kind) in past)
    assert {r["store_id"] for r in found} == {k for k, _ in past} | {k for k, _ in seen}


def test_retention_equals_the_self_join(spark, facts):
    gmv = Counter()
    for s in facts[0]:
        if s["seller_signed_on"]:
            gmv[s["seller_id"], s["seller_signed_on"].date().replace(day=1)] += s["subtotal"]
    expected = {}
    for month in {m for _, m in gmv}:
        before = (month - dt.timedelta(days=1)).replace(day=1)
        kept = [v for (s, m), v in gmv.items() if m == month and (s, before) in gmv]
        if kept:
            expected[month] = (sum(kept), sum(v for (_, m), v in gmv.items() if m == before))
    frame = spark.createDataFrame([(s, m, v) for (s, m), v in gmv.items()], "seller_id bigint, month date, gmv bigint")
    assert {r["month"]: (r["retained_gmv"], r["previous_gmv"]) for r in rows(gmv_retention(frame))} == expected


def test_new_and_existing_add_up_to_the_revenue(spark, facts):
    mk = shop(spark, sales=facts[0], invoice_items=facts[1])
    for r in rows(ops.revenue_report(mk, *RANGE)):
        parts = float(r["Revenue from New Sellers ($)"]) + float(r["Revenue from Existing Sellers ($)"])
        assert parts == pytest.approx(float(r["Net Revenue ($)"]), abs=0.011)
    for r in rows(kpi.sellers_kpi(mk, *RANGE)):
        assert r["GMV from New ($)"] + r["GMV from Repeat ($)"] == r["GMV ($)"]


def test_sheets_from_one_pass_equal_the_single_pivots(spark, facts):
    mk = shop(spark, sales=facts[0], invoice_items=facts[1])
    together = rows(investor.all_sheets(mk, *RANGE))
    for fact, (sheet, _, _) in investor.FACTS.items():
        ours = [{k: v for k, v in r.items() if k not in ("position", "sheet")} for r in together if r["sheet"] == sheet]
        assert ours == rows(investor.store_month_pivot(mk, fact, *RANGE))
        total = investor.store_month_fact(mk, fact, *RANGE).agg(F.sum("value")).first()[0]
        assert sum(r["Total"] for r in ours) == pytest.approx(float(total))


def test_rows_without_a_key_are_not_joined_in_one_task(spark):
    """As unsold listings, which have no buyer, in the report of states."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, F.col("id") % 100).alias("key"), (F.col("id") % 700).alias("a"), F.col("id").alias("b")
    )
    others = spark.range(50).select((F.col("id") * 2).alias("key"), F.concat(F.lit("n"), "id").alias("name"))
    others = others.unionByName(others.limit(5)).unionByName(spark.createDataFrame([(None, "none")], "key bigint, name string"))
    held = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = with_matches(rows, others.hint("merge"), "key", "a", "b")
        assert found.columns == ["key", "a", "b", "name"]
        plain = rows.join(others, "key", "left")
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
        tasks = found.where("key IS NULL").groupBy(F.spark_partition_id()).count().count()
        assert tasks > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
