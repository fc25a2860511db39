"""What the reports take for granted of the relations, checked: types, keys, domains, ranges and references.

Each relation is read once. A row becomes a handful of facts: its key as a value of that key's domain, its references as
values of the domains of others, and the rules that it breaks. Facts are counted before they are shuffled, so a value
that a third of all rows refer to is one row per task; a value with two keys is a repeat, one with references and no
key an orphan. The result is a relation of violations, empty for a sound marketplace.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.sources.marketplace import Marketplace
from bazaarlens.sources.schema import schema

VIOLATIONS = "relation string, column string, rule string, rows bigint, example string, detail string"


@dataclass(frozen=True)
class Rules:
    """The key of a relation, columns that refer to keys (`relation.column`), columns that must not be NULL, domains of
    columns, and least and largest values. NULL is in every domain and range, and refers to nothing."""

    key: str | None = None
    references: Mapping[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    domains: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)


# fixed values: the statuses that the reports know
INVOICE_STATUSES = ("NOT_STARTED", "PENDING", "COMPLETED")
POST_STATUSES = ("ACTIVE", "SOLDOUT", "RESERVED", "DEACTIVATED", "EXPIRED", "DRAFT")

CONTRACT: dict[str, Rules] = {
    "sales": Rules(
        "invoice_id", {"buyer_id": "stores.store_id", "seller_id": "stores.store_id"},
        ("buyer_id", "seller_id", "subtotal", "created_at"), {"invoice_status": INVOICE_STATUSES},
        {"fee_percent": (0, 100), "subtotal": (0, 1e15)},
    ),
    "invoices": Rules(
        "invoice_id", {"buyer_id": "stores.store_id", "seller_id": "stores.store_id"}, ("created_at",),
        {"invoice_status": INVOICE_STATUSES},
    ),
    "invoice_items": Rules(
        "invoice_item_id", {"invoice_id": "sales.invoice_id", "post_id": "posts.post_id"}, ("invoice_id", "post_id"),
        {"status": ("INCLUDED", "REMOVED")},
    ),
    "posts": Rules(
        "post_id", {"seller_id": "stores.store_id", "ndc": "drugs.ndc_upc_hri"}, ("created_at",),
        {"status": POST_STATUSES}, {"price": (0, 1e15), "partial_quantity": (0, 1e15)},
    ),
    "drugs": Rules("ndc_upc_hri", {}, ("drug_group",), {}, {"package_price": (0, 1e15), "unit_price": (0, 1e15)}),
    "stores": Rules("store_id", {"address_id": "addresses.address_id", "funding_id": "funding_accounts.funding_id"}, ("created_at",)),
    "addresses": Rules("address_id", {}, ("state",)),
    "funding_accounts": Rules("funding_id", {}, ("funding_status",)),
    "users": Rules("id", {}, ("email",)),
    "monthly_sales_goal": Rules("month_year", {}, ("sales_goal",)),
}


def _found(mk: Marketplace, relation: str, declared: T.StructType) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The relation, and what is wrong with its columns: (column, detail)."""
    try:
        frame = mk.table(relation, *declared.names)
    except AnalysisException:
        frame = mk.table(relation)
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    wrong = [
        (f.name, "missing" if f.name not in kinds else f"{kinds[f.name].simpleString()}, declared {f.dataType.simpleString()}")
        for f in declared.fields
        if kinds.get(f.name) != f.dataType
    ]
    return frame, wrong


def _facts(frame: DataFrame, relation: str, rules: Rules) -> DataFrame | None:
    """(domain, value, said): one row per fact. `said` is `key`, a referring column, or a broken rule."""
    have = set(frame.columns)

    def fact(domain: str, value: Column, said: str) -> Column:
        return F.struct(F.lit(domain).alias("domain"), value.cast("string").alias("value"), F.lit(said).alias("said"))

    def when(condition: Column, of: Column) -> Column:
        return F.when(condition, of)

    facts = []
    if rules.key in have:
        key = F.col(rules.key)
        facts.append(when(key.isNotNull(), fact(f"{relation}.{rules.key}", key, "key")))
    for column, target in rules.references.items():
        if column in have:
            facts.append(when(F.col(column).isNotNull(), fact(target, F.col(column), f"{relation}.{column}")))
    for column in (*([rules.key] if rules.key else []), *rules.required):
        if column in have:
            facts.append(when(F.col(column).isNull(), fact("", F.lit(None), f"{relation}.{column}.required")))
    for column, domain in rules.domains.items():
        if column in have:
            facts.append(when(~F.col(column).isin(*domain), fact("", F.col(column), f"{relation}.{column}.domain")))
    for column, (least, most) in rules.ranges.items():
        if column in have:
            outside = ~F.col(column).between(least, most)
            facts.append(when(outside, fact("", F.col(column), f"{relation}.{column}.range")))
    if not facts:
        return None
    return frame.select(F.explode(F.array_compact(F.array(*facts))).alias("f")).select("f.*")


def violations(mk: Marketplace, contract: Mapping[str, Rules] | None = None, ids: str = "bigint") -> DataFrame:
    """(relation, column, rule, rows, example, detail) of what breaks the contract.

    Rules: `type` (rows is NULL, as it concerns all), `required`, `domain`, `range`, `unique` (rows beyond the first of
    their key) and `orphan` (rows whose reference has no key). The example is the smallest value concerned.
    """
    contract = contract or CONTRACT
    facts, wrong = [], []
    for relation, rules in contract.items():
        frame, columns = _found(mk, relation, schema(relation, ids))
        wrong += [(relation, column, "type", None, None, detail) for column, detail in columns]
        if (found := _facts(frame, relation, rules)) is not None:
            facts.append(found)
    types = mk.spark.createDataFrame(wrong, VIOLATIONS)
    if not facts:
        return types
    every = facts[0]
    for more in facts[1:]:
        every = every.unionByName(more)
    counts = every.groupBy("domain", "value", "said").agg(F.count(F.lit(1)).alias("n"))
    # Facts about one value meet: few rows, a key and the columns that refer to it.
    by_value = counts.groupBy("domain", "value").agg(
        F.sum(F.when(F.col("said") == "key", F.col("n"))).alias("keys"),
        F.collect_list(F.struct("said", "n")).alias("facts"),
    )
    met = by_value.select("domain", "value", "keys", F.explode("facts").alias("f")).select("domain", "value", "keys", "f.*")
    broken = F.col("domain") == ""
    repeated = (F.col("said") == "key") & (F.col("keys") > 1)
    orphan = (F.col("said") != "key") & F.col("keys").isNull() & ~broken
    place = F.split(F.when(F.col("said") == "key", F.col("domain")).otherwise(F.col("said")), "[.]")
    rule = F.when(broken, place[2]).when(repeated, "unique").when(orphan, "orphan")
    rows = F.when(repeated, F.col("n") - 1).otherwise(F.col("n"))
    found = (
        met.select(place[0].alias("relation"), place[1].alias("column"), rule.alias("rule"), rows.alias("n"), "value", "domain")
        .where("rule IS NOT NULL")
        .groupBy("relation", "column", "rule")
        .agg(
            F.sum("n").alias("rows"), F.min("value").alias("example"),
            F.max(F.when(F.col("rule") == "orphan", F.col("domain"))).alias("detail"),
        )
    )
    return found.unionByName(types).orderBy("relation", "column", "rule")
