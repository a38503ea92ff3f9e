"""The wide user table, one row per customer, derived from the order, line, event and supplier tables.

Money is summed as whole cents and rates as whole hundredths, so a sum does not depend on the order in which
partitions arrive. Each branch aggregates to one row per customer before it is joined, which keeps counts from
fanning out and leaves only unique keys in the joins. No branch gathers a customer's rows in one task: distinct
counts work on (customer, value) groups and every last step sums rows that are already pre-aggregated, so a customer
that holds a third of all rows costs no more than others. A caller that selects a few columns pays only for the
branches they need, since a left join to a frame with unique keys is dropped when none of its columns is used.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import materialize, new_path
from .contracts import SCORING_COLUMNS, SCORING_LABEL, TRAINING_COLUMNS, TRAINING_LABEL, USER_KEY

# Reference dates, tags and thresholds of the mapping, as SQL predicates over an order.
ORDER_DAY = "date'2001-08-02'"
EVENT_DAY = "date'2024-02-01'"
TAGS = {
    "success": "o_orderstatus = 'F'",
    "cancel": "o_orderstatus = 'O'",
    "refund": "o_orderstatus = 'P'",
    "flt": "o_orderpriority = '1-URGENT'",
    "htl": "o_orderpriority = '2-HIGH'",
    "trn": "o_orderpriority = '4-NOT SPECIFIED'",
    "first_class": "o_totalprice >= 250000",
    "aboard": "o_orderkey % 4 = 0",
    "guarantee": "o_orderkey % 3 = 0",
    "noshow": "o_orderkey % 5 = 0",
    "credit": "o_orderkey % 2 = 0",
    "debit": "o_orderkey % 2 = 1",
    "tenth": "o_orderkey % 10 = 0",
}
SEGMENTS = "array('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"
# ``rint`` stays in primitive doubles, where ``round`` would build a decimal per value.
CENTS = "cast(rint({0} * 100) as bigint)"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _where(*tags: str) -> str:
    return " AND ".join(TAGS[t] for t in tags) or "true"


def _count(*tags: str) -> str:
    return f"count(*) FILTER (WHERE {_where(*tags)})"


def _amount(*tags: str) -> str:
    return f"sum(_cents) FILTER (WHERE {_where(*tags)}) / 100.0D"


def _maximum(*tags: str) -> str:
    return f"coalesce(max(o_totalprice) FILTER (WHERE {_where(*tags)}), 0.0D)"


def _recency(*tags: str) -> str:
    return f"cast(datediff({ORDER_DAY}, max(to_date(o_orderdate)) FILTER (WHERE {_where(*tags)})) as bigint)"


def _aggregate(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in columns.items()])


def _order_measures() -> dict[str, str]:
    s = "success"
    out = {
        "ord_success_order_count": _count(s),
        "ord_cancel_order_count": _count("cancel"),
        "ord_cancel_htl_order_count": _count("cancel", "htl"),
        "ord_cancel_trn_order_count": _count("cancel", "trn"),
        "ord_success_first_class_order_count": _count(s, "first_class"),
        "ord_success_aboard_order_count": _count(s, "aboard"),
        "ord_success_htl_guarantee_order_count": _count(s, "htl", "guarantee"),
        "ord_success_htl_noshow_order_count": _count(s, "htl", "noshow"),
        "ord_success_order_amount": _amount(s),
        "ord_total_order_amount": _amount(),
        "ord_success_first_class_order_amount": _amount(s, "first_class"),
        "ord_success_aboard_order_amount": _amount(s, "aboard"),
        "ord_success_max_order_amount": _maximum(s),
        "voi_complrefund_count": _count("refund", "tenth"),
        "bil_payord_count": "count(*)",
        "bil_paysord_count": _count(s),
        "bil_refundord_count": _count("refund"),
        "_refund_htl": _count("refund", "htl"),
        "_first_order": "min(to_date(o_orderdate))",
    }
    for channel in ("flt", "htl", "trn"):
        out[f"ord_success_{channel}_order_count"] = _count(s, channel)
        out[f"ord_success_{channel}_order_amount"] = _amount(s, channel)
        out[f"ord_success_{channel}_max_order_amount"] = _maximum(s, channel)
        out[f"ord_success_{channel}_last_order_days"] = _recency(s, channel)
    for channel in ("flt", "htl"):
        for subset in ("first_class", "aboard"):
            out[f"ord_success_{channel}_{subset}_order_count"] = _count(s, channel, subset)
            out[f"ord_success_{channel}_{subset}_order_amount"] = _amount(s, channel, subset)
    for side in ("credit", "debit"):
        out[f"bil_payord_{side}_count"] = _count(side)
        out[f"bil_paysord_{side}_count"] = _count(s, side)
    return out


# What each branch yields per customer, as aggregate expressions.
ORDER_MEASURES = _order_measures()
ORDER_VARIETY = {
    "ord_success_order_type_count": "count(o_orderpriority) FILTER (WHERE ok)",
    "bil_ordertype_count": "count(o_orderpriority)",
    "bil_platform_count": "count(o_orderstatus)",
}
LINE_MEASURES = {
    "com_idno_count": "sum(n_suppliers)",
    "ord_success_order_cmobile_count": "sum(n_ok_suppliers)",
    "ord_success_order_acity_count": "count(s_nationkey) FILTER (WHERE nation_ok = 1)",
    "ord_success_flt_order_acity_count": "count(s_nationkey) FILTER (WHERE nation_flt = 1)",
    "_lead": "sum(lead_sum) / nullif(sum(lead_n), 0)",
    "ord_success_flt_avg_order_pricerate": "sum(rate_sum) / nullif(sum(rate_n), 0) / 100.0D",
    "_profit": "sum(profit_sum) / 10000.0D",
    "_generous": "cast(coalesce(sum(pct_sum) >= 5 * sum(pct_n), false) as bigint)",
}
# What the branches below read of a line and its order.
LINE_FACTS = {
    "o_custkey": "o_custkey",
    "l_suppkey": "l_suppkey",
    "l_partkey": "l_partkey",
    "l_linenumber": "l_linenumber",
    "ok": _where("success"),
    "flt": _where("success", "flt"),
    "lead": "cast(datediff(to_date(l_shipdate), to_date(o_orderdate)) as bigint)",
    "l_discount": "l_discount",
    "l_extendedprice": "l_extendedprice",
}
LINE_VARIETY = {
    "com_passenger_count": "count(l_partkey)",
    "com_mobile_count": "count(l_linenumber)",
}
EVENT_MEASURES = {
    "_idle_days": f"cast(datediff({EVENT_DAY}, max(day)) as bigint)",
    "_active_days": "count(distinct day)",
    "_errors": "count(*) FILTER (WHERE event_type = 'error')",
    "_clicks": "count(*) FILTER (WHERE event_type = 'click')",
    "_large_errors": "count(*) FILTER (WHERE event_type = 'error' AND value > 50)",
    "cap_tmoney_balance": "sum(_cents) FILTER (WHERE event_type = 'view') / 100.0D",
    "cap_wallet_balance": "sum(_cents) FILTER (WHERE event_type = 'purchase') / 100.0D",
}


def order_measures(orders: DataFrame, columns: dict[str, str] = ORDER_MEASURES) -> DataFrame:
    """Counts, amounts, maxima and recency per customer: one hash aggregate with partial sums."""
    priced = orders.withColumn("_cents", F.expr(CENTS.format("o_totalprice")))
    return _aggregate(priced, ["o_custkey"], columns)


def order_variety(orders: DataFrame, columns: dict[str, str] = ORDER_VARIETY) -> list[DataFrame]:
    """Distinct order priorities and statuses per customer, a frame each: one row per value is left before they are counted."""
    tagged = orders.withColumn("ok", F.expr(_where("success")))
    return [
        _aggregate(tagged.groupBy(F.col("o_custkey").alias(f"{value}_custkey"), value).agg(F.max("ok").alias("ok")), [f"{value}_custkey"], chosen)
        for value in ("o_orderpriority", "o_orderstatus") if (chosen := {n: e for n, e in columns.items() if value in e})
    ]


def line_measures(lines: DataFrame, suppliers: DataFrame, columns: dict[str, str] = LINE_MEASURES) -> DataFrame:
    """Sums over the customer's lines, with distinct suppliers and supplier nations.

    Groups shrink from (customer, supplier) over (customer, nation), where nations are counted, to customer, so each distinct
    count becomes a plain count of groups and the rows are never replicated.
    """
    facts = lines.selectExpr(
        "o_custkey AS l_custkey",
        "l_suppkey",
        "ok",
        "flt",
        "lead",
        CENTS.format("l_discount") + " AS pct",
        # Price and discount have two decimals each, so cents times percent is exact.
        f"{CENTS.format('l_extendedprice')} * {CENTS.format('l_discount')} AS profit",
    )
    sums = ["lead_sum", "lead_n", "rate_sum", "rate_n", "profit_sum", "pct_sum", "pct_n"]
    per_supplier = _aggregate(
        facts,
        ["l_custkey", "l_suppkey"],
        {
            "any_ok": "max(cast(ok as int))",
            "any_flt": "max(cast(flt as int))",
            "lead_sum": "sum(lead) FILTER (WHERE ok)",
            "lead_n": "count(lead) FILTER (WHERE ok)",
            "rate_sum": "sum(100 - pct) FILTER (WHERE flt)",
            "rate_n": "count(pct) FILTER (WHERE flt)",
            "profit_sum": "sum(profit) FILTER (WHERE ok)",
            "pct_sum": "sum(pct)",
            "pct_n": "count(pct)",
        },
    )
    located = per_supplier.join(
        suppliers.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left"
    )
    if not any("nation" in e for e in columns.values()):
        # Without a nation to count, (customer, supplier) shrinks to customer at once.
        counted = located.withColumns({
            "n_suppliers": F.expr("cast(l_suppkey IS NOT NULL as bigint)"),
            "n_ok_suppliers": F.expr("cast(l_suppkey IS NOT NULL AND any_ok <=> 1 as bigint)"),
        })
        return _aggregate(counted, ["l_custkey"], columns)
    per_nation = _aggregate(
        located,
        ["l_custkey", "s_nationkey"],
        {
            "n_suppliers": "count(l_suppkey)",
            "n_ok_suppliers": "count(l_suppkey) FILTER (WHERE any_ok = 1)",
            "nation_ok": "max(any_ok)",
            "nation_flt": "max(any_flt)",
            **{c: f"sum({c})" for c in sums},
        },
    )
    return _aggregate(per_nation, ["l_custkey"], columns)


def line_variety(lines: DataFrame, columns: dict[str, str] = LINE_VARIETY) -> list[DataFrame]:
    """Distinct parts and line numbers per customer, a frame each: one row per value is left before they are counted."""
    return [
        lines.select(F.col("o_custkey").alias(f"{value}_custkey"), value).distinct().groupBy(f"{value}_custkey").agg(F.expr(columns[name]).alias(name))
        for name, value in (("com_passenger_count", "l_partkey"), ("com_mobile_count", "l_linenumber")) if name in columns
    ]


def event_measures(events: DataFrame, columns: dict[str, str] = EVENT_MEASURES) -> DataFrame:
    """Event counts, value sums and active days per user."""
    priced = events.selectExpr(
        "user_id", "event_type", "value", "to_date(ts) AS day", f"{CENTS.format('value')} AS _cents"
    )
    return _aggregate(priced, ["user_id"], columns)


def _user_columns() -> dict[str, str]:
    """Each column of the user table over the joined branches."""
    made = [*ORDER_MEASURES, *ORDER_VARIETY, *LINE_MEASURES, *LINE_VARIETY]
    columns = {USER_KEY: "c_custkey"}
    columns.update({n: f"coalesce({n}, 0L)" for n in made if n.endswith("_count")})
    columns.update({n: f"coalesce({n}, 0.0D)" for n in made if "_max_" in n})
    nullable = ("_order_amount", "_last_order_days", "_order_pricerate")
    columns.update({n: n for n in made if n.endswith(nullable) and "_max_" not in n})
    signup_days = f"coalesce(cast(datediff({ORDER_DAY}, _first_order) as bigint), 0L)"
    # The share of successes in percent against a fixed spread of keys, all in whole numbers.
    flag = "cast(coalesce((c_custkey * 7919) % 100 * bil_payord_count < 100 * ord_success_order_count, false) as bigint)"
    columns.update(
        {
            "cap_tmoney_balance": "cap_tmoney_balance",
            "cap_wallet_balance": "cap_wallet_balance",
            "uid_grade": "cast(c_nationkey % 5 as bigint)",
            "uid_age": "18 + c_custkey % 50",
            "uid_lastlogindays": "coalesce(_idle_days, 999L)",
            "uid_dealorders": "coalesce(ord_success_order_count, 0L)",
            "uid_emailvalid": "cast(c_custkey % 2 = 0 as bigint)",
            "uid_mobilevalid": "cast(c_custkey % 3 = 0 as bigint)",
            "uid_addressvalid": "cast(c_custkey % 5 = 0 as bigint)",
            "uid_isindentify": "cast(c_custkey % 7 = 0 as bigint)",
            "uid_samemobile": "cast(c_custkey % 11 = 0 as bigint)",
            "uid_authenticated_days": "c_custkey % 1000",
            "uid_signupdays": signup_days,
            "uid_signmonths": f"{signup_days} div 30",
            "pro_advanced_date": "_lead",
            "ord_success_avg_leadtime": "_lead",
            "pro_generous_stingy_tag": "coalesce(_generous, 0L)",
            "pro_htl_star_prefer": "1 + c_custkey % 5",
            "pro_htl_consuming_capacity":
                "coalesce(ord_success_htl_order_amount / nullif(ord_success_htl_order_count, 0), 0.0D)",
            "pro_phone_type": f"array_position({SEGMENTS}, c_mktsegment) - 1",
            "pro_validpoints": "floor(coalesce(ord_success_order_amount, 0.0D) / 1000)",
            "pro_base_active": "coalesce(_active_days, 0L)",
            "acc_loginday_count": "coalesce(_active_days, 0L)",
            "pro_ctrip_profits": "coalesce(_profit, 0.0D)",
            "pro_customervalue": "coalesce(ord_success_order_amount / nullif(ord_success_order_count, 0), 0.0D)",
            "ord_success_htl_order_refund_ratio": "_refund_htl / nullif(ord_success_htl_order_count, 0)",
            "voi_complaint_count": "coalesce(_errors, 0L)",
            "voi_comment_count": "coalesce(_clicks, 0L)",
            "fai_lackbalance": "coalesce(_large_errors, 0L)",
            TRAINING_LABEL: flag,
            SCORING_LABEL: flag,
        }
    )
    return columns


USER_COLUMNS = _user_columns()


# The tables that are joined at full size, and the key that joins them.
BUCKET_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def bucketed_tables(spark: SparkSession, sf_dir: str, buckets: int, prefix: str | None = None) -> dict[str, DataFrame]:
    """Orders and lines written once as tables in ``buckets`` buckets of their order key, sorted within, so that every later
    join of the two reads matching buckets side by side and moves no row.

    Each bucket is gathered by one task and written as one file; choose as many as make a bucket some hundred megabytes.
    Tables are named ``<prefix>_orders`` and so on in the session's catalogue, the prefix being made up if none is given,
    and lie in the shared folder.
    """
    prefix = prefix or f"scorekit_{uuid.uuid4().hex}"
    out = {}
    for name, key in BUCKET_KEYS.items():
        rows = load(spark, sf_dir, name).repartition(buckets, key)
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", new_path(spark, f"bucketed-{name}")).saveAsTable(f"{prefix}_{name}")
        out[name] = spark.table(f"{prefix}_{name}")
    return out


def order_lines(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Each line with its order, as far as the measures need them."""
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *[F.expr(e).alias(n) for n, e in LINE_FACTS.items()])


def user_table(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None, tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """``uid_uid``, the raw columns that the feature groups read, and both labels; one row per customer.

    Given ``columns``, only those, in that order, and only the branches behind them are planned. ``tables`` stand in for
    files of the same name, such as :func:`bucketed_tables`.
    """
    wanted = list(USER_COLUMNS) if columns is None else list(dict.fromkeys(columns))
    used = set(re.findall(r"[a-z_]\w*", " ".join(USER_COLUMNS[c] for c in wanted)))

    def source(name: str) -> DataFrame:
        return tables[name] if tables and name in tables else load(spark, sf_dir, name)

    def needed(available: dict[str, str]) -> dict[str, str]:
        return {n: e for n, e in available.items() if n in used}

    out = source("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    if needed({**ORDER_MEASURES, **ORDER_VARIETY, **LINE_MEASURES, **LINE_VARIETY}):
        orders = source("orders")
    if chosen := needed(ORDER_MEASURES):
        out = out.join(order_measures(orders, chosen), F.col("c_custkey") == F.col("o_custkey"), "left")
    if chosen := needed(ORDER_VARIETY):
        for part in order_variety(orders, chosen):
            out = out.join(part, F.col("c_custkey") == F.col(part.columns[0]), "left")
    if needed({**LINE_MEASURES, **LINE_VARIETY}):
        lines = order_lines(source("lineitem"), orders)
        if len(needed(LINE_VARIETY)) + bool(needed(LINE_MEASURES)) > 1:
            # The dearest join runs once: its narrow result is written and feeds every branch.
            read = LINE_FACTS if needed(LINE_MEASURES) else ("o_custkey", "l_partkey", "l_linenumber")
            lines = materialize(lines.select(*read), "lines")
    if chosen := needed(LINE_MEASURES):
        measures = line_measures(lines, source("supplier"), chosen)
        out = out.join(measures, F.col("c_custkey") == F.col("l_custkey"), "left")
    if chosen := needed(LINE_VARIETY):
        for part in line_variety(lines, chosen):
            out = out.join(part, F.col("c_custkey") == F.col(part.columns[0]), "left")
    if chosen := needed(EVENT_MEASURES):
        events = event_measures(source("events"), chosen)
        out = out.join(events, F.col("c_custkey") == F.col("user_id"), "left")
    return out.select(*[F.expr(USER_COLUMNS[c]).alias(c) for c in wanted])


def _contract(users: DataFrame, names: list[str]) -> list[Column]:
    """Contract columns as double; those that the tables cannot supply are null."""
    have = set(users.columns)
    return [(F.col(n) if n in have else F.lit(None)).cast("double").alias(n) for n in names]


def training_table(users: DataFrame) -> DataFrame:
    """The 123 training columns, in contract order."""
    return users.select(*_contract(users, TRAINING_COLUMNS))


def scoring_table(users: DataFrame, keyed: bool = False) -> DataFrame:
    """The 123 scoring columns in contract order, optionally behind the row id and the user id."""
    keys = [F.col(USER_KEY).cast("double").alias("ID"), F.col(USER_KEY).cast("string").alias(USER_KEY)]
    return users.select(*(keys if keyed else []), *_contract(users, SCORING_COLUMNS))
