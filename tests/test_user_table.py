"""The user table on a skewed fixture, against plain Python; and what its plans read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scorekit.operators.features import GROUPS, raw_columns
from scorekit.sources import user_table as module
from scorekit.sources.user_table import USER_COLUMNS, bucketed_tables, load, order_lines, user_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_supplies_every_feature():
    assert set(raw_columns(*GROUPS.values())) <= set(USER_COLUMNS)
    assert len(set(raw_columns(*GROUPS.values()))) == 79


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Customer 1 holds most orders and lines, customer 2 has a few, customer 3 has nothing."""
    base = str(tmp_path_factory.mktemp("skewed"))
    day = dt.datetime(2000, 1, 1)
    orders, lines = [], []
    for k in range(300):
        owner = 2 if k % 30 == 0 else 1
        price = 100.0 + k * 1000.25
        orders.append((k, owner, "FOP"[k % 3], price, day + dt.timedelta(days=k),
                       ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"][k % 5]))
        for n in range(1, 4):
            lines.append((k, k % 17, (k * n) % 11, n, 1.0, 10.5 * n, 0.01 * (k % 11), 0.0, "N", "O", day + dt.timedelta(days=k + n)))
    stamp = "timestamp_ntz"
    frames = {
        "customer": spark.createDataFrame(
            [(c, f"c{c}", c, 0.0, "BUILDING") for c in (1, 2, 3)],
            "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": spark.createDataFrame(
            orders, f"o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate {stamp}, "
                    "o_orderpriority string"),
        "lineitem": spark.createDataFrame(
            lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                   f"l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate {stamp}"),
        "supplier": spark.createDataFrame(
            [(s, f"s{s}", s % 4, 0.0) for s in range(10)],  # supplier 10 is missing
            "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
        "events": spark.createDataFrame(
            [(i, dt.datetime(2024, 1, 1 + i % 3, 5), 1, ["view", "error", "click"][i % 3], 10.25 * i, "{}") for i in range(30)],
            f"event_id bigint, ts {stamp}, user_id bigint, event_type string, value double, props string"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{base}/{name}.parquet")
    return base, orders, lines


def test_counts_on_a_skewed_customer(spark, skewed):
    base, orders, lines = skewed
    rows = {r["uid_uid"]: r for r in user_table(spark, base).collect()}
    assert set(rows) == {1, 2, 3}
    owner = {o[0]: o[1] for o in orders}
    status = {o[0]: o[2] for o in orders}
    priority = {o[0]: o[5] for o in orders}
    for c in (1, 2, 3):
        mine = [o for o in orders if o[1] == c]
        ok = [o for o in mine if o[2] == "F"]
        own = [x for x in lines if owner[x[0]] == c]
        good = [x for x in own if status[x[0]] == "F"]
        flt = [x for x in good if priority[x[0]] == "1-URGENT"]
        r = rows[c]
        assert r["bil_payord_count"] == len(mine) and r["ord_success_order_count"] == len(ok)
        assert r["ord_success_order_amount"] == (round(sum(o[3] for o in ok), 2) if ok else None)
        assert r["ord_success_max_order_amount"] == max((o[3] for o in ok), default=0.0)
        assert r["ord_success_order_type_count"] == len({o[5] for o in ok})
        assert r["bil_ordertype_count"] == len({o[5] for o in mine}) and r["bil_platform_count"] == len({o[2] for o in mine})
        assert r["com_passenger_count"] == len({x[1] for x in own}) and r["com_idno_count"] == len({x[2] for x in own})
        assert r["com_mobile_count"] == len({x[3] for x in own})
        assert r["ord_success_order_cmobile_count"] == len({x[2] for x in good})
        assert r["ord_success_order_acity_count"] == len({x[2] % 4 for x in good if x[2] < 10})
        assert r["ord_success_flt_order_acity_count"] == len({x[2] % 4 for x in flt if x[2] < 10})
        leads = [x[3] for x in good]
        assert r["pro_advanced_date"] == (sum(leads) / len(leads) if leads else None)
        expected = 1 if own and sum(round(x[6] * 100) for x in own) >= 5 * len(own) else 0
        assert r["pro_generous_stingy_tag"] == expected
    assert rows[1]["acc_loginday_count"] == 3 and rows[1]["voi_complaint_count"] == 10
    assert rows[2]["cap_wallet_balance"] is None and rows[3]["uid_lastlogindays"] == 999
    assert rows[3]["uid_flag"] == 0 and rows[3]["uid_signupdays"] == 0


def test_columns_decide_what_is_read(spark, sf_dir):
    only_customers = plan(user_table(spark, sf_dir, ["uid_uid", "uid_age"]))
    assert only_customers.count("FileScan") == 1 and "Exchange" not in only_customers
    relation = plan(user_table(spark, sf_dir, ["uid_uid", "com_mobile_count"]))
    assert "supplier.parquet" not in relation and "events.parquet" not in relation
    assert "l_extendedprice" not in relation
    assert relation.count("lineitem.parquet") == 1


def test_catalyst_drops_unused_branches_of_the_whole_table(spark, sf_dir):
    pruned = plan(user_table(spark, sf_dir).select("uid_uid", "uid_age"))
    assert pruned.count("FileScan") == 1


def test_no_branch_collects_or_crosses(spark, sf_dir):
    whole = plan(user_table(spark, sf_dir))
    assert "collect_set" not in whole and "CartesianProduct" not in whole and "NestedLoop" not in whole
    assert "lineitem.parquet" not in whole  # lines and orders meet once, before this plan, and are read from the result
    assert "Expand" not in whole  # no distinct count replicates rows


def test_repartitioned_input_gives_the_same_table(spark, sf_dir, tmp_path):
    for t in ("customer", "orders", "lineitem", "supplier", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(5).write.parquet(f"{tmp_path}/{t}.parquet")
    same = user_table(spark, sf_dir).exceptAll(user_table(spark, str(tmp_path)))
    assert same.count() == 0


def test_keys_are_unique(spark, users):
    assert users.agg(F.count("*") - F.countDistinct("uid_uid")).collect()[0][0] == 0


def test_bucketed_tables_are_joined_where_they_lie(spark, sf_dir):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = bucketed_tables(spark, sf_dir, 8)
        joined = order_lines(tables["lineitem"], tables["orders"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        files = order_lines(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders"))
        assert "Exchange" in files._jdf.queryExecution().executedPlan().toString()
        assert joined.exceptAll(files).count() == 0 and files.exceptAll(joined).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_lines_are_written_with_no_more_than_the_branches_read(spark, skewed, monkeypatch):
    written = []
    monkeypatch.setattr(module, "materialize", lambda df, name: written.append(df.columns) or df)
    user_table(spark, skewed[0])
    facts = ["o_custkey", "l_suppkey", "l_partkey", "l_linenumber", "ok", "flt", "lead", "l_discount", "l_extendedprice"]
    assert written == [facts]
    written.clear()
    user_table(spark, skewed[0], ["com_passenger_count", "com_mobile_count"])
    assert written == [["o_custkey", "l_partkey", "l_linenumber"]]


def test_nations_are_grouped_only_where_they_are_counted(spark, skewed):
    base = skewed[0]
    names = ["com_idno_count", "ord_success_order_cmobile_count", "pro_advanced_date", "pro_generous_stingy_tag", "pro_ctrip_profits"]
    some, more = user_table(spark, base, ["uid_uid", *names]), user_table(spark, base, ["uid_uid", *names, "ord_success_order_acity_count"])
    assert "keys=[l_custkey" in plan(some) and "s_nationkey" not in plan(some) and "s_nationkey" in plan(more)
    assert sorted(some.collect()) == sorted(r[:-1] for r in more.collect())
    twice = {"supplier": load(spark, base, "supplier").unionByName(load(spark, base, "supplier").where("s_suppkey < 4"))}
    some, more = (user_table(spark, base, df.columns, twice) for df in (some, more))
    assert sorted(some.collect()) == sorted(r[:-1] for r in more.collect())
