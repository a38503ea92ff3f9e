"""The wide user table as one SQL statement in another engine's dialect: the twin that results are checked against.

Written out on its own rather than generated from the DataFrame code, so that a slip in one shows up as a difference.
"""

USERS_CTE = """
lines AS (
  SELECT o.o_custkey AS ck, o.o_orderstatus = 'F' AS ok,
         o.o_orderstatus = 'F' AND o.o_orderpriority = '1-URGENT' AS flt,
         date_diff('day', o.o_orderdate::DATE, l.l_shipdate::DATE) AS lead,
         round(l.l_discount * 100)::BIGINT AS pct, round(l.l_extendedprice * 100)::BIGINT AS cents,
         l.l_partkey, l.l_suppkey, l.l_linenumber, s.s_nationkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
line_agg AS (
  SELECT ck,
    count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, count(DISTINCT l_linenumber) AS linenos,
    count(DISTINCT l_suppkey) FILTER (WHERE ok) AS ok_supps,
    count(DISTINCT s_nationkey) FILTER (WHERE ok) AS ok_nations,
    count(DISTINCT s_nationkey) FILTER (WHERE flt) AS flt_nations,
    sum(lead) FILTER (WHERE ok)::DOUBLE / nullif(count(lead) FILTER (WHERE ok), 0) AS lead,
    sum(100 - pct) FILTER (WHERE flt)::DOUBLE / nullif(count(pct) FILTER (WHERE flt), 0) / 100::DOUBLE AS rate,
    sum(cents * pct) FILTER (WHERE ok)::DOUBLE / 10000::DOUBLE AS profit,
    CASE WHEN sum(pct) >= 5 * count(pct) THEN 1 ELSE 0 END AS generous
  FROM lines GROUP BY ck
),
tagged AS (
  SELECT o_custkey AS ck, o_orderkey, o_totalprice, o_orderdate::DATE AS day, o_orderpriority, o_orderstatus,
    round(o_totalprice * 100)::BIGINT AS cents,
    o_orderstatus = 'F' AS ok, o_orderstatus = 'O' AS cancelled, o_orderstatus = 'P' AS refunded,
    o_orderpriority = '1-URGENT' AS flt, o_orderpriority = '2-HIGH' AS htl, o_orderpriority = '4-NOT SPECIFIED' AS trn,
    o_totalprice >= 250000 AS first_class, o_orderkey % 4 = 0 AS aboard, o_orderkey % 2 = 0 AS credit
  FROM orders
),
order_agg AS (
  SELECT ck,
    count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE cancelled) AS n_cancel,
    count(*) FILTER (WHERE refunded) AS n_refund,
    count(*) FILTER (WHERE cancelled AND htl) AS n_cancel_htl,
    count(*) FILTER (WHERE cancelled AND trn) AS n_cancel_trn,
    count(*) FILTER (WHERE refunded AND htl) AS n_refund_htl,
    count(*) FILTER (WHERE refunded AND o_orderkey % 10 = 0) AS n_complaint_refund,
    count(*) FILTER (WHERE ok AND first_class) AS n_ok_first, count(*) FILTER (WHERE ok AND aboard) AS n_ok_aboard,
    count(*) FILTER (WHERE ok AND flt) AS n_flt, count(*) FILTER (WHERE ok AND htl) AS n_htl,
    count(*) FILTER (WHERE ok AND trn) AS n_trn,
    count(*) FILTER (WHERE ok AND flt AND first_class) AS n_flt_first,
    count(*) FILTER (WHERE ok AND flt AND aboard) AS n_flt_aboard,
    count(*) FILTER (WHERE ok AND htl AND first_class) AS n_htl_first,
    count(*) FILTER (WHERE ok AND htl AND aboard) AS n_htl_aboard,
    count(*) FILTER (WHERE ok AND htl AND o_orderkey % 3 = 0) AS n_htl_guarantee,
    count(*) FILTER (WHERE ok AND htl AND o_orderkey % 5 = 0) AS n_htl_noshow,
    count(*) FILTER (WHERE credit) AS n_credit, count(*) FILTER (WHERE NOT credit) AS n_debit,
    count(*) FILTER (WHERE ok AND credit) AS n_ok_credit, count(*) FILTER (WHERE ok AND NOT credit) AS n_ok_debit,
    count(DISTINCT o_orderpriority) FILTER (WHERE ok) AS ok_priorities,
    count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT o_orderstatus) AS statuses,
    sum(cents)::DOUBLE / 100::DOUBLE AS a, sum(cents) FILTER (WHERE ok)::DOUBLE / 100::DOUBLE AS a_ok,
    sum(cents) FILTER (WHERE ok AND first_class)::DOUBLE / 100::DOUBLE AS a_ok_first,
    sum(cents) FILTER (WHERE ok AND aboard)::DOUBLE / 100::DOUBLE AS a_ok_aboard,
    sum(cents) FILTER (WHERE ok AND flt)::DOUBLE / 100::DOUBLE AS a_flt,
    sum(cents) FILTER (WHERE ok AND htl)::DOUBLE / 100::DOUBLE AS a_htl,
    sum(cents) FILTER (WHERE ok AND trn)::DOUBLE / 100::DOUBLE AS a_trn,
    sum(cents) FILTER (WHERE ok AND flt AND first_class)::DOUBLE / 100::DOUBLE AS a_flt_first,
    sum(cents) FILTER (WHERE ok AND flt AND aboard)::DOUBLE / 100::DOUBLE AS a_flt_aboard,
    sum(cents) FILTER (WHERE ok AND htl AND first_class)::DOUBLE / 100::DOUBLE AS a_htl_first,
    sum(cents) FILTER (WHERE ok AND htl AND aboard)::DOUBLE / 100::DOUBLE AS a_htl_aboard,
    max(o_totalprice) FILTER (WHERE ok) AS m_ok, max(o_totalprice) FILTER (WHERE ok AND flt) AS m_flt,
    max(o_totalprice) FILTER (WHERE ok AND htl) AS m_htl, max(o_totalprice) FILTER (WHERE ok AND trn) AS m_trn,
    date_diff('day', max(day) FILTER (WHERE ok AND flt), DATE '2001-08-02') AS d_flt,
    date_diff('day', max(day) FILTER (WHERE ok AND htl), DATE '2001-08-02') AS d_htl,
    date_diff('day', max(day) FILTER (WHERE ok AND trn), DATE '2001-08-02') AS d_trn,
    date_diff('day', min(day), DATE '2001-08-02') AS signup_days
  FROM tagged GROUP BY ck
),
event_agg AS (
  SELECT user_id AS ck,
    date_diff('day', max(ts)::DATE, DATE '2024-02-01') AS idle, count(DISTINCT ts::DATE) AS days,
    count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS clicks,
    count(*) FILTER (WHERE event_type = 'error' AND value > 50) AS large_errors,
    sum(round(value * 100)::BIGINT) FILTER (WHERE event_type = 'view')::DOUBLE / 100::DOUBLE AS viewed,
    sum(round(value * 100)::BIGINT) FILTER (WHERE event_type = 'purchase')::DOUBLE / 100::DOUBLE AS bought
  FROM events GROUP BY user_id
),
users AS (
  SELECT c.c_custkey AS uid_uid,
    (c.c_nationkey % 5)::BIGINT AS uid_grade, 18 + c.c_custkey % 50 AS uid_age,
    coalesce(e.idle, 999) AS uid_lastlogindays, coalesce(o.n_ok, 0) AS uid_dealorders,
    (c.c_custkey % 2 = 0)::BIGINT AS uid_emailvalid, (c.c_custkey % 3 = 0)::BIGINT AS uid_mobilevalid,
    (c.c_custkey % 5 = 0)::BIGINT AS uid_addressvalid, (c.c_custkey % 7 = 0)::BIGINT AS uid_isindentify,
    (c.c_custkey % 11 = 0)::BIGINT AS uid_samemobile, c.c_custkey % 1000 AS uid_authenticated_days,
    coalesce(o.signup_days, 0) AS uid_signupdays, coalesce(o.signup_days, 0) // 30 AS uid_signmonths,
    l.lead AS pro_advanced_date, coalesce(l.generous, 0)::BIGINT AS pro_generous_stingy_tag,
    1 + c.c_custkey % 5 AS pro_htl_star_prefer,
    coalesce(o.a_htl / nullif(o.n_htl, 0), 0) AS pro_htl_consuming_capacity,
    (list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c.c_mktsegment) - 1)::BIGINT
      AS pro_phone_type,
    floor(coalesce(o.a_ok, 0) / 1000)::BIGINT AS pro_validpoints, coalesce(e.days, 0) AS pro_base_active,
    coalesce(l.profit, 0) AS pro_ctrip_profits, coalesce(o.a_ok / nullif(o.n_ok, 0), 0) AS pro_customervalue,
    coalesce(o.m_ok, 0) AS ord_success_max_order_amount, coalesce(o.n_ok, 0) AS ord_success_order_count,
    o.a_ok AS ord_success_order_amount, l.lead AS ord_success_avg_leadtime, o.a AS ord_total_order_amount,
    coalesce(o.n_cancel, 0) AS ord_cancel_order_count,
    coalesce(o.n_ok_first, 0) AS ord_success_first_class_order_count,
    o.a_ok_first AS ord_success_first_class_order_amount,
    coalesce(o.ok_priorities, 0) AS ord_success_order_type_count,
    coalesce(o.n_ok_aboard, 0) AS ord_success_aboard_order_count, o.a_ok_aboard AS ord_success_aboard_order_amount,
    coalesce(l.ok_nations, 0) AS ord_success_order_acity_count,
    coalesce(l.ok_supps, 0) AS ord_success_order_cmobile_count,
    o.d_flt AS ord_success_flt_last_order_days,
    coalesce(o.n_flt_first, 0) AS ord_success_flt_first_class_order_count,
    o.a_flt_first AS ord_success_flt_first_class_order_amount, coalesce(o.m_flt, 0) AS ord_success_flt_max_order_amount,
    l.rate AS ord_success_flt_avg_order_pricerate,
    coalesce(o.n_flt_aboard, 0) AS ord_success_flt_aboard_order_count,
    o.a_flt_aboard AS ord_success_flt_aboard_order_amount, coalesce(o.n_flt, 0) AS ord_success_flt_order_count,
    o.a_flt AS ord_success_flt_order_amount, coalesce(l.flt_nations, 0) AS ord_success_flt_order_acity_count,
    o.d_htl AS ord_success_htl_last_order_days,
    coalesce(o.n_htl_first, 0) AS ord_success_htl_first_class_order_count,
    o.a_htl_first AS ord_success_htl_first_class_order_amount, coalesce(o.m_htl, 0) AS ord_success_htl_max_order_amount,
    o.n_refund_htl::DOUBLE / nullif(o.n_htl, 0) AS ord_success_htl_order_refund_ratio,
    coalesce(o.n_htl_aboard, 0) AS ord_success_htl_aboard_order_count,
    o.a_htl_aboard AS ord_success_htl_aboard_order_amount,
    coalesce(o.n_htl_guarantee, 0) AS ord_success_htl_guarantee_order_count,
    coalesce(o.n_htl_noshow, 0) AS ord_success_htl_noshow_order_count,
    coalesce(o.n_htl, 0) AS ord_success_htl_order_count, o.a_htl AS ord_success_htl_order_amount,
    coalesce(o.n_cancel_htl, 0) AS ord_cancel_htl_order_count,
    coalesce(o.n_cancel_trn, 0) AS ord_cancel_trn_order_count, o.d_trn AS ord_success_trn_last_order_days,
    coalesce(o.m_trn, 0) AS ord_success_trn_max_order_amount, coalesce(o.n_trn, 0) AS ord_success_trn_order_count,
    o.a_trn AS ord_success_trn_order_amount, coalesce(l.parts, 0) AS com_passenger_count,
    coalesce(l.supps, 0) AS com_idno_count, coalesce(l.linenos, 0) AS com_mobile_count,
    coalesce(e.large_errors, 0) AS fai_lackbalance, coalesce(o.n, 0) AS bil_payord_count,
    coalesce(o.n_ok, 0) AS bil_paysord_count, coalesce(o.n_refund, 0) AS bil_refundord_count,
    coalesce(o.n_credit, 0) AS bil_payord_credit_count, coalesce(o.n_debit, 0) AS bil_payord_debit_count,
    coalesce(o.n_ok_credit, 0) AS bil_paysord_credit_count, coalesce(o.n_ok_debit, 0) AS bil_paysord_debit_count,
    coalesce(o.priorities, 0) AS bil_ordertype_count, coalesce(o.statuses, 0) AS bil_platform_count,
    e.viewed AS cap_tmoney_balance, e.bought AS cap_wallet_balance, coalesce(e.days, 0) AS acc_loginday_count,
    coalesce(e.errors, 0) AS voi_complaint_count, coalesce(o.n_complaint_refund, 0) AS voi_complrefund_count,
    coalesce(e.clicks, 0) AS voi_comment_count,
    CASE WHEN (c.c_custkey * 7919) % 100 * o.n < 100 * o.n_ok THEN 1 ELSE 0 END::BIGINT AS uid_flag,
    CASE WHEN (c.c_custkey * 7919) % 100 * o.n < 100 * o.n_ok THEN 1 ELSE 0 END::BIGINT AS score
  FROM customer c LEFT JOIN order_agg o ON o.ck = c.c_custkey LEFT JOIN line_agg l ON l.ck = c.c_custkey
  LEFT JOIN event_agg e ON e.ck = c.c_custkey
)
"""
