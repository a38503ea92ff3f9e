"""Column contracts of the wide user table. Columns are bound by name, never by position."""

from __future__ import annotations

from pyspark.sql import types as T

# The 123 columns of the training table, in file order. ``uid_flag`` is the 0/1 label.
TRAINING_COLUMNS = """
uid_grade uid_age uid_lastlogindays uid_dealorders uid_emailvalid uid_mobilevalid uid_addressvalid
uid_isindentify uid_authenticated_days uid_samemobile uid_signupdays uid_signmonths uid_haspaypwd
pro_advanced_date pro_generous_stingy_tag pro_htl_star_prefer pro_htl_consuming_capacity pro_phone_type
pro_validpoints pro_base_active pro_secretary pro_agent pro_ctrip_profits pro_customervalue
pro_generousindex_fltn pro_lastyearprofits_fltn pro_pricesensitivity_fltn pro_ismarketing
ord_success_last_order_days ord_success_max_order_amount ord_success_order_count
ord_success_order_quantity ord_success_order_amount ord_success_avg_leadtime ord_total_order_count
ord_total_order_quantity ord_total_order_amount ord_cancel_order_count ord_refund_order_count
ord_success_first_class_order_count ord_success_first_class_order_amount ord_success_order_type_count
ord_success_self_order_count ord_success_self_order_amount ord_success_aboard_order_count
ord_success_aboard_order_amount ord_success_order_acity_count ord_success_order_cmobile_count
ord_success_flt_last_order_days ord_success_flt_first_class_order_count
ord_success_flt_first_class_order_amount ord_success_flt_max_order_amount
ord_success_flt_avg_order_pricerate ord_success_flt_aboard_order_count
ord_success_flt_aboard_order_amount ord_success_flt_order_count ord_success_flt_order_amount
ord_success_flt_order_acity_count ord_cancel_flt_order_count ord_refund_flt_order_count
ord_success_htl_last_order_days ord_success_htl_first_class_order_count
ord_success_htl_first_class_order_amount ord_success_htl_max_order_amount
ord_success_htl_order_refund_ratio ord_success_htl_aboard_order_count
ord_success_htl_aboard_order_amount ord_success_htl_guarantee_order_count
ord_success_htl_noshow_order_count ord_success_htl_avg_order_pricerate ord_success_htl_order_count
ord_success_htl_order_amount ord_cancel_htl_order_count ord_refund_htl_order_count
ord_success_pkg_last_order_days ord_success_pkg_first_class_order_count
ord_success_pkg_first_class_order_amount ord_success_pkg_max_order_amount
ord_success_pkg_aboard_order_count ord_success_pkg_aboard_order_amount ord_success_pkg_order_count
ord_success_pkg_order_amount ord_cancel_pkg_order_count ord_refund_pkg_order_count
ord_success_trn_last_order_days ord_success_trn_first_class_order_count
ord_success_trn_first_class_order_amount ord_success_trn_max_order_amount ord_success_trn_order_count
ord_success_trn_order_amount ord_cancel_trn_order_count ord_refund_trn_order_count com_passenger_count
com_idno_count com_mobile_count com_has_child fai_lackbalance fai_risk fai_putwrong fai_invalid
bil_payord_count bil_paysord_count bil_refundord_count bil_payord_credit_count bil_payord_debit_count
bil_paysord_credit_count bil_paysord_debit_count bil_ordertype_count bil_platform_count
cap_tmoney_balance cap_wallet_balance cap_refund_balance cap_total_balance cap_withdrow_count
cap_withdrow_amount acc_loginday_count acc_pwd_count acc_paypwd_count acc_bindmobile_count
voi_complaint_count voi_complrefund_count voi_comment_count uid_flag
""".split()

# The scoring table holds the same columns, except that these four move behind the others and
# the known label ``score`` takes the place of ``uid_flag``.
_MOVED_LAST = ["uid_samemobile", "uid_haspaypwd", "pro_ismarketing", "ord_refund_flt_order_count"]
SCORING_COLUMNS = [c for c in TRAINING_COLUMNS if c not in {*_MOVED_LAST, "uid_flag"}] + _MOVED_LAST + ["score"]

TRAINING_LABEL = "uid_flag"
SCORING_LABEL = "score"
USER_KEY = "uid_uid"


def string_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def double_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType(), True) for n in names])


def keyed_schema(names: list[str]) -> T.StructType:
    """Row id and user id in front of double columns."""
    keys = [T.StructField("ID", T.DoubleType(), True), T.StructField(USER_KEY, T.StringType(), True)]
    return T.StructType(keys + double_schema(names).fields)
