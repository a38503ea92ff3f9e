"""The five feature groups: which columns each takes, which it derives, and how it fills gaps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.contracts import TRAINING_LABEL


@dataclass(frozen=True)
class GroupSpec:
    """One feature group.

    ``fill_train`` and ``fill_score`` are what null and NaN become in each phase; ``None`` leaves the gap, so
    that assembling the vector raises. ``rf_share`` and ``gbt_share`` blend the two models' scores.
    """

    name: str
    score_column: str
    features: tuple[str, ...]
    weight: float
    fill_train: float | None = None
    fill_score: float | None = None
    rf_share: float = 1.0
    gbt_share: float = 0.0
    derived: tuple[str, ...] = field(default=())

    def fill(self, training: bool) -> float | None:
        return self.fill_train if training else self.fill_score


# Stems whose unit price is <stem>_order_amount / <stem>_order_count.
UNIT_PRICE_STEMS = """
ord_success ord_success_first_class ord_success_aboard ord_success_flt_first_class ord_success_flt_aboard
ord_success_flt ord_success_htl_first_class ord_success_htl_aboard ord_success_htl ord_success_trn
""".split()

# Payment ratios, result: (paid, all).
PAY_RATIOS = {
    "bil_pays_ratio": ("bil_paysord_count", "bil_payord_count"),
    "bil_pays_credit_ratio": ("bil_paysord_credit_count", "bil_payord_credit_count"),
    "bil_pays_debit_ratio": ("bil_paysord_debit_count", "bil_payord_debit_count"),
}


def _ratio(numerator: str, denominator: str) -> str:
    """The quotient in SQL text: many expressions parse faster than they build call by call."""
    return f"try_divide(cast({numerator} as double), cast({denominator} as double))"


def derived_columns() -> dict[str, str]:
    """Every derived feature by name, as SQL. A zero count gives null, for the group's fill to replace.

    ``cap_balance`` counts the wallet twice and leaves the refund balance out; that is the defined behaviour.
    """
    out = {f"{s}_order_price": _ratio(f"{s}_order_amount", f"{s}_order_count") for s in UNIT_PRICE_STEMS}
    out.update({name: _ratio(paid, total) for name, (paid, total) in PAY_RATIOS.items()})
    out["cap_balance"] = "cap_tmoney_balance + cap_wallet_balance + cap_wallet_balance"
    return out


def derived_inputs() -> dict[str, tuple[str, ...]]:
    """The raw columns behind each derived feature."""
    out: dict[str, tuple[str, ...]] = {
        f"{s}_order_price": (f"{s}_order_amount", f"{s}_order_count") for s in UNIT_PRICE_STEMS
    }
    out.update(PAY_RATIOS)
    out["cap_balance"] = ("cap_tmoney_balance", "cap_wallet_balance")
    return out


def raw_columns(*specs: GroupSpec) -> list[str]:
    """The table columns that the groups read, each once."""
    inputs = derived_inputs()
    names = [c for s in specs for f in s.features for c in (inputs[f] if f in s.derived else (f,))]
    return list(dict.fromkeys(names))


def _spec(name: str, score_column: str, features: str, weight: float, **kw) -> GroupSpec:
    names = tuple(features.split())
    known = derived_inputs()
    return GroupSpec(name, score_column, names, weight, derived=tuple(n for n in names if n in known), **kw)


# Feature lists in vector order, fills, blend shares and weights in the total.
GROUPS: dict[str, GroupSpec] = {
    g.name: g
    for g in (
        _spec(
            "people", "score_people",
            """uid_grade uid_dealorders uid_emailvalid uid_age uid_mobilevalid uid_addressvalid uid_isindentify
            uid_authenticated_days uid_signupdays uid_signmonths uid_lastlogindays uid_samemobile
            ord_success_order_cmobile_count com_mobile_count pro_generous_stingy_tag pro_base_active
            pro_customervalue pro_phone_type pro_validpoints pro_htl_consuming_capacity""",
            0.3, rf_share=0.6, gbt_share=0.4,
        ),
        _spec(
            "consuming", "score_consuming",
            """pro_advanced_date pro_htl_star_prefer pro_ctrip_profits ord_success_max_order_amount
            ord_success_avg_leadtime ord_cancel_order_count ord_success_order_type_count
            ord_success_order_acity_count ord_success_flt_last_order_days ord_success_flt_max_order_amount
            ord_success_flt_avg_order_pricerate ord_success_flt_order_acity_count
            ord_success_htl_last_order_days ord_success_htl_max_order_amount
            ord_success_htl_order_refund_ratio ord_success_htl_guarantee_order_count
            ord_success_htl_noshow_order_count ord_cancel_htl_order_count ord_success_trn_last_order_days
            ord_success_order_price ord_success_first_class_order_price ord_success_aboard_order_price
            ord_success_flt_first_class_order_price ord_success_flt_aboard_order_price
            ord_success_flt_order_price ord_success_htl_first_class_order_price
            ord_success_htl_aboard_order_price ord_success_htl_order_price ord_success_trn_order_price""",
            0.25, fill_train=-1.0, fill_score=0.0,
        ),
        _spec(
            "financial", "score_fanacial",
            """voi_complrefund_count fai_lackbalance bil_refundord_count bil_ordertype_count bil_platform_count
            pro_htl_star_prefer pro_htl_consuming_capacity pro_phone_type ord_success_max_order_amount
            ord_total_order_amount ord_success_flt_first_class_order_count ord_success_trn_max_order_amount
            ord_success_htl_first_class_order_count ord_success_htl_max_order_amount
            ord_success_aboard_order_count cap_balance ord_success_htl_aboard_order_price
            ord_success_first_class_order_price bil_pays_debit_ratio bil_pays_credit_ratio bil_pays_ratio""",
            0.2, fill_train=0.0, fill_score=0.0,
        ),
        _spec(
            "interaction", "score_interaction",
            """voi_complaint_count voi_complrefund_count voi_comment_count acc_loginday_count pro_validpoints
            pro_base_active pro_ctrip_profits pro_customervalue""",
            0.15,
        ),
        _spec(
            "relation", "score_relation",
            "com_passenger_count com_idno_count com_mobile_count ord_success_order_cmobile_count",
            0.1,
        ),
    )
}


def feature_columns(spec: GroupSpec, training: bool) -> list[Column]:
    """The group's features as double columns, in vector order, derived and filled for the given phase."""
    derived, fill = derived_columns(), spec.fill(training)
    out = []
    for name in spec.features:
        e = f"cast({derived[name] if name in spec.derived else name} as double)"
        if fill is not None:
            # Null and NaN become the fill; infinities stay.
            e = f"coalesce(nanvl({e}, null), {fill}D)"
        out.append(F.expr(e).alias(name))
    return out


def label_column(label: str) -> Column:
    """The label as double; a missing label raises instead of being filled."""
    c = F.col(label).cast("double")
    return F.when(c.isNull(), F.raise_error(F.lit(f"null label in {label}")).cast("double")).otherwise(c)


def group_features(
    df: DataFrame, spec: GroupSpec, training: bool, label: str = TRAINING_LABEL, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Kept columns, then the label (in training only), then the group's features: one projection."""
    head: list[Column] = [F.col(k) for k in keep]
    if training:
        head.append(label_column(label).alias(label))
    return df.select(*head, *feature_columns(spec, training))


def assemble(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    """Features as one dense-or-sparse vector column. Text is cast to double; null, NaN and bad text raise."""
    types = dict(df.dtypes)
    text = {n: F.col(n).cast("double") for n in features if types[n] == "string"}
    source = df.withColumns(text) if text else df
    return VectorAssembler(inputCols=features, outputCol=output, handleInvalid="error").transform(source)


def assemble_labeled(df: DataFrame, label: str) -> DataFrame:
    """``label double, features vector``; every column but the label is a feature, in frame order."""
    features = [c for c in df.columns if c != label]
    numeric = df.select(label_column(label).alias("label"), *features)
    return assemble(numeric, features).select("label", "features")


def assemble_vector(df: DataFrame) -> DataFrame:
    """``features vector`` over all columns, in frame order."""
    return assemble(df, df.columns).select("features")
