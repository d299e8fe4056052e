"""Characteristics of the merged panel: firm age, mispricing ranks, quality minus junk. And the panel's assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import mean_present
from quantloom.operators.cross import rank, zrank, zscore


def quality_helpers(t) -> dict[str, str]:
    ch5 = {"gpoa_ch5": "gp_at", "roe_ch5": "ni_be", "roa_ch5": "ni_at", "cfoa_ch5": "ocf_at", "gmar_ch5": "gp_sale"}
    return {"ni_at": "ib / nullif(at_, 0)", "gp_sale": "gp / nullif(sale, 0)", "debt_at": "debt / nullif(at_, 0)", **{k: t.D(v, 5) for k, v in ch5.items()}, "roe_std": t.R("std", "ni_be", 5)}


def assemble(crspm: DataFrame, crspd: DataFrame | None, funda: DataFrame | None, fundq: DataFrame | None, firm: str = "gvkey") -> DataFrame:
    """Left joins onto monthly stocks: daily-based values by (id, date), accounts by (firm, date). Columns both have stay the left's."""
    out = crspm
    for other, key in ((crspd, "id"), (funda, firm), (fundq, firm)):
        if other is not None:
            new = [c for c in other.columns if c not in out.columns]
            out = out.join(other.select(key, "date", *new), [key, "date"], "left")
    return out


def age(df: DataFrame, company: str | None = None) -> DataFrame:
    """Months since an id's first row; with the company's age from accounts, raised by their largest gap."""
    own = F.row_number().over(W.partitionBy("id").orderBy("date")).cast("double")
    df = df.withColumn("age", own)
    if company:
        gap = F.max(F.col(company) - F.col("age")).over(W.partitionBy("id"))
        df = df.withColumn("age", F.col("age") + F.greatest(F.lit(0.0), F.coalesce(gap, F.lit(0.0))))
    return df


def mispricing(df: DataFrame, jkp: bool = False) -> DataFrame:
    """mispricing_perf and mispricing_mgmt: means of percentile ranks by date."""
    perf = {c: rank(c, ["date"], True, True) for c in ("o_score", "ret_12_1", "gp_at", "niq_at")}
    mgmt = {c: rank(c, ["date"], False, True) for c in ("chcsho_12m", "eqnpo_12m", "oaccruals_at", "noa_at", "at_gr1", "ppeinv_gr1a")}
    perf["o_score"] = 1 - perf["o_score"]
    if jkp:
        mgmt["eqnpo_12m"] = 1 - mgmt["eqnpo_12m"]
    df = df.withColumns({f"_p_{c}": v for c, v in perf.items()} | {f"_m_{c}": v for c, v in mgmt.items()})
    here = sum((F.col(f"_m_{c}").isNotNull().cast("int") for c in mgmt), F.lit(0))
    out = df.withColumns({"mispricing_perf": mean_present(*(f"_p_{c}" for c in perf)), "mispricing_mgmt": F.when(here >= 3, mean_present(*(f"_m_{c}" for c in mgmt)))})
    return out.drop(*(f"_p_{c}" for c in perf), *(f"_m_{c}" for c in mgmt))


def quality(df: DataFrame) -> DataFrame:
    """qmj_growth, qmj_prof, qmj_safety and qmj, from the helper columns."""
    df = df.withColumns({"_acc": -F.col("oaccruals_at"), "_bab": -F.col("betabab_1260d"), "_lev": -F.col("debt_at"), "_o": -F.col("o_score"), "_evol": -F.coalesce("roeq_std", F.col("roe_std") / 2)})
    df = zrank(df, ["gpoa_ch5", "roe_ch5", "roa_ch5", "cfoa_ch5", "gmar_ch5"], "qmj_growth", ["date"])
    df = zrank(df, ["gp_at", "ni_be", "ni_at", "ocf_at", "gp_sale", "_acc"], "qmj_prof", ["date"])
    df = zrank(df, ["_bab", "_lev", "_o", "z_score", "_evol"], "qmj_safety", ["date"])
    df = df.withColumn("_r", rank((F.col("qmj_prof") + F.col("qmj_growth") + F.col("qmj_safety")) / 3, ["date"]))
    return df.withColumn("qmj", zscore("_r", ["date"])).drop("_acc", "_bab", "_lev", "_o", "_evol", "_r")
