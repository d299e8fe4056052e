"""Characteristics from quarterly accounts. Flows are quarterly already; operators/joins.py makes them from year-to-date values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spec import Terms, above, create, div, nonzero, nz, replaced

RAW = "atq saleq revtq ibq txtq seqq txditcq pstkq ceqq ltq cshprq ajexq epspxq oancfq dpq wcapq prccq cshoq actq cheq lctq dlcq".split()


def prepare(t: Terms) -> list[dict[str, str]]:
    """Negative values of what can't be negative are missing; book equity; then values near zero are zero, and negative book equity is missing."""
    zero = lambda x: f"case when abs({x}) < 1e-7 then 0.0 else {x} end"
    return [
        {x: f"case when {x} >= 0 then {x} end" for x in ("atq", "saleq", "revtq", "cheq")},
        {"be": f"coalesce(seqq, ceqq + pstkq, atq - ltq) + {nz('txditcq')} - {nz('pstkq')}"},
        {x: zero(x) for x in [*RAW, "be"]},
        {"be": "case when be >= 0 then be end"},
    ]


def formulas(t: Terms) -> dict[str, str]:
    L, D, R = t.L, t.D, t.R
    surprise = lambda d: div(f"{d} - {R('mean', d, 8, 6, 1)}", above(R("std", d, 8, 6, 1)))
    return {
        "_atq4": L("atq", 4), "_atq1": L("atq"), "_beq1": L("be"), "_dni4": D("ibq", 4), "_rn": f"row_number() {t.over}",
        "chtx": div(D("txtq", 4), nonzero("_atq4")),
        "_stop": "case when coalesce(_dni4 <= 0, true) then _rn end", "_laststop": "max(_stop) over (partition by id order by date rows between unbounded preceding and current row)",
        "ni_inc8q": "case when _dni4 is not null then cast(least(8, _rn - coalesce(_laststop, 0)) as int) end",
        "niq_be": div("ibq", nonzero("_beq1")), "niq_be_chg1": D("niq_be", 4), "niq_at": div("ibq", nonzero("_atq1")), "roavol": R("std", "niq_at", 16, 8), "niq_at_chg1": D("niq_at", 4),
        "_sps": "saleq" if t.jkp else div("saleq", "cshprq * ajexq"), "_dsps": D("_sps", 4), "saleq_su": surprise("_dsps"), "_eps": "ibq" if t.jkp else div("epspxq", "ajexq"), "_deps": D("_eps", 4), "niq_su": surprise("_deps"),
        "_wc": nz("wcapq"), "_dwc": D("_wc"), "_cfs": div("coalesce(oancfq, ibq + dpq - _dwc)", "saleq"), "ocfq_saleq_std": R("std", "_cfs", 16, 8),
        "_dsale4": D("saleq", 4), "rsup": div("_dsale4", above("prccq * cshoq")), "_accq": "actq - cheq - lctq + dlcq", "_daccq": D("_accq"), "_sacc": "_daccq / case when saleq <= 0 then 0.01 else saleq end", "stdacc": R("std", "_sacc", 16),
    }


def characteristics(df: DataFrame, wanted: list[str] | None = None, t: Terms = Terms()) -> DataFrame:
    return create(replaced(df, prepare(t)), formulas(t), wanted)


#: Quarterly flows that add up to annual ones; the later ones come from year-to-date values.
FLOWS = """cogs xsga xint dp txt xrd spi sale revt xopr oibdp oiadp ib ni xido nopi mii pi xi
oancf dv sstk dlcch capx dltr txbcof xidoc dpc fiao ibc prstkc fincf""".split()
#: Quarterly columns that keep their names.
_KEPT = {"fyearq", "rdq"}


def annual_from_quarters(df: DataFrame, flows: list[str] | None = None, id: str = "id", date: str = "date", fyear: str = "fyearq", fqtr: str = "fqtr") -> DataFrame:
    """Annual accounts that are renewed each quarter: quarterly accounts with the annual names of their columns, x for xq.

    Of flows the last four quarters add up, if all four are there and their dates follow each other by quarters. In a fourth quarter
    the year-to-date value xy counts where there is one, which also gives a firm's first year; but not if the fiscal year was changed
    within the four quarters, as it then has fewer. Other values are the quarter's own; prccq becomes prcc_f.
    """
    own = {c: "prcc_f" if c == "prccq" else c[:-1] for c in df.columns if c.endswith("q") and c not in _KEPT}
    flows = [x for x in (flows or FLOWS) if f"{x}q" in own]
    by = W.partitionBy(id).orderBy(date)
    months = lambda d: F.year(d) * 12 + F.month(d)
    label = F.col(fyear) * 4 + F.col(fqtr)
    df = df.withColumns({"_months": months(F.col(date)) - months(F.lag(date, 3).over(by)), "_labels": label - F.lag(label, 3).over(by)})
    running_year = F.coalesce(F.col("_months") == 9, F.lit(False))
    changed = running_year & (F.col("_labels") != 3)
    last = by.rowsBetween(-3, 0)
    made = {}
    for x in flows:
        q = F.col(f"{x}q").cast("double")
        four = F.when(running_year & (F.count(q).over(last) == 4), F.sum(q).over(last))
        y = F.when((F.col(fqtr) == 4) & ~F.coalesce(changed, F.lit(False)), F.col(f"{x}y").cast("double")) if f"{x}y" in df.columns else F.lit(None).cast("double")
        made[f"{x}q"] = F.coalesce(y, four)
    return df.withColumns(made).drop("_months", "_labels").withColumnsRenamed(own)
