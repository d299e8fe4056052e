"""Characteristics from annual accounts: preparation and formulas. Columns at, lt and do are called at_, lt_ and do_."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spec import Terms, above, create, div, flag, nonzero, nz, replaced, total

#: Columns that the formulas read (amounts, as doubles).
RAW = "at_ sale revt dv che lt_ ivao ivst gp cogs xopr xsga ebitda oibdp ebit oiadp dp pi xint spi nopi xido xi do_ ib ni txt mii dvt pstkrv pstkl pstk seq ceq dltt lct lo txditc act rect invt aco ap dlc txp lco txdb itcb icapt mib prcc_f csho oancf capx xrd sstk prstkc dltis dltr dlcch ppegt ppent intan ao emp re dcvt dcpstk cshrc dm fatb fatl ppenb ppenls txfo txfed txdi ajex scstkc".split()
#: Industry codes of sin stocks, and corporate tax rates by the last year that they held.
_SIN_NAICS = "'7132', '71312', '713210', '71329', '713290', '72112', '721120'"
_TAX = [(1978, 0.48), (1986, 0.46), (1987, 0.40), (1992, 0.34), (9999, 0.35)]


def prepare(t: Terms) -> list[dict[str, str]]:
    """Projections, in order: negative amounts that can't be, values that are as good as zero, then missing items from others."""
    c = lambda *xs: f"coalesce({', '.join(xs)})"
    return [
        {x: f"case when {x} >= 0 then {x} end" for x in ("at_", "sale", "revt", "dv", "che")},
        {x: f"case when abs({x}) < 1e-7 then 0.0 else {x} end" for x in RAW},
        {"ivao": nz("ivao"), "ivst": nz("ivst"), "sale": c("sale", "revt"), "xopr": c("xopr", "cogs + xsga"), "xido": c("xido", f"xi + {nz('do_')}"), "dvt": c("dvt", "dv"), "pstkrv": c("pstkrv", "pstkl", "pstk")},
        {"gp": c("gp", "sale - cogs"), "seq": c("seq", f"ceq + {nz('pstkrv')}", "at_ - lt_")},
        {"ebitda": c("ebitda", "oibdp", "sale - xopr", "gp - xsga"), "at_": c("at_", f"seq + dltt + {nz('lct')} + {nz('lo')} + {nz('txditc')}")},
        {"ebit": c("ebit", "oiadp", "ebitda - dp"), "at_": above("at_")},
        {"pi": c("pi", f"ebit - xint + {nz('spi')} + {nz('nopi')}"), "avgat": t.R("mean", "at_", 2), "act": c("act", "rect + invt + che + aco")},
        {"ib": c("ib", "ni - xido", f"pi - txt - {nz('mii')}"), "lct": c("lct", "ap + dlc + txp + lco"), "txditc": c("txditc", total("txdb", "itcb")), "debt": total("dltt", "dlc")},
        {"nix": c("ni", f"ib + {nz('xido')}", "xi + do_"), "be": f"seq + {nz('txditc')} - {nz('pstkrv')}", "bev": c(f"icapt + {nz('dlc')} - {nz('che')}", f"seq + debt - {nz('che')} + {nz('mib')}"), "me": "prcc_f * csho", "me_fiscal": "prcc_f * csho",
         "_nwc": f"act - che - (lct - {nz('dlc')}) + (at_ - act - ivao - (lt_ - lct - dltt))", "_ac": "act - che - lct + dlc + txp"},
        {"oacc": c("ib - oancf", t.D("_nwc")), "acc_": f"{t.D('_ac')} + dp", "sic2": "substring(sic, 1, 2)", "sic3": "substring(sic, 1, 3)"},
        {"ocf": c("oancf", "ib - oacc", "ib + dp"), **{x: f"case when {x} >= 0 then {x} end" for x in ("be", "bev", "debt", "seq")}},
    ]


def _duration() -> str:
    """Equity duration: ten years of return on equity and growth that revert, then a perpetuity. Helpers _q0.. hold the years."""
    return "case when least(" + ", ".join(f"_b{i}" for i in range(1, 11)) + ") >= 0 and _dur > 1 then _dur end"


def _years() -> dict[str, str]:
    out = {"_roe0": "case when _be1 > 1 then ib / _be1 end", "_g0": "case when _sale1 > 1 then sale / _sale1 - 1 end", "_b0": "be"}
    for i in range(1, 11):
        out[f"_roe{i}"] = f"0.12 * (1 - 0.57) + 0.57 * _roe{i - 1}"
        out[f"_g{i}"] = f"0.06 * (1 - 0.24) + 0.24 * _g{i - 1}"
        out[f"_b{i}"] = f"_b{i - 1} * (1 + _g{i})"
    flows = [f"_b{i - 1} * (_roe{i} - _g{i}) / power(1.12, {i})" for i in range(1, 11)]
    out["_pv"] = " + ".join(flows)
    out["_tpv"] = " + ".join(f"{i} * ({x})" for i, x in enumerate(flows, 1))
    out["_dur"] = f"{div('_tpv', 'me')} + {11 + 1 / 0.12!r} * {div('me - _pv', 'me')}"
    return out


def _industry(x: str) -> str:
    return f"(({x}) - avg({x}) over (partition by sic2, fyear))"


def formulas(t: Terms) -> dict[str, str]:
    L, D, G, R, j = t.L, t.D, t.G, t.R, t.jkp
    size = "at_" if j else "avgat"
    c2e = lambda x: f"(({x}) / {above('_m_' + x)} - 1)"
    grow = lambda x: {f"_m_{x}": R("mean", x, 2, 2 if j else 1, 1)}
    herf = lambda x: {f"_s_{x}": f"case when _herf_ok then sum({x}) over (partition by sic3, fyear) end", f"_h0_{x}": div(x, f"_s_{x}"), f"_h_{x}": f"case when _herf_ok and count({x}) over (partition by sic3, fyear) >= 5 and count({x}) over (partition by sic3, fyear) >= 0.8 * count(*) over (partition by sic3, fyear) then sum(_h0_{x} * _h0_{x}) over (partition by sic3, fyear) end"}
    last = {f"_{x}1": L(x) for x in ("at_", "be", "sale", "ppent", "nix", "seq")}
    rate = "case " + " ".join(f"when fyear <= {y} then {r}" for y, r in _TAX) + " end"
    f = {
        **{k.replace("_at_1", "_at1"): v for k, v in last.items()},
        "at_gr1": G("at_"), "sale_gr1": G("sale"), "sale_gr3": G("sale", 3), "debt_gr3": G("debt", 3 if j else 5), "inv_gr1a": div(D("invt"), size), "lti_gr1a": div(D("ivao"), "at_"),
        "_coa": "act - che", "_col": f"lct - {nz('dlc')}", "_ncoa": "at_ - act - ivao", "_ncol": "lt_ - lct - dltt",
        "coa_gr1a": div(D("_coa"), "at_"), "col_gr1a": div(D("_col"), "at_"), "_cowc": "_coa - _col", "cowc_gr1a": div(D("_cowc"), "at_"), "ncoa_gr1a": div(D("_ncoa"), "at_"), "ncol_gr1a": div(D("_ncol"), "at_"),
        "_nncoa": "_ncoa - _ncol", "nncoa_gr1a": div(D("_nncoa"), "at_"), "_noa": f"act - che + at_ - act - ivao - (lct - {nz('dlc')} + (lt_ - lct - dltt))", "noa_gr1a": div(D("_noa"), "_at1"),
        "_fnl": "debt + pstkrv", "fnl_gr1a": div(D("_fnl"), size), "_nfna": "ivst + ivao - _fnl", "nfna_gr1a": div(D("_nfna"), "at_"),
        "ebit_sale": div("ebit", above("sale")), "gp_at": div("gp", "at_"), "cop_at": div(f"ebitda + {nz('xrd')} - oacc", "at_"), "ni_be": div("ib", nonzero("be")), "ebit_bev": div("ebit", above("bev")),
        "_eqnetis": total("sstk", "-prstkc") if j else total("sstk", "-prstkc", "-dv"), "_ddltt": D("dltt"), "_ddlc": D("dlc"),
        "_dbnetis": total(f"coalesce({total('dltis', '-dltr')}, _ddltt)", "coalesce(dlcch, _ddlc)"), "netis_at": div("_eqnetis + _dbnetis", "at_"), "eqnetis_at": div("_eqnetis", "at_"), "dbnetis_at": div("_dbnetis", "at_"),
        "oaccruals_at": div("oacc", size), "acc": div("coalesce(ib - oancf, acc_)", "avgat"), "oaccruals_ni": div("oacc", f"abs({nonzero('nix')})"), "pctacc": div("coalesce(ib - oancf, acc_)", "case when abs(ib) < 1e-7 then 0.01 else abs(ib) end"),
        "_tacc": f"oacc + {D('_nfna')}", "taccruals_at": div("_tacc", "at_"), "taccruals_ni": div("_tacc", f"abs({nonzero('nix')})"), "noa_at": div("_noa", "_at1"), "opex_at": div("xopr", "at_"), "at_turnover": div("sale", "avgat"),
        "sale_bev": div("sale", above("bev")), "rd_sale": div("xrd", above("sale")), "be_me": div("be", "me"), "at_me": div("at_", "me"), "ni_me": div("ib", "me"), "sale_me": div("sale", "me"), "ocf_me": div("ocf", "me"),
        "cfp": div("coalesce(oancf, ib - acc_)", "me"), "fcf_me": div("ocf - capx", "me"), "rd_me": div("xrd", "me"), "_mev": above(f"me + debt - {nz('che')}"), "bev_mev": div("bev", "_mev"), "eqpo_me": div("dvt + prstkc", "me"),
        "eqnpo_me": div(f"dvt - {total('sstk', '-prstkc')}", "me"), "ebitda_mev": div("ebitda", "_mev"), "enterprise_multiple": div(f"me + debt + pstkrv - {nz('che')}", above("oibdp")), "ocf_at": div("ocf", "at_"), "ocf_at_chg1": D("ocf_at"),
        "cash_at": div("che", "at_"), "_ppeinv": "ppegt + invt", "ppeinv_gr1a": div(D("_ppeinv"), "_at1"), "_lnoa": "ppent + intan + ao - lo", "lnoa_gr1a": div(f"{D('_lnoa')} + dp", "at_ + _at1" if j else "avgat"),
        "capx_gr1": G("capx"), "capx_gr2": G("capx", 2), "capx_gr3": G("capx", 3), "sti_gr1a": div(D("ivst"), "at_"), "rd5_at": div("xrd + " + " + ".join(f"{w} * {L('xrd', k)}" for k, w in ((1, 0.8), (2, 0.6), (3, 0.4), (4, 0.2))), "at_"),
        "age": f"cast(row_number() {t.over} * {12 if t.m == 1 else 1} as int)", **grow("sale"), **grow("invt"), **grow("rect"), **grow("gp"), **grow("xsga"),
        "dsale_dinv": f"{c2e('sale')} - {c2e('invt')}", "dsale_drec": f"{c2e('sale')} - {c2e('rect')}", "dgp_dsale": f"{c2e('gp')} - {c2e('sale')}", "dsale_dsga": f"{c2e('sale')} - {c2e('xsga')}",
        "debt_me": div("debt", "me"), "netdebt_me": div(f"debt - {nz('che')}", "me"), "_cs": div("capx", above("sale")), "_mcs": R("mean", "_cs", 3, None, 1), "capex_abn": f"_cs / {above('_mcs')} - 1", "inv_gr1": G("invt"), "be_gr1a": div(D("be"), size),
        "op_at": div(f"ebitda + {nz('xrd')}", "at_"), "pi_nix": "case when pi >= 0 and nix > 0 then pi / nix end", "op_atl1": div(f"ebitda + {nz('xrd')}", "_at1"), "ope_be": div("ebitda - xint", nonzero("be")),
        "operprof": div(f"revt - {nz('cogs')} - {nz('xsga')} - {nz('xint')}", above("ceq")), "ope_bel1": div("ebitda - xint", nonzero("_be1")), "gp_atl1": div("gp", "_at1"), "cop_atl1": div(f"ebitda + {nz('xrd')} - oacc", "_at1"), "at_be": div("at_", nonzero("be")),
        "_aliq": f"che + 0.75 * (act - che) + 0.5 * (at_ - act - {nz('intan')})", "aliq_at": div("_aliq", "_at1"), "_mat": "at_ - be + me", "aliq_mat": div("_aliq", L("_mat")), "tangibility": div("che + 0.715 * rect + 0.547 * invt + 0.535 * ppegt", "at_"),
        **_years(), "eq_dur": _duration(),
        "_roa": div("ib", "_at1"), "_croa": div("ocf", "_at1"), "_lev": div("dltt", "at_" if j else "avgat"), "_cur": div("act", "lct"), "_gm": div("gp", "sale"), "_ato": div("sale", "_at1"),
        "f_score": " + ".join([flag("_roa > 1e-7"), flag("_croa > 1e-7"), flag(f"{D('_roa')} > 1e-7"), flag("_croa - _roa > 1e-7"), flag(f"{D('_lev')} < 1e-7"), flag(f"{D('_cur')} > 1e-7"), flag("abs(sstk) < 1e-7") if j else flag("abs(coalesce(sstk - pstk, 0)) < 1e-7"), flag(f"{D('_gm')} > 1e-7"), flag(f"{D('_ato')} > 1e-7")]),
        "_act2": "coalesce(act, che + rect + invt)", "_lct2": "coalesce(lct, ap)", "_p1": div("ib", "at_"), "_p2": div("dltt", "at_"), "_p3": div("_act2", "_lct2"), "_p4": div("sale - cogs", "sale"), "_p5": div("sale", "at_"),
        "ps": " + ".join([flag("ib > 0"), flag("oancf > 0"), flag(f"{D('_p1')} > 0"), flag("oancf > ib"), flag(f"{D('_p2')} < 0"), flag(f"{D('_p3')} > 0"), flag(f"{D('_p4')} > 0"), flag(f"{D('_p5')} > 0"), flag("scstkc = 0")]),
        "o_score": f"-1.32 - 0.407 * ln({above('at_')}) + 6.03 * {div('debt', 'at_')} + 1.43 * {div('act - lct', 'at_')} + 0.076 * {div('lct', above('act'))} - 1.72 * {flag('lt_ > at_')} - 2.37 * {div('nix', 'at_')} - 1.83 * {div('pi + dp', above('lt_'))} + 0.285 * {flag('nix < 0 and _nix1 < 0')} - 0.52 * {div('nix - _nix1', above('abs(nix) + abs(_nix1)'))}",
        "z_score": f"1.2 * {div('act - lct', 'at_')} + 1.4 * {div('re', 'at_')} + 3.3 * {div('ebitda', 'at_')} + 0.6 * {div('me_fiscal', 'case when lt_ > 0 then lt_ end')} + {div('sale', 'at_')}",
        "_pp1": "case when _ppent1 > 0 then _ppent1 end", "kz_index": f"-1.002 * {div('ib + dp', '_pp1')} + 0.283 * {div('at_ + me_fiscal - be' + ('' if j else ' - txdb'), 'at_')} + 3.139 * {div('debt', nonzero('debt + seq'))} - 39.368 * {div('dvt', '_pp1')} - 1.315 * {div('che', '_pp1')}",
        "_mbe": R("mean", "be", 2), "_ero": div("nix", "case when _mbe > 0 then _mbe end"), "_pay": f"case when nix <= 0 then {div('dvt / 0.06', 'at_')} else {div('dvt', 'nix')} end", "_iv": "be + (_ero - 0.12) / 1.12 * be + (_ero - 0.12) / 0.12 / 1.12 * (1 + (1 - _pay) * _ero) * be",
        "intrinsic_value": "case when _iv > 0 then _iv end", "_semp": div("sale", above("emp")), "sale_emp_gr1": G("_semp"), "emp_gr1": div(D("emp"), R("mean", "emp", 2)),
        "_ea": div("ib", "_at1"), "_oa": div("ocf", "_at1"), "_sea": R("std", "_ea", 5), "_soa": R("std", "_oa", 5), "earnings_variability": div("_sea", above("_soa")),
        "_nia": div("ib", "at_"), "_nial": L("_nia"), "_nin": f"count(case when _nial is not null then _nia end) {t.frame(5)}", "_nir2": f"regr_r2(_nia, _nial) {t.frame(5)}",
        "ni_ar1": f"case when _nin >= 5 then regr_slope(_nia, _nial) {t.frame(5)} end", "ni_ivol": f"case when _nin >= 5 then sqrt(var_samp(case when _nial is not null then _nia end) {t.frame(5)} * greatest(0, 1 - _nir2)) end",
        "cashpr": div("me + dltt - at_", above("che")), "roic": div("ebit - nopi", above("ceq + lt_ - che")), "absacc": "abs(acc)", "depr": div("dp", above("ppent")), "_depr": div("dp", nonzero("ppent")), "pchdepr": G("_depr"),
        "_ppi": "coalesce(ppegt, ppent) + invt", "invest": div(D("_ppi"), "_at1"), "sin": flag(f"sic between '2100' and '2199' or sic between '2080' and '2085' or naics in ({_SIN_NAICS})"),
        "currat": div("_act2", nonzero("_lct2")), "pchcurrat": G("currat"), "quick": div("_act2 - invt", nonzero("_lct2")), "pchquick": G("quick"), "salecash": div("sale", above("che")), "salerec": div("sale", above("rect")), "saleinv": div("sale", above("invt")), "pchsaleinv": G("saleinv"),
        "cashdebt": div("ib + dp", above("_mlt")), "_mlt": R("mean", "lt_", 2), "_xrat": div("xrd", "at_"), "rd": flag(f"{div('xrd', 'revt')} >= 0 and _xrat >= 0 and {G('xrd')} >= 0.05 and {G('_xrat')} >= 0.05"), "_pm": div("ib", "sale"), "chpmia": D("_pm"),
        "_opat": "rect + invt + aco + ppent + intan - ap - lco - lo", "_ato2": div("sale", R("mean", "_opat", 2)), "chatoia": D("_ato2"), "_bm": div("ceq", "me"), "bm_ia": _industry("_bm"), "cfp_ia": _industry("cfp"), "_hire": nz(G("emp")), "chempia": _industry("_hire"), "mve_ia": _industry("me"),
        "_rer": f"coalesce({div('fatb + fatl', 'ppegt')}, {div('ppenb + ppenls', 'ppent')})", "realestate": "case when count(_rer) over (partition by sic2, fyear) >= 5 then _rer - avg(_rer) over (partition by sic2, fyear) end",
        "secured": nz(div("dm", above("dltt + dlc"))), "securedind": flag("secured > 0"), "convind": flag(f"coalesce(dcvt, dcpstk - {nz('pstk')}) > 0 or cshrc > 0"), "_capx2": f"coalesce(capx, {D('ppent')})", **grow("_capx2"), "_dcapx": c2e("_capx2"), "pchcapx_ia": _industry("_dcapx"),
        "_tax": "coalesce(txfo + txfed, txt - txdi)", "_tb": div("_tax", f"({rate}) * ib"), "tb": "case when ib <= 1e-7 then case when _tax > 0 then 1.0 end else _tb end",
        "_herf_ok": "not coalesce(sic between '6000' and '6999' or sic between '4900' and '4939' or (datadate <= date '1980-01-01' and sic in ('4011', '4210', '4213')) or (datadate <= date '1978-01-01' and sic = '4512') or (datadate <= date '1982-01-01' and sic in ('4812', '4813')), false)",
        **herf("sale"), **herf("at_"), **herf("be"), "herf_sale": R("mean", "_h_sale", 3), "herf_at": R("mean", "_h_at_", 3), "herf_be": R("mean", "_h_be", 3), "dy": div("dvt", "me"), "_adj": "csho * ajex", "chcsho": G("_adj"), "lgr": G("lt_"),
    }
    return f


def names(t: Terms = Terms()) -> list[str]:
    return [k for k in formulas(t) if not k.startswith("_")]


def characteristics(df: DataFrame, wanted: list[str] | None = None, t: Terms = Terms()) -> DataFrame:
    """df: id, date, sic, naics, fyear, RAW and datadate, the accounts' own date (default: date). Gives df after preparation with the
    wanted characteristics."""
    if "datadate" not in df.columns:
        df = df.withColumn("datadate", F.col("date"))
    return create(replaced(df, prepare(t)), formulas(t), wanted)
