"""Factor and characteristic portfolios: sorts with breakpoints of one exchange, one aggregate per date for all factors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import div
from quantloom.operators.analytics import weighted
from quantloom.operators.cross import breakpoints
from quantloom.operators.selection import exact_quantiles

#: Factors by model: name -> (characteristic, whether high is good, name of its size factor).
MODELS = {
    "ff3": {"hml": ("be_me", True)},
    "ff5": {"hml": ("be_me", True), "rmw": ("ope_be", True), "cma": ("at_gr1", False)},
    "hxz4": {"inv": ("at_gr1", False), "roe": ("niq_be", True)},
    "sy4": {"mgmt": ("mispricing_mgmt", True), "perf": ("mispricing_perf", True)},
}


#: The name of each model's size factor.
SIZE_FACTORS = {"ff3": "smb_ff", "ff5": "smb_ff5", "hxz4": "smb_hxz", "sy4": "smb_sy"}


def held_next(df: DataFrame, ret: str = "exret", size: str = "me", id: str = "id", date: str = "date", primary: str | None = "primary") -> DataFrame:
    """Rows for sorts: all columns but `ret` as they were a row of the id before, so that they are known when the return begins; rows
    without a return or a size go, and so do those that weren't primary."""
    by = W.partitionBy(id).orderBy(date)
    out = df.withColumns({c: F.lag(c).over(by) for c in df.columns if c not in (id, date, ret)}).where(F.col(ret).isNotNull() & F.col(size).isNotNull())
    return out.where(F.coalesce(F.col(primary), F.lit(False))) if primary else out


def daily_held_next(daily: DataFrame, monthly: DataFrame, chars: list[str], ret: str = "exret", size: str = "me", id: str = "id", date: str = "date", primary: str | None = "primary") -> DataFrame:
    """Daily rows for sorts: as held_next(), with the monthly characteristics of the month in which the day before lies."""
    own = daily.withColumn("_month", F.last_day(date))
    rows = held_next(own, ret, size, id, date, primary)
    return rows.join(monthly.select(id, F.last_day(date).alias("_month"), *chars), [id, "_month"], "left").drop("_month")


def factor_models(df: DataFrame, models: dict[str, dict[str, tuple[str, bool]]] = MODELS, size_factors: dict[str, str] = SIZE_FACTORS, ret: str = "exret", size: str = "me", date: str = "date", rf: str | None = "rf", **how) -> DataFrame:
    """date, mktrf, rf, and the factors of all models with their size factors, of rows for sorts, monthly or daily.

    The models are one plan: a characteristic that several factors sort on has its breakpoints and portfolios once, all breakpoints
    are one aggregate, and all portfolios are another. A model's size factor is the mean over its factors.
    """
    sorts: dict[tuple[str, bool], str] = {}
    for factors in models.values():
        for name, sort in factors.items():
            sorts.setdefault(sort, name)
    by = factor_portfolios(df, {name: sort for sort, name in sorts.items()}, ret, size, size, date, size_factor=None, **how)
    out = {"mktrf": F.col("mkt")}
    for m, factors in models.items():
        own = [sorts[s] for s in factors.values()]
        out |= {size_factors[m]: reduce(lambda a, b: a + b, (F.col(f"smb_{k}") for k in own)) / len(own)}
        out |= {name: F.col(sorts[s]) for name, s in factors.items()}
    by = by.select(date, *(c.alias(k) for k, c in out.items()))
    if not rf:
        return by
    rates = df.groupBy(date).agg(F.max(rf).alias("rf"))
    return by.join(rates, date).select(date, "mktrf", "rf", *(k for k in out if k != "mktrf"))


def factor_portfolios(df: DataFrame, factors: dict[str, tuple[str, bool]], ret: str, weight: str, size: str = "me", date: str = "date", nyse: str = "exchcd = 1", split: tuple[float, ...] = (0.3, 0.7), size_factor: str | None = "smb") -> DataFrame:
    """One row per date: mkt, and per factor its return and `smb_<factor>`; `size_factor`: their mean over the factors.

    2 x 3 sorts: size at the median, characteristic at `split`, both of the exchange's stocks. A factor is the mean over the sizes of
    the good class less the bad one. All breakpoints are one aggregate per date, and all portfolios one more.
    """
    nyse_only = lambda c: F.when(F.expr(nyse), F.col(c))
    cuts = breakpoints(df, [date], {"_size": (nyse_only(size), [0.5]), **{f"_{k}": (nyse_only(c), list(split)) for k, (c, _) in factors.items()}})
    j = df.join(cuts, date)
    small = F.col(size) <= F.col("_size_0")
    aggs, last = [weighted(ret, weight).alias("mkt")], len(split)
    for k, (c, _) in factors.items():
        cls = F.when(F.col(c) <= F.col(f"_{k}_0"), 0).when(F.col(c) <= F.col(f"_{k}_{last - 1}"), 1).when(F.col(c).isNotNull(), 2)
        for s, is_s in (("s", small), ("b", ~small)):
            for i in range(3):
                here = is_s & (cls == i)
                aggs.append(weighted(F.when(here, F.col(ret)), F.when(here, F.col(weight))).alias(f"_{k}_{s}{i}"))
    by = j.groupBy(date).agg(*aggs)
    out = {}
    for k, (_, high) in factors.items():
        p = lambda s, i: F.col(f"_{k}_{s}{i}")  # noqa: B023, E731
        good, bad = (2, 0) if high else (0, 2)
        out[k] = (p("s", good) + p("b", good) - p("s", bad) - p("b", bad)) / 2
        out[f"smb_{k}"] = (p("s", 0) + p("s", 1) + p("s", 2) - p("b", 0) - p("b", 1) - p("b", 2)) / 3
    by = by.withColumns(out)
    if size_factor:
        by = by.withColumn(size_factor, reduce(lambda a, b: a + b, (F.col(f"smb_{k}") for k in factors)) / len(factors))
    return by.select(date, "mkt", *out, *([size_factor] if size_factor else []))


def _long_form(df: DataFrame, chars: list[str], ret: str, date: str, size: str, nyse: str, small: float, cap: float | None) -> DataFrame:
    """date, char, x, r, the weights ew, vw and vw_cap, and whether a stock is above the exchange's size quantile `small`; one row for
    each characteristic that a row has. vw_cap: the greatest size of the exchange's stocks, over all dates, up to its quantile `cap`."""
    on_nyse = F.when(F.expr(nyse), F.col(size)).cast("double")
    rows = df.join(breakpoints(df, [date], {"_small": (on_nyse, [small])}), date)
    most = None
    if cap is not None:
        (q,) = exact_quantiles(df, {"cap": (on_nyse, [cap])})["cap"]
        most = df.agg(F.max(F.when(on_nyse <= F.lit(q), on_nyse))).first()[0] if q is not None else None
    capped = F.least(F.col(size), F.lit(most).cast("double"))  # least() takes no notice of null
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("char"), F.col(c).cast("double").alias("x")) for c in chars)))
    return rows.select(date, F.col(ret).alias("r"), F.lit(1.0).alias("ew"), F.col(size).cast("double").alias("vw"), capped.cast("double").alias("vw_cap"), (F.col(size) > F.col("_small_0")).alias("_big"), each).where(F.col("x").isNotNull())


def char_portfolios(df: DataFrame, chars: list[str], ret: str = "exret", date: str = "date", size: str = "me", nyse: str = "exchcd = 1", split: int = 3, small: float = 0.2, cap: float = 0.8) -> DataFrame:
    """date, char, group, ret_ew, ret_vw, ret_vw_cap, signal, n_firms: portfolios h, m, l of each characteristic, and hml, h less l in
    all columns, of rows for sorts.

    Cut points are of stocks above the exchange's size quantile `small`. Characteristics are in long form, so one aggregate makes all
    portfolios with all weights, and hml comes of it without another pass over the rows.
    """
    long = _long_form(df, chars, ret, date, size, nyse, small, cap)
    keys = [date, "char"]
    cuts = breakpoints(long, keys, {"_q": (F.when(F.col("_big"), F.col("x")), [i / split for i in range(1, split)])})
    above = reduce(lambda a, b: a + b, ((F.col("x") > F.col(f"_q_{i}")).cast("int") for i in range(split - 1)))
    rows = long.join(cuts, keys).where(F.col("_q_0").isNotNull()).withColumn("_cls", split - 1 - above)
    by = rows.groupBy(*keys, "_cls").agg(*(weighted("r", w).alias(f"ret_{w}") for w in ("ew", "vw", "vw_cap")), F.avg("x").alias("signal"), F.count("x").alias("n_firms"))
    values = ["ret_ew", "ret_vw", "ret_vw_cap", "signal", "n_firms"]
    names = {0: "h", split - 1: "l"} | ({1: "m"} if split == 3 else {i: f"m{i}" for i in range(1, split - 1)})
    one = by.groupBy(*keys).pivot("_cls", list(range(split))).agg(F.first(F.struct(*values)))
    spread = F.struct(*((F.col(f"`0`.{v}") - F.col(f"`{split - 1}`.{v}")).alias(v) for v in values))
    each = F.array(*(F.struct(F.lit(names[i]).alias("group"), F.col(f"`{i}`").alias("v")) for i in range(split)), F.struct(F.lit("hml").alias("group"), spread.alias("v")))
    return one.select(*keys, F.inline(each)).where("v.n_firms is not null").select(*keys, "group", "v.*")


def characteristic_portfolios(df: DataFrame, chars: list[str], ret: str, date: str = "date", size: str = "me", nyse: str = "exchcd = 1", split: tuple[float, ...] = (1 / 3, 2 / 3), small: float = 0.2, cap: float | None = 0.8) -> DataFrame:
    """date, characteristic, ret_ew, ret_vw, ret_vw_cap, signal, n_firms of tercile portfolios, highest less lowest.

    Breakpoints are of stocks above the exchange's size quantile `small`; vw_cap limits weights at the exchange's quantile `cap` of
    size over all dates. Characteristics are put into long form, so that one pass makes all portfolios.
    """
    long = _long_form(df, chars, ret, date, size, nyse, small, cap).withColumnRenamed("char", "characteristic")
    cuts = breakpoints(long, [date, "characteristic"], {"_q": (F.when(F.col("_big"), F.col("x")), list(split))})
    j = long.join(cuts, [date, "characteristic"])
    high, low = F.col("x") > F.col(f"_q_{len(split) - 1}"), F.col("x") <= F.col("_q_0")

    def spread(w):
        of = lambda c: weighted(F.when(c, F.col("r")), F.when(c, F.col(w)))
        return (of(high) - of(low)).alias(f"ret_{w}")

    return j.groupBy(date, "characteristic").agg(*map(spread, ("ew", "vw", "vw_cap")), (F.avg(F.when(high, F.col("x"))) - F.avg(F.when(low, F.col("x")))).alias("signal"), F.count("*").alias("n_firms"))


def june_sorts(monthly: DataFrame, annual: DataFrame, ret: str = "ret", me: str = "me", firm: str = "id", nyse: str = "exchcd = 1") -> DataFrame:
    """date, smb, hml of the classic construction: sorted each June on size then and book value of the year before over December's
    size, held from July to June, weights by size a month before.

    monthly: id, date, ret, me, exchcd; annual: firm, datadate, be (fiscal year ends in a calendar year).
    """
    m = monthly.withColumn("_hold", F.year(F.add_months("date", -6)))  # July to June is a holding year
    dec = monthly.where(F.month("date") == 12).select("id", (F.year("date") + 1).alias("_hold"), F.col(me).alias("_dec"))
    june = monthly.where(F.month("date") == 6).select("id", F.year("date").alias("_hold"), F.col(me).alias("_june"), F.expr(nyse).alias("_nyse"))
    book = annual.groupBy(F.col(firm).alias("id"), (F.year("datadate") + 1).alias("_hold")).agg(F.max_by("be", "datadate").alias("_be"))
    s = june.join(dec, ["id", "_hold"]).join(book, ["id", "_hold"]).where("_be > 0 and _dec > 0").withColumn("_bm", div("_be", "_dec"))
    cuts = breakpoints(s, ["_hold"], {"_s": (F.when(F.col("_nyse"), F.col("_june")), [0.5]), "_b": (F.when(F.col("_nyse"), F.col("_bm")), [0.3, 0.7])})
    s = s.join(cuts, "_hold").select("id", "_hold", (F.col("_june") > F.col("_s_0")).alias("_big"), ((F.col("_bm") > F.col("_b_0")).cast("int") + (F.col("_bm") > F.col("_b_1")).cast("int")).alias("_val"))
    before = F.lag(me).over(W.partitionBy("id").orderBy("date"))
    j = m.withColumn("_w", before).join(s, ["id", "_hold"])
    of = lambda big, v: weighted(F.when((F.col("_big") == big) & (F.col("_val") == v), F.col(ret)), F.when((F.col("_big") == big) & (F.col("_val") == v), F.col("_w")))
    by = j.groupBy("date").agg(*(of(b, v).alias(f"{'b' if b else 's'}{v}") for b in (True, False) for v in range(3)))
    return by.select("date", ((F.col("s0") + F.col("s1") + F.col("s2") - F.col("b0") - F.col("b1") - F.col("b2")) / 3).alias("smb"), ((F.col("s2") + F.col("b2") - F.col("s0") - F.col("b0")) / 2).alias("hml"))


_CELLS = [f"{s}{v}" for s in "sb" for v in "lmh"]


def june_factors(monthly: DataFrame, annual: DataFrame, held: bool = False, firm: str = "id", ret: str = "ret", nyse: str = "exchcd = 1") -> DataFrame:
    """date, sl, sm, sh, bl, bm, bh, smb, hml and n_ of each of these: the six portfolios of the classic construction, its factors, and
    the numbers of stocks with a return.

    monthly: id, firm, date (month end), ret, me, exchcd, primary, and retx if held; annual: firm, datadate, be. Stocks are sorted each
    June by size then, and by book value of the fiscal year that ended in the year before over December's size, and kept from July to
    June. Of several accounts of a firm and year the last counts; a firm's first year of accounts isn't used, and its book value must
    be positive.

    Plainly: rows of primary stocks with a positive size, weights by size a month before, and cut points of the exchange's stocks with
    more than two years of accounts. held: weights of portfolios that are bought in June and held, the size then times the products of
    the returns without dividends since, where a missing one changes nothing; all rows with a positive weight; cut points of all of the
    exchange's sorted stocks.
    """
    by_id = W.partitionBy("id").orderBy("date")
    july = F.add_months("date", -6)  # July to June is a holding year
    m = monthly.withColumns({"_hold": F.year(july), "_first": F.month(july) == 1, "_before": F.lag("me").over(by_id)})
    if held:
        grown = F.sum(F.log1p("retx")).over(W.partitionBy("id", "_hold").orderBy("date"))
        m = m.withColumn("_grown", F.coalesce(grown, F.lit(0.0)))
        m = m.withColumns({"_before": F.when(F.row_number().over(by_id) == 1, F.col("me") / (1 + F.col("retx"))).otherwise(F.col("_before")), "_earlier": F.lag("_grown").over(by_id)})
        base = F.max(F.when(F.col("_first"), F.col("_before"))).over(W.partitionBy("id", "_hold"))
        m = m.withColumn("_w", F.when(F.col("_first"), F.col("_before")).otherwise(base * F.exp("_earlier")))
        rows = m.where("_w > 0")
    else:
        rows = m = m.withColumn("_w", F.col("_before")).where(F.col("primary") & (F.col("me") > 0))
    year = F.year("datadate")
    books = annual.groupBy(F.col(firm).alias("_firm"), year.alias("_year")).agg(F.max_by("be", "datadate").alias("_be"))
    books = books.withColumn("_age", F.row_number().over(W.partitionBy("_firm").orderBy("_year")) - 1).where("_age >= 1 and _be > 0")
    june = m.where(F.month("date") == 6).select("id", F.col(firm).alias("_firm"), (F.year("date") - 1).alias("_year"), F.col("me").alias("_size"), F.expr(nyse).alias("_nyse")).where("_size > 0")
    december = m.where(F.month("date") == 12).select("id", F.year("date").alias("_year"), F.col("me").alias("_then")).where("_then > 0")
    s = june.join(books, ["_firm", "_year"]).join(december, ["id", "_year"]).withColumn("_bm", div("_be", "_then"))
    counts = F.col("_nyse") if held else F.col("_nyse") & (F.col("_age") > 1)
    cuts = breakpoints(s, ["_year"], {"_s": (F.when(counts, F.col("_size")), [0.5]), "_b": (F.when(counts, F.col("_bm")), [0.3, 0.7])})
    s = s.join(cuts, "_year").where("_s_0 is not null and _b_0 is not null")
    cell = F.concat(F.when(F.col("_size") > F.col("_s_0"), "b").otherwise("s"), F.when(F.col("_bm") > F.col("_b_1"), "h").when(F.col("_bm") > F.col("_b_0"), "m").otherwise("l"))
    j = rows.join(s.select("id", (F.col("_year") + 1).alias("_hold"), cell.alias("_cell")), ["id", "_hold"])
    here = lambda c, x: F.when(F.col("_cell") == c, F.col(x))
    by = j.groupBy("date").agg(*(weighted(here(c, ret), here(c, "_w")).alias(c) for c in _CELLS), *(F.count(here(c, ret)).alias(f"n_{c}") for c in _CELLS))
    c = F.col
    smb = (c("sl") + c("sm") + c("sh") - c("bl") - c("bm") - c("bh")) / 3
    hml = (c("sh") + c("bh") - c("sl") - c("bl")) / 2
    return by.select("date", *_CELLS, smb.alias("smb"), hml.alias("hml"), *(f"n_{x}" for x in _CELLS), sum((c(f"n_{x}") for x in _CELLS), F.lit(0)).alias("n_smb"), sum((c(f"n_{x}") for x in ("bh", "sh", "bl", "sl")), F.lit(0)).alias("n_hml"))
