"""Rules of single operators on rows made by hand."""

import datetime as dt

from pyspark.sql import functions as F

from quantloom.operators import cross
from quantloom.operators import portfolio as P
from quantloom.plans import fundq
from quantloom.plans.spec import Terms, replaced


def test_quarterly_preparation(spark):
    rows = [
        {"seqq": 10.0, "txditcq": 2.0, "pstkq": 1.0, "saleq": -5.0, "revtq": 7.0, "want": 11.0},
        {"ceqq": 6.0, "pstkq": 1.0, "want": 6.0},  # common and preferred equity, less preferred
        {"ceqq": 6.0, "atq": 20.0, "ltq": 5.0, "want": 15.0},  # no preferred: assets less liabilities
        {"seqq": -3.0, "want": None},
        {"seqq": 1e-9, "want": 0.0},
        {"atq": -1.0, "ltq": 5.0, "want": None},
    ]
    names = [*fundq.RAW, "want"]
    df = spark.createDataFrame([[r.get(c) for c in names] for r in rows], ", ".join(f"{c} double" for c in names))
    got = replaced(df, fundq.prepare(Terms())).collect()
    assert [r.be for r in got] == [r["want"] for r in rows]
    assert got[0].saleq is None and got[0].revtq == 7.0  # sales aren't filled from revenue


def test_kinds_of_anomalies(spark):
    level = [10.0, 11.0, 10.5, 500.0, 10.0, 11.0, 10.5, 11.2, -1.0, 10.1, 10.6]
    df = spark.createDataFrame([(1, dt.date(2000, 1, 1) + dt.timedelta(k), x) for k, x in enumerate(level)], "id int, date date, x double")
    odd = lambda **k: [r.x for r in cross.anomalies(df, "x", "id", "date", "odd", **k).where("odd").orderBy("date").collect()]
    assert 500.0 in odd(tails=(0.2, 0.8)) and -1.0 not in odd(kinds=("value",), tails=(0.0, 1.0))
    assert odd(kinds=("value",), tails=(0.2, 0.8)) == [500.0, -1.0]
    assert odd(kinds=("negative",), rare_negative=0.1) == [-1.0] and odd(kinds=("negative",), rare_negative=0.05) == []


def test_evaluation_is_after_costs(spark):
    days = [dt.date(2000, m, 28) for m in range(1, 5)]
    held = spark.createDataFrame([("p", d, i, 0.5, r) for d in days for i, r in ((1, 0.02), (2, -0.01))], "pf string, date date, id int, wgt double, ret double")
    out = P.portfolio_returns(held, cost=0.01)
    rows = out.orderBy("date").collect()
    assert all(abs(r.net_excess - (r.excess - r.cost)) < 1e-12 for r in rows) and any(r.cost > 0 for r in rows)
    e = P.evaluate(out).first()
    assert abs(e.mean - 12 * sum(r.net_excess for r in rows) / 4) < 1e-12 and abs(e.turnover - 12 * sum(r.turnover for r in rows) / 4) < 1e-12
    flat = P.evaluate(P.portfolio_returns(held.where("id = 1"))).first()
    assert flat.sharpe == 0.0
    last = P.evaluate_series(out).orderBy("date").collect()[-1]
    assert all(abs(last[c] - e[c]) < 1e-12 for c in ("mean", "std", "sharpe", "cum_ret", "mdd", "msd", "turnover"))


def test_annual_accounts_from_quarters(spark):
    rows = [("2000-03-31", 2000, 1, 1.0, 1.0), ("2000-06-30", 2000, 2, 2.0, 3.0), ("2000-09-30", 2000, 3, 3.0, 6.0), ("2000-12-31", 2000, 4, 4.0, 11.0), ("2001-03-31", 2001, 1, 5.0, 5.0), ("2001-06-30", 2001, 2, 6.0, None)]
    rows += [("2001-09-30", 2002, 1, 7.0, 7.0), ("2001-12-31", 2002, 4, 8.0, 15.0), ("2002-06-30", 2002, 2, 9.0, 9.0), ("2002-09-30", 2002, 3, None, 9.0), ("2002-12-31", 2002, 4, 1.0, None)]
    df = spark.createDataFrame([(1, *r, 7.0, 50.0) for r in rows], "id int, d string, fyearq int, fqtr int, saleq double, saley double, atq double, prccq double").withColumn("date", F.to_date("d"))
    out = fundq.annual_from_quarters(df).orderBy("date").collect()
    # A fourth quarter has the year to date; a changed fiscal year, or none to date, the last four quarters; a gap, or a missing quarter, nothing.
    assert [r.sale for r in out] == [None, None, None, 11.0, 14.0, 18.0, 22.0, 26.0, None, None, None]
    assert out[0].at == 7.0 and out[0].prcc_f == 50.0 and out[0].fyearq == 2000
