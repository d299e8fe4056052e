"""Costs of trades and kinds of return against a plain ledger that is kept date by date."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import portfolio as P

DATES = [dt.date(2000, m, 28) for m in (1, 2, 3, 4, 5)]
#: date -> id -> (return, weight); names come, go and come back, one is sold short.
HELD = [{1: (0.1, 0.5), 2: (-0.05, 0.5)}, {1: (0.02, 0.7), 3: (0.2, -0.2)}, {2: (0.0, 0.4)}, {1: (-0.3, 0.6), 2: (0.1, 0.3)}, {1: (0.05, 0.6), 3: (0.04, 0.1)}]
RF = [0.001, 0.002, 0.0, 0.004, 0.003]


@pytest.fixture(scope="module")
def position(spark):
    rows = [(7, d, i, r, w, f) for d, held, f in zip(DATES, HELD, RF) for i, (r, w) in held.items()]
    return spark.createDataFrame(rows, "pf int, date date, id int, ret double, wgt double, rf double")


def ledger(price, start=1.0, rf=True):
    """Per date gross, excess and cost, where price(date, id, after, before) is what a trade costs."""
    value, before, out = start, {}, []
    for k, (held, f) in enumerate(zip(HELD, RF)):
        f = f if rf else 0.0
        cash = 1 - sum(max(w, 0) for _, w in held.values())
        after = {i: w * value for i, (_, w) in held.items()}
        cost = sum(price(DATES[k], i, after.get(i, 0.0), before.get(i, 0.0)) for i in {*after, *before}) if k else 0.0
        gross, excess = sum(w * r for r, w in held.values()) + cash * f, sum(w * (r - f) for r, w in held.values()) + cash * f
        out.append((gross, excess, cost / value))
        before = {i: after[i] * (1 + r) for i, (r, _) in held.items()}
        value *= 1 + gross
    return np.array(out)


def parts(buy, sell):
    def price(date, i, after, before):
        x, (a, b, c) = abs(after - before), buy if after > before else sell
        return 0.0 if after == before else a + b * x + c * x * x

    return price


def check(out, want):
    rows = out.orderBy("date").collect()
    got = np.array([(r.gross_ret, r.excess, r.cost) for r in rows])
    assert np.allclose(got, want, atol=1e-12), (got, want)
    assert all(abs(r.net_ret - r.gross_ret + r.cost) < 1e-12 and abs(r.net_excess - r.excess + r.cost) < 1e-12 for r in rows)


def test_constant_costs(position):
    check(P.portfolio_returns(position, "rf", cost=0.002), ledger(parts((0, 0.002, 0), (0, 0.002, 0))))
    check(P.portfolio_returns(position, "rf", cost=P.Costs.of(0.002), start=50.0), ledger(parts((0, 0.002, 0), (0, 0.002, 0)), 50.0))
    costs = P.Costs.of(buy_fixed=5, buy_linear=0.002, buy_quad=0.001, sell_linear=0.003, sell_quad=0.001)
    check(P.portfolio_returns(position, "rf", cost=costs, start=100.0), ledger(parts((5, 0.002, 0.001), (0, 0.003, 0.001)), 100.0))
    check(P.portfolio_returns(position, cost=lambda after, before: F.abs(after - before) * 0.01), ledger(parts((0, 0.01, 0), (0, 0.01, 0)), rf=False))
    with pytest.raises(ValueError, match="buy_cubic"):
        P.Costs.of(buy_cubic=1)


def test_costs_by_id(spark, position):
    rates = {1: 0.002, 2: 0.003}
    table = spark.createDataFrame(list(rates.items()), "id int, cost double")
    check(P.portfolio_returns(position, "rf", cost=P.Costs.of_table(table, ("id",))), ledger(lambda d, i, a, b: rates.get(i, 0.0) * abs(a - b)))


@pytest.mark.parametrize("carried", [False, True])
def test_costs_by_date_and_id(spark, position, carried):
    rows = [(DATES[1], 1, 0.004, 0.1, 1.0), (DATES[2], 2, 0.005, None, 2.0), (DATES[3], 1, None, 0.3, 3.0), (DATES[0], 3, 0.007, 0.4, 4.0)]
    table = spark.createDataFrame(rows, "date date, id int, buy_linear double, buy_fixed double, sell_fixed double")

    def price(date, i, after, before):
        mine = [r for r in rows if r[1] == i and (r[0] <= date if carried else r[0] == date)]
        if not mine or after == before:
            return 0.0
        _, _, linear, fixed, sell = max(mine)
        return (linear or 0) * (after - before) + (fixed or 0) if after > before else sell

    check(P.portfolio_returns(position, "rf", cost=P.Costs.of_table(table, ("date", "id"), carried), start=10.0), ledger(price, 10.0))
    if carried:
        with pytest.raises(ValueError, match="carried"):
            P.Costs.of_table(table, ("id",), True)


def losses(r):
    """Of each row: drawdown, its duration and start; the successive loss, its duration and start."""
    cum, top, t0, up, u0, out = 0.0, 0.0, -1, 0.0, -1, []
    for t, x in enumerate(r):
        cum += np.log1p(x)
        if cum >= top:
            top, t0 = cum, t
        if x > 0:
            up, u0 = cum, t
        out.append((1 - np.exp(cum - top), t - t0, max(t0, 0), max(0.0, 1 - np.exp(cum - up)), t - u0, max(u0, 0)))
    return out


def test_spans_of_losses(spark):
    r = [-0.1, 0.05, 0.2, -0.1, -0.2, 0.0, 0.1, -0.05, 0.5, -0.28, -0.0001, 0.3]
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=31 * t) for t in range(len(r))]
    held = P.from_returns(spark.createDataFrame([("a", d, x) for d, x in zip(days, r)] + [("b", days[0], 0.1), ("b", days[1], None)], "who string, date date, r double"), "r", "who")
    rows = P.drawdowns(held.where("pf = 'a'"), "net_ret").orderBy("date").collect()
    want = losses(r)
    for x, (dd, n, s, sd, m, u) in zip(rows, want):
        assert np.allclose((x.drawdown, x.succdown), (dd, sd)) and (x.duration, x.start, x.succ_duration, x.succ_start) == (n, days[s], m, days[u])
    one = {x.pf: x for x in P.evaluate(held, kind="gross").collect()}
    worst, last = max(range(len(r)), key=lambda t: want[t][0]), max(range(len(r)), key=lambda t: want[t][3])
    assert (one["a"].mdd_start, one["a"].mdd_end, one["a"].mdd_duration) == (days[want[worst][2]], days[worst], want[worst][1])
    assert (one["a"].msd_start, one["a"].msd_end, one["a"].msd_duration) == (days[want[last][5]], days[last], want[last][4])
    assert np.isclose(one["a"].mean, np.mean(r) * 12) and one["a"].periods == len(r) and one["b"].periods == 1 and one["b"].mdd == 0
    series = P.evaluate_series(held.where("pf = 'a'"), kind="netret").orderBy("date").collect()
    for t, x in enumerate(series):
        k = max(range(t + 1), key=lambda j: want[j][0])
        assert (x.mdd_start, x.mdd_end, x.periods) == (days[want[k][2]], days[k], t + 1)


def test_kinds_of_return(position):
    out = P.portfolio_returns(position, "rf", cost=0.01)
    rows = out.orderBy("date").collect()
    for kind, (ret, excess) in P.RETURN_TYPES.items():
        e = P.evaluate(out, kind=kind).first()
        x = np.array([r[excess] for r in rows])
        assert np.isclose(e.mean, x.mean() * 12) and np.isclose(e.cum_ret, np.log1p([r[ret] for r in rows]).sum())
