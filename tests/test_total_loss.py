"""Returns that lose all, or more: they stay in what is cumulated."""

import datetime as dt
import math

import pytest

from quantloom.operators import portfolio as P

DAYS = [dt.date(2001, m, 28) for m in range(1, 6)]


@pytest.mark.parametrize("lost", [-1.5, -1.0])
def test_losses_of_all_and_more(spark, lost):
    r = [0.1, -0.2, lost, 0.3, -0.1]
    held = P.from_returns(spark.createDataFrame(list(zip(DAYS, r)), "date date, r double").selectExpr("7 as pf", "*"), "r")
    e = P.evaluate(held, kind="gross").first()
    values = [x.value for x in held.orderBy("date").collect()]
    assert math.isclose(values[1], 0.88) and e.periods == 5
    if lost < -1:
        assert all(map(math.isnan, (*values[2:], e.cum_ret, e.mdd, e.msd)))
        assert (e.mdd_start, e.mdd_end, e.mdd_duration) == (DAYS[2], DAYS[2], 0)
        assert (e.msd_start, e.msd_end, e.msd_duration) == (DAYS[0], DAYS[2], 2)
    else:
        assert values[2:] == [0.0] * 3 and e.cum_ret == -math.inf and e.mdd == 1
        assert (e.mdd_start, e.mdd_end, e.mdd_duration) == (DAYS[0], DAYS[2], 2)
    series = P.evaluate_series(held, kind="gross").orderBy("date").collect()
    assert (series[2].mdd_end, series[4].mdd_end) == (DAYS[2], DAYS[2]) and math.isclose(series[1].mdd, 0.2)


def test_costs_above_the_value(spark):
    """Fixed costs of each trade can take more than all: what they leave isn't the return without them."""
    held = spark.createDataFrame([("p", d, i, 0.5, 0.01 * i) for d in DAYS for i in (1, 2)], "pf string, date date, id int, wgt double, ret double")
    e = P.evaluate(P.portfolio_returns(held, cost=P.Costs.of(buy_fixed=1.0, sell_fixed=1.0))).first()
    assert math.isnan(e.cum_ret) and math.isnan(e.mdd) and (e.mdd_start, e.mdd_end) == (DAYS[1], DAYS[1])
