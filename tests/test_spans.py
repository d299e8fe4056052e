"""Spans of dates against a plain walk over days; link tables; codes carried into events."""

import datetime as dt
import random

import pytest

from quantloom.operators import joins as J
from quantloom.operators import spans as S

D0 = dt.date(2000, 1, 1)


def day(n):
    return None if n is None else D0 + dt.timedelta(days=n)


def some_spans(seed, keys=3, n=8):
    r, out = random.Random(seed), []
    for k in range(keys):
        for _ in range(n):
            s = r.randrange(60)
            out.append((k, day(s), None if r.random() < 0.08 else day(s + r.randrange(-1, 9))))
    return out


def days(rows, horizon=100):
    """key -> the days that its spans hold."""
    out = {}
    for k, s, e in rows:
        out.setdefault(k, set()).update(range((s - D0).days, horizon if e is None else (e - D0).days + 1))
    return out


def runs(held, horizon=100):
    out, start = [], None
    for n in range(horizon + 1):
        if n in held and start is None:
            start = n
        if start is not None and n not in held:
            out.append((day(start), None if n == horizon else day(n - 1)))
            start = None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merged_spans_hold_the_same_days(spark, seed):
    rows = some_spans(seed)
    got = sorted(map(tuple, S.merged(spark.createDataFrame(rows + rows[:3], "k int, s date, e date"), ["k"], "s", "e").collect()), key=str)
    assert got == sorted(((k, *r) for k, held in days(rows).items() for r in runs(held)), key=str)


def test_gap_joins_spans(spark):
    df = spark.createDataFrame([(1, day(0), day(4)), (1, day(8), day(9)), (1, day(14), None)], "k int, s date, e date")
    assert S.merged(df, ["k"], "s", "e", 4).collect() == [(1, day(0), day(9)), (1, day(14), None)]
    assert S.merged(df.where("false"), ["k"], "s", "e").count() == 0


def test_shared_spans_hold_the_days_of_both(spark):
    a, b = some_spans(7), some_spans(8)
    one, two = (S.merged(spark.createDataFrame(x, "k int, s date, e date"), ["k"], "s", "e") for x in (a, b))
    got = sorted(map(tuple, S.shared(one, two, ["k"], "s", "e").select("k", "s", "e").collect()), key=str)
    assert got == sorted(((k, *r) for k in days(a) for r in runs(days(a)[k] & days(b)[k])), key=str)


def test_history_has_a_span_for_each_run(spark):
    rows = [(1, "a", 0), (1, "a", 1), (1, None, 2), (1, "a", 3), (1, "b", 4), (1, "a", 5), (2, None, 0), (2, "c", 1)]
    got = {tuple(r) for r in S.history(spark.createDataFrame([(i, v, day(n)) for i, v, n in rows], "id int, v string, date date"), "id", "v", "date").collect()}
    assert got == {(1, "a", day(0), day(3)), (1, "b", day(4), day(4)), (1, "a", day(5), day(5)), (2, "c", day(1), day(1))}


def test_link_table(spark):
    stocks = spark.createDataFrame([(1, "AAAAAAAA1", day(0)), (1, "AAAAAAAA1", day(30)), (1, "BBBBBBBB2", day(60)), (2, "CCCCCCCC3", day(5)), (3, None, day(5))], "permno int, cusip string, date date")
    securities = spark.createDataFrame([("AAAAAAAA9", "g1", day(10), day(19)), ("AAAAAAAA5", "g1", day(20), None), ("BBBBBBBB0", "g2", None, None), ("CCCCCCCC1", "g3", day(6), day(9)), (None, "g4", day(0), None)], "cusip string, gvkey string, a date, b date")
    accounts = spark.createDataFrame([("AAAAAAAA7",), (None,)], "cusip string")
    plain = {tuple(r) for r in S.cusip_linktable(stocks, securities, accounts).collect()}
    assert plain == {("AAAAAAAA", "g1", 1, day(0), day(60), True), ("CCCCCCCC", "g3", 2, day(5), day(5), False)}
    timed = {tuple(r) for r in S.cusip_linktable(stocks, securities.where("a is not null"), by_history=True, span=("a", "b")).collect()}
    assert timed == {("AAAAAAAA", "g1", 1, day(10), day(30), False)}


def test_stocks_are_prepared_in_one_go(spark):
    stocks = spark.createDataFrame([(1, day(0), 10.0, 5.0, 0.1, 7, 11, 1), (1, day(31), -9.0, 5.0, None, 7, None, None), (2, day(31), 1.0, 1.0, 0.2, 7, None, 3)], "permno int, date date, prc double, vol double, ret double, permco int, shrcd int, exchcd int")
    events = spark.createDataFrame([(1, day(31), None, 560.0, None, None, None), (2, day(31), None, 560.0, None, 1232.0, 0.5)], "permno int, date date, dlret double, dlstcd double, exchcd int, distcd double, divamt double")
    links = spark.createDataFrame([("A", "g", 1, day(0), day(40), True)], "cusip string, gvkey string, permno int, linkdt date, linkenddt date, linkprim boolean")
    got = {(r.permno, r.date): r for r in S.prepared_stocks(stocks, events, links, method=2).collect()}
    # The event has no exchange code of its own; the stock's last known one counts.
    assert abs(got[1, day(31)].ret + 0.35) < 1e-12 and abs(got[2, day(31)].ret - (1.2 * 0.45 - 1)) < 1e-12
    assert got[1, day(31)].shrcd == 11 and got[1, day(31)].gvkey == "g" and got[2, day(31)].cash_div == 0.5
    assert got[1, day(0)].primary and got[1, day(31)].primary and not got[2, day(31)].gvkey


def test_codes_are_carried_by_id(spark):
    df = spark.createDataFrame([(1, day(0), 5), (1, day(1), None), (2, day(0), None), (2, day(1), 6)], "id int, date date, c int")
    assert [r.c for r in J.carried(df, "id", "date", ["c"]).orderBy("id", "date").collect()] == [5, 5, None, 6]
