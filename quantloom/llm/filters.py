"""Filter interaction audit: what each filter of a chain removes, in every order of the filters, by inclusion and exclusion.

Rows become counts by part and set of failed filters. From these come the joint failures J(S), the documents that fail all filters
of S, for every set S, as sums of products of flags. All else is a fixed linear form of J: the survivors of a set of filters and a
filter's unique failures by Moebius inversion, and its Shapley value from the game's Harsanyi dividends, (-1)^(|T|+1) J(T) of each
set T, which are shared evenly by the filters of T. No order is ever run over the documents.

Defined results: a null text is empty, and an empty text has no words and fails A only (and E, if it is a copy). A null source is
part '', together with empty sources. Rows alike in doc_id count each; none of them is a copy of the other. A row without a doc_id is
no copy and has no label, and others are no copies of it. Of several labels of a doc_id any counts. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, documents, materialise

FILTERS = "ABCDE"


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and a boolean for each filter: A under 200 words, B under half of them distinct, C over 2 % capitals, D marks, E a copy."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("t"), F.array_remove(F.split(text, WHITE), "").alias("w"))
    n, chars = F.size("w"), F.char_length("t")
    capitals = chars - F.char_length(F.regexp_replace("t", "[A-Z]", ""))
    flags = {"A": n < 200, "B": 100 * F.size(F.array_distinct("w")).cast("long") < 50 * n.cast("long"), "C": 100 * capitals.cast("long") > 2 * chars.cast("long"), "D": F.col("t").rlike(r"[#$%&*|]")}
    rows = materialise(rows.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("k"), *(v.alias(c) for c, v in flags.items())))
    # The first of each text that repeats; a row for each text leaves a task, however many copies it has. As a table of its own, so
    # that both sides of the join are dealt by plain shuffles: only such a join has its large partitions split.
    first = materialise(rows.groupBy("k").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(first, "k", "left").select("doc_id", "part", *flags, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with booleans good and toxic; rows without a doc_id have no label, and don't take part in the join."""
    marks = labels.groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    joined = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    none = rows.where("doc_id is null").withColumns({"good": F.lit(None).cast("boolean"), "toxic": F.lit(None).cast("boolean")})
    return joined.unionByName(none).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def audit(rows: DataFrame, filters: str = FILTERS, part: str = "part", lost: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """part, filter_order, step, kept, removed, redundant, unique_fails, shapley and the columns of `lost`, of every order.

    rows: part and a boolean for each filter, a letter each; lost: name -> boolean column whose rows are counted among the removed.
    """
    k = len(filters)
    sets = range(1 << k)
    weights = {"n": F.lit(1), **{c: F.col(x).cast("int") for c, x in lost.items()}}
    counts = rows.groupBy(part, *filters).agg(*(F.sum(w).alias(f"_{c}") for c, w in weights.items())).withColumns({x: F.col(x).cast("long") for x in filters})
    flags = {s: [f"`{filters[i]}`" for i in range(k) if s >> i & 1] for s in sets}
    table = counts.groupBy(part).agg(*(F.expr(f"sum({' * '.join([f'`_{c}`', *flags[s]])}) as `_{c}{s}`") for c in weights for s in sets))

    def form(c: str, coefficients: dict[int, int]) -> str:
        return " + ".join(f"{x}L * `_{c}{s}`" for s, x in coefficients.items())

    def arrayed(c: str, forms: Iterable[str]) -> Column:
        return F.expr(f"array({', '.join(forms)}) as `{c}`")

    sign = {s: -1 if s.bit_count() % 2 else 1 for s in sets}
    having = [[t for t in sets if t >> i & 1] for i in range(k)]
    arrays = [arrayed(f"_s_{c}", (form(c, {t: sign[t] for t in sets if t & s == t}) for s in sets)) for c in weights]
    arrays.append(arrayed("_fails", (f"`_n{1 << i}`" for i in range(k))))
    arrays.append(arrayed("_only", (form("n", {t: -sign[t] for t in ts}) for ts in having)))
    arrays.append(arrayed("_shapley", (form("n", {t: -sign[t] * (factorial(k) // t.bit_count()) for t in ts}) for ts in having)))
    steps = []
    for order in permutations(range(k)):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append(f"('{name}', {step}, {before}, {before | 1 << i}, {i})")
            before |= 1 << i
    out = table.select(part, *arrays).select("*", F.expr(f"inline(array({', '.join(steps)})) as (filter_order, step, _b, _a, _i)"))
    gone = lambda c: F.get(f"_s_{c}", F.col("_b")) - F.get(f"_s_{c}", F.col("_a"))
    of = lambda c: F.get(c, F.col("_i"))
    return out.select(
        part, "filter_order", "step", F.get("_s_n", F.col("_a")).alias("kept"), gone("n").alias("removed"), (of("_fails") - gone("n")).alias("redundant"), of("_only").alias("unique_fails"), *(gone(c).alias(c) for c in lost), of("_shapley").alias("shapley")
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    rows = failures(documents(spark, sf_dir).select("doc_id", "source", "text"))
    rows = labelled(rows, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))
    return audit(rows, lost={"good_lost": "good", "toxic_lost": "toxic"})


_HIT = ", ".join(f"case filter_order[{i}] when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end" for i in range(1, 6))
#: Every order is run over the counts by part and failed filters, step by step.
OP13_SQL = (
    r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
x as (select doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as lo from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
m as (
  select part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as d, coalesce(doc_id > lo, false) as e, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from x left join l using (doc_id) group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (
  select f1.f || f2.f || f3.f || f4.f || f5.f as filter_order from f f1 join f f2 on f2.f <> f1.f join f f3 on f3.f not in (f1.f, f2.f)
  join f f4 on f4.f not in (f1.f, f2.f, f3.f) join f f5 on f5.f not in (f1.f, f2.f, f3.f, f4.f)),
r as (
  select part, filter_order, n, good, toxic, a::int + b::int + c::int + d::int + e::int as failed,
    [HIT] as hit
  from m cross join o),
p as (select *, coalesce(nullif(list_position(hit, true), 0), 6) as out from r),
s as (select p.*, step, filter_order[step] as filter, hit[step] as fails from p cross join (select unnest(range(1, 6)) as step)),
v as (select part, filter_order[out] as filter, sum(n) as shapley from p where out < 6 group by all)
select part, filter_order, cast(step as int) as step, cast(sum(case when out > step then n else 0 end) as bigint) as kept, cast(sum(case when out = step then n else 0 end) as bigint) as removed,
  cast(sum(case when fails and out < step then n else 0 end) as bigint) as redundant, cast(sum(case when fails and failed = 1 then n else 0 end) as bigint) as unique_fails,
  cast(sum(case when out = step then good else 0 end) as bigint) as good_lost, cast(sum(case when out = step then toxic else 0 end) as bigint) as toxic_lost,
  cast(coalesce(any_value(shapley), 0) as bigint) as shapley
from s left join v using (part, filter) group by part, filter_order, step
""".replace("HIT", _HIT)
)
