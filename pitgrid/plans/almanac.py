"""Queries over the rule-made calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.operators import calendar as ca
from pitgrid.plans.fixtures import read

# A twin by other means: every day is looked at, and its place among the weekdays of its month tells the holiday.
SPECIAL = ", ".join(f"(date '{d}', '{n}')" for d, n in ca.SPECIAL.items())
KEPT = lambda m, d: f"((m = {m} and d = {d} and w <= 5) or (date + 1 = make_date(y, {m}, {d}) and w = 5) or (date - 1 = make_date(y, {m}, {d}) and w = 1))"
ALMANAC = f"""
ends as ({{ends}}),
raw as (select unnest(generate_series((select a from ends) - interval 15 day, (select z from ends) + interval 15 day, interval 1 day))::date as date),
parts as (select date, year(date) as y, month(date) as m, day(date) as d, isodow(date) as w, (day(date) - 1) // 7 + 1 as n, month(date + 7) <> month(date) as last_one from raw),
e1 as (select distinct y, y % 19 as a, y // 100 as b, y % 100 as c from parts),
e2 as (select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h from e1),
e3 as (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as l from e2),
e4 as (select *, (a + 11 * h + 22 * l) // 451 as k from e3),
paschal as (select y, make_date(y, (h + l - 7 * k + 114) // 31, (h + l - 7 * k + 114) % 31 + 1) as easter from e4),
special(closed, name) as (values {SPECIAL}),
reasons as (select p.*, case when w >= 6 then 'Weekend' when s.name is not null then s.name
  when (m = 1 and d = 1) or (m = 1 and d = 2 and w = 1) then 'New Year''s Day' when y >= 1998 and m = 1 and w = 1 and n = 3 then 'Martin Luther King Jr. Day'
  when m = 2 and w = 1 and n = 3 then 'Washington''s Birthday' when date = easter - 2 then 'Good Friday' when m = 5 and w = 1 and last_one then 'Memorial Day'
  when y >= 2022 and {KEPT(6, 19)} then 'Juneteenth' when {KEPT(7, 4)} then 'Independence Day' when m = 9 and w = 1 and n = 1 then 'Labor Day'
  when m = 11 and w = 4 and n = 4 then 'Thanksgiving Day' when {KEPT(12, 25)} then 'Christmas Day' end as reason
  from parts p join paschal using (y) left join special s on closed = date),
opened as (select *, reason is null as is_open, coalesce(reason is null and (((m = 7 and d = 3) or (m = 12 and d = 24)) and w <= 4 or (m = 11 and w = 5 and d between 23 and 29)), false) as early_close from reasons),
almanac as (select date, is_open, reason, early_close, case when is_open then sum(is_open::int) filter (where date >= (select a from ends)) over (order by date) end::int as session,
  last_value(case when is_open then date end ignore nulls) over (order by date rows between unbounded preceding and 1 preceding) as previous,
  first_value(case when is_open then date end ignore nulls) over (order by date rows between 1 following and unbounded following) as next,
  case when is_open then timezone('America/New_York', date + case when early_close then interval 13 hour else interval 16 hour end)::timestamp end as closes_at,
  case when is_open then timezone('America/New_York', date + case when early_close then interval 825 minute else interval 1005 minute end)::timestamp end as final_at,
  date_trunc('week', date)::date as week, date_trunc('month', date)::date as month, date_trunc('quarter', date)::date as quarter from opened)"""


def over(spark, table: str, sf: str, column: str, before: int = 0):
    """The days that a table covers, and so many before: a UTC time may belong to the day before in New York."""
    first, last = read(spark, sf, table).agg(F.date_sub(F.min(F.col(column).cast("date")), before), F.max(F.col(column).cast("date"))).first()
    return ca.days(spark, str(first), str(last))


def sql(table: str, column: str) -> str:
    return "with " + ALMANAC.replace("{ends}", f"select min({column})::date as a, max({column})::date as z from {table}")


def market_days(spark, sf):
    """Every day that orders cover, with its session or why there is none."""
    df = over(spark, "orders", sf, "o_orderdate")
    return df.withColumns({c: F.col(c).cast("string") for c in ("closes_at", "final_at")})


def completed_sessions(spark, sf):
    """The newest final session at the time of each event, counted by hour."""
    df = ca.completed(read(spark, sf, "events").select("ts"), over(spark, "events", sf, "ts", 1), "ts")
    return df.groupBy(F.date_trunc("hour", "ts").cast("string").alias("hour"), "completed").agg(F.count(F.lit(1)).alias("n"))


def shipments(spark, sf):
    """Daily bars of suppliers, with the time of the last trade that each supplier's payload reflects."""
    df = read(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("date")).agg(F.max("l_extendedprice").alias("high"), F.sum("l_quantity").alias("volume"))
    from pyspark.sql import Window

    last = F.max("date").over(Window.partitionBy("l_suppkey")).cast("timestamp")
    return df.withColumn("traded_at", F.timestamp_add("MINUTE", (F.col("l_suppkey") % 29 * 60).cast("int"), last))


def live_bars_dropped(spark, sf):
    """Finished bars of each supplier by two rules: no live last bar, and none after the last final session."""
    calendar = over(spark, "lineitem", sf, "l_shipdate")
    now = str(read(spark, sf, "lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).first()[0]) + " 20:50:00"
    df = ca.finished(ca.without_live_bar(shipments(spark, sf), calendar, ["l_suppkey"], "traded_at"), calendar, now)
    return df.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("bars"), F.max("date").alias("newest"), F.sum("volume").alias("volume"))


QUERIES = {
    "market_days": (market_days, sql("orders", "o_orderdate") + " select * replace (strftime(closes_at, '%Y-%m-%d %H:%M:%S') as closes_at, strftime(final_at, '%Y-%m-%d %H:%M:%S') as final_at) from almanac where date between (select a from ends) and (select z from ends)"),
    "final_sessions": (completed_sessions, sql("events", "ts") + """, v as (select ts, (select max(date) from almanac where final_at <= ts) as completed from events)
select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, completed, count(*) as n from v group by all"""),
    "live_bars_dropped": (live_bars_dropped, sql("lineitem", "l_shipdate") + """, b as (select l_suppkey, l_shipdate::date as date, sum(l_quantity) as volume, max(l_shipdate::date) over (partition by l_suppkey) as last from lineitem group by 1, 2, l_shipdate),
j as (select b.*, closes_at from b left join almanac using (date)),
k as (select * from j where not coalesce(date = last and last + to_minutes((l_suppkey % 29 * 60)::int) < closes_at - interval 1 minute, false))
select l_suppkey, count(*) as bars, max(date) as newest, sum(volume) as volume from k where date <= (select max(date) from almanac where final_at <= (select z from ends) + interval 1250 minute) group by 1"""),
}
