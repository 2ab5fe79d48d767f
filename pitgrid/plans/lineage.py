"""Queries over symbols that changed, share counts that jump, and streams that go on."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.operators import asof, audit, identity
from pitgrid.operators.store import shared_folder
from pitgrid.plans import filings
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.prices import rounded
from pitgrid.streaming import feeds


def renames(spark, sf):
    """Old names of every fourth supplier, some with several renames in a row and some in a ring."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda letter: F.concat(F.lit(letter), F.col("k"))
    steps = [(4, "S", "R"), (8, "R", "N"), (16, "N", "M"), (32, "M", "L")]
    chains = [F.when(F.col("k") % m == 0, F.struct(name(a).alias("old"), name(b).alias("new"))) for m, a, b in steps]
    ring = [F.when(F.col("k") % 10 == 3, F.struct(name(a).alias("old"), name(b).alias("new"))) for a, b in (("S", "X"), ("X", "Y"), ("Y", "Z"), ("Z", "X"))]
    return s.select(F.explode(F.array_compact(F.array(*chains, *ring))).alias("r")).select("r.*")


def symbols(spark, sf):
    return identity.closed_renames(renames(spark, sf))


def members_renamed(spark, sf):
    """Members of each date under today's symbols, and how many names of the snapshot each stands for."""
    members = read(spark, sf, "members")
    # a snapshot may hold a name's old and new symbol
    both = members.unionByName(members.where("substring(ticker, 2) % 8 = 0").withColumn("ticker", F.concat(F.lit("R"), F.substring("ticker", 2, 12))))
    return asof.members_current(read(spark, sf, "as_of").select("as_of"), both, identity.closed_renames(renames(spark, sf)))


RENAMES = """s as (select s_suppkey as k from supplier),
rn as (select 'S' || k as old, 'R' || k as new from s where k % 4 = 0 union all select 'R' || k, 'N' || k from s where k % 8 = 0 union all select 'N' || k, 'M' || k from s where k % 16 = 0 union all select 'M' || k, 'L' || k from s where k % 32 = 0
  union all select 'S' || k, 'X' || k from s where k % 10 = 3 union all select 'X' || k, 'Y' || k from s where k % 10 = 3 union all select 'Y' || k, 'Z' || k from s where k % 10 = 3 union all select 'Z' || k, 'X' || k from s where k % 10 = 3),
walk as (with recursive w as (select old, old as here, [old] as seen from rn union all select w.old, rn.new, list_append(w.seen, rn.new) from w join rn on rn.old = w.here where len(list_distinct(w.seen)) = len(w.seen)) select * from w),
one as (select old, min(new) as new from rn group by 1),
closed as (select old, arg_max(here, len(seen)) as current from walk w where not exists (select 1 from one where one.old = w.here) or len(list_distinct(seen)) < len(seen) group by old)"""


def filed_counts(spark, sf):
    """Diluted share counts as filed: after the splits on record, and after one in five that nobody recorded for some names."""
    f = filings.facts(spark, sf).where("concept = 'shares_diluted'").select("ticker", "period_end", "filed", "val")
    done = f.join(read(spark, sf, "splits"), "ticker").where("date <= period_end").groupBy("ticker", "period_end", "filed", "val").agg(F.product("ratio").alias("_f"))
    f = f.join(done, ["ticker", "period_end", "filed", "val"], "left").withColumn("val", F.col("val") * F.coalesce("_f", F.lit(1.0)))
    hidden = (F.substring("ticker", 2, 12).cast("int") % 4 == 1) & (F.col("period_end") >= "1997-07-01")
    return f.withColumn("val", F.col("val") * F.when(hidden, F.lit(4.88)).otherwise(1.0))


def jumps(spark, sf):
    return rounded(audit.share_jumps(filed_counts(spark, sf), read(spark, sf, "splits")))


def sightings(spark, sf):
    """The kinds of events that each user has been seen with, once each, from the stream of events."""
    events = feeds.arriving(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return feeds.sightings(events, ["user_id", "event_type"], "ts", shared_folder(spark), "60 days").select("user_id", "event_type")


QUERIES = {
    "renames_closed": (symbols, "with " + RENAMES + " select * from closed"),
    "members_renamed": (members_renamed, ctes("members", "as_of") + ", " + RENAMES + """,
pair as (select index_symbol, ticker, as_of, source from members union all select index_symbol, 'R' || substring(ticker, 2), as_of, source from members where substring(ticker, 2)::int % 8 = 0),
snap as (select a.as_of, index_symbol, source, max(m.as_of) as snapshot from as_of a join members m on m.as_of <= a.as_of group by all)
select snap.as_of, snap.index_symbol, snap.source, snapshot, coalesce(current, ticker) as ticker, min(ticker) as named, count(*) as names from snap join pair b on b.index_symbol = snap.index_symbol and b.source = snap.source and b.as_of = snapshot left join closed on old = ticker group by all"""),
    "share_jumps": (jumps, filings.FACTS + f""",
c0 as (select f.ticker, period_end, filed, val * coalesce((select product(ratio) from splits s where s.ticker = f.ticker and s.date <= period_end), 1) * case when substring(f.ticker, 2)::int % 4 = 1 and period_end >= date '1997-07-01' then 4.88 else 1 end as val from facts f where concept = 'shares_diluted'),
c1 as (select ticker, period_end, arg_min(val, (filed, val)) as val from c0 where val > 0 group by all),
c2 as (select *, val / lag(val) over (partition by ticker order by period_end) as ratio from c1),
c3 as (select *, list_filter({[x for r in audit.DECLARED for x in (r, 1 / r)]}, lambda c: abs(ratio - c) <= 0.06 * c)[1] as declared from c2)
select ticker, period_end, round(val, 6) + 0.0 as val, round(ratio, 6) + 0.0 as ratio, round(declared, 6) + 0.0 as declared from c3 where declared is not null and not exists (select 1 from splits s where s.ticker = c3.ticker and abs(s.date - period_end) <= 200)"""),
    "stream_first_sightings": (sightings, "select distinct user_id, event_type from events"),
}
