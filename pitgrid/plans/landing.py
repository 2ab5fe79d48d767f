"""Queries over payloads as they land, made of the given tables, and over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.functions.scalars import once
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.prices import rounded
from pitgrid.sources import frames, landed, ownership
from pitgrid.streaming import feeds


def facts(spark, sf):
    """Quarterly sums as nested company payloads, flattened again."""
    q = read(spark, sf, "quarters")
    end = F.date_sub(F.add_months("period_start", 3), 1)
    fact = F.struct(F.col("period_start").cast("string").alias("start"), end.cast("string").alias("end"), F.col("revenue").alias("val"), F.date_add(end, 35).cast("string").alias("filed"), F.lit("10-Q").alias("form"))
    per = q.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("ticker")).agg(F.collect_list(fact).alias("f"))
    tree = F.struct(F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), F.struct(F.create_map(F.lit("USD"), F.col("f")).alias("units")), F.lit("Unmodelled"), F.struct(F.create_map(F.lit("USD"), F.col("f")).alias("units")))).alias("facts"))
    payloads = per.select("ticker", F.to_json(tree).alias("payload"))
    return rounded(landed.company_facts(payloads, spark.createDataFrame([("Revenues", "revenue")], "tag string, concept string")))


def bars(spark, sf):
    """Bars as parallel arrays, one of them twice and one without a close."""
    b = read(spark, sf, "bars")
    one = F.struct("date", F.unix_timestamp(F.col("date").cast("timestamp")).alias("timestamp"), "open", "high", "low", F.when(F.dayofmonth("date") != 13, F.col("close")).alias("close"), "volume")
    per = b.groupBy("ticker").agg(F.array_sort(F.collect_list(one)).alias("r")).withColumn("r", F.concat("r", F.slice("r", 1, 1)))
    arrays = [F.col(f"r.{n}").alias(n) for n in ("timestamp", "open", "high", "low", "close", "volume")]
    return rounded(landed.chart_bars(per.select("ticker", F.to_json(F.struct(*arrays)).alias("payload"))))


def events(spark, sf):
    """Filing indexes with item lists; amendments and unknown items go."""
    e = read(spark, sf, "corporate_events")
    form = F.when(F.col("accession") % 11 == 0, "8-K/A").when(F.col("accession") % 13 == 0, "4").otherwise("8-K")
    row = F.struct(F.col("accession").cast("string").alias("accession"), form.alias("form"), F.col("filed").cast("string").alias("filed"), F.concat("item_code", F.lit(", 9.01,"), "item_code").alias("items"))
    per = e.groupBy("ticker").agg(F.collect_list(row).alias("r"))
    arrays = [F.col(f"r.{n}").alias(n) for n in ("accession", "form", "filed", "items")]
    index = landed.filing_index(per.select("ticker", F.to_json(F.struct(*arrays)).alias("payload")), ["8-K", "10-Q"])
    return landed.event_items(index)


def series(spark, sf):
    m = read(spark, sf, "macro")
    line = F.concat_ws(",", F.col("date").cast("string"), F.when(F.dayofmonth("date") % 5 != 0, F.round("value", 3).cast("string")).otherwise("."))
    per = m.groupBy("series_id").agg(F.concat(F.lit("DATE,VALUE\n"), F.array_join(F.collect_list(line), "\n")).alias("payload"))
    return landed.series_csv(per)


def calendar(spark, sf):
    s = read(spark, sf, "supplier")
    eps = F.when(F.col("s_acctbal") < 0, F.concat(F.lit("($"), F.abs(F.round("s_acctbal", 2)).cast("string"), F.lit(")"))).when(F.col("s_suppkey") % 5 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.round("s_acctbal", 2).cast("string")))
    row = F.struct(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.lit("2001-07-02").alias("date"), F.when(F.col("s_suppkey") % 3 == 0, "time-pre-market").when(F.col("s_suppkey") % 3 == 1, "time-after-hours").otherwise("").alias("time"), eps.alias("eps"))
    return landed.earnings_calendar(s.groupBy((F.col("s_suppkey") % 8).alias("page")).agg(F.to_json(F.collect_list(row)).alias("payload")))


def views(spark, sf):
    a = read(spark, sf, "attention").groupBy("ticker", F.to_date("date").alias("day")).agg(F.sum("wiki_views").alias("v"))
    item = F.struct(F.concat(F.date_format("day", "yyyyMMdd"), F.lit("00")).alias("timestamp"), F.col("v").alias("views"))
    return landed.page_views(a.groupBy("ticker").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("payload")))


def holding_reports(spark, sf):
    """Holdings reports of members, a hundred lines or so in a file; a twentieth of the files is cut off."""
    sec = read(spark, sf, "securities")
    m = read(spark, sf, "members").where("source = 'a'").join(sec.select("ticker", "name"), "ticker").withColumn("no", F.substring("ticker", 2, 12).cast("int"))
    name = F.when(F.col("no") % 11 == 4, F.concat(F.lit("Unheard "), "name")).otherwise(F.col("name"))
    line = F.concat(F.lit("<invstOrSec><name>"), name, F.lit(", Inc. /DE/</name><assetCat>"), F.when(F.length("ticker") % 2 == 0, "EC").otherwise("DBT"), F.lit("</assetCat><pctVal>"), F.round(F.col("no") / 100, 2).cast("string"), F.lit("</pctVal></invstOrSec>"))
    per = m.groupBy("index_symbol", "as_of", (F.col("no") % 20).alias("part"), F.floor(F.col("no") / 2000).alias("more")).agg(F.array_join(F.collect_list(line), "").alias("lines"))
    whole = F.concat(F.lit('<edgarSubmission xmlns="urn:nport"><seriesName>All</seriesName>'), "lines", F.lit("</edgarSubmission>"))
    return per.select("index_symbol", "as_of", F.when(F.col("part") == 7, F.substring(whole, 1, 60)).otherwise(whole).alias("payload")), sec


def holdings(spark, sf):
    from pitgrid.functions.scalars import company_key

    reports, sec = holding_reports(spark, sf)
    return rounded(landed.fund_holdings(reports, sec, company_key(F.col("name")))[0])


def holdings_rejected(spark, sf):
    from pitgrid.functions.scalars import company_key

    reports, sec = holding_reports(spark, sf)
    return landed.fund_holdings(reports, sec, company_key(F.col("name")))[1].groupBy("index_symbol", "as_of", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


def lot_files(spark, sf):
    """Position files of two hundred lots or so; some lines have no number of shares, some no ticker, one file in nine no such column."""
    p = read(spark, sf, "positions")
    ticker = F.when(F.col("lot_id") % 31 == 0, "?? no").otherwise(F.lower("ticker"))
    shares = F.when(F.col("lot_id") % 17 == 0, "n/a").otherwise(F.round("shares", 2).cast("string"))
    line = F.concat_ws(",", ticker, shares, F.col("cost_basis").cast("string"))
    head = F.when(F.col("file") % 9 == 2, "Symbol, Amount ,Avg Cost\n").otherwise("Symbol, Quantity ,Avg Cost\n")
    per = p.groupBy(F.floor(F.col("lot_id") / 200).alias("file")).agg(F.array_sort(F.collect_list(F.struct("lot_id", line.alias("l")))).alias("x"))
    return per.select("file", F.concat(head, F.array_join("x.l", "\n")).alias("payload")), {"symbol": "ticker", "quantity": "shares", "avg cost": "cost_basis"}


def lots(spark, sf):
    return landed.positions_csv(*lot_files(spark, sf))[0]


def lots_rejected(spark, sf):
    return landed.positions_csv(*lot_files(spark, sf))[1]


def bars_quarantined(spark, sf):
    """Bars with faults put in by date and volume: the sound ones counted, the others with their reason."""
    b = read(spark, sf, "bars")
    odd = b.withColumns({
        "close": F.when(F.dayofyear("date") % 37 == 0, F.col("high") * 1.01).when(F.dayofyear("date") % 41 == 0, None).otherwise(F.col("close")),
        "volume": F.when(F.dayofyear("date") % 43 == 0, -F.col("volume")).otherwise(F.col("volume")),
    })
    good, bad = landed.sound_bars(odd)
    return bad.select("ticker", "date", "reason").unionByName(good.groupBy("ticker").agg(F.max("date").alias("date"), F.concat(F.lit("sound: "), F.count(F.lit(1)).cast("string")).alias("reason")))


LOTS = ctes("positions") + """, f as (select *, lot_id // 200 as file, row_number() over (partition by lot_id // 200 order by lot_id) as line from positions)"""
QUARANTINE = ctes("bars") + """, o as (select ticker, date, high, low, case when dayofyear(date) % 37 = 0 then high * 1.01 when dayofyear(date) % 41 = 0 then null else close end as close, case when dayofyear(date) % 43 = 0 then -volume else volume end as volume from bars),
j as (select *, case when close is null or close <= 0 then 'no close' when volume < 0 then 'negative volume' when high < low then 'high under low' when close > high * 1.001 or close < low * 0.999 then 'close outside range' end as reason from o)
select ticker, date, reason from j where reason is not null union all select ticker, max(date), 'sound: ' || count(*) from j where reason is null group by 1"""
HELD = ctes("members", "securities") + """, m as (select index_symbol, as_of, ticker, substring(ticker, 2)::int as no, s.name from members join securities s using (ticker) where source = 'a')"""


def splits(spark, sf):
    """Split events of chart payloads; a ratio without a denominator goes."""
    s = read(spark, sf, "splits")
    one = F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("date"), (F.col("ratio") * 2).alias("numerator"), F.when(F.substring("ticker", 2, 12).cast("int") % 21 == 0, 0.0).otherwise(2.0).alias("denominator"))
    per = s.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), one))).alias("splits"))
    return landed.chart_splits(per.select("ticker", F.to_json(F.struct("splits")).alias("payload")))


def plain(x):
    """A number in two digits after the point, as text."""
    x = F.col(x) if isinstance(x, str) else x
    return x.cast("decimal(20,2)").cast("string")


def documents(spark, sf):
    """An ownership document for each order and supplier: its lines are transactions, of which the seventh are derivative; some documents are broken, empty or of another issuer."""
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    note = F.when(F.col("o_orderpriority") == "5-LOW", '<footnoteId id="F1"/>').when(F.col("o_orderpriority") == "1-URGENT", '<footnoteId id="F2"/>').otherwise("")
    code = F.when(F.col("l_linenumber") == 6, "").when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("M")
    value = lambda tag, v, more="": F.concat(F.lit(f"<{tag}><value>"), v, F.lit("</value>"), F.lit(more) if isinstance(more, str) else more, F.lit(f"</{tag}>"))
    body = F.concat(
        value("transactionDate", F.col("o_orderdate").cast("date").cast("string")), F.lit("<transactionCoding><transactionCode>"), code, F.lit("</transactionCode></transactionCoding><transactionAmounts>"),
        value("transactionShares", plain("l_quantity"), note), value("transactionPricePerShare", plain("l_extendedprice")), value("transactionAcquiredDisposedCode", F.when(F.col("l_returnflag") == "R", "D").otherwise("A")),
        F.lit("</transactionAmounts><postTransactionAmounts>"), value("sharesOwnedFollowingTransaction", plain(F.col("l_quantity") * F.col("l_linenumber"))), F.lit("</postTransactionAmounts>"),
    )
    one = F.struct("l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("d"), "l_quantity", "l_extendedprice", body.alias("body"))
    per = lines.groupBy("l_orderkey", "l_suppkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    tagged = lambda tag, last: F.concat(F.lit(f"<{tag}Table>"), F.array_join(F.transform(F.filter("x", lambda t: (t["l_linenumber"] == 7) == last), lambda t: F.concat(F.lit(f"<{tag}Transaction>"), t["body"], F.lit(f"</{tag}Transaction>"))), ""), F.lit(f"</{tag}Table>"))
    key = F.col("l_orderkey")
    whole = F.concat(
        F.lit('<?xml version="1.0"?><ownershipDocument xmlns="urn:own"><issuer><issuerCik>'), F.lpad(F.when(key % 89 == 0, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey")).cast("string"), 10, "0"), F.lit("</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerName>P"),
        (F.col("o_custkey") % 50).cast("string"), F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>"), F.when(F.col("o_custkey") % 2 == 0, "1").otherwise("false"), F.lit("</isDirector><isOfficer>"), F.when(F.col("o_custkey") % 3 == 0, "true").otherwise("0"),
        F.lit("</isOfficer><officerTitle>"), F.when(F.col("o_custkey") % 3 == 0, "CFO").otherwise(""), F.lit("</officerTitle></reportingOwnerRelationship></reportingOwner><aff10b5One>"), F.when(key % 23 == 0, "true").otherwise("0"), F.lit("</aff10b5One>"),
        tagged("nonDerivative", False), tagged("derivative", True), F.lit('<footnotes><footnote id="F1">Sold under a Rule 10b5-1 plan &amp; earlier.</footnote><footnote id="F2">Shares sold to cover tax.</footnote></footnotes><remarks>none</remarks></ownershipDocument>'),
    )
    payload = F.when(key % 97 == 0, F.substring(whole, 1, 120)).when(key % 83 == 0, "").otherwise(whole)
    return per.select(F.concat_ws("-", "l_orderkey", "l_suppkey", "o_custkey", F.col("day").cast("string")).alias("accession"), F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.col("l_suppkey").cast("string").alias("cik"), F.date_add("day", 2).alias("filed"), once(payload=payload))


def owned(spark, sf):
    parsed = ownership.documents(documents(spark, sf))
    # a price is an amount over a number of shares, so it may end in a five at few digits
    return rounded(ownership.trades(ownership.transactions(parsed)).drop("cik"), 9)


def owned_rejected(spark, sf):
    parsed = ownership.documents(documents(spark, sf))
    return ownership.rejects(parsed, ownership.transactions(parsed))


OWNED = """with own as (select concat_ws('-', l_orderkey, l_suppkey, o_custkey, o_orderdate::date) as accession, 'S' || l_suppkey as ticker, l_suppkey, l_orderkey, o_custkey, o_orderdate::date as day, o_orderpriority as prio,
  l_linenumber as place, row(l_linenumber, l_partkey, l_shipdate::date, l_quantity, l_extendedprice) as ord, l_linenumber = 7 as deriv, case when l_linenumber = 6 then '' when l_returnflag = 'A' then 'P' when l_returnflag = 'R' then 'S' else 'M' end as code,
  case when l_returnflag = 'R' then 'D' else 'A' end as dir, case when l_returnflag = 'R' then -round(l_quantity, 2) else round(l_quantity, 2) end as shares, round(l_extendedprice, 2) as price, round(l_quantity * l_linenumber, 2) as post from lineitem join orders on l_orderkey = o_orderkey),
why as (select *, case when l_orderkey % 97 = 0 then 'not XML' when l_orderkey % 83 = 0 then 'empty' when l_orderkey % 89 = 0 then 'another issuer' end as reason from own)"""


def frame_files(spark, sf):
    q = read(spark, sf, "quarters").where("l_suppkey % 10 <> 3 or period_start < '2000-01-01'")
    name = F.concat(F.lit("CY"), F.year("period_start"), F.lit("Q"), F.quarter("period_start"), F.lit("I"))
    end = F.date_sub(F.add_months("period_start", 3), 1)
    entry = F.struct(F.concat_ws("-", F.lit("A"), "l_suppkey", name).alias("accn"), F.when(F.col("l_suppkey") % 17 != 0, F.col("l_suppkey")).alias("cik"), end.cast("string").alias("end"), F.when(F.col("l_suppkey") % 13 == 0, 0.0).otherwise(100.0 * (1 + F.col("l_suppkey") % 5) + F.year("period_start")).alias("val"))
    files = q.groupBy(name.alias("frame"), F.floor(F.col("l_suppkey") / 1000).alias("part")).agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("payload"))
    filings = q.where("l_suppkey % 6 <> 0").select(F.concat_ws("-", F.lit("A"), "l_suppkey", name).alias("accession"), F.date_add(end, 35).alias("filed"))
    names = read(spark, sf, "supplier").where("s_suppkey % 8 <> 5").select(F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), F.concat(F.lit("S"), "s_suppkey").alias("ticker"))
    return frames.counts(files), filings, names


def framed(spark, sf):
    return frames.share_facts(*frame_files(spark, sf))[0]


def framed_rejected(spark, sf):
    return frames.share_facts(*frame_files(spark, sf))[1].groupBy("frame", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("cik").alias("first"))


FRAMED = ctes("quarters") + """, e as (select l_suppkey as k, lpad(l_suppkey::varchar, 10, '0') as cik, 'CY' || year(period_start) || 'Q' || quarter(period_start) || 'I' as frame, cast(period_start + interval 3 month as date) - 1 as end_, case when l_suppkey % 13 = 0 then 0 else 100.0 * (1 + l_suppkey % 5) + year(period_start) end as val
  from quarters where l_suppkey % 10 <> 3 or period_start < date '2000-01-01'),
n as (select * from e where k % 17 <> 0 and k % 13 <> 0 qualify row_number() over (partition by k order by end_ desc) = 1)"""


def event_stream(spark, sf):
    return rounded(feeds.run_now(feeds.hourly(feeds.arriving(spark, sf, "events.parquet")), ["hour", "event_type"]))


QUERIES = {
    "landed_facts": (facts, ctes("quarters") + " select concat('S', l_suppkey) as ticker, 'revenue' as concept, 'Revenues' as tag, 'USD' as unit, period_start, cast(period_start + interval 3 month as date) - 1 as period_end, cast(period_start + interval 3 month as date) + 34 as filed, '10-Q' as form, round(revenue, 6) + 0.0 as val from quarters"),
    "landed_bars": (bars, ctes("bars") + " select ticker, date, round(open, 6) + 0.0 as open, round(high, 6) + 0.0 as high, round(low, 6) + 0.0 as low, round(close, 6) + 0.0 as close, round(volume, 6) + 0.0 as volume from bars where day(date) <> 13"),
    "landed_events": (events, ctes("corporate_events") + " select ticker, filed, accession::varchar as accession, item_code, category, case item_code " + " ".join(f"when '{k}' then '{w}'" for k, (_, w) in landed.ITEMS.items()) + " end as subtype from corporate_events where accession % 11 <> 0 and accession % 13 <> 0"),
    "landed_series": (series, ctes("macro") + " select series_id, date, round(value, 3) as value from macro where day(date) % 5 <> 0"),
    "landed_calendar": (calendar, "select concat('S', s_suppkey) as ticker, date '2001-07-02' as report_date, case s_suppkey % 3 when 0 then 'before' when 1 then 'after' else 'unknown' end as session, case when s_acctbal < 0 or s_suppkey % 5 <> 0 then round(s_acctbal, 2) end as eps_estimate from supplier"),
    "landed_views": (views, ctes("attention") + " select ticker, date::date as date, sum(wiki_views) as wiki_views from attention group by all"),
    "landed_holdings": (holdings, HELD + " select index_symbol, as_of, round(no / 100, 2) + 0.0 as weight, ticker from m where no % 20 <> 7 and length(ticker) % 2 = 0 and no % 11 <> 4"),
    "landed_holdings_rejected": (holdings_rejected, HELD + """ select index_symbol, as_of, 'no such name' as reason, count(*) as n, min('Unheard ' || name || ', Inc. /DE/') as first from m where no % 20 <> 7 and length(ticker) % 2 = 0 and no % 11 = 4 group by all
union all select index_symbol, as_of, 'not XML', count(distinct no // 2000), null from m where no % 20 = 7 group by all"""),
    "landed_positions": (lots, LOTS + " select ticker, round(shares, 2) as shares, cost_basis from f where file % 9 <> 2 and lot_id % 31 <> 0 and lot_id % 17 <> 0"),
    "landed_positions_rejected": (lots_rejected, LOTS + " select distinct file, null::int as line, 'no column shares' as reason from f where file % 9 = 2 union all select file, line::int, case when lot_id % 31 = 0 then 'no ticker' else 'no shares' end from f where file % 9 <> 2 and (lot_id % 31 = 0 or lot_id % 17 = 0)"),
    "bars_quarantined": (bars_quarantined, QUARANTINE),
    "landed_splits": (splits, ctes("splits") + " select * from splits where substring(ticker, 2)::int % 21 <> 0"),
    "landed_ownership": (owned, OWNED + """, l as (select *, max((code = 'M')::int) over (partition by accession) as m from why where reason is null and not deriv and code <> '')
select accession, ticker, day + 2 as filed, 'P' || (o_custkey % 50) as insider, nullif(concat_ws(', ', case when o_custkey % 2 = 0 then 'Director' end, case when o_custkey % 3 = 0 then 'Officer' end, case when o_custkey % 3 = 0 then 'CFO' end), '') as role,
  day as txn_date, code as txn_code, dir as direction, round(sum(shares), 9) + 0.0 as shares, round(sum(abs(shares) * price), 9) + 0.0 as value, round(arg_max(post, ord), 9) + 0.0 as post_txn_shares, round(sum(abs(shares) * price) / abs(sum(shares)), 9) + 0.0 as price,
  nullif(concat_ws(',', case when bool_or(prio = '5-LOW' or l_orderkey % 23 = 0) then '10b5-1' end, case when code = 'S' and max(m) = 1 then 'exercise' end, case when bool_or(prio = '1-URGENT') then 'plan' end), '') as flags, count(*) as lots from l group by accession, ticker, day, o_custkey, code, dir"""),
    "landed_ownership_rejected": (owned_rejected, OWNED + """ select distinct accession, null::varchar as kind, null::int as place, reason from why where reason is not null union all
select accession, kind, place, 'no code' from (select accession, code, case when deriv then 'derivative' else 'non-derivative' end as kind, (row_number() over (partition by accession, deriv order by ord) - 1)::int as place from why where reason is null) where code = ''"""),
    "landed_share_frames": (framed, FRAMED + " select 'S' || k as ticker, 'shares_outstanding' as concept, 'EntityCommonStockSharesOutstanding' as tag, end_ as period_start, end_ as period_end, end_ + 35 as filed, 'FRAME' as form, val::double as val from n where k % 8 <> 5 and k % 6 <> 0"),
    "landed_share_frames_rejected": (framed_rejected, FRAMED + """ select frame, reason, count(*) as n, min(c) as first from (select frame, case when k % 17 <> 0 then cik end as c, case when k % 17 = 0 then 'no filer' when k % 13 = 0 then 'no count' end as reason from e
  union all select frame, cik, case when k % 8 = 5 then 'unknown filer' when k % 6 = 0 then 'filing not indexed' end from n) where reason is not null group by all"""),
    "stream_event_counts": (event_stream, "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 6) + 0.0 as total from events group by all"),
}
