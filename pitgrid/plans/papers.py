"""Queries over policy documents, news feeds, the security master, the ingest log and what to read first."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitgrid.operators import queue, store
from pitgrid.operators import text as tx
from pitgrid.plans import press
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.prices import rounded
from pitgrid.sources import papers

SLUGS = tuple(tx.AGENCY_SECTORS)


def register(spark, sf):
    """Documents as register pages of a hundred: titles are their first lines, abstracts their whole texts, agencies follow the source."""
    d = read(spark, sf, "documents").withColumn("no", F.regexp_extract("source", "([0-9]+)$", 1).cast("int"))
    slugs = F.array(*map(F.lit, SLUGS))
    agency = lambda k: F.struct(F.initcap(F.regexp_replace(F.get(slugs, k), "-", " ")).alias("name"), F.get(slugs, k).alias("slug"))
    one = F.struct(
        F.when(F.col("doc_id") % 53 != 0, F.concat(F.lit("D"), "doc_id")).alias("document_number"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"),
        F.when(F.col("doc_id") % 3 == 0, "Rule").when(F.col("doc_id") % 3 == 1, "Proposed Rule").otherwise("Correction").alias("type"),
        F.when(F.col("doc_id") % 47 == 0, "soon").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).cast("string")).alias("publication_date"),
        F.lit("https://register.example/").alias("html_url"), F.array(agency(F.col("no") % 27), agency((F.col("no") + 9) % 27)).alias("agencies"),
    )
    pages = d.groupBy(F.floor(F.col("doc_id") / 100).alias("page")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("o"))))["o"].alias("results"))).alias("payload"))
    return papers.policies(pages)


def policy(spark, sf):
    rows, _ = register(spark, sf)
    return rows.select("doc_id", "published", "doc_type", "agencies", F.char_length("title").alias("title_chars"), F.char_length("abstract").alias("chars"), F.array_join("themes", ",").alias("themes"), F.array_join("sectors", ",").alias("sectors"))


def policy_rejected(spark, sf):
    return register(spark, sf)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first"))


def policy_affected(spark, sf):
    """Documents of one sector in a month, with at most forty names of each of their sectors; a security's sector goes round the sectors by its number."""
    rows, _ = register(spark, sf)
    sectors = sorted({x for v in tx.AGENCY_SECTORS.values() for x in v})
    names = read(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.get(F.array(*map(F.lit, sectors)), (F.col("s_suppkey") % len(sectors)).cast("int")).alias("sector"))
    now = queue.policy_asof(rows, "2024-02-20", 30, sector="Energy")
    return queue.affected(now, names).select("doc_id", F.array_join("tickers", ",").alias("tickers"))


def _policy_sql() -> str:
    slugs = list(SLUGS)
    found = ", ".join("case when " + " or ".join(f"contains(lower(both_), '{w}')" for w in ws) + f" then '{k}' end" for k, ws in tx.THEMES.items())
    by_agency = " ".join(f"when '{k}' then {v}" for k, v in tx.AGENCY_SECTORS.items())
    by_theme = " ".join(f"when '{k}' then {list(v)}" for k, v in tx.THEME_SECTORS.items())
    return f"""with p0 as (select doc_id as k, text, string_split(text, chr(10))[1] as title, regexp_extract(source, '([0-9]+)$', 1)::int as no, {slugs} as slugs, string_split(text, chr(10))[1] || ' ' || text as both_ from documents),
p1 as (select *, [slugs[no % 27 + 1], slugs[(no + 9) % 27 + 1]] as own, list_filter([{found}], lambda x: x is not null) as th from p0),
p2 as (select *, list_distinct(list_concat(flatten(list_transform(own, lambda s: case s {by_agency} end)), flatten(list_transform(th, lambda t: case t {by_theme} else []::varchar[] end)))) as raw,
  list_concat(flatten(list_transform(own, lambda s: case s {by_agency} end)), flatten(list_transform(th, lambda t: case t {by_theme} else []::varchar[] end))) as every_ from p1),
p3 as (select *, list_filter(every_, lambda x, i: list_position(every_, x) = i) as sectors, date '2024-01-01' + (k % 90)::int as published from p2 where k % 53 <> 0 and k % 47 <> 0)"""


POLICY = _policy_sql()
CAPS = "array_to_string(list_transform(string_split(replace(s, '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
SECTORS = str(sorted({x for v in tx.AGENCY_SECTORS.values() for x in v}))


def feed_rows(spark, sf):
    """News as it lands: JSON items with and without an envelope, and RSS items; some have no time, some no title."""
    n = read(spark, sf, "news").where("ticker is not null")
    title = F.when(F.col("id") % 29 != 0, F.col("title"))
    when = F.when(F.col("id") % 7 == 0, "yesterday").when(F.col("id") % 7 == 1, F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    flat = [title.alias("title"), when.alias("pubDate"), F.col("body").alias("summary"), F.struct(F.col("source").alias("displayName")).alias("provider"), F.struct(F.concat(F.lit("u"), "id").alias("url")).alias("canonicalUrl")]
    item = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.struct(*flat).alias("content")))).otherwise(F.to_json(F.struct(*flat)))
    json = n.where("id % 3 <> 0").groupBy("ticker", F.floor(F.col("id") / 20000).alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", item.alias("i")))).alias("x"))
    payload = F.when(F.substring("ticker", 2, 9).cast("int") % 10 == 9, "<html>").otherwise(F.concat(F.lit("["), F.array_join(F.col("x.i"), ","), F.lit("]")))
    return papers.news_items(json.select("ticker", F.lit("2025-01-01 00:00:00").cast("timestamp").alias("fetched_at"), payload.alias("payload")))


def feed(spark, sf):
    rows, _ = feed_rows(spark, sf)
    return rows.select("ticker", F.md5("title").alias("title"), "url", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), "source", F.char_length("body").alias("chars"))


def feed_rejected(spark, sf):
    return feed_rows(spark, sf)[1].groupBy("ticker", "reason").agg(F.count(F.lit(1)).alias("n"))


def rss_rows(spark, sf):
    n = read(spark, sf, "news").where("ticker is not null and id % 3 = 0")
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    title = F.when(F.col("id") % 29 == 0, "").otherwise(F.concat(F.lit("<title>N"), "id", F.lit("</title>")))
    when = F.when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("<pubDate>"), F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.when(F.col("id") % 2 == 0, " GMT").otherwise(" +0000"), F.lit("</pubDate>")))
    item = F.concat(F.lit("<item>"), title, F.lit("<link>u"), "id", F.lit("</link>"), when, F.lit("<description>"), esc(F.substring_index("body", "\n", 1)), F.lit("</description></item>"))
    files = n.groupBy("ticker", F.floor(F.col("id") / 20000).alias("part")).agg(F.array_join(F.collect_list(item), "").alias("x"))
    whole = F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>"))
    return papers.news_rss(files.select("ticker", F.lit("wire").alias("source"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("fetched_at"), F.when(F.substring("ticker", 2, 9).cast("int") % 10 == 8, F.substring(whole, 1, 40)).otherwise(whole).alias("payload")))


def rss(spark, sf):
    rows, bad = rss_rows(spark, sf)
    good = rows.select("ticker", "title", "url", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(bad.groupBy("ticker", "reason").agg(F.count(F.lit(1)).cast("string").alias("title")).select("ticker", "title", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("published"), "reason"))


def master(spark, sf):
    """The security master from filers' records, with a predecessor's record where the first is empty, and a vendor's fields where it has gaps."""
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    record = lambda name, sic: F.to_json(F.struct(name.alias("name"), sic.alias("sic"), F.when(k % 4 != 0, F.upper("n_name")).alias("sicDescription"), F.when(k % 5 != 0, F.array(F.lit("NYSE"), F.lit("CBOE"))).alias("exchanges"), F.when(k % 3 == 0, F.struct(F.struct(F.col("n_name").alias("country")).alias("business"))).alias("addresses")))
    code = (F.lit(100) + k * 97 % 8900).cast("string")
    one = s.select(F.concat(F.lit("S"), k).alias("ticker"), F.concat(F.lit("C"), k).alias("filer"), F.lit(0).alias("place"), F.when(k % 11 == 0, "{}").otherwise(record(F.col("s_name"), F.when(k % 7 != 0, code))).alias("payload"))
    two = s.select(F.concat(F.lit("S"), k).alias("ticker"), F.concat(F.lit("P"), k).alias("filer"), F.lit(1).alias("place"), record(F.concat(F.lit("Old "), "s_name"), code).alias("payload"))
    vendor = s.select(F.concat(F.lit("S"), k).alias("ticker"), F.when(k % 14 == 0, "Energy").alias("sector"), F.lit("Vendor trade").alias("industry"), F.when(k % 2 == 0, "OTC").alias("exchange"), F.lit("XX").alias("country"))
    return papers.gaps_filled(papers.securities(one.unionByName(two)), vendor)


def _sector_sql(code: str) -> str:
    from pitgrid.operators import identity as idn

    ranges = " ".join(f"when {code} between {a} and {b} then '{s}'" for a, b, s in idn.CODE_RANGES)
    first = " ".join(f"when {code} // 100 = {d} then '{s}'" for d, s in idn.BY_TWO_DIGITS.items())
    return f"case when {code} in {idn.REAL_ESTATE_CODES} then 'Real Estate' {ranges} {first} else 'Unknown' end"


def ingest(spark, sf):
    """The log of two days of attempts by source and key, made of orders: those of one status failed."""
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), (F.col("o_custkey") % 20).cast("string").alias("key"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").cast("long").alias("rows"), F.when(F.col("o_orderstatus") == "P", "no answer").alias("error"))
    one = o.groupBy("source", "key", "at").agg(F.max("rows").alias("rows"), F.max("error").alias("error"))
    empty = spark.createDataFrame([], "source string, key string, last_attempt timestamp, last_success timestamp, rows long, error string")
    log = store.record_ingest(empty, one.where("at < '1998-01-01'"))
    out = store.record_ingest(log, one.where("at >= '1998-01-01'"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("last_attempt", "last_success")})


def review_queue(spark, sf):
    """Results filings of the last half year without a review, in the order in which they should be read: held names first, the largest holding first."""
    e = read(spark, sf, "corporate_events").where("item_code = '2.02'")
    newest = e.agg(F.date_sub(F.max("filed"), 180).alias("_since"))
    todo = e.join(read(spark, sf, "reviews").select("ticker", "accession"), ["ticker", "accession"], "left_anti").join(newest, F.col("filed") >= F.col("_since")).select("ticker", "filed", "accession")
    held = read(spark, sf, "positions").groupBy("ticker").agg(F.sum("shares").alias("s"))
    first = held.withColumn("priority", F.row_number().over(Window.orderBy(F.desc("s"), "ticker"))).where("priority <= 25")
    return queue.review_order(todo, first)


def review_list(spark, sf):
    own = read(spark, sf, "positions").where("lot_id % 7 = 0").select("ticker")
    return queue.recent_reviews(read(spark, sf, "reviews"), own, "1998-01-01", "1998-06-30").select("ticker", "filed", "accession", "score", "own", "place")


def headlines(spark, sf):
    """News with what its title and whole body say."""
    n = read(spark, sf, "news").withColumn("_t", F.concat_ws(" ", "title", "body"))
    out = n.withColumns({"events": tx.tags(F.col("_t")), "guidance": tx.first_of(F.col("_t"), tx.GUIDANCE), "analyst": tx.first_of(F.col("_t"), tx.ANALYSTS)})
    return out.withColumn("material", tx.material(F.col("events"), F.col("guidance"), F.col("analyst"))).drop("_t")


def closed_digest(spark, sf):
    """Headlines of two hours, each once with its names, in parts: watched names, picks, material ones."""
    watch = read(spark, sf, "positions").where("lot_id % 40 = 0").select("ticker")
    picks = read(spark, sf, "supplier").where("s_suppkey % 6 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"))
    out = queue.closed_market_digest(headlines(spark, sf), "2024-01-01 01:00:00", "2024-01-01 03:00:00", watch, picks)
    return out.select(F.md5("title_key").alias("title"), F.array_join("tickers", ",").alias("tickers"), F.date_format("published", "HH:mm").alias("at"), "id", "part")


def categories(spark, sf):
    """Words of five categories: the hundred most frequent ones, twenty each."""
    words = read(spark, sf, "news").select(F.explode(tx.tokens(F.col("body"))).alias("word")).groupBy("word").count()
    r = F.row_number().over(Window.orderBy(F.desc("count"), "word"))
    kinds = F.array(*map(F.lit, KINDS))
    lexicon = words.orderBy(F.desc("count"), "word").limit(100).withColumn("r", r).select("word", F.get(kinds, F.floor((F.col("r") - 1) / 20).cast("int")).alias("category"))
    return rounded(tx.category_counts(read(spark, sf, "news"), lexicon, "id", "body", list(KINDS)))


KINDS = ("positive", "negative", "uncertainty", "litigious", "constraining")


def summaries(spark, sf):
    """What the wire says of each name: counts, events, guidance, notes."""
    t = press.told(spark, sf).withColumn("tone", (F.col("id") % 5 - 2).cast("double") / 2)
    out = tx.direction_summary(t, ["ticker"], ["published", "id"], "tone")
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return rounded(out.select("ticker", "articles", "material", "tone", flat("top_events").alias("top_events"), flat("guidance").alias("guidance"), flat("analyst_actions").alias("analysts"), F.array_join("notes", " | ").alias("notes")))


def _notes() -> str:
    cells = [f"case when guidance = '{k}' then '{v}' end" for k, v in tx.NOTES["guidance"].items()] + [f"case when list_contains(events, '{k}') then '{v}' end" for k, v in tx.NOTES["event"].items()] + [f"case when analyst = '{k}' then '{v}' end" for k, v in tx.NOTES["analyst"].items()]
    return "list_filter([" + ", ".join(cells) + "], lambda x: x is not null)"


QUERIES = {
    "landed_policy": (policy, POLICY + f" select 'D' || k as doc_id, published, case k % 3 when 0 then 'Final rule' when 1 then 'Proposed rule' else 'Correction' end as doc_type, array_to_string(list_transform(own, lambda s: {CAPS}), '; ') as agencies, length(title)::int as title_chars, length(text)::int as chars, array_to_string(th, ',') as themes, array_to_string(sectors, ',') as sectors from p3"),
    "landed_policy_rejected": (policy_rejected, "select case when doc_id % 53 = 0 then 'no number' else 'no date' end as reason, count(*) as n, min(doc_id // 100) as first from documents where doc_id % 53 = 0 or doc_id % 47 = 0 group by 1"),
    "policy_affected": (policy_affected, POLICY + f""", sec as (select 'S' || s_suppkey as ticker, {SECTORS}[s_suppkey % len({SECTORS}) + 1] as sector from supplier qualify row_number() over (partition by sector order by 'S' || s_suppkey) <= 40),
now as (select * from p3 where published between date '2024-02-20' - 30 and date '2024-02-20' and list_contains(sectors, 'Energy')), hit as (select k, unnest(sectors) as sector from now)
select 'D' || now.k as doc_id, coalesce(x.t, '') as tickers from now left join (select k, array_to_string(list_sort(list(distinct ticker)), ',') as t from hit join sec using (sector) group by 1) x using (k)"""),
    "landed_news": (feed, ctes("news") + """ select ticker, md5(title) as title, 'u' || id as url, strftime(case when id % 7 = 0 then timestamp '2025-01-01' else published end, '%Y-%m-%d %H:%M:%S') as published, source, length(body)::int as chars from news where id % 3 <> 0 and id % 29 <> 0 and substring(ticker, 2)::int % 10 <> 9"""),
    "landed_news_rejected": (feed_rejected, ctes("news") + """ select ticker, 'no title' as reason, count(*) as n from news where id % 3 <> 0 and id % 29 = 0 and substring(ticker, 2)::int % 10 <> 9 group by 1
union all select ticker, 'not JSON', count(distinct id // 20000) from news where id % 3 <> 0 and substring(ticker, 2)::int % 10 = 9 group by 1"""),
    "landed_rss": (rss, ctes("news") + """, r as (select *, substring(ticker, 2)::int % 10 = 8 as cut from news where id % 3 = 0)
select ticker, 'N' || id as title, 'u' || id as url, strftime(case when id % 7 = 0 then timestamp '2025-01-01' else published end, '%Y-%m-%d %H:%M:%S') as published, null as reason from r where not cut and id % 29 <> 0
union all select ticker, count(*)::varchar, null, null, 'no title' from r where not cut and id % 29 = 0 group by 1 union all select ticker, count(distinct id // 20000)::varchar, null, null, 'not XML' from r where cut group by 1"""),
    "security_master": (master, f"""with s as (select *, s_suppkey as k, s_suppkey % 11 = 0 as old, (100 + s_suppkey * 97 % 8900)::int as code from supplier join nation on s_nationkey = n_nationkey),
m as (select *, case when not old and k % 7 = 0 then 'Unknown' else {_sector_sql('code')} end as sec from s)
select 'S' || k as ticker, case when old then 'P' else 'C' end || k as filer, case when old then 'Old ' || s_name else s_name end as name, case when sec = 'Unknown' and k % 14 = 0 then 'Energy' else sec end as sector,
  case when k % 4 <> 0 then array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') else 'Vendor trade' end as industry, case when k % 5 <> 0 then 'NYSE' when k % 2 = 0 then 'OTC' end as exchange, case when k % 3 = 0 then n_name else 'US' end as country from m"""),
    "ingest_log": (ingest, """with a as (select o_orderpriority as source, (o_custkey % 20)::varchar as key, o_orderdate::date as at_, max(o_totalprice::decimal(18,2)) as price, bool_or(o_orderstatus = 'P') as failed, max(floor(o_totalprice))::bigint as n from orders group by 1, 2, 3)
select source, key, strftime(max(at_), '%Y-%m-%d') as last_attempt, strftime(max(at_) filter (where not failed), '%Y-%m-%d') as last_success, arg_max(n, at_) filter (where not failed) as rows, arg_max(case when failed then 'no answer' else '' end, at_) as e from a group by 1, 2""".replace("arg_max(case when failed then 'no answer' else '' end, at_) as e", "nullif(arg_max(case when failed then 'no answer' else '' end, at_), '') as error")),
    "review_queue": (review_queue, ctes("corporate_events", "reviews", "positions") + """, h as (select ticker, row_number() over (order by sum(shares) desc, ticker) as p from positions group by 1 qualify p <= 25),
t as (select e.ticker, filed, accession, p from corporate_events e left join h using (ticker) where item_code = '2.02' and filed >= (select max(filed) - 180 from corporate_events where item_code = '2.02') and not exists (select 1 from reviews r where r.ticker = e.ticker and r.accession = e.accession))
select ticker, filed, accession, row_number() over (order by p nulls last, filed desc, accession, ticker) as place from t"""),
    "review_list": (review_list, ctes("reviews", "positions") + """, o as (select distinct ticker from positions where lot_id % 7 = 0)
select r.ticker, filed, accession, score, o.ticker is not null as own, row_number() over (order by o.ticker is not null desc, abs(score) desc, filed desc, accession, r.ticker) as place from reviews r left join o using (ticker) where filed between date '1998-01-01' and date '1998-06-30'"""),
    "news_categories": (categories, None),
    "news_summary": (summaries, press.EVENT_ROWS + f""", er2 as (select er.*, news_.published, (er.id % 5 - 2) / 2.0 as tone from er join (select id, published from told) news_ using (id)),
bs as (select ticker, count(*) as articles, count(case when material then 1 end) as material, round(avg(tone), 6) + 0.0 as tone from er2 group by 1),
ev as (select ticker, k, count(*) as n from (select ticker, unnest(events) as k from er2) group by ticker, k qualify row_number() over (partition by ticker order by count(*) desc, k) <= 6),
el as (select ticker, string_agg(k || ':' || n, ',' order by k) as top_events from ev group by 1), gl as (select ticker, string_agg(k || ':' || n, ',' order by k) as guidance from (select ticker, guidance as k, count(*) as n from er2 where guidance is not null group by all) group by 1),
al as (select ticker, string_agg(k || ':' || n, ',' order by k) as analysts from (select ticker, analyst as k, count(*) as n from er2 where analyst is not null group by all) group by 1),
nt as (select ticker, published, id, unnest({_notes()}) as note, unnest(range(len({_notes()}))) as i from er2), nf as (select ticker, note, min(row(published, id, i)) as o from nt group by ticker, note qualify row_number() over (partition by ticker order by min(row(published, id, i)), note) <= 8),
nl as (select ticker, string_agg(note, ' | ' order by o) as notes from nf group by 1)
select bs.*, top_events, guidance, analysts, notes from bs left join el using (ticker) left join gl using (ticker) left join al using (ticker) left join nl using (ticker)"""),
    "closed_market_digest": (closed_digest, None),
}
