"""Queries over texts, stored tables and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.functions import scalars as sc
from pitgrid.operators import audit, store
from pitgrid.operators import text as tx
from pitgrid.plans import filings, panel as pl, prices as pr
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.prices import rounded
from pitgrid.plans.alternatives import MEMBERS, membership

WORDS = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^a-z]+'), lambda x: x <> '')"
COUNTED = ctes("news") + f""",
tk as (select id, unnest({WORDS.format("body")}) as word, unnest(range(len({WORDS.format("body")}))) as pos from news),
fr as (select word, row_number() over (order by count(*) desc, word) as r from tk group by 1)"""


def lexicon(spark, sf):
    """The 20 most frequent words as positive, the next 20 as negative."""
    words = read(spark, sf, "news").select(F.explode(tx.tokens(F.col("body"))).alias("word")).groupBy("word").count()
    top = words.orderBy(F.desc("count"), "word").limit(40)
    from pyspark.sql import Window

    r = F.row_number().over(Window.orderBy(F.desc("count"), "word"))
    return top.withColumn("r", r).select("word", F.when(F.col("r") <= 20, 1).otherwise(-1).alias("sign"))


def tone(spark, sf):
    return rounded(tx.lexicon_tone(read(spark, sf, "news"), lexicon(spark, sf), "id", "body"))


NEG = str(tx.NEGATORS)
TONE = COUNTED + f""",
nb as (select *, max(case when word in {NEG} then pos end) over (partition by id order by pos rows between unbounded preceding and 1 preceding) as last from tk),
ht as (select id, (case when r <= 20 then 1 else -1 end) * (case when pos - last <= 3 then -1 else 1 end) as s from nb join fr using (word) where r <= 40),
sm as (select id, sum((s > 0)::int) as p, sum((s < 0)::int) as n from ht group by 1)
select news.id, coalesce(p, 0)::bigint as positive, coalesce(n, 0)::bigint as negative, round(case when coalesce(p, 0) + coalesce(n, 0) > 0 then (p - n) / (p + n) else 0 end, 6) + 0.0 as polarity from news left join sm using (id)"""


def figures(spark, sf):
    n = read(spark, sf, "news")
    both = F.concat_ws(" ", "title", "body")
    return n.select("id", F.array_join(tx.figures(both), "|").alias("figures"), F.array_join(tx.tags(both), ",").alias("tags"), F.array_join(tx.themes(both), ",").alias("themes"))


def _tag_sql():
    from pitgrid.plans.press import _rule

    t = "lower(concat_ws(' ', title, body))"
    rule = lambda r: _rule(r).replace("lower(title)", t)
    tags = ", ".join(f"case when {rule(r)} then '{k}' end" for k, r in tx.EVENTS.items())
    th = ", ".join("case when " + " or ".join(f"contains({t}, '{w}')" for w in ws) + f" then '{k}' end" for k, ws in tx.THEMES.items())
    return f"""select id, figures, array_to_string(case when list_has_any(ev, ['dividend_raise', 'dividend_cut']) then list_filter(ev, lambda x: x <> 'dividend') else ev end, ',') as tags, themes from (
select id, array_to_string(regexp_extract_all(concat_ws(' ', title, body), '(\\$[0-9][0-9,.]*|[0-9]+(?:\\.[0-9]+)?%)', 1)[1:4], '|') as figures, list_filter([{tags}], lambda x: x is not null) as ev, concat_ws(',', {th}) as themes from news)"""


def keys(spark, sf):
    return tx.keywords(read(spark, sf, "news"), "id", "body", ["that", "with", "this", "from"])


def headlines(spark, sf):
    return tx.newest(tx.first_sightings(read(spark, sf, "news"))).select("id", "ticker", "published", "place")


TITLE = "trim(regexp_replace(lower(coalesce({}, '')), '\\s+', ' ', 'g'))"


def shared_headlines(spark, sf):
    return tx.across_tickers(read(spark, sf, "news"))


def ids(spark, sf):
    return read(spark, sf, "news").select("id", sc.article_id(F.col("ticker"), F.col("title")).alias("article_id"))


def sentences(spark, sf):
    news = read(spark, sf, "news")
    return rounded(tx.central_sentences(news, "id", "body", tx.common_words(news, "body")))


def names(spark, sf):
    s = read(spark, sf, "securities")
    return s.select("ticker", sc.normalize_ticker(F.concat(F.lower("ticker"), F.lit(".a [x]"))).alias("symbol"), sc.company_key(F.concat("name", F.lit(", Inc. & Co"), "industry")).alias("company_key"), F.initcap(F.lower("industry")).alias("industry"))


NOISE = str(sc.COMPANY_NOISE)


def upserted(spark, sf):
    """Positions with new stops for some lots and some new lots."""
    old = read(spark, sf, "positions").select("lot_id", "ticker", "shares", "stop")
    new = old.where("lot_id % 3 = 0").select("lot_id", (F.col("stop") * 1.1).alias("stop")).unionByName(old.where("lot_id % 50 = 0").select((F.col("lot_id") + 1_000_000).alias("lot_id"), "stop"))
    return rounded(store.upsert(old, new, ["lot_id"]))


def replaced(spark, sf):
    e = read(spark, sf, "corporate_events").select("ticker", "filed", "accession", "category")
    fresh = e.where("category = 'results' and accession % 2 = 0 and filed between '1997-01-01' and '1997-06-30'").withColumn("filed", F.date_add("filed", 200))
    return store.replace_window(e, fresh, "filed", "1997-01-01", "1997-06-30", "category", ["results"])


def newest_members(spark, sf):
    return store.keep_newest(read(spark, sf, "members"), ["index_symbol", "ticker"], "as_of", "source")


def thinned(spark, sf):
    e = read(spark, sf, "corporate_events").groupBy("category", "filed").agg(F.count(F.lit(1)).alias("n"))
    return store.thin_weekly(e, ["category"], "filed", "2001-06-30", 400)


def prints(spark, sf):
    t = {n: (read(spark, sf, n), d) for n, d in (("bars", "date"), ("corporate_events", "filed"), ("insider_txns", "filed"), ("members", "as_of"), ("macro", "date"), ("attention", "date"), ("news", "published"))}
    return store.fingerprint(t)


PRINTS = ctes("bars", "corporate_events", "insider_txns", "members", "macro", "attention", "news") + " " + " union all ".join(
    f"select '{n}' as source, count(*) as n, min({d})::date as first, max({d})::date as last, max({d})::date - min({d})::date as span from {n}" for n, d in (("bars", "date"), ("corporate_events", "filed"), ("insider_txns", "filed"), ("members", "as_of"), ("macro", "date"), ("attention", "date"), ("news", "published"))
)


def unreferenced(spark, sf):
    """Events of names that never were members."""
    return store.orphans(read(spark, sf, "corporate_events"), read(spark, sf, "members"), ["ticker"]).groupBy("category").count().withColumnRenamed("count", "n")


def sessions_of_year(spark, sf):
    """Days with a session over all years that orders cover; days with a multiple of seven orders are closed."""
    days = read(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    first, last = days.agg(F.min("date"), F.max("date")).first()
    return store.open_days(spark, str(first), str(last), days.where("n % 7 = 0").select("date"))


def bar_checks(spark, sf):
    df = read(spark, sf, "bars").withColumn("why", F.coalesce(audit.bad_bar(), F.lit("ok")))
    return df.groupBy("why").agg(F.count(F.lit(1)).alias("n"))


def bounds(spark, sf):
    wide = pl.frame(spark, sf).select("as_of", "ticker", *[F.col(f).cast("double").alias(f) for f in audit.BOUNDS])
    return audit.out_of_bounds(wide.unpivot(["as_of", "ticker"], list(audit.BOUNDS), "factor", "value"))


def covered(spark, sf):
    return rounded(audit.coverage(pr.long_factors(spark, sf)))


def filing_checks(spark, sf):
    return audit.late_periods(filings.facts(spark, sf))


def jumps(spark, sf):
    return rounded(audit.split_jumps(read(spark, sf, "bars"), read(spark, sf, "splits")))


def gaps(spark, sf):
    return rounded(audit.survivorship_gap(membership(spark, sf), read(spark, sf, "bars")))


def rebased(spark, sf):
    b = read(spark, sf, "bars").select("ticker", "date", "close")
    fresh = b.withColumn("close", F.when(F.col("ticker").endswith("7"), F.col("close") * 1.01).otherwise(F.col("close")))
    return rounded(audit.basis_changed(fresh, b, "close", 0.005))


def fresh(spark, sf):
    return audit.freshness(read(spark, sf, "bars"), "2001-10-31", 3)


QUERIES = {
    "news_tone": (tone, TONE),
    "news_tags": (figures, ctes("news") + " " + _tag_sql()),
    "news_keywords": (keys, COUNTED + """, c as (select id, word, count(*) as count from tk where length(word) >= 4 and word not in ('that', 'with', 'this', 'from') group by all)
select * from (select *, row_number() over (partition by id order by count desc, word) as place from c) where place <= 8"""),
    "news_headlines": (headlines, ctes("news") + f""", f as (select * from news qualify row_number() over (partition by ticker, {TITLE.format("substring(title, 1, 90)")} order by published, id) = 1)
select * from (select id, ticker, published, row_number() over (partition by ticker order by published desc, id) as place from f) where place <= 25"""),
    "news_shared": (shared_headlines, ctes("news") + f" select {TITLE.format('title')} as title_key, array_to_string(list_sort(list(distinct ticker)), ',') as tickers, min(published) as first, count(*) as n from news group by 1"),
    "article_ids": (ids, ctes("news") + f" select id, substring(sha256(coalesce(ticker, '') || '|' || {TITLE.format('title')}), 1, 24) as article_id from news"),
    "news_summaries": (sentences, None),
    "security_names": (names, ctes("securities") + f""" select ticker, case when regexp_matches(upper(ticker) || '-A', '^[A-Z][A-Z0-9]{{0,5}}(-[A-Z0-9]{{1,3}})?$') then upper(ticker) || '-A' end as symbol,
array_to_string(list_sort(list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(name || ', Inc. & Co' || industry), '[^a-z0-9]+', ' ', 'g')), ' +'), lambda x: x <> '' and x not in {NOISE}))), ' ') as company_key,
array_to_string(list_transform(string_split(lower(industry), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as industry from securities"""),
    "positions_upsert": (upserted, ctes("positions") + """, u as (select lot_id, stop * 1.1 as stop from positions where lot_id % 3 = 0 union all select lot_id + 1000000, stop from positions where lot_id % 50 = 0)
select coalesce(p.lot_id, u.lot_id) as lot_id, ticker, round(shares, 6) + 0.0 as shares, round(case when u.lot_id is not null then u.stop else p.stop end, 6) + 0.0 as stop from positions p full join u on p.lot_id = u.lot_id"""),
    "events_replaced": (replaced, ctes("corporate_events") + """ select ticker, filed, accession, category from corporate_events where not (category = 'results' and filed between '1997-01-01' and '1997-06-30')
union all select ticker, filed + 200, accession, category from corporate_events where category = 'results' and accession % 2 = 0 and filed between '1997-01-01' and '1997-06-30'"""),
    "members_newest": (newest_members, ctes("members") + " select * from members qualify row_number() over (partition by index_symbol, ticker order by as_of desc, source desc) = 1"),
    "events_thinned": (thinned, ctes("corporate_events") + """, e as (select category, filed, count(*) as n from corporate_events group by all) select * from e where filed >= date '2001-06-30' - 400 union all
select * from (select * from e where filed < date '2001-06-30' - 400) qualify row_number() over (partition by category, date_trunc('week', filed) order by filed desc) = 1"""),
    "source_coverage": (prints, PRINTS),
    "events_orphaned": (unreferenced, ctes("corporate_events", "members") + " select category, count(*) as n from corporate_events e where not exists (select 1 from members m where m.ticker = e.ticker) group by 1"),
    "open_days": (sessions_of_year, """with c as (select o_orderdate::date as date, count(*) as n from orders group by 1),
d as (select unnest(generate_series((select min(date) from c), (select max(date) from c), interval 1 day))::date as date)
select date, row_number() over w as session, lag(date) over w as previous, lead(date) over w as next from d where isodow(date) <= 5 and date not in (select date from c where n % 7 = 0) window w as (order by date)"""),
    "bar_checks": (bar_checks, ctes("bars") + " select case when close is null or close <= 0 then 'no close' when volume < 0 then 'negative volume' when high < low then 'high under low' when close > high * 1.001 or close < low * 0.999 then 'close outside range' else 'ok' end as why, count(*) as n from bars group by 1"),
    "factor_bounds": (bounds, "with " + pl.FRAME + ", lg as (" + " union all ".join(f"""select ticker, '{k}' as factor, "{k}"::double as value, {a!r} as lo, {b!r} as hi from frame""" for k, (a, b) in audit.BOUNDS.items()) + """)
select factor, count(case when value < lo or value > hi then 1 end) as bad, count(value) as n, coalesce(array_to_string(list_sort(list(distinct ticker) filter (where value < lo or value > hi))[1:5], ','), '') as examples from lg group by 1"""),
    "factor_coverage": (covered, pr.LONG + """, c as (select as_of, factor, avg((value is not null)::int) as share, count(value) as n from long group by all)
select as_of, factor, round(share, 6) + 0.0 as share, n, case when share = 0 then 'missing' when share < 0.1 then 'empty' when share < 0.5 then 'sparse' else 'ok' end as status from c"""),
    "filing_checks": (filing_checks, filings.FACTS + " select ticker, count(case when filed < period_end then 1 end) as early, max(filed) as last_filed, count(*) as n from facts group by 1"),
    "split_jumps": (jumps, ctes("bars", "splits") + f""", r as (select *, lag(close) over (partition by ticker order by date) / close as ratio from bars), c as (select *, list_filter({list(audit.SPLITS)}, lambda c: abs(ratio / c - 1) <= 0.06)[1] as canon from r)
select ticker, date, round(ratio, 6) + 0.0 as ratio, round(canon, 6) + 0.0 as canon from c where canon is not null and not exists (select 1 from splits s where s.ticker = c.ticker and abs(c.date - s.date) <= 200)"""),
    "survivorship_gap": (gaps, MEMBERS + """, m as (select distinct as_of, ticker from mem) select as_of, count(*) as members,
round(1 - count(case when exists (select 1 from bars b where b.ticker = m.ticker and b.date between m.as_of - 60 and m.as_of + 30) then 1 end) / count(*), 6) + 0.0 as gap from m group by 1"""),
    "basis_changes": (rebased, ctes("bars") + " select ticker, round(max(abs(case when ticker like '%7' then close * 1.01 else close end / close - 1)), 6) + 0.0 as most, max(abs(case when ticker like '%7' then close * 1.01 else close end / close - 1)) > 0.005 as changed from bars group by 1"),
    "bar_freshness": (fresh, ctes("bars") + " select ticker, max(date) as newest, date '2001-10-31' - max(date) as age, case when date '2001-10-31' - max(date) <= 3 then 'fresh' else 'stale' end as status from bars group by 1"),
}
