"""Queries over headlines: events, direction, tone, relevance, themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.operators import asof
from pitgrid.operators import text as tx
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.prices import rounded


def told(spark, sf) -> DataFrame:
    """Headlines with their events, guidance and analysts' actions."""
    w = read(spark, sf, "wire").where(~tx.promotional(F.col("title")))
    return w.withColumns({"events": tx.tags(F.col("title")), "guidance": tx.first_of(F.col("title"), tx.GUIDANCE), "analyst": tx.first_of(F.col("title"), tx.ANALYSTS)})


def _rule(r: str) -> str:
    """A pattern for an engine without look-behind: price targets are renamed before."""
    return "regexp_matches(replace(lower(title), 'price target', 'price tgt'), '" + r.replace("(?<!price )target", "target").replace("price target", "price tgt").replace("(?:price )?target", "(?:price tgt|target)") + "')"


TOLD = ctes("wire") + f""", pw as (select * from wire where not regexp_matches(title, '{tx.PROMOTION}')),
t0 as (select *, list_filter([{", ".join(f"case when {_rule(r)} then '{k}' end" for k, r in tx.EVENTS.items())}], lambda x: x is not null) as ev, case {" ".join(f"when {_rule(r)} then '{k}'" for k, r in tx.GUIDANCE.items())} end as guidance,
  case {" ".join(f"when {_rule(r)} then '{k}'" for k, r in tx.ANALYSTS.items())} end as analyst from pw),
told as (select * exclude (ev), case when list_has_any(ev, ['dividend_raise', 'dividend_cut']) then list_filter(ev, lambda x: x <> 'dividend') else ev end as events from t0)"""


def events(spark, sf):
    """Events, direction and weight of every headline that isn't promotion."""
    t = told(spark, sf)
    e, g, a = F.col("events"), F.col("guidance"), F.col("analyst")
    return rounded(t.select("id", F.array_join(e, ",").alias("events"), g, a, tx.material(e, g, a).alias("material"), tx.event_polarity(e, g, a).alias("event_polarity")))


def _map(kind: str, x: str) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then {v!r}" for k, v in tx.POLARITY[kind].items()) + " end"


EVENT_ROWS = TOLD + f""", er as (select *, guidance is not null or analyst is not null or list_has_any(events, {list(tx.MATERIAL)}) as material,
  list_filter(list_concat([{_map("guidance", "guidance")}, {_map("analyst", "analyst")}], list_transform(events, lambda e: {_map("event", "e")})), lambda x: x is not null) as parts from told)"""
POLARITY = "case when len(parts) > 0 then greatest(-1.0, least(1.0, list_sum(parts))) end"


def tones(spark, sf):
    """Tone of headlines: words of a lexicon, what events say, and doubt."""
    t = told(spark, sf)
    lexicon = spark.createDataFrame([("beat", 1), ("raises", 1), ("growth", 1), ("upgrades", 1), ("cuts", -1), ("shortage", -1), ("lawsuit", -1), ("resigns", -1)], "word string, sign int")
    tone = tx.lexicon_tone(t, lexicon, "id", "title").select("id", "polarity")
    words = tx.tokens(F.col("title"))
    doubt = F.size(F.filter(words, lambda w: w.isin("may", "plans", "quiet", "rules"))) / F.greatest(F.size(words), F.lit(1))
    df = t.join(tone, "id").withColumn("both", tx.blended(F.col("polarity"), tx.event_polarity(F.col("events"), F.col("guidance"), F.col("analyst")), doubt))
    return rounded(df.select("id", F.round("both", 4).alias("polarity"), tx.tone_label(F.col("both")).alias("label")))


TONES = EVENT_ROWS + f""", wd as (select id, list_filter(string_split_regex(lower(title), '[^a-z]+'), lambda x: x <> '') as w from told), ps as (select id, unnest(w) as word, unnest(range(len(w))) as pos from wd),
nb as (select *, max(case when word in {tx.NEGATORS} then pos end) over (partition by id order by pos rows between unbounded preceding and 1 preceding) as last from ps),
lx(word, sign) as (values ('beat', 1), ('raises', 1), ('growth', 1), ('upgrades', 1), ('cuts', -1), ('shortage', -1), ('lawsuit', -1), ('resigns', -1)),
ht as (select id, sign * (case when pos - last <= 3 then -1 else 1 end) as s from nb join lx using (word)), sm as (select id, sum((s > 0)::int) as p, sum((s < 0)::int) as n from ht group by 1),
tn as (select er.id, coalesce((p - n) / (p + n), 0)::double as tone, {POLARITY} as ev, len(list_filter(w, lambda x: x in ('may', 'plans', 'quiet', 'rules'))) / greatest(len(w), 1) as doubt from er join wd using (id) left join sm using (id)),
bl as (select id, case when ev is null then tone when abs(tone) < 0.15 then 0.75 * ev + 0.25 * tone else 0.5 * ev + 0.5 * tone end * case when doubt > 0.05 then greatest(0.5, 1 - 4 * doubt) else 1 end as both_ from tn)
select id, round(both_, 4) + 0.0 as polarity, case when both_ >= 0.35 then '🟢 Positive' when both_ >= 0.10 then '🟢 Mildly positive' when both_ > -0.10 then '⚪ Neutral' when both_ > -0.35 then '🟠 Mildly negative' else '🔴 Negative' end as label from bl"""


def directions(spark, sf):
    """Per name: articles, material ones, most frequent events, counts of directions."""
    t = told(spark, sf)
    count = lambda c, k: F.count(F.when(F.col(c) == k, 1)).alias(k)
    base = t.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("articles"), F.count(F.when(tx.material(F.col("events"), F.col("guidance"), F.col("analyst")), 1)).alias("material"),
        *[count("guidance", k) for k in tx.GUIDANCE], *[count("analyst", k) for k in tx.ANALYSTS],
    )
    seen = t.select("ticker", F.explode("events").alias("event")).groupBy("ticker", "event").count()
    order = Window.partitionBy("ticker").orderBy(F.desc("count"), "event")
    top = seen.withColumn("p", F.row_number().over(order)).where("p <= 6").groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "event", "count"))), lambda x: F.concat_ws(":", x["event"], x["count"].cast("string"))), ",").alias("top_events"))
    return base.join(top, "ticker", "left")


def recent(spark, sf):
    """Articles of the two days up to each day with news: how many, promotional ones, those about the name, and the newest."""
    w = read(spark, sf, "wire").join(read(spark, sf, "securities").select("ticker", "name"), "ticker")
    w = w.withColumns({"promo": tx.promotional(F.col("title")), "about": tx.is_about(F.col("title"), F.col("body"), F.col("ticker"), F.col("name")), "day": F.to_date("published")})
    seen = asof.window_join(w.select(F.col("day").alias("as_of")).distinct(), w, "day", 2)
    return seen.groupBy("as_of", "ticker").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("promo"), 1)).alias("promo"), F.count(F.when(F.col("about"), 1)).alias("about"), F.max_by("id", F.struct("published", "id")).alias("newest"))


def heat(spark, sf):
    """Articles per theme and per sector that it bears on."""
    t = read(spark, sf, "wire").withColumn("themes", tx.themes(F.col("title")))
    by_theme = t.select(F.explode("themes").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("theme"))
    by_sector = t.select(F.explode(tx.theme_sectors(F.col("themes"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("sector"))
    return by_theme.unionByName(by_sector)


def _themes() -> str:
    found = ", ".join("case when " + " or ".join(f"contains(lower(title), '{w}')" for w in ws) + f" then '{k}' end" for k, ws in tx.THEMES.items())
    sectors = " ".join(f"when '{k}' then {list(v)}" for k, v in tx.THEME_SECTORS.items())
    return ctes("wire") + f""", th as (select id, list_filter([{found}], lambda x: x is not null) as th from wire), sc as (select id, list_distinct(flatten(list_transform(th, lambda t: case t {sectors} else []::varchar[] end))) as sc from th)
select tag, count(*) as n, 'theme' as kind from (select unnest(th) as tag from th) group by 1 union all select tag, count(*), 'sector' from (select unnest(sc) as tag from sc) group by 1"""


def digest(spark, sf):
    """Roll-up of each name's five newest headlines: kind and title, those with events first."""
    t = told(spark, sf)
    order = Window.partitionBy("ticker").orderBy(F.desc((F.size("events") > 0).cast("int")), F.desc("published"), "id")
    line = F.concat_ws(": ", F.coalesce(F.get("events", F.lit(0)), F.lit("news")), "title")
    top = t.withColumn("p", F.row_number().over(order)).where("p <= 5").withColumn("line", line)
    return top.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), " | ").alias("digest"))


QUERIES = {
    "news_events": (events, EVENT_ROWS + f" select id, array_to_string(events, ',') as events, guidance, analyst, material, round({POLARITY}, 6) + 0.0 as event_polarity from er"),
    "news_polarity": (tones, TONES),
    "news_directions": (directions, EVENT_ROWS + f""", bs as (select ticker, count(*) as articles, count(case when material then 1 end) as material, {", ".join(f"count(case when guidance = '{k}' then 1 end) as {k}" for k in tx.GUIDANCE)}, {", ".join(f"count(case when analyst = '{k}' then 1 end) as {k}" for k in tx.ANALYSTS)} from er group by 1),
ex as (select ticker, unnest(events) as event from er), ec as (select ticker, event, count(*) as c from ex group by all), ep as (select *, row_number() over (partition by ticker order by c desc, event) as p from ec)
select bs.*, top_events from bs left join (select ticker, string_agg(event || ':' || c, ',' order by p) as top_events from ep where p <= 6 group by 1) x using (ticker)"""),
    "news_recent": (recent, ctes("wire", "securities") + f""", w as (select wire.*, name, published::date as day, regexp_matches(title, '{tx.PROMOTION}') as promo, list_filter(string_split_regex(trim(regexp_replace(lower(name), '[^a-z0-9& ]', ' ', 'g')), ' +'), lambda x: x <> '') as ws from wire join securities using (ticker)),
x as (select *, len(ws) = 0 or contains(lower(concat_ws(' ', title, body)), case when length(ws[1]) >= 4 then ws[1] else array_to_string(ws[1:2], ' ') end) or regexp_matches(concat_ws(' ', title, body), '[:$(]\\s?' || replace(ticker, '-', '.') || '\\b') as about from w)
select as_of, ticker, count(*) as n, count(case when promo then 1 end) as promo, count(case when about then 1 end) as about, arg_max(id, (published, id)) as newest from x join (select distinct day as as_of from w) d on day <= as_of and day > as_of - 2 group by all"""),
    "theme_heat": (heat, _themes()),
    "news_digest": (digest, TOLD + """, p as (select *, row_number() over (partition by ticker order by (len(events) > 0)::int desc, published desc, id) as p from told)
select ticker, string_agg(coalesce(events[1], 'news') || ': ' || title, ' | ' order by p) as digest from p where p <= 5 group by 1"""),
}
