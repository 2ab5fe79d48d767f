"""Readers of landed payloads: one row per payload in, typed rows out, without driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions.scalars import company_key, money, normalize_ticker
from pitgrid.operators.audit import bad_bar

FACT = "struct<start:string,end:string,val:double,filed:string,form:string,fy:int,fp:string>"
FACTS = f"struct<facts:map<string,map<string,struct<units:map<string,array<{FACT}>>>>>>"
CHART = "struct<timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>,splits:map<string,struct<date:bigint,numerator:double,denominator:double>>>"
FILINGS = "struct<accession:array<string>,form:array<string>,filed:array<string>,items:array<string>>"
# Item codes of current reports, their categories and what they tell.
ITEMS = {
    "1.01": ("strategy", "Material definitive agreement"),
    "1.02": ("strategy", "Termination of material agreement"),
    "2.01": ("strategy", "Completion of acquisition or disposition"),
    "2.02": ("results", "Results of operations"),
    "2.05": ("restructuring", "Costs associated with exit or disposal"),
    "2.06": ("impairment", "Material impairment"),
    "3.01": ("listing", "Delisting / listing-rule noncompliance"),
    "4.01": ("audit", "Change in certifying accountant"),
    "4.02": ("audit", "Non-reliance on prior financials"),
    "5.02": ("management", "Director / officer departure or appointment"),
    "5.07": ("governance", "Shareholder vote results"),
    "7.01": ("disclosure", "Regulation FD disclosure"),
    "8.01": ("disclosure", "Other events"),
}


def company_facts(payloads: DataFrame, concepts: DataFrame, payload: str = "payload") -> DataFrame:
    """namespace -> tag -> unit -> facts as rows of modelled tags; a missing start is the end."""
    tree = payloads.withColumn("_t", F.from_json(payload, FACTS))
    names = tree.select("ticker", F.explode("_t.facts").alias("namespace", "_tags"))
    tags = names.select("ticker", "namespace", F.explode("_tags").alias("tag", "_u"))
    units = tags.select("ticker", "tag", F.explode("_u.units").alias("unit", "_f")).join(concepts, "tag")
    f = units.select("ticker", "concept", "tag", "unit", F.explode("_f").alias("f"))
    day = lambda c: F.col(f"f.{c}").cast("date")
    return f.select("ticker", "concept", "tag", "unit", F.coalesce(day("start"), day("end")).alias("period_start"), day("end").alias("period_end"), day("filed").alias("filed"), F.col("f.form").alias("form"), F.col("f.val").alias("val")).where(
        "val is not null and period_end is not null and filed is not null"
    )


def filing_index(payloads: DataFrame, forms: list[str], payload: str = "payload") -> DataFrame:
    """Column arrays of a filing index as rows of the wanted forms and their amendments."""
    x = F.from_json(payload, FILINGS)
    rows = payloads.select("ticker", F.explode(F.arrays_zip(x["accession"].alias("accession"), x["form"].alias("form"), x["filed"].alias("filed"), x["items"].alias("items"))).alias("r")).select("ticker", "r.*")
    return rows.where(F.regexp_replace("form", "/A$", "").isin(*forms)).withColumn("filed", F.col("filed").cast("date"))


def event_items(filings: DataFrame) -> DataFrame:
    """Comma-joined item codes of original current reports as event rows of known items."""
    known = F.create_map(*[x for k, (kind, what) in ITEMS.items() for x in (F.lit(k), F.struct(F.lit(kind).alias("category"), F.lit(what).alias("subtype")))])
    codes = F.array_distinct(F.transform(F.split("items", ","), F.trim))
    rows = filings.where("form = '8-K'").select("ticker", "filed", "accession", F.explode(codes).alias("item_code"))
    return rows.withColumn("_k", F.try_element_at(known, F.col("item_code"))).where("_k is not null").select("*", "_k.category", "_k.subtype").drop("_k")


def chart_bars(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Parallel arrays of a chart as bars; of one day's the last stays, bars without close go."""
    x = F.from_json(payload, CHART)
    names = ("timestamp", "open", "high", "low", "close", "volume")
    rows = payloads.select("ticker", F.posexplode(F.arrays_zip(*[x[n].alias(n) for n in names])).alias("i", "b")).where("b.close is not null")
    rows = rows.withColumn("date", F.timestamp_seconds("b.timestamp").cast("date"))
    order = Window.partitionBy("ticker", "date").orderBy(F.desc("i"))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("ticker", "date", *[F.col(f"b.{n}").alias(n) for n in names[1:]])


def chart_splits(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    x = F.from_json(payload, CHART)
    rows = payloads.select("ticker", F.explode(F.map_values(x["splits"])).alias("s"))
    return rows.where("s.denominator > 0 and s.numerator > 0").select("ticker", F.timestamp_seconds("s.date").cast("date").alias("date"), (F.col("s.numerator") / F.col("s.denominator")).alias("ratio"))


def series_csv(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Lines of date,value; a dot or nothing is missing, a header isn't a date."""
    lines = payloads.select("series_id", F.explode(F.split(payload, "\n")).alias("line")).select("series_id", F.split("line", ",").alias("p"))
    return lines.select("series_id", F.get("p", F.lit(0)).try_cast("date").alias("date"), F.get("p", F.lit(1)).try_cast("double").alias("value")).where("date is not null and value is not null")


def earnings_calendar(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows of an earnings calendar: money in brackets is negative, session times are normalised."""
    kind = "array<struct<symbol:string,date:string,time:string,eps:string>>"
    r = payloads.select(F.explode(F.from_json(payload, kind)).alias("r")).select("r.*")
    when = F.when(F.col("time").contains("pre"), "before").when(F.col("time").contains("after"), "after").otherwise("unknown")
    return r.select(F.col("symbol").alias("ticker"), F.col("date").cast("date").alias("report_date"), when.alias("session"), money(F.col("eps")).alias("eps_estimate"))


def page_views(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    r = payloads.select("ticker", F.explode(F.from_json(payload, "struct<items:array<struct<timestamp:string,views:double>>>")["items"]).alias("i"))
    return r.select("ticker", F.to_date(F.substring("i.timestamp", 1, 8), "yyyyMMdd").alias("date"), F.col("i.views").alias("wiki_views"))


HOLDINGS = "seriesName string, invstOrSec array<struct<name:string,assetCat:string,pctVal:string>>, _corrupt string"


def fund_holdings(payloads: DataFrame, securities: DataFrame, key: Column, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Equity lines of holdings reports (index_symbol, as_of, payload) as members, matched by company key; and rejects with a reason.

    Rejected are reports that aren't XML, equity lines whose name no security has, and lines whose
    name more than one has.  Lines of other kinds aren't asked for and are no rejects.
    """
    bare = F.regexp_replace(payload, r'\sxmlns(:\w+)?="[^"]*"', "")
    df = payloads.withColumn("_d", F.from_xml(bare, HOLDINGS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("_d").isNull() | F.col("_d._corrupt").isNotNull()
    lines = df.where(~broken).select("index_symbol", "as_of", F.explode("_d.invstOrSec").alias("h")).where("coalesce(h.assetCat, 'EC') = 'EC'")
    lines = lines.select("index_symbol", "as_of", F.col("h.name").alias("name"), company_key(F.col("h.name")).alias("_k"), F.col("h.pctVal").try_cast("double").alias("weight"))
    known = securities.select("ticker", key.alias("_k")).groupBy("_k").agg(F.min("ticker").alias("ticker"), F.count_distinct("ticker").alias("_n"))
    found = lines.join(known, "_k", "left").withColumn("reason", F.when(F.col("ticker").isNull(), "no such name").when(F.col("_n") > 1, "name of several"))
    members = found.where("reason is null").select("index_symbol", "as_of", "weight", "ticker")
    bad = df.where(broken).select("index_symbol", "as_of", F.lit(None).cast("string").alias("name"), F.lit("not XML").alias("reason"))
    return members, found.where("reason is not null").select("index_symbol", "as_of", "name", "reason").unionByName(bad)


def sound_bars(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars that can be right, and the others with the reason why they can't."""
    judged = bars.withColumn("reason", bad_bar())
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def positions_csv(payloads: DataFrame, aliases: dict[str, str], payload: str = "payload", needed: tuple[str, ...] = ("ticker", "shares")) -> tuple[DataFrame, DataFrame]:
    """Lines of files (file, payload) with a header whose names may be aliases, as positions; and rejects with a reason.

    A file without a needed column is rejected as a whole, a line whose ticker or number of shares
    can't be read on its own.
    """
    lines = payloads.withColumn("_l", F.split(payload, "\r?\n")).withColumn("_h", F.transform(F.split(F.get("_l", F.lit(0)), ","), lambda c: F.lower(F.trim(c))))
    known = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
    lines = lines.withColumn("_h", F.transform("_h", lambda c: F.coalesce(F.try_element_at(known, c), c)))
    lacks = F.array_except(F.array(*map(F.lit, needed)), F.coalesce("_h", F.array().cast("array<string>")))
    lines = lines.withColumn("_lacks", lacks)
    whole = lines.where(F.size("_lacks") > 0).select("file", F.lit(None).cast("int").alias("line"), F.concat(F.lit("no column "), F.array_join("_lacks", ", ")).alias("reason"))
    rows = lines.where(F.size("_lacks") == 0).select("file", "_h", F.posexplode("_l").alias("line", "_t")).where("line > 0 and trim(_t) <> ''").withColumn("_p", F.split("_t", ","))
    at = lambda name: F.when(F.array_contains("_h", name), F.trim(F.get("_p", F.array_position("_h", name).cast("int") - 1)))
    rows = rows.select("file", "line", normalize_ticker(at("ticker")).alias("ticker"), at("shares").try_cast("double").alias("shares"), at("cost_basis").try_cast("double").alias("cost_basis"))
    rows = rows.withColumn("reason", F.when(F.col("ticker").isNull(), "no ticker").when(F.col("shares").isNull(), "no shares"))
    return rows.where("reason is null").select("ticker", "shares", "cost_basis"), whole.unionByName(rows.where("reason is not null").select("file", "line", "reason"))
