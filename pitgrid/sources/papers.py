"""Readers of policy documents, news feeds and filers' records: rows, and rejects with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.operators import identity, text as tx

POLICY = "struct<results:array<struct<document_number:string,title:string,abstract:string,type:string,publication_date:string,html_url:string,agencies:array<struct<name:string,slug:string>>>>>"
# What kinds of documents are called.
KINDS = {"Rule": "Final rule", "Proposed Rule": "Proposed rule", "Presidential Document": "Executive action", "Notice": "Notice"}
CONTENT = "title:string,pubDate:string,displayTime:string,summary:string,description:string,provider:struct<displayName:string>,canonicalUrl:struct<url:string>,clickThroughUrl:struct<url:string>"
ITEMS = f"array<struct<content:struct<{CONTENT}>,{CONTENT}>>"
RSS = "channel struct<item:array<struct<title:string,link:string,pubDate:string,description:string,summary:string>>>, _corrupt string"
RECORD = "struct<name:string,sic:string,sicDescription:string,exchanges:array<string>,addresses:struct<business:struct<country:string>>>"


def policies(payloads: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Documents of register pages (page, payload) with their agencies, themes and the sectors they bear on.

    Sectors are those of the agencies in their order, then those of the themes, each once.
    """
    df = payloads.withColumn("_p", F.from_json(payload, POLICY))
    d = df.select("page", F.posexplode("_p.results").alias("place", "d"))
    day = F.to_date(F.try_to_timestamp(F.substring("d.publication_date", 1, 10), F.lit("yyyy-MM-dd")))
    labels = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    list_of = lambda field: F.filter(F.transform(F.coalesce(F.col("d.agencies"), F.array().cast("array<struct<name:string,slug:string>>")), lambda a: a[field]), lambda x: F.coalesce(x, F.lit("")) != "")
    text = F.concat_ws(" ", "d.title", "d.abstract")
    rows = d.select(
        "page", "place", F.col("d.document_number").alias("doc_id"), day.alias("published"), F.coalesce(F.try_element_at(labels, F.col("d.type")), F.col("d.type")).alias("doc_type"), F.array_join(list_of("name"), "; ").alias("agencies"),
        F.col("d.title").alias("title"), F.col("d.abstract").alias("abstract"), F.coalesce("d.html_url", F.lit("")).alias("url"), tx.themes(text).alias("themes"), list_of("slug").alias("_slugs"),
    )
    rows = rows.withColumn("sectors", tx.policy_sectors(F.col("_slugs"), F.col("themes"))).drop("_slugs")
    rows = rows.withColumn("reason", F.when(F.coalesce("doc_id", F.lit("")) == "", "no number").when(F.col("published").isNull(), "no date"))
    bad = df.where(F.col("_p.results").isNull()).select("page", F.lit(None).cast("int").alias("place"), F.lit("not a page").alias("reason"))
    return rows.where("reason is null").drop("page", "place", "reason"), rows.where("reason is not null").select("page", "place", "reason").unionByName(bad)


def moment(text: Column) -> Column:
    """A time as feeds write it: ISO 8601, or a mail header's with or without the day of the week; NULL if it is neither."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    mail = [F.try_to_timestamp(bare, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm z")]
    return F.coalesce(F.when(bare.rlike(r"^\d{4}-"), bare.try_cast("timestamp")), F.when(~bare.rlike(r"^\d{4}-"), F.coalesce(*mail)))


def news_items(payloads: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Articles of JSON feeds (ticker, fetched_at, payload); their fields may lie under ``content``.

    An article without a readable time counts as of when it was fetched.
    """
    df = payloads.withColumn("_i", F.from_json(payload, ITEMS))
    rows = df.select("ticker", "fetched_at", F.posexplode("_i").alias("place", "i"))
    rows = rows.select("ticker", "fetched_at", "place", F.coalesce("i.content", F.struct(*[F.col(f"i.{f.split(':')[0]}").alias(f.split(":")[0]) for f in ("title", "pubDate", "displayTime", "summary", "description", "provider", "canonicalUrl", "clickThroughUrl")])).alias("c"))
    rows = rows.select(
        "ticker", "place", F.col("c.title").alias("title"), F.coalesce("c.canonicalUrl.url", "c.clickThroughUrl.url", F.lit("")).alias("url"), F.coalesce(moment(F.coalesce("c.pubDate", "c.displayTime")), "fetched_at").alias("published"),
        F.coalesce("c.provider.displayName", F.lit("unknown")).alias("source"), F.coalesce("c.summary", "c.description", F.lit("")).alias("body"),
    )
    return judged(rows, df.where(F.col("_i").isNull()).select("ticker", F.lit(None).cast("int").alias("place"), F.lit("not JSON").alias("reason")))


def news_rss(payloads: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Articles of RSS feeds (ticker, source, fetched_at, payload), like ``news_items``."""
    df = payloads.withColumn("_d", F.from_xml(payload, RSS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("_d").isNull() | F.col("_d._corrupt").isNotNull()
    rows = df.where(~broken).select("ticker", "source", "fetched_at", F.posexplode("_d.channel.item").alias("place", "i"))
    rows = rows.select("ticker", "place", F.col("i.title").alias("title"), F.coalesce("i.link", F.lit("")).alias("url"), F.coalesce(moment(F.col("i.pubDate")), "fetched_at").alias("published"), "source", F.coalesce("i.summary", "i.description", F.lit("")).alias("body"))
    return judged(rows, df.where(broken).select("ticker", F.lit(None).cast("int").alias("place"), F.lit("not XML").alias("reason")))


def judged(rows: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    untitled = F.trim(F.coalesce("title", F.lit(""))) == ""
    return rows.where(~untitled).drop("place"), rows.where(untitled).select("ticker", "place", F.lit("no title").alias("reason")).unionByName(broken)


def securities(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The security master from filers' records (ticker, filer, place, payload): of a ticker's filers the first in place that has a record.

    ticker, filer, name, sector (by industry code), industry, exchange, country.
    """
    df = payloads.withColumn("r", F.from_json(payload, RECORD)).where(F.coalesce("r.name", "r.sic", "r.sicDescription").isNotNull())
    order = Window.partitionBy("ticker").orderBy("place", "filer")
    first = df.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    industry = F.initcap(F.lower(F.trim("r.sicDescription")))
    return first.select(
        "ticker", "filer", F.coalesce("r.name", "ticker").alias("name"), identity.sector_of_code(F.col("r.sic")).alias("sector"), F.when(industry != "", industry).alias("industry"), F.get("r.exchanges", F.lit(0)).alias("exchange"),
        F.coalesce("r.addresses.business.country", F.lit("US")).alias("country"),
    )


def gaps_filled(master: DataFrame, vendor: DataFrame, fields: tuple[str, ...] = ("sector", "industry", "exchange", "country")) -> DataFrame:
    """``master`` with what it lacks taken from ``vendor`` (ticker and fields): only fields that are NULL or Unknown change; names that only the vendor has don't come in."""
    v = vendor.select("ticker", *[F.col(f).alias(f"_{f}") for f in fields])
    lacks = lambda f: F.col(f).isNull() | (F.col(f) == "Unknown")
    known = lambda f: F.when(F.col(f"_{f}") != "Unknown", F.col(f"_{f}"))
    return master.join(v, "ticker", "left").select(*[F.when(lacks(c), F.coalesce(known(c), F.col(c))).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in master.columns])
