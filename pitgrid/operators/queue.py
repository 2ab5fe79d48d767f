"""What to read first: reviews to write, reviews written, policy that bears on a name, and the digest of a closed market."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions.scalars import normalize_title
from pitgrid.operators.store import shared_folder, written


def review_order(todo: DataFrame, first: DataFrame) -> DataFrame:
    """Filings to review with their place: names of ``first`` (ticker, priority) by priority, then all others; the newest filing first, ties by accession and ticker."""
    df = todo.join(first.groupBy("ticker").agg(F.min("priority").alias("_p")), "ticker", "left")
    return placed(df, [F.asc_nulls_last("_p"), F.desc("filed"), "accession", "ticker"]).drop("_p")


def recent_reviews(reviews: DataFrame, own: DataFrame, since: str, until: str, day: str = "filed") -> DataFrame:
    """Reviews of the days from ``since`` to ``until`` with their place: own names first, then the strongest score, then the newest."""
    held = own.select("ticker").distinct().withColumn("own", F.lit(True))
    df = reviews.where(F.col(day).between(F.lit(since).cast("date"), F.lit(until).cast("date"))).join(held, "ticker", "left").fillna({"own": False})
    return placed(df, [F.desc("own"), F.desc_nulls_last(F.abs("score")), F.desc(day), "accession", "ticker"])


def placed(df: DataFrame, order: list) -> DataFrame:
    """Rows with their place in an order over all of them, without one task for all: places are counted within ranges and then run on.

    Spark sorts by range; the number of rows of each range is all that meets in one place.  The
    ranges are written, since sampling might draw them otherwise the next time.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, shared_folder(df.sparkSession))
    within = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = within.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return within.join(before, "_range").withColumn("place", (F.col("_in") + F.col("_before")).cast("long")).drop("_range", "_in", "_before")


def policy_asof(policies: DataFrame, as_of: str, days: int = 30, sector: str | None = None, theme: str | None = None) -> DataFrame:
    """Documents published in the days up to ``as_of``, of a sector and theme where they are named."""
    df = policies.where(F.col("published").between(F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")))
    df = df if sector is None else df.where(F.array_contains("sectors", sector))
    return df if theme is None else df.where(F.array_contains("themes", theme))


def affected(policies: DataFrame, securities: DataFrame, most: int = 40) -> DataFrame:
    """doc_id and the tickers it bears on: of each of its sectors the first ``most`` names, all together sorted and each once."""
    order = Window.partitionBy("sector").orderBy("ticker")
    names = securities.select("ticker", "sector").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    hit = policies.select("doc_id", F.explode("sectors").alias("sector")).distinct().join(names, "sector")
    tickers = hit.groupBy("doc_id").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    return policies.select("doc_id").distinct().join(tickers, "doc_id", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>")))


def closed_market_digest(news: DataFrame, last_close: str, now: str, watch: DataFrame, picks: DataFrame) -> DataFrame:
    """News since the market closed, each headline once with all its tickers, in three parts.

    ``watch`` if it names a watched ticker, else ``pick`` if it names a current pick, else
    ``material`` if it is material (a boolean column of ``news``); other headlines are left out.
    """
    df = news.where((F.col("published") > F.lit(last_close).cast("timestamp")) & (F.col("published") <= F.lit(now).cast("timestamp")))
    mark = lambda t, name: t.select("ticker").distinct().withColumn(name, F.lit(True))
    df = df.join(mark(watch, "_w"), "ticker", "left").join(mark(picks, "_k"), "ticker", "left")
    one = df.groupBy(normalize_title(F.col("title")).alias("title_key")).agg(
        F.array_sort(F.collect_set("ticker")).alias("tickers"), F.min("published").alias("published"), F.min_by("id", F.struct("published", "id")).alias("id"),
        F.max(F.coalesce("_w", F.lit(False))).alias("_w"), F.max(F.coalesce("_k", F.lit(False))).alias("_k"), F.max("material").alias("_m"),
    )
    part = F.when(F.col("_w"), "watch").when(F.col("_k"), "pick").when(F.col("_m"), "material")
    return one.withColumn("part", part).where("part is not null").drop("_w", "_k", "_m")
