"""Share counts of all filers by period, dated by the index of filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME = "struct<data:array<struct<accn:string,cik:bigint,end:string,val:double>>>"


def frame_names(as_of: str, back: int = 4) -> list[str]:
    """Names of the newest quarters' frames, newest first."""
    year, quarter = int(as_of[:4]), (int(as_of[5:7]) - 1) // 3
    return [f"CY{(4 * year + quarter - k) // 4}Q{(4 * year + quarter - k) % 4 + 1}I" for k in range(back)]


def counts(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """cik, accession, end, shares, frame and ``reason`` of all entries of frame payloads (frame, payload)."""
    df = payloads.withColumn("_f", F.from_json(payload, FRAME))
    bad = df.where(F.col("_f.data").isNull()).select(F.lit(None).cast("string").alias("cik"), F.lit(None).cast("string").alias("accession"), F.lit(None).cast("date").alias("end"), F.lit(None).cast("double").alias("shares"), "frame", F.lit("not a frame").alias("reason"))
    e = df.select("frame", F.explode("_f.data").alias("e"))
    rows = e.select(
        F.lpad(F.col("e.cik").cast("string"), 10, "0").alias("cik"), F.col("e.accn").alias("accession"), F.to_date(F.try_to_timestamp("e.end", F.lit("yyyy-MM-dd"))).alias("end"), F.col("e.val").alias("shares"), "frame",
        F.when(F.col("e.cik").isNull(), "no filer").when(F.coalesce(F.col("e.val"), F.lit(0.0)) == 0, "no count").when(F.try_to_timestamp("e.end", F.lit("yyyy-MM-dd")).isNull(), "no date").alias("reason"),
    )
    return rows.unionByName(bad)


def share_facts(entries: DataFrame, filings: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (ticker, concept, tag, period_start, period_end, filed, form, val) of each filer's newest count, and rejects with a reason.

    ``filings`` (accession, filed) dates a count by its accession; a count whose filing isn't
    indexed has no knowable date and is rejected, not guessed.  ``names`` are (cik, ticker).
    Of counts of one day the newest frame's counts, and of those the greatest accession's.
    """
    order = Window.partitionBy("cik").orderBy(F.desc("end"), F.desc("frame"), F.desc("accession"))
    good = entries.where("reason is null").withColumn("_r", F.row_number().over(order))
    newest = good.where("_r = 1").drop("_r")
    dated = newest.join(filings.groupBy("accession").agg(F.min("filed").alias("filed")), "accession", "left").join(names.select("cik", "ticker").distinct(), "cik", "left")
    dated = dated.withColumn("reason", F.when(F.col("ticker").isNull(), "unknown filer").when(F.col("filed").isNull(), "filing not indexed"))
    facts = dated.where("reason is null").select(
        "ticker", F.lit("shares_outstanding").alias("concept"), F.lit("EntityCommonStockSharesOutstanding").alias("tag"), F.col("end").alias("period_start"), F.col("end").alias("period_end"), "filed", F.lit("FRAME").alias("form"), F.col("shares").alias("val")
    )
    out = ("cik", "accession", "frame", "reason")
    return facts, entries.where("reason is not null").select(*out).unionByName(dated.where("reason is not null").select(*out))
