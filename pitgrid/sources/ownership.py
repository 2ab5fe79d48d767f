"""Ownership documents: nested tables of transactions with footnotes, as rows and as rejects with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions.scalars import once, safe_div

NOTE = "footnoteId:array<struct<_id:string>>"
CELL = f"struct<value:string,{NOTE}>"
TRANSACTION = (
    f"struct<securityTitle:{CELL},transactionDate:{CELL},transactionCoding:struct<transactionCode:string,{NOTE}>,"
    f"transactionAmounts:struct<transactionShares:{CELL},transactionPricePerShare:{CELL},transactionAcquiredDisposedCode:{CELL}>,"
    f"postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{CELL}>,{NOTE}>"
)
OWNER = "struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,officerTitle:string>>"
DOCUMENT = (
    f"issuer struct<issuerCik:string>, reportingOwner array<{OWNER}>, aff10b5One string, nonDerivativeTable struct<nonDerivativeTransaction:array<{TRANSACTION}>>,"
    f" derivativeTable struct<derivativeTransaction:array<{TRANSACTION}>>, footnotes struct<footnote:array<struct<_VALUE:string,_id:string>>>, remarks string, _corrupt string"
)
# What a footnote says of a trade that was no decision of the day.
PLANNED = r"(?i)10b5\s*-\s*1"
MECHANICAL = r"(?i)employee stock purchase|\bespp\b|dividend reinvest|\bdrip\b|401\s*\(?k\)?|deferred compensation|sell[- ]to[- ]cover|sold to cover|(?:satisfy|cover)\w*\s+(?:the\s+)?(?:\w+\s+)?tax\s+withholding"
ROLES = (("isDirector", "Director"), ("isOfficer", "Officer"), ("isTenPercentOwner", "10% Owner"))


def is_true(flag: Column) -> Column:
    return F.coalesce(F.lower(F.trim(flag)).isin("1", "true", "yes", "y"), F.lit(False))


def number(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def documents(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload rows (accession, ticker, cik, filed) with the parsed document ``d`` and ``reason``, why it can't be used, or NULL.

    A document of another issuer is one that the company filed as an owner of somebody else.
    """
    bare = F.regexp_replace(payload, r'\sxmlns(:\w+)?="[^"]*"', "")
    # parsed once: as a plain column it would be parsed again in each condition that asks for the reason
    df = payloads.select("*", once(d=F.from_xml(bare, DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "attributePrefix": "_", "valueTag": "_VALUE"})))
    issuer, own = F.trim("d.issuer.issuerCik").try_cast("long"), F.trim(F.col("cik").cast("string")).try_cast("long")
    transactions = F.coalesce(F.size("d.nonDerivativeTable.nonDerivativeTransaction"), F.lit(0)) + F.coalesce(F.size("d.derivativeTable.derivativeTransaction"), F.lit(0))
    return df.withColumn(
        "reason",
        F.when(F.col(payload).isNull() | (F.trim(payload) == ""), "empty").when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), "not XML")
        .when(issuer != own, "another issuer").when(transactions == 0, "no transactions"),
    )


def transactions(parsed: DataFrame) -> DataFrame:
    """A row for each transaction of both tables of usable documents, in document order, with ``reason`` where it has no code."""
    d = parsed.where("reason is null")
    tag = lambda path, kind: F.transform(F.coalesce(F.col(path), F.array().cast(f"array<{TRANSACTION}>")), lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), t.alias("t")))
    both = F.concat(tag("d.nonDerivativeTable.nonDerivativeTransaction", "non-derivative"), tag("d.derivativeTable.derivativeTransaction", "derivative"))
    owner = F.get("d.reportingOwner", F.lit(0))
    relation = owner["reportingOwnerRelationship"]
    roles = F.array_compact(F.array(*[F.when(is_true(relation[k]), F.lit(v)) for k, v in ROLES], F.when(F.trim(relation["officerTitle"]) != "", F.trim(relation["officerTitle"]))))
    planned = is_true(F.col("d.aff10b5One")) | F.coalesce(F.col("d.remarks").rlike(PLANNED), F.lit(False))
    df = d.select(
        "accession", "ticker", "cik", "filed", F.coalesce(owner["reportingOwnerId"]["rptOwnerName"], F.lit("unknown")).alias("insider"), F.when(F.size(roles) > 0, F.array_join(roles, ", ")).alias("role"),
        planned.alias("_planned"), F.col("d.footnotes.footnote").alias("_notes"), F.explode(both).alias("x"),
    )
    t = F.col("x.t")
    amounts, none = t["transactionAmounts"], F.array().cast("array<struct<_id:string>>")
    places = (
        t["footnoteId"], t["securityTitle"]["footnoteId"], t["transactionDate"]["footnoteId"], t["transactionCoding"]["footnoteId"], amounts["transactionShares"]["footnoteId"],
        amounts["transactionPricePerShare"]["footnoteId"], amounts["transactionAcquiredDisposedCode"]["footnoteId"], t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"]["footnoteId"],
    )
    asked = F.transform(F.flatten(F.array(*[F.coalesce(p, none) for p in places])), lambda n: n["_id"])
    notes = F.array_join(F.transform(F.filter(F.coalesce(F.col("_notes"), F.array().cast("array<struct<_VALUE:string,_id:string>>")), lambda n: F.array_contains(asked, n["_id"])), lambda n: n["_VALUE"]), " ")
    shares, sign = number(amounts["transactionShares"]["value"]), F.trim(amounts["transactionAcquiredDisposedCode"]["value"])
    code = F.trim(t["transactionCoding"]["transactionCode"])
    df = df.select(
        "accession", "ticker", "cik", "filed", "insider", "role", F.col("x.kind").alias("kind"), F.col("x.place").alias("place"),
        F.coalesce(F.substring(F.trim(t["transactionDate"]["value"]), 1, 10).try_cast("date"), F.col("filed")).alias("txn_date"), code.alias("txn_code"), sign.alias("direction"),
        F.when(sign == "D", -F.abs(shares)).otherwise(shares).alias("shares"), number(amounts["transactionPricePerShare"]["value"]).alias("price"),
        number(t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"]["value"]).alias("post_txn_shares"), notes.alias("notes"), "_planned",
    )
    flags = F.array_compact(F.array(F.when(F.col("_planned") | F.col("notes").rlike(PLANNED), F.lit("10b5-1")), F.when(F.col("notes").rlike(MECHANICAL), F.lit("plan"))))
    return df.withColumn("flags", flags).withColumn("reason", F.when(F.coalesce(F.col("txn_code"), F.lit("")) == "", "no code")).drop("_planned", "notes")


def trades(rows: DataFrame, kind: str = "non-derivative") -> DataFrame:
    """Lots of one document, person, day, code and direction as one trade.

    Shares and value are sums, the price is their quotient, the holding is that after the last
    lot, flags are united; a sale on a day with an option exercise in the document is flagged too.
    """
    day = Window.partitionBy("accession", "kind", "txn_date")
    exercised = (F.col("txn_code") == "S") & (F.max((F.col("txn_code") == "M").cast("int")).over(day) == 1)
    df = rows.where((F.col("kind") == kind) & F.col("reason").isNull()).withColumn("flags", F.when(exercised, F.array_append("flags", F.lit("exercise"))).otherwise(F.col("flags")))
    value = F.when((F.col("price") != 0) & F.col("shares").isNotNull(), F.abs("shares") * F.col("price"))
    out = df.groupBy("accession", "ticker", "cik", "filed", "insider", "role", "txn_date", "txn_code", "direction").agg(
        F.sum("shares").alias("shares"), F.sum(value).alias("value"), F.max_by("post_txn_shares", "place").alias("post_txn_shares"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))), ",").alias("flags"), F.count(F.lit(1)).alias("lots"),
    )
    return out.withColumns({"price": safe_div(F.col("value"), F.abs("shares")), "flags": F.when(F.col("flags") != "", F.col("flags"))})


def rejects(parsed: DataFrame, rows: DataFrame) -> DataFrame:
    """accession, place and reason of documents and transactions that gave no row."""
    whole = parsed.where("reason is not null").select("accession", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("place"), "reason")
    return whole.unionByName(rows.where("reason is not null").select("accession", "kind", "place", "reason"))
