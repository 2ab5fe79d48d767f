"""Readers of landed payloads on small payloads: what becomes a row and what is rejected, and why."""

from pyspark.sql import functions as F

from pitgrid.functions.scalars import company_key
from pitgrid.sources import frames, landed, ownership

TXN = """<{t}Transaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>{day}</value></transactionDate>
<transactionCoding><transactionCode>{code}</transactionCode>{note}</transactionCoding><transactionAmounts><transactionShares><value>{shares}</value></transactionShares>
<transactionPricePerShare><value>{price}</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>{dir}</value></transactionAcquiredDisposedCode></transactionAmounts>
<postTransactionAmounts><sharesOwnedFollowingTransaction><value>{post}</value></sharesOwnedFollowingTransaction></postTransactionAmounts></{t}Transaction>"""
DOC = """<?xml version="1.0"?><ownershipDocument xmlns="http://x/y"><issuer><issuerCik>{issuer}</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerName>Doe J</rptOwnerName></reportingOwnerId>
<reportingOwnerRelationship><isDirector>true</isDirector><isOfficer>1</isOfficer><isTenPercentOwner>0</isTenPercentOwner><officerTitle> CEO </officerTitle></reportingOwnerRelationship></reportingOwner>
<aff10b5One>{box}</aff10b5One><nonDerivativeTable>{plain}</nonDerivativeTable><derivativeTable>{other}</derivativeTable>
<footnotes><footnote id="F1">Acquired under the ESPP</footnote><footnote id="F2">pursuant to a 10b5-1 plan</footnote><footnote id="F3">weighted average price</footnote></footnotes><remarks>{remarks}</remarks></ownershipDocument>"""


def txn(code, shares, price, dir="A", post="", day="2024-03-01", note="", t="nonDerivative"):
    return TXN.format(t=t, code=code, shares=shares, price=price, dir=dir, post=post, day=day, note=note)


def read(spark, **docs):
    rows = spark.createDataFrame([(k, "X", "0000000042", "2024-03-04", v) for k, v in docs.items()], "accession string, ticker string, cik string, filed string, payload string")
    parsed = ownership.documents(rows.withColumn("filed", F.col("filed").cast("date")))
    lines = ownership.transactions(parsed)
    return {(r.accession, r.txn_code, r.direction): r for r in ownership.trades(lines).collect()}, sorted((r.accession, r.kind, r.place, r.reason) for r in ownership.rejects(parsed, lines).collect()), lines


def doc(plain="", other="", issuer="42", box="0", remarks=""):
    return DOC.format(issuer=issuer, box=box, plain=plain, other=other, remarks=remarks)


def test_lots_become_one_trade(spark):
    got, bad, _ = read(spark, a=doc(txn("S", "100", "10.0", "D", "900") + txn("S", "300", "12.0", "D", "600") + txn("P", "1,000", "", "A", "1600")))
    sale = got["a", "S", "D"]
    assert (sale.shares, sale.value, sale.price, sale.post_txn_shares, sale.lots, sale.flags) == (-400.0, 4600.0, 11.5, 600.0, 2, None)
    assert (got["a", "P", "A"].shares, got["a", "P", "A"].value, got["a", "P", "A"].price) == (1000.0, None, None)
    assert sale.role == "Director, Officer, CEO" and sale.insider == "Doe J" and not bad


def test_flags_come_from_box_remarks_footnotes_and_exercises(spark):
    got, _, _ = read(
        spark,
        box=doc(txn("P", "1", "1"), box="true"), remarks=doc(txn("P", "1", "1"), remarks="Rule 10B5 - 1 plan"), espp=doc(txn("P", "1", "1", note='<footnoteId id="F1"/>')),
        both=doc(txn("P", "1", "1", note='<footnoteId id="F2"/><footnoteId id="F1"/>')), other=doc(txn("P", "1", "1", note='<footnoteId id="F3"/><footnoteId id="F9"/>')),
        exercise=doc(txn("M", "5", "0") + txn("S", "5", "9", "D")), later=doc(txn("M", "5", "0") + txn("S", "5", "9", "D", day="2024-03-02")),
    )
    flags = {k[0]: r.flags for k, r in got.items() if k[1] != "M"}
    assert flags == {"box": "10b5-1", "remarks": "10b5-1", "espp": "plan", "both": "10b5-1,plan", "other": None, "exercise": "exercise", "later": None}


def test_what_gives_no_row_has_a_reason(spark):
    got, bad, lines = read(
        spark, cut=doc(txn("P", "1", "1"))[:300], none=None, blank=" ", owner=doc(txn("P", "1", "1"), issuer="7"), nothing=doc(), code=doc(txn("", "1", "1") + txn("P", "2", "1", day="")), text="no xml at all",
        derivative=doc(other=txn("M", "3", "1", t="derivative")),
    )
    assert bad == [("blank", None, None, "empty"), ("code", "non-derivative", 0, "no code"), ("cut", None, None, "not XML"), ("none", None, None, "empty"), ("nothing", None, None, "no transactions"), ("owner", None, None, "another issuer"), ("text", None, None, "not XML")]
    assert set(got) == {("code", "P", "A")} and str(got["code", "P", "A"].txn_date) == "2024-03-04"
    assert ownership.trades(lines, "derivative").count() == 1


def test_share_counts_are_the_newest_and_dated(spark):
    entry = lambda cik, end, val, accn="a1": f'{{"accn":"{accn}","cik":{cik},"end":"{end}","val":{val}}}'
    frame = lambda name, *e: (name, '{"data":[' + ",".join(e) + "]}")
    files = spark.createDataFrame([frame("CY2024Q1I", entry(1, "2024-03-31", 10), entry(2, "2024-03-31", 5, "a2"), entry(3, "2024-03-31", 0)), frame("CY2024Q2I", entry(1, "2024-06-30", 11, "a3"), entry(4, "2024-06-30", 7, "a4"), entry(2, "soon", 7)), ("CY2024Q3I", "<html>")], "frame string, payload string")
    filings = spark.createDataFrame([("a2", "2024-04-20"), ("a3", "2024-07-20"), ("a3", "2024-07-25")], "accession string, filed string").withColumn("filed", F.col("filed").cast("date"))
    names = spark.createDataFrame([("0000000001", "ONE"), ("0000000002", "TWO"), ("0000000004", "FOUR")], "cik string, ticker string")
    facts, bad = frames.share_facts(frames.counts(files), filings, names)
    assert sorted((r.ticker, r.val, str(r.filed), str(r.period_end)) for r in facts.collect()) == [("ONE", 11.0, "2024-07-20", "2024-06-30"), ("TWO", 5.0, "2024-04-20", "2024-03-31")]
    assert sorted((r.cik or "", r.reason) for r in bad.collect()) == [("", "not a frame"), ("0000000002", "no date"), ("0000000003", "no count"), ("0000000004", "filing not indexed")]
    assert frames.frame_names("2024-02-10") == ["CY2024Q1I", "CY2023Q4I", "CY2023Q3I", "CY2023Q2I"]


def test_holdings_are_reconciled(spark):
    line = lambda name, cat="EC", pct="0.5": f"<invstOrSec><name>{name}</name><assetCat>{cat}</assetCat><pctVal>{pct}</pctVal></invstOrSec>"
    report = "<r>" + line("SMITH A O CORP") + line("Applied Materials INC /DE") + line("Twin Class A") + line("Nobody") + line("A Bond", "DBT") + line("AT&amp;T Inc", pct="x") + "</r>"
    files = spark.createDataFrame([("I", "2024-01-31", report), ("I", "2024-02-29", report[:80]), ("I", "2024-03-31", None)], "index_symbol string, as_of string, payload string")
    sec = spark.createDataFrame([("AOS", "A O Smith Corp"), ("AMAT", "Applied Materials"), ("TW1", "Twin Co"), ("TW2", "Twin Inc"), ("T", "AT and T")], "ticker string, name string")
    good, bad = landed.fund_holdings(files, sec, company_key(F.col("name")))
    assert sorted((r.ticker, r.weight) for r in good.collect()) == [("AMAT", 0.5), ("AOS", 0.5), ("T", None)]
    assert sorted((r.as_of, r.name or "", r.reason) for r in bad.collect()) == [("2024-01-31", "Nobody", "no such name"), ("2024-01-31", "Twin Class A", "name of several"), ("2024-02-29", "", "not XML"), ("2024-03-31", "", "not XML")]


def test_positions_and_bars(spark):
    files = spark.createDataFrame([("f", "Symbol,Qty\nabc,5\n,1\nx y,2\nabc,many\n"), ("g", "a,b\n1,2"), ("h", None)], "file string, payload string")
    good, bad = landed.positions_csv(files, {"symbol": "ticker", "qty": "shares"})
    assert [(r.ticker, r.shares, r.cost_basis) for r in good.collect()] == [("ABC", 5.0, None)]
    assert sorted((r.file, r.line or 0, r.reason) for r in bad.collect()) == [("f", 2, "no ticker"), ("f", 3, "no ticker"), ("f", 4, "no shares"), ("g", 0, "no column ticker, shares"), ("h", 0, "no column ticker, shares")]
    bars = spark.createDataFrame([("A", 10.0, 9.0, 9.5, 1.0), ("B", 10.0, 9.0, 11.0, 1.0), ("C", 10.0, 9.0, None, 1.0), ("D", 10.0, 9.0, 9.5, -1.0), ("E", None, None, 9.5, None)], "ticker string, high double, low double, close double, volume double")
    good, bad = landed.sound_bars(bars)
    assert sorted(r.ticker for r in good.collect()) == ["A", "E"]
    assert {r.ticker: r.reason for r in bad.collect()} == {"B": "close outside range", "C": "no close", "D": "negative volume"}
