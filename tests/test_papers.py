"""Readers of documents and feeds, and what to read first, on small inputs."""

import datetime as dt
import json
from collections import Counter

from pyspark.sql import functions as F

from pitgrid.operators import queue, store
from pitgrid.operators import text as tx
from pitgrid.plans import papers as plan
from pitgrid.plans.fixtures import read
from pitgrid.sources import papers

SF = "/root/testdata/sf0.001"
T = dt.datetime.fromisoformat


def test_policies(spark):
    doc = lambda **k: {"document_number": "1", "title": "Tariff on pipes", "abstract": "an emission rule", "type": "Rule", "publication_date": "2024-01-05", "html_url": "u", "agencies": [{"name": "EPA", "slug": "environmental-protection-agency"}, {"name": "X"}]} | k
    page = json.dumps({"results": [doc(), doc(document_number=""), doc(document_number="2", publication_date="?"), doc(document_number="3", agencies=None, title=None, abstract="medicare", type="Notice")]})
    rows, bad = papers.policies(spark.createDataFrame([(1, page), (2, "[]"), (3, None)], "page int, payload string"))
    got = {r.doc_id: r for r in rows.collect()}
    assert got["1"].sectors == ["Energy", "Utilities", "Materials", "Industrials", "Consumer Discretionary"] and got["1"].themes == ["tariff", "energy"] and got["1"].agencies == "EPA; X" and got["1"].doc_type == "Final rule"
    assert got["3"].sectors == ["Health Care"] and got["3"].agencies == "" and set(got) == {"1", "3"}
    assert sorted((r.page, r.reason) for r in bad.collect()) == [(1, "no date"), (1, "no number"), (2, "not a page"), (3, "not a page")]
    sec = spark.createDataFrame([(f"T{i}", "Energy") for i in range(50)] + [("H", "Health Care")], "ticker string, sector string")
    hit = {r.doc_id: r.tickers for r in queue.affected(rows, sec).collect()}
    assert len(hit["1"]) == 40 and hit["3"] == ["H"]
    assert [r.doc_id for r in queue.policy_asof(rows, "2024-02-04", 30, theme="healthcare").collect()] == ["3"] and queue.policy_asof(rows, "2024-02-05", 30).count() == 0


def test_feeds(spark):
    now = T("2025-01-01T00:00:00")
    items = json.dumps([{"content": {"title": "A", "pubDate": "2024-01-01T10:00:00Z", "provider": {"displayName": "P"}, "canonicalUrl": {"url": "u"}, "summary": "s"}}, {"title": "B", "pubDate": "nonsense", "description": "d"}, {"title": " "}, {"content": {"title": "C", "displayTime": "2024-01-01T10:00:00+02:00"}}])
    good, bad = papers.news_items(spark.createDataFrame([("X", now, items), ("Y", now, "oops")], "ticker string, fetched_at timestamp, payload string"))
    got = {r.title: r for r in good.collect()}
    assert (got["A"].published, got["A"].source, got["A"].url, got["A"].body) == (T("2024-01-01T10:00:00"), "P", "u", "s")
    assert got["B"].published == now and got["B"].body == "d" and got["C"].published == T("2024-01-01T08:00:00")
    assert sorted((r.ticker, r.reason) for r in bad.collect()) == [("X", "no title"), ("Y", "not JSON")]
    feed = "<rss><channel><item><title>A</title><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><link>l</link></item><item><title>B</title><pubDate>1 Jan 2024 10:00:00 -0500</pubDate></item><item><title/></item><item><title>C</title><description>x &amp; y</description></item></channel></rss>"
    good, bad = papers.news_rss(spark.createDataFrame([("X", "w", now, feed), ("Y", "w", now, feed[:50])], "ticker string, source string, fetched_at timestamp, payload string"))
    got = {r.title: r for r in good.collect()}
    assert got["A"].published == T("2024-01-01T10:00:00") and got["B"].published == T("2024-01-01T15:00:00") and got["C"].published == now and got["C"].body == "x & y"
    assert sorted((r.ticker, r.reason) for r in bad.collect()) == [("X", "no title"), ("Y", "not XML")]


def test_failures_keep_the_last_success(spark):
    log = spark.createDataFrame([("s", "a", 1, 1, 10, None), ("s", "b", 1, None, None, "x")], "source string, key string, last_attempt int, last_success int, rows long, error string")
    tries = spark.createDataFrame([("s", "a", 2, 0, "down"), ("s", "b", 3, 7, None), ("s", "b", 2, 5, None), ("s", "c", 2, None, "down")], "source string, key string, at int, rows long, error string")
    got = sorted(map(tuple, store.record_ingest(log, tries).select("key", "last_attempt", "last_success", "rows", "error").collect()))
    assert got == [("a", 2, 1, 10, "down"), ("b", 3, 3, 7, None), ("c", 2, None, None, "down")]


def test_order_of_reviews(spark):
    todo = spark.createDataFrame([("A", "2024-01-01", 1), ("B", "2024-03-01", 2), ("C", "2024-02-01", 3), ("C", "2024-02-02", 4)], "ticker string, filed string, accession int")
    first = spark.createDataFrame([("C", 1), ("A", 2)], "ticker string, priority int")
    assert [r.accession for r in sorted(queue.review_order(todo, first).collect(), key=lambda r: r.place)] == [4, 3, 1, 2]
    reviews = spark.createDataFrame([("A", "2024-01-01", 1, 0.5), ("B", "2024-01-02", 2, -2.0), ("C", "2024-01-03", 3, 1.0), ("D", "2024-01-03", 4, None), ("E", "2025-01-03", 5, 9.0)], "ticker string, filed string, accession int, score double")
    got = queue.recent_reviews(reviews, spark.createDataFrame([("A",)], "ticker string"), "2024-01-01", "2024-12-31").collect()
    assert [r.accession for r in sorted(got, key=lambda r: r.place)] == [1, 2, 3, 4]
    many = spark.range(3000).selectExpr("cast(id % 7 as string) as ticker", "cast(id * 7919 % 3001 as string) as filed", "id as accession").repartition(8)
    rows = sorted(queue.review_order(many, first).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1, 3001)) and [r.filed for r in rows] == sorted((r.filed for r in rows), reverse=True)


def test_notes_in_order(spark):
    df = spark.createDataFrame([(["legal", "buyback"], "raised", "downgrade"), ([], None, None)], "e array<string>, g string, a string")
    got = [r.n for r in df.select(tx.direction_notes(F.col("e"), F.col("g"), F.col("a")).alias("n")).collect()]
    assert got == [["Management raised forward guidance", "Capital returning to shareholders via buyback", "Legal overhang", "Sell-side downgrade"], []]


def test_categories_against_a_loop(spark):
    news = {r.id: r.body or "" for r in read(spark, SF, "news").collect()}
    counts = Counter(w for b in news.values() for w in tokens(b))
    ranked = sorted(counts, key=lambda w: (-counts[w], w))[:100]
    kind = {w: plan.KINDS[i // 20] for i, w in enumerate(ranked)}
    turn = {"positive": "negative", "negative": "positive"}
    for r in plan.categories(spark, SF).collect():
        seen, last = Counter(), -9
        for i, w in enumerate(tokens(news[r.id])):
            if w in kind:
                seen[turn.get(kind[w], kind[w]) if i - last <= tx.REACH else kind[w]] += 1
            if w in tx.NEGATORS:
                last = i
        assert [r[k] for k in plan.KINDS] == [seen[k] for k in plan.KINDS] and r.words == len(tokens(news[r.id]))


def tokens(text):
    import re

    return [w for w in re.split("[^a-z]+", text.lower()) if w]


def test_digest_of_a_closed_market_against_a_loop(spark):
    news = [r for r in plan.headlines(spark, SF).collect() if T("2024-01-01T01:00:00") < r.published <= T("2024-01-01T03:00:00")]
    watch = {r.ticker for r in read(spark, SF, "positions").where("lot_id % 40 = 0").collect()}
    picks = {f"S{r.s_suppkey}" for r in read(spark, SF, "supplier").collect() if r.s_suppkey % 6 == 0}
    groups = {}
    for r in news:
        groups.setdefault(" ".join((r.title or "").lower().split()), []).append(r)
    want = []
    for rows in groups.values():
        names = {r.ticker for r in rows}
        part = "watch" if names & watch else "pick" if names & picks else "material" if any(r.material for r in rows) else None
        if part:
            first = min(rows, key=lambda r: (r.published, r.id))
            want.append((",".join(sorted(names)), first.id, part))
    got = [(r.tickers, r.id, r.part) for r in plan.closed_digest(spark, SF).collect()]
    assert sorted(got) == sorted(want) and got
