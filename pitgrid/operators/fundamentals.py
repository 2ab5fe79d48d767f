"""Fundamentals from restated filings: rows (ticker, concept, tag, period_start, period_end, filed, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions.scalars import cagr, growth, once, raw_div, safe_div  # noqa: F401

FORMS = ("10-Q", "10-Q/A", "10-K", "10-K/A", "20-F", "20-F/A")
FRESH_DAYS = 500


def span_class(days: Column) -> Column:
    """What a period of so many days is: Q, H, 9M or A."""
    return F.when(days.between(60, 115), "Q").when(days.between(150, 220), "H").when(days.between(240, 310), "9M").when(days.between(330, 400), "A")


def known_at(facts: DataFrame, dates: DataFrame) -> DataFrame:
    """Every fact with each as-of date by which it was filed, of the financial forms.

    The dates are one row, which each name's facts of a concept get: facts dealt by ticker stay
    where they are, and nothing that follows by (as_of, ticker) shuffles facts times dates.  The
    rows come in order of name, concept, date, tag and period, which leaves later sorts little.
    """
    asked = F.broadcast(dates.agg(F.sort_array(F.collect_set("as_of")).alias("_d")))  # one row
    first = [c for c in ("tag", "period_start", "period_end", "filed") if c in facts.columns]
    rest = first + [c for c in facts.columns if c not in (*first, "ticker", "concept")]
    own = facts.where(F.col("form").isin(*FORMS)).groupBy("ticker", "concept").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("_f"))
    rows = own.join(asked).select("ticker", "concept", "_f", F.explode("_d").alias("as_of")).select("ticker", "concept", "as_of", F.explode("_f").alias("_x"))
    return rows.where("_x.filed <= as_of").select("as_of", "ticker", "concept", *[F.col(f"_x.{c}") for c in rest])


def split_restated(facts: DataFrame, splits: DataFrame, shares: tuple[str, ...], per_share: tuple[str, ...]) -> DataFrame:
    """Share counts times, and per-share values over, the product of split ratios after the filing and by the as-of date."""
    own = splits.groupBy("ticker").agg(F.collect_list(F.struct("date", "ratio")).alias("_s"))
    after = F.filter("_s", lambda s: (s["date"] > F.col("filed")) & (s["date"] <= F.col("as_of")))
    f = F.when(F.col("_s").isNotNull(), F.aggregate(after, F.lit(1.0), lambda a, s: a * F.coalesce(s["ratio"], F.lit(1.0)))).otherwise(F.lit(1.0))
    val = F.when(F.col("concept").isin(*shares), F.col("val") * f).when(F.col("concept").isin(*per_share), F.col("val") / f).otherwise(F.col("val"))
    return facts.join(own, "ticker", "left").withColumn("val", val).drop("_s")


def single_tag(facts: DataFrame, recent_days: int = 365, at: str = "as_of") -> DataFrame:
    """Per (``at``, ticker, concept) the rows of one tag: of those filed near the newest, the one of largest median size."""
    own, group = Window.partitionBy("ticker", "concept", at, "tag"), Window.partitionBy("ticker", "concept", at)
    df = facts.withColumn("_last", F.max("filed").over(own))
    df = df.withColumns({"_newest": F.max("_last").over(group), "_many": F.min("tag").over(group) != F.max("tag").over(group)})
    # where there is one tag only, its size doesn't matter
    df = df.withColumn("_scale", F.median(F.when(F.col("_many"), F.abs("val"))).over(own))
    best = F.max(F.when(F.datediff("_newest", "_last") <= recent_days, F.struct("_scale", "tag"))).over(group)
    return df.withColumn("_best", best).where("tag = _best.tag").drop("_last", "_newest", "_many", "_scale", "_best")


def latest_version(facts: DataFrame, *keys: str) -> DataFrame:
    """The newest filed row of each period, whole."""
    w = Window.partitionBy("ticker", "concept", "as_of", *keys).orderBy(F.desc("filed"), F.desc("val"))
    return facts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def flow_periods(facts: DataFrame) -> DataFrame:
    """Quarterly values of flows, and with ``year`` true the values of reported years, of one pass over the facts.

    Quarters are reported ones, and differences of cumulative reports of one start.  A value that
    is over ten times the one of a year before with the sign turned is suspect and NULL.
    """
    one = latest_version(facts, "period_start", "period_end").withColumn("span", span_class(F.datediff("period_end", "period_start"))).where("span is not null")
    w = Window.partitionBy("ticker", "concept", "as_of", "period_start").orderBy("period_end")
    step = one.withColumns({"_e": F.lag("period_end").over(w), "_v": F.lag("val").over(w), "_f": F.lag("filed").over(w)})
    gap = F.datediff("period_end", "_e")
    # one row gives one quarter at most: its own, or what it has over the report before
    own, made = F.col("span") == "Q", F.col("span").isin("H", "9M", "A") & gap.between(60, 115)
    row = lambda year, filed, val: F.struct(F.lit(year).alias("year"), filed.alias("filed"), val.alias("val"))
    quarter = row(False, F.when(own, F.col("filed")).otherwise(F.greatest("filed", "_f")), F.when(own, F.col("val")).otherwise(F.col("val") - F.col("_v")))
    given = F.array_compact(F.array(F.when(own | made, quarter), F.when(F.col("span") == "A", row(True, F.col("filed"), F.col("val")))))
    rows = step.select("as_of", "ticker", "concept", "period_end", F.explode(given).alias("_x")).select("as_of", "ticker", "concept", "period_end", "_x.*")
    both = latest_version(rows, "year", "period_end")
    order = Window.partitionBy("ticker", "concept", "as_of", "year").orderBy("period_end")
    ago = F.lag("val", 4).over(order)
    suspect = ~F.col("year") & (ago != 0) & (F.abs(F.col("val") / ago) > 10) & (F.col("val") * ago < 0)
    return both.withColumn("val", F.when(F.coalesce(suspect, F.lit(False)), None).otherwise(F.col("val")))


def flow_quarters(facts: DataFrame) -> DataFrame:
    """The quarters of ``flow_periods``."""
    return flow_periods(facts).where("not year").select("as_of", "ticker", "concept", "period_end", "filed", "val")


def trailing(quarters: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Per (as_of, ticker, concept): ttm, and the same one, two, three years before.

    ttm is the sum of the last four quarters, else the latest year reported, else NULL.  Years are
    those of ``facts``, or where none are given those among the ``quarters`` (``flow_periods``),
    which then need no second look at the facts.
    """
    by = ["as_of", "ticker", "concept"]
    if facts is not None:
        year = latest_version(facts, "period_start", "period_end").where(span_class(F.datediff("period_end", "period_start")) == "A")
        columns = [*by, "period_end", "filed", "val", "year"]
        quarters = quarters.withColumn("year", F.lit(False)).select(columns).unionByName(year.withColumn("year", F.lit(True)).select(columns))
    kind = Window.partitionBy("ticker", "concept", "as_of", "year")
    q = quarters.withColumn("_k", F.when(~F.col("year"), F.count(F.lit(1)).over(kind) - F.row_number().over(kind.orderBy("period_end")) + 1))
    take = lambda n: F.when(F.count(F.when(F.col("_k").between(4 * n + 1, 4 * n + 4), 1)) == 4, F.sum(F.when(F.col("_k").between(4 * n + 1, 4 * n + 4), F.col("val"))))
    sums = q.groupBy(*by).agg(
        *[take(n).alias(f"y{n}") for n in range(4)], F.max(F.when(~F.col("year"), F.col("filed"))).alias("filed"),
        F.max_by("val", F.when(F.col("year"), F.struct("period_end", "filed"))).alias("annual"),
    )
    return sums.select(*by, F.coalesce("y0", "annual").alias("ttm"), "y1", "y2", "y3", "filed")


def stocks(facts: DataFrame) -> DataFrame:
    """Latest value of stock concepts, its filing date, and the value one and three years before."""
    by = ["as_of", "ticker", "concept"]
    last = F.max("period_end").over(Window.partitionBy("ticker", "concept", "as_of"))
    df = latest_version(facts, "period_end").withColumn("_m", last)
    at = lambda n: F.max_by("val", F.when(F.col("period_end") <= F.add_months("_m", -12 * n), F.col("period_end")))
    return df.groupBy(*by).agg(F.max_by("val", "period_end").alias("now"), F.max_by("filed", "period_end").alias("filed"), at(1).alias("y1"), at(3).alias("y3"))


def surprise(quarters: DataFrame, concept: str = "eps_diluted") -> DataFrame:
    """Change of the last quarter on the year before, over the deviation of up to seven changes before it."""
    w = Window.partitionBy("ticker", "as_of").orderBy("period_end")
    q = quarters.where(F.col("concept") == concept).withColumn("chg", F.col("val") - F.lag("val", 4).over(w))
    before = w.rowsBetween(-7, -1)
    q = q.withColumns({"sd": F.stddev_samp("chg").over(before), "k": F.count("chg").over(before), "n": F.row_number().over(w)})
    out = q.groupBy("as_of", "ticker").agg(F.max_by(F.struct("chg", "sd", "k", "n", "filed"), "period_end").alias("x"))
    return out.select("as_of", "ticker", F.when((F.col("x.n") >= 8) & (F.col("x.k") >= 4), safe_div(F.col("x.chg"), F.col("x.sd"))).alias("sue"), F.col("x.filed").alias("sue_filed"))


def calendar(dates: DataFrame) -> DataFrame:
    """One row: the as-of dates in order, and for every day from the first to the last how many of them lie before it."""
    asked = dates.agg(F.sort_array(F.collect_set("as_of")).alias("_d"))
    days = F.sequence(F.get("_d", F.lit(0)), F.get("_d", F.size("_d") - 1))
    return asked.select("_d", F.transform(days, lambda day: F.size(F.filter("_d", lambda d: d < day))).alias("_at"))


def first_date(day: Column) -> Column:
    """The number of the first as-of date that sees ``day``, beside a ``calendar``; NULL if none does."""
    return F.when(day.isNotNull(), F.get("_at", F.greatest(F.datediff(day, F.get("_d", F.lit(0))), F.lit(0))))


def known_spans(facts: DataFrame, dates: DataFrame, splits: DataFrame, shares: tuple[str, ...], per_share: tuple[str, ...], keys: tuple[str, ...] = ("period_start", "period_end")) -> DataFrame:
    """Each fact with the numbers of the as-of dates that it holds for, from ``since`` up to before ``till``.

    What ``known_at``, ``split_restated``, ``single_tag`` and ``latest_version`` by ``keys`` give for
    every date, as intervals: a fact holds from its filing to the next version's, in parts where a split
    changes it.  Where a concept has several tags, which of them counts is looked at date by date.
    """
    asked = F.broadcast(calendar(dates))  # one row
    cuts = splits.join(asked).select("ticker", F.struct("date", "ratio", first_date(F.col("date")).alias("at")).alias("s")).where("s.at is not null").groupBy("ticker").agg(F.collect_list("s").alias("_s"))
    version = Window.partitionBy("ticker", "concept", "tag", *keys).orderBy("filed", "val")
    group = Window.partitionBy("ticker", "concept")
    df = facts.where(F.col("form").isin(*FORMS)).join(asked).withColumns({"since": first_date(F.col("filed")), "_n": F.size("_d")}).drop("_d", "_at").where("since is not null")
    df = df.withColumns({"till": F.coalesce(F.lead("since").over(version), "_n"), "_mixed": F.min("tag").over(group) != F.max("tag").over(group)})
    # which of several tags counts depends on the older versions too
    df = df.where("_mixed or since < till").join(cuts, "ticker", "left")
    moved = F.col("_s").isNotNull() & F.col("concept").isin(*shares, *per_share)
    later = lambda test: F.filter("_s", lambda s: (s["date"] > F.col("filed")) & test(s["at"]))
    turns = F.transform(later(lambda at: (at > F.col("since")) & (at < F.col("till"))), lambda s: s["at"])
    starts = F.when(F.col("_mixed"), F.sequence("since", F.col("_n") - 1)).when(moved, F.array_distinct(F.concat(F.array("since"), turns))).otherwise(F.array("since"))
    df = df.withColumn("_f", starts).withColumn("_from", F.explode_outer("_f")).drop("_f")
    ends = F.when(F.col("_mixed"), F.col("_from") + 1).when(moved, F.array_min(F.transform(later(lambda at: at > F.col("_from")), lambda s: s["at"])))
    f = F.when(moved, F.aggregate(later(lambda at: at <= F.col("_from")), F.lit(1.0), lambda a, s: a * F.coalesce(s["ratio"], F.lit(1.0)))).otherwise(F.lit(1.0))
    val = F.when(F.col("concept").isin(*shares), F.col("val") * f).when(F.col("concept").isin(*per_share), F.col("val") / f).otherwise(F.col("val"))
    df = df.withColumns({"val": val, "till": F.least("till", ends), "_slot": F.when(F.col("_mixed"), F.col("_from"))})
    return single_tag(df, at="_slot").where("_from < till").select("ticker", "concept", "period_start", "period_end", "filed", "val", F.col("_from").alias("since"), "till")


def flow_spans(known: DataFrame) -> DataFrame:
    """Quarters of flows, and with ``year`` true reported years, of the as-of dates they hold for; like ``flow_periods``, but of one period several may hold."""
    one = known.withColumn("span", span_class(F.datediff("period_end", "period_start"))).where("span is not null")
    shorter = Window.partitionBy("ticker", "concept", "period_start").orderBy(F.unix_date("period_end")).rangeBetween(Window.unboundedPreceding, -1)
    df = one.withColumn("_p", F.collect_list(F.struct("period_end", "filed", "val", "since", "till")).over(shorter))
    summed = F.col("span") != "Q"
    turns = F.concat(F.transform("_p", lambda p: p["since"]), F.transform("_p", lambda p: p["till"]))
    starts = F.array_distinct(F.concat(F.array("since"), F.filter(turns, lambda t: (t > F.col("since")) & (t < F.col("till")))))
    df = df.withColumn("_from", F.explode(F.when(summed, starts).otherwise(F.array("since"))))
    holds = F.filter("_p", lambda p: (p["since"] <= F.col("_from")) & (p["till"] > F.col("_from")))
    df = df.withColumns({"_b": F.when(summed, F.array_max(holds)), "till": F.least("till", F.when(summed, F.array_min(F.filter(turns, lambda t: t > F.col("_from")))))})
    own, made = ~summed, summed & F.datediff("period_end", "_b.period_end").between(60, 115)
    row = lambda year, filed, val: F.struct(F.lit(year).alias("year"), filed.alias("filed"), val.alias("val"))
    quarter = row(False, F.when(own, F.col("filed")).otherwise(F.greatest("filed", "_b.filed")), F.when(own, F.col("val")).otherwise(F.col("val") - F.col("_b.val")))
    given = F.array_compact(F.array(F.when(own | made, quarter), F.when(F.col("span") == "A", row(True, F.col("filed"), F.col("val")))))
    return df.select("ticker", "concept", "period_end", F.col("_from").alias("since"), "till", F.explode(given).alias("_x")).select("ticker", "concept", "period_end", "since", "till", "_x.*")


def holding(rows: DataFrame, dates: DataFrame, lists: dict[str, Column]) -> DataFrame:
    """Per (as_of, ticker, concept) the lists of (period_end, filed, val) that hold then, in order, of rows that meet a condition; some list has a row.

    An entity's rows of a concept are arrays, of which each date takes its own; of one period the last filed holds.
    """
    one = F.struct("period_end", "filed", "val", "since", "till")
    own = rows.groupBy("ticker", "concept").agg(*[F.sort_array(F.collect_list(F.when(c, one))).alias(k) for k, c in lists.items()])
    df = own.join(F.broadcast(calendar(dates).select("_d"))).select("ticker", "concept", *lists, F.posexplode("_d").alias("_i", "as_of"))
    now = lambda k: F.filter(k, lambda x: (x["since"] <= F.col("_i")) & (x["till"] > F.col("_i")))
    last = lambda k: F.filter(k, lambda x, i: F.coalesce(F.get(k, i + 1)["period_end"] != x["period_end"], F.lit(True)))
    by = ("as_of", "ticker", "concept")
    df = df.select(*by, once(**{k: now(k) for k in lists})).where(" + ".join(f"size({k})" for k in lists) + " > 0")
    return df.select(*by, once(**{k: last(k) for k in lists}))


def flows_at(known: DataFrame, dates: DataFrame) -> DataFrame:
    """Per (as_of, ticker, concept) the ``quarters`` and ``years`` known then, of ``known_spans``.

    A quarter that is over ten times the one of a year before with the sign turned is suspect and NULL.
    """
    df = holding(flow_spans(known), dates, {"quarters": ~F.col("year"), "years": F.col("year")})
    ago = lambda i: F.get("quarters", i - 4)["val"]
    suspect = lambda x, i: (ago(i) != 0) & (F.abs(x["val"] / ago(i)) > 10) & (x["val"] * ago(i) < 0)
    judged = F.transform("quarters", lambda x, i: F.struct(x["period_end"].alias("period_end"), x["filed"].alias("filed"), F.when(F.coalesce(suspect(x, i), F.lit(False)), None).otherwise(x["val"]).alias("val")))
    return df.select("as_of", "ticker", "concept", "years", once(quarters=judged))


def quarter_back(n: int, field: str = "val") -> Column:
    """Of the quarters of ``flows_at`` the n-th from the last, which is the first."""
    return F.get("quarters", F.size("quarters") - n)[field]


def with_trailing(flows: DataFrame) -> DataFrame:
    """``flows_at`` with ttm, y1, y2, y3 and filed as ``trailing`` gives them."""
    sums = {}
    for n in range(4):
        last = [quarter_back(4 * n + k) for k in (4, 3, 2, 1)]
        sums[f"y{n}"] = F.when((F.size("quarters") >= 4 * n + 4) & F.coalesce(*last).isNotNull(), sum((F.coalesce(x, F.lit(0.0)) for x in last), F.lit(0.0)))
    ttm = F.coalesce(sums.pop("y0"), F.get("years", F.size("years") - 1)["val"])
    return flows.withColumns({"ttm": ttm, **sums, "filed": F.array_max(F.transform("quarters", lambda x: x["filed"]))})


def with_surprise(flows: DataFrame, concept: str = "eps_diluted") -> DataFrame:
    """``flows_at`` with sue and sue_filed as ``surprise`` gives them, where the concept is ``concept``."""
    change = lambda n: quarter_back(n) - quarter_back(n + 4)
    own = F.col("concept") == concept
    flows = flows.withColumns({"_c": F.when(own, change(1)), "_before": F.when(own, F.array_compact(F.array(*[change(n) for n in range(8, 1, -1)])))})

    def add(a: Column, x: Column) -> Column:
        n, d = a["n"] + 1, x - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d / n).alias("mean"), (a["m2"] + d * (d - d / n)).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    sd = F.aggregate("_before", start, add, lambda a: F.when(a["n"] > 1, F.sqrt(a["m2"] / (a["n"] - 1))))
    enough = (F.size("quarters") >= 8) & (F.size("_before") >= 4)
    return flows.withColumns({"sue": F.when(own & enough, safe_div(F.col("_c"), sd)), "sue_filed": F.when(own, quarter_back(1, "filed"))}).drop("_c", "_before")


def stocks_at(known: DataFrame, dates: DataFrame) -> DataFrame:
    """``stocks`` of ``known_spans`` by period_end."""
    df = holding(known, dates, {"_p": F.lit(True)}).withColumn("_l", F.get("_p", F.size("_p") - 1))
    by = lambda n: F.try_element_at(F.filter("_p", lambda x: x["period_end"] <= F.add_months("_l.period_end", -12 * n)), F.lit(-1))["val"]
    return df.select("as_of", "ticker", "concept", F.col("_l.val").alias("now"), F.col("_l.filed").alias("filed"), by(1).alias("y1"), by(3).alias("y3"))


def usable_equity(equity: Column, assets: Column, income: Column) -> Column:
    ok = (equity > 0) & ((assets.isNull()) | (equity >= 0.01 * assets)) & (income.isNull() | (F.abs(income) <= 2 * equity))
    return F.when(ok, equity)


def usable_income(income: Column, revenue: Column) -> Column:
    return F.when(revenue.isNull() | (F.abs(income) >= 0.005 * F.abs(revenue)), income)


def share_count(cover: Column, cover_filed: Column, diluted: Column, diluted_filed: Column, basic: Column, basic_filed: Column, as_of: Column, income: Column, eps: Column, split_recent: Column) -> Column:
    """Cover-page count if fresh, else the fresh average that was filed last, diluted before basic; NULL if far from income / eps and no split explains it."""
    fresh = lambda v, f: F.when((v > 0) & (F.datediff(as_of, f) <= FRESH_DAYS), v)
    d, b = fresh(diluted, diluted_filed), fresh(basic, basic_filed)
    average = F.when(d.isNotNull() & b.isNotNull() & (basic_filed > diluted_filed), b).otherwise(F.coalesce(d, b))
    count = F.coalesce(fresh(cover, cover_filed), average)
    implied = safe_div(income, eps)
    ratio = safe_div(count, F.when(implied > 0, implied))
    return F.when(ratio.isNull() | ratio.between(0.70, 1.45) | split_recent, count)


def recent_splits(splits: DataFrame, dates: DataFrame, days: int = 400) -> DataFrame:
    """(as_of, ticker) with a split in the days before."""
    b = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    seen = splits.withColumn("_b", F.explode(F.array(b("date"), b("date") + 1)))
    return dates.select("as_of", b("as_of").alias("_b")).join(seen, "_b").where(f"date <= as_of and date > date_sub(as_of, {days})").select("as_of", "ticker").distinct()


def ratios(w: DataFrame, divide=safe_div) -> DataFrame:
    """Named ratios from the wide row of trailing sums, stock values and the years before.

    ``divide`` is how a ratio is taken; with ``raw_div`` a zero below leaves an infinity, for checks.
    """
    c = F.col
    equity = usable_equity(c("equity"), c("assets"), c("net_income"))
    debt = F.coalesce(F.when(c("total_debt") > 0, c("total_debt")), F.when(F.coalesce("long_term_debt", F.lit(0.0)) + F.coalesce("short_term_debt", F.lit(0.0)) > 0, F.coalesce("long_term_debt", F.lit(0.0)) + F.coalesce("short_term_debt", F.lit(0.0))))
    fcf = c("operating_cash_flow") - F.abs("capex")
    invested = equity + F.coalesce(debt, F.lit(0.0))
    made = {
        "FCF": fcf, "GROSS_MARGIN": divide(c("gross_profit"), c("revenue")), "OPERATING_MARGIN": divide(c("operating_income"), c("revenue")), "NET_MARGIN": divide(c("net_income"), c("revenue")), "ROE": divide(c("net_income"), equity),
        "ROA": divide(c("net_income"), c("assets")), "ROIC": divide(c("operating_income"), invested), "GROSS_PROFITABILITY": divide(c("gross_profit"), c("assets")),
        "ASSET_TURNOVER": divide(c("revenue"), c("assets")), "DEBT_TO_EQUITY": divide(debt, equity), "NET_DEBT_TO_EQUITY": divide(debt - F.coalesce("cash", F.lit(0.0)), equity),
        "CURRENT_RATIO": divide(c("current_assets"), c("current_liabilities")), "FCF_CONVERSION": divide(fcf, usable_income(c("net_income"), c("revenue"))),
        "EPS": divide(c("net_income"), c("shares")), "ACCRUALS": divide(c("net_income") - c("operating_cash_flow"), c("assets")),
        "REVENUE_GROWTH_1Y": growth(c("revenue"), c("revenue_y1")), "EARNINGS_GROWTH_1Y": growth(c("net_income"), c("net_income_y1")),
        "REVENUE_CAGR_3Y": cagr(c("revenue"), c("revenue_y3"), 3), "EQUITY_CAGR_3Y": cagr(c("equity"), c("equity_y3"), 3), "EPS_CAGR_3Y": cagr(c("eps_diluted"), c("eps_diluted_y3"), 3),
        "MARKET_CAP": c("market_cap"), "EV": c("market_cap") + F.coalesce(debt, F.lit(0.0)) - F.coalesce("cash", F.lit(0.0)),
        "EARNINGS_YIELD": divide(c("net_income"), c("market_cap")), "FCF_YIELD": divide(fcf, c("market_cap")), "SALES_YIELD": divide(c("revenue"), c("market_cap")),
        "BOOK_TO_MARKET": divide(equity, c("market_cap")), "BUYBACK_YIELD": divide(F.abs("buybacks"), c("market_cap")), "DIVIDEND_YIELD": divide(F.abs("dividends_paid"), c("market_cap")),
        "PAYOUT_RATIO": divide(F.abs("dividends_paid"), c("net_income")),
    }
    made["EBIT_TO_EV"] = divide(c("operating_income"), made["EV"])
    before = {k: divide(c(a), c(b)) for k, a, b in (("roa", "net_income_y1", "assets_y1"), ("lev", "long_term_debt_y1", "assets_y1"), ("cur", "current_assets_y1", "current_liabilities_y1"), ("gm", "gross_profit_y1", "revenue_y1"), ("turn", "revenue_y1", "assets_y1"))}
    tests = (
        made["ROA"] > 0, c("operating_cash_flow") > 0, made["ROA"] > before["roa"], c("operating_cash_flow") > c("net_income"), divide(c("long_term_debt"), c("assets")) < before["lev"],
        made["CURRENT_RATIO"] > before["cur"], c("shares") <= 1.02 * c("shares_y1"), made["GROSS_MARGIN"] > before["gm"], made["ASSET_TURNOVER"] > before["turn"],
    )
    made["PIOTROSKI_F"] = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    made |= {"FORWARD_PE": c("forward_pe"), "TRAILING_PE": c("trailing_pe")}
    made["EARNINGS_SURPRISE"] = F.when(F.datediff("as_of", "sue_filed") <= 100, c("sue"))
    return w.select("as_of", "ticker", *[v.alias(k) for k, v in made.items()])
