"""The wide factor frame: universes, factors that meet in it, and targets after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions.scalars import average_rank, correlation, safe_div
from pitgrid.operators.asof import asof_join, window_join

KEYS = ("as_of", "ticker")
# What a stated conviction counts.
CONVICTION = {"low": 0.5, "medium": 0.8, "high": 1.0}


def joined(frames: list[DataFrame]) -> DataFrame:
    """Factor families side by side, a row for every name that any of them has.

    Each family has a row per name and date, so what they are united to has one value of each
    column; rows meet in one shuffle, where full joins would each deal all columns so far anew.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.groupBy(*KEYS).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c not in KEYS])


def labelled(frame: DataFrame, securities: DataFrame) -> DataFrame:
    """The rows of known names with their sector; a missing one is Unknown."""
    names = securities.select("ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"))
    return frame.join(names, "ticker")


def restricted(frame: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of names that are members at that very date, so that later members don't enter."""
    return frame.join(members.select(*KEYS).distinct(), list(KEYS), "left_semi")


def with_targets(frame: DataFrame, targets: DataFrame, members: DataFrame, returns: list[str]) -> DataFrame:
    """One table for research: every factor of every member at every date, with its forward returns and what they have over the mean member's.

    ``members`` (as_of, ticker) says who was in the universe then; a name that came later isn't in
    its earlier rows.  A return whose horizon hasn't passed is NULL, and so is its excess.
    """
    rows = restricted(frame, members).join(targets.select("as_of", "ticker", *returns), ["as_of", "ticker"], "left")
    date = Window.partitionBy("as_of")
    return rows.withColumns({f"{r}_excess": F.col(r) - F.avg(r).over(date) for r in returns})


def first_sessions(sessions: DataFrame) -> DataFrame:
    """For every day from the first session to the last, the first session on or after it."""
    before = F.lag("date").over(Window.orderBy("session"))
    days = F.sequence(F.coalesce(F.date_add(before, 1), F.col("date")), F.col("date"))
    return sessions.withColumn("days", days).select(F.explode("days").alias("day"), "session")


def earnings_reaction(grid: DataFrame, market: DataFrame, events: DataFrame, dates: DataFrame, sessions: DataFrame, days: int = 63, item: str = "2.02") -> DataFrame:
    """EARNINGS_REACTION per (as_of, ticker): return less the market's around the newest results filing of the days before.

    From the session before the first one on or after the filing to the session after it, as
    far as the as-of session; nothing where that leaves no step.
    """
    seen = window_join(dates, events.where(F.col("item_code") == item), "filed", days + 1)
    last = seen.groupBy("as_of", "session", "ticker").agg(F.max("filed").alias("day"))
    at = last.withColumnRenamed("session", "now").join(first_sessions(sessions), "day")
    at = at.select("as_of", "ticker", (F.col("session") - 1).alias("start"), F.least(F.col("session") + 1, F.col("now")).alias("end")).where("end > start")
    px = grid.select("ticker", "session", "close_ff")
    index = market.select("session", F.col("close").alias("level"))
    side = lambda s, p, m: (px.select("ticker", F.col("session").alias(s), F.col("close_ff").alias(p)), index.select(F.col("session").alias(s), F.col("level").alias(m)))
    (p0, m0), (p1, m1) = side("start", "_p0", "_m0"), side("end", "_p1", "_m1")
    df = at.join(p0, ["ticker", "start"]).join(p1, ["ticker", "end"]).join(m0, "start").join(m1, "end").where("_p0 > 0 and _m0 > 0")
    move = (F.col("_p1") / F.col("_p0") - 1) - (F.col("_m1") / F.col("_m0") - 1)
    return df.select(*KEYS, move.alias("EARNINGS_REACTION")).where("EARNINGS_REACTION is not null")


def view_factor(reviews: DataFrame, dates: DataFrame, days: int = 120) -> DataFrame:
    """LLM_EARNINGS_VIEW per (as_of, ticker): the newest stored review's score times the weight of its conviction."""
    seen = window_join(dates, reviews, "filed", days + 1)
    last = seen.groupBy(*KEYS).agg(F.max_by(F.struct("score", "conviction"), F.struct("filed", "accession")).alias("r"))
    weight = F.create_map(*[x for k, v in CONVICTION.items() for x in (F.lit(k), F.lit(v))])
    return last.select(*KEYS, (F.col("r.score") * F.coalesce(F.try_element_at(weight, F.col("r.conviction")), F.lit(0.5))).alias("LLM_EARNINGS_VIEW"))


def pending_reviews(events: DataFrame, reviews: DataFrame, dates: DataFrame, days: int = 120, item: str = "2.02") -> DataFrame:
    """Results filings of the days before each date that no review covers."""
    seen = window_join(dates, events.where(F.col("item_code") == item), "filed", days)
    return seen.join(reviews.select("ticker", "accession").distinct(), ["ticker", "accession"], "left_anti").select(*KEYS, "filed", "accession")


def dollar_volume(grid: DataFrame, dates: DataFrame, sessions: int = 20) -> DataFrame:
    """adv per (as_of, ticker): mean of close times volume over the last sessions that traded."""
    w = Window.partitionBy("ticker").orderBy("session").rowsBetween(-sessions + 1, 0)
    df = grid.withColumn("adv", F.avg(F.col("close") * F.col("volume")).over(w))
    return df.join(dates.select("as_of", "session"), "session").select(*KEYS, F.col("close_ff").alias("price"), "adv")


# Universes that have a name, and what belongs to each beside its index.
PRESETS: dict[str, dict] = {
    "spy": {"index": "SPY"},
    "qqq": {"index": "QQQ"},
    "dia": {"index": "DIA"},
    "iwm": {"index": "IWM"},
    "us_large_cap": {"index": "SPY", "min_cap": 10e9},
    "us_mid_cap": {"index": "SPY", "min_cap": 2e9, "max_cap": 10e9},
    "dividend_quality": {"index": "SPY", "dividend_payers": True, "profitable": True, "min_cap": 5e9},
    "tech_growth": {"index": "SPY", "sectors": ["Information Technology", "Communication Services"], "min_cap": 5e9},
    "healthcare": {"index": "SPY", "sectors": ["Health Care"]},
    "liquid_tradables": {"index": "SPY", "min_adv": 25e6, "min_price": 10.0},
}


def preset(names: DataFrame, members: DataFrame, name: str, **other) -> DataFrame:
    """The named universe: members (as_of, index_symbol, ticker) of its index that pass its bounds; ``other`` bounds go before them.

    A date without a snapshot of the index has no names, rather than today's.
    """
    how = PRESETS[name] | other
    held = members.where(F.col("index_symbol") == how.pop("index")).select("as_of", "ticker").distinct()
    return universe(names.join(held, ["as_of", "ticker"], "left_semi"), **how)


def universe(
    names: DataFrame, sectors: list[str] | None = None, countries: list[str] | None = None, min_price: float | None = None, min_adv: float | None = None,
    min_cap: float | None = None, max_cap: float | None = None, most: int | None = None, exchanges: list[str] | None = None, exclude_adr: bool = False,
    dividend_payers: bool = False, profitable: bool = False,
) -> DataFrame:
    """Rows of (as_of, ticker, sector, country, price, adv, market_cap) that belong to a universe.

    Where they are asked about, also exchange, is_adr, dividend_yield and eps.

    A name without a sector, country or exchange is out only where that is asked about; one not
    known to be a foreign receipt is none; one without a price or volume fails the liquidity gate;
    one without a market value, a yield or earnings passes their bounds.
    ``most`` keeps the largest of each date, those of unknown size last, ties by name.
    """
    out = names
    for column, wanted in (("sector", sectors), ("country", countries), ("exchange", exchanges)):
        if wanted:
            out = out.where(F.col(column).isin(*wanted))
    if exclude_adr:
        out = out.where(F.coalesce(F.col("is_adr").cast("int"), F.lit(0)) == 0)
    for column, asked in (("dividend_yield", dividend_payers), ("eps", profitable)):
        if asked:
            out = out.where(F.col(column).isNull() | (F.col(column) > 0))
    for column, least in (("price", min_price), ("adv", min_adv)):
        if least is not None:
            out = out.where(F.col(column) >= least)
    cap = F.col("market_cap")
    if min_cap is not None:
        out = out.where(cap.isNull() | (cap >= min_cap))
    if max_cap is not None:
        out = out.where(cap.isNull() | (cap <= max_cap))
    if most is not None:
        order = Window.partitionBy("as_of").orderBy(F.desc_nulls_last("market_cap"), "ticker")
        out = out.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= most).drop("_p")
    return out


def forward_months(bars: DataFrame, dates: DataFrame, months: tuple[int, ...] = (1, 3, 6), slack: int = 7, stale: int = 35) -> DataFrame:
    """fwd_<m>m per (as_of, ticker): return from the last close by the date to the last close by so many months later.

    NULL where the data ends more than ``slack`` days before the horizon, and where either
    close is older than ``stale`` days.
    """
    ends = bars.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    spans = ends.withColumn("_y", F.explode(F.sequence(F.year("first"), F.year("last") + 1)))
    asked = spans.join(dates.select("as_of", F.year("as_of").alias("_y")), "_y").where("as_of >= first").select("ticker", "as_of")
    out = asof_join(asked, bars, ["ticker"], "as_of", "date", ["close"], max_age_days=stale).withColumnRenamed("close", "_now")
    last = bars.agg(F.max("date").alias("_last"))
    for m in months:
        out = out.withColumn("_end", F.add_months("as_of", m))
        out = asof_join(out, bars, ["ticker"], "_end", "date", ["close"], max_age_days=stale).withColumnRenamed("close", f"_p{m}")
    out = out.crossJoin(F.broadcast(last))  # one row
    value = lambda m: F.when(F.add_months("as_of", m) <= F.date_add("_last", slack), safe_div(F.col(f"_p{m}"), F.col("_now")) - 1)
    return out.select(*KEYS, *[value(m).alias(f"fwd_{m}m") for m in months])


def gated(frame: DataFrame, gates: dict[str, Column], cells: list[tuple[str, str, float]]) -> DataFrame:
    """Long rows (as_of, strategy, factor, ticker, sector, value): of each strategy the factors of the names that pass its gates.

    One pass over the frame; ``factor`` is strategy/factor, so that each strategy's names are
    a cross-section of their own.
    """
    one = lambda s, f: F.struct(F.lit(s).alias("strategy"), F.lit(f"{s}/{f}").alias("factor"), F.col(f).cast("double").alias("value"))
    made = F.array_compact(F.array(*[F.when(gates[s], one(s, f)) for s, f, _ in cells]))
    return frame.select(*KEYS, "sector", F.explode(made).alias("x")).select("as_of", "ticker", "sector", "x.*")


def standing(frame: DataFrame, gates: dict[str, Column], scores: DataFrame) -> DataFrame:
    """(as_of, ticker, strategy, pct): a strategy's percentile of every name, 0 for those its gates leave out, NULL where it has no score."""
    pairs = F.array(*[F.struct(F.lit(s).alias("strategy"), ok.alias("ok")) for s, ok in gates.items()])
    every = frame.select(*KEYS, F.explode(pairs).alias("x")).select(*KEYS, "x.*")
    out = every.join(scores.select(*KEYS, "strategy", "percentile"), [*KEYS, "strategy"], "left")
    return out.select(*KEYS, "strategy", F.when(F.col("ok"), F.col("percentile")).otherwise(F.lit(0.0)).alias("pct"))


def family_votes(standing_: DataFrame, families: DataFrame, views: DataFrame, veto: str, vote_at: float = 0.8, veto_at: float = 0.9, strong: float = 1.0) -> DataFrame:
    """votes, mean, families, vetoed and composite per (as_of, ticker).

    A family votes where the mean percentile of its strategies reaches ``vote_at``; a stored
    view votes for or against from ``strong`` on; the veto strategy's first tenth takes one
    away.  The composite is votes plus half the mean percentile; NULL under two opinions.
    """
    fam = standing_.join(families, "strategy").groupBy(*KEYS, "family").agg(F.avg("pct").alias("p"))
    out = fam.groupBy(*KEYS).agg(F.coalesce(F.sum((F.col("p") >= vote_at).cast("int")), F.lit(0)).alias("votes"), F.avg("p").alias("mean"), F.count("p").alias("families"))
    out = out.join(views, list(KEYS), "left")
    view = F.col("LLM_EARNINGS_VIEW")
    against = standing_.where(F.col("strategy") == veto).select(*KEYS, F.coalesce(F.col("pct") >= veto_at, F.lit(False)).alias("vetoed"))
    out = out.join(against, list(KEYS), "left").withColumn("vetoed", F.coalesce("vetoed", F.lit(False)))
    side = F.when(view >= strong, 1).when(view <= -strong, -1).otherwise(0)
    out = out.withColumns({"votes": F.col("votes") + side - F.col("vetoed").cast("int"), "families": F.col("families") + view.isNotNull().cast("int")})
    return out.withColumn("composite", F.when(F.col("families") >= 2, F.col("votes") + 0.5 * F.coalesce("mean", F.lit(0.0)))).drop("LLM_EARNINGS_VIEW")


def vote_labels(voted: DataFrame, families: int) -> DataFrame:
    """``voted`` with the label of its votes."""
    v = F.col("votes")
    # The labels.
    label = (
        F.when(F.col("vetoed") & (v <= 1), "🔴 Avoid — on the avoid list").when(v >= 3, F.concat(F.lit("🟢 Strong Buy — "), v.cast("string"), F.lit(f" of {families} families agree")))
        .when(v == 2, f"🟢 Buy — 2 of {families} families agree").when(v == 1, "🟡 Hold / watch — 1 family").otherwise("⚪ Neutral — no family agrees")
    )
    return voted.withColumn("signal", label)


def factor_ic(long: DataFrame, target: str, neutral: bool, least: int) -> DataFrame:
    """Rank correlation of every factor with ``target`` per date, within sectors where ``neutral``."""
    df = long.where(F.col("value").isNotNull() & F.col(target).isNotNull())
    own = Window.partitionBy("as_of", "factor", "sector")
    off = (lambda c: F.col(c) - F.avg(c).over(own)) if neutral else F.col
    df = df.withColumns({"_x": F.round(off("value"), 12), "_y": F.round(off(target), 12)})
    by = ["as_of", "factor"]
    ranks = df.select(*by, average_rank(F.col("_x"), *by).alias("a"), average_rank(F.col("_y"), *by).alias("b"))
    n = F.count(F.lit(1))
    return ranks.groupBy(*by).agg(F.when(n >= least, correlation(F.col("a"), F.col("b"))).alias("ic"), n.alias("n"))


def availability(long: DataFrame, weights: DataFrame, live_only: tuple[str, ...] = ("FORWARD_PE", "TRAILING_PE", "LLM_EARNINGS_VIEW")) -> DataFrame:
    """Per (as_of, strategy, factor): weight, share of names that have it, and its status."""
    share = long.groupBy("as_of", "factor").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"))
    thin = F.when(F.col("coverage") < 0.1, "empty").when(F.col("coverage") < 0.5, "sparse").otherwise("ok")
    status = F.when(F.col("factor").isin(*live_only) & (thin != "ok"), "live_only").otherwise(thin)
    return share.join(weights, "factor").select("as_of", "strategy", "factor", "weight", "coverage", status.alias("status"))


def degraded(available: DataFrame) -> DataFrame:
    """Per (as_of, strategy): factors and the share of weight that aren't fit to rank on."""
    bad = F.col("status") != "ok"
    return available.groupBy("as_of", "strategy").agg(
        F.count(F.when(bad, 1)).alias("bad"), F.count(F.lit(1)).alias("factors"), F.coalesce(F.sum(F.when(bad, F.col("weight"))) / F.sum("weight"), F.lit(0.0)).alias("lost")
    ).withColumn("honest", F.col("bad") == 0)


def weight_shares(weights: DataFrame) -> DataFrame:
    """Weights of each strategy as shares of their sum."""
    return weights.withColumn("share", safe_div(F.col("weight"), F.sum("weight").over(Window.partitionBy("strategy"))))


def rebalanced(weights: DataFrame, factor: str, share: float) -> DataFrame:
    """Shares with one factor at ``share`` and the others in proportion in the rest."""
    shares = weight_shares(weights)
    own = F.max(F.when(F.col("factor") == factor, F.col("share"))).over(Window.partitionBy("strategy"))
    rest = safe_div(F.col("share") * (1 - share), 1 - own)
    return shares.withColumn("share", F.when(own.isNull(), F.col("share")).when(F.col("factor") == factor, F.lit(share)).otherwise(rest))
