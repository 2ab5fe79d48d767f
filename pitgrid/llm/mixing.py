"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; the tokens of the cells are raked:
scaled in turn to the target of each margin, round after round, until all margins hold.  A
document is then sampled with a probability in proportion to raked over present tokens of
its cell, so the tokens expected in the sample have the target margins.  The sample is as
large as the neediest cell allows, and at least ``LEAST`` of the tokens: cells too small for
their part of that are taken whole, and the others are raked to what is then left.  ``margins``
says which targets hold.  Rows and cells stay in Spark SQL: a few rounds of windows over the
cells are one plan, whose result is written before the next; the driver only reads by how much
the worst margin is off.  The draw is a hash of the document's id.

Tokens are counted as words, which SQL can do; where a table of token counts is at hand, give
it as ``weight``.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pitgrid.llm.staging import drop, stage

WHITE = "[\\x20\\x09-\\x0D]+"
DIMS = ("source", "lang", "topic")
#: A margin's targets are its token shares to this power, where none are given: 1 keeps
#: them, 0 makes them even.
TEMPER = {"source": 0.5, "lang": 0.5, "topic": 1.0}
ROUNDS = 10
#: After ``ROUNDS`` rounds, more follow until no margin is off by this share of all tokens, or ``MOST`` more are done.
TOLERANCE, MOST = 1e-6, 1000
#: Rounds in one plan.
STEP = 5
#: The sample has at least this share of the tokens in cells that the targets don't rule out.
LEAST = 0.25
NONE = "(none)"
#: The form of a text stands for its topic where the table has none; SQL for both engines.
TOPIC = (
    "case when text like '% | %' then 'table' when text like '%!! %' then 'notices'"
    " when text like '%&&&%' or text like '%###%' then 'symbols' else 'prose' end"
)


def tokens(text: Column) -> Column:
    """Words of a text; a text without words counts as one, so that every row has weight."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")
    return F.greatest(F.size(words), F.lit(1)).cast("long")


def placed(docs: DataFrame, key: str, text: str, source: str, lang: str, topic: Column | None, weight: Column | None = None) -> list[Column]:
    topic = topic if topic is not None else F.expr(TOPIC.replace("text", f"`{text}`"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    count = tokens(F.col(text)) if weight is None else F.greatest(F.coalesce(weight.cast("long"), F.lit(1)), F.lit(1)).cast("long")
    return [name(F.col(source)).alias("source"), name(F.col(lang)).alias("lang"), name(topic).alias("topic"), count.alias("n_tokens")]


def within(column: str | Column, d: str) -> Column:
    """The sum over all cells with the same value of a margin."""
    return F.sum(column).over(Window.partitionBy(d))


def even_out(cells: DataFrame, rounds: int, most: int, whole: float = 1.0) -> tuple[DataFrame, float]:
    """``cells`` with ``x`` raked until the sums of each margin are ``want_*``, and by what share of ``whole`` the worst is off.

    At least ``rounds`` rounds are done, and at most ``most``; no more follow once they don't
    bring the margins nearer, as with targets that can't be met together.
    """
    done, before = 0, math.inf
    while True:
        step, out = min(STEP, (rounds if done < rounds else most) - done), cells
        for _ in range(step):
            for d in DIMS:
                now = within("x", d)
                out = out.withColumn("x", F.when(now > 0, F.col("x") * F.col(f"want_{d}") / now).otherwise(F.lit(0.0)))
        gap = F.greatest(*[F.abs(within("x", d) - F.col(f"want_{d}")) for d in DIMS])
        old, cells = cells, stage(out.withColumn("gap", gap), "raked")
        drop(old)
        done += step
        worst = (cells.agg(F.max("gap")).first()[0] or 0.0) / whole
        cells = without(cells, "gap")
        if done >= rounds and (worst <= TOLERANCE or done >= most or worst > 0.999 * before):
            return cells, worst
        before = worst


def without(staged: DataFrame, *columns: str) -> DataFrame:
    """A staged table without some columns, still known as staged."""
    out = staged.drop(*columns)
    out.staged_at = staged.staged_at
    return out


def with_goals(cells: DataFrame, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """``cells`` with the weight of each margin's value; a given target that doesn't list a value rules it out."""
    out = cells
    for d in DIMS:
        given = (targets or {}).get(d)
        goal = F.pow(within("tokens", d).cast("double"), F.lit(TEMPER[d]))
        if given is not None:
            listed = F.create_map(*[x for k, v in sorted(given.items()) for x in (F.lit(k), F.lit(float(v)))])
            goal = F.coalesce(F.try_element_at(listed, F.col(d)), F.lit(0.0))
        out = out.withColumn(f"goal_{d}", goal)
    return out


def in_shares(cells: DataFrame, weights: dict[str, Column], whole: float) -> DataFrame:
    """``cells`` with ``want_*``: ``whole`` shared among the values of each margin by their weights, which all cells of a value agree on."""
    sizes = cells.withColumns({f"__w_{d}": w for d, w in weights.items()} | {f"__n_{d}": within(F.lit(1), d) for d in DIMS})
    sums = sizes.agg(*[F.sum(F.col(f"__w_{d}") / F.col(f"__n_{d}")) for d in DIMS]).first()
    share = {d: F.col(f"__w_{d}") * F.lit(whole / x if x else 0.0) for d, x in zip(DIMS, sums)}
    return sizes.withColumns({f"want_{d}": x for d, x in share.items()}).drop(*[f"__{k}_{d}" for k in "wn" for d in DIMS])


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, most: int | None = None) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``raked``, whose margins are in proportion to the targets.

    A given target lists the weight of each value of a margin; values it doesn't list get 0.
    ``most``: further rounds are done, up to so many in all, until the margins hold.
    """
    goals = stage(with_goals(cells, targets), "cells")
    start = in_shares(goals, {d: F.col(f"goal_{d}") for d in DIMS}, 1.0)
    start = stage(start.withColumn("x", F.col("tokens").cast("double")), "raked")
    drop(goals)
    out, gap = even_out(start, rounds, most or rounds)
    if most and gap > TOLERANCE:
        warnings.warn(f"the targets can't be met together: a margin is off by {gap:.2g} of the tokens", stacklevel=2)
    done = out.withColumnRenamed("x", "raked")
    done.staged_at = out.staged_at
    return done


def chances(rows: DataFrame, targets: dict | None, rounds: int, least: float = LEAST) -> DataFrame:
    """source, lang, topic, tokens, prob of each cell, and its margins' goals."""
    cells = rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))
    out = rake(cells, targets, rounds, max(rounds, MOST))
    made, held, highest = out.agg(F.sum("raked"), F.sum(F.when(F.col("raked") > 0, F.col("tokens"))), F.max(F.col("raked") / F.col("tokens"))).first()
    names = [*DIMS, "tokens", "prob", *[f"goal_{d}" for d in DIMS]]
    if not made:
        return out.withColumn("prob", F.lit(0.0)).select(*names)
    size = least * held
    if made / highest >= size:
        return out.withColumn("prob", F.col("raked") / F.col("tokens") / F.lit(highest)).select(*names)
    # too small a sample: cells whose part of a larger one exceeds them are taken whole, and the others share what is left
    out = out.withColumns({"x": F.col("raked") * F.lit(size / made), "whole": F.lit(False), **{f"want_{d}": F.col(f"want_{d}") * F.lit(size) for d in DIMS}})
    out = stage(out.drop("raked"), "raked")
    while True:
        full = ~F.col("whole") & (F.col("x") > 0) & (F.col("x") >= F.col("tokens") * (1 - 1e-12))
        marked = stage(out.withColumn("new", full), "raked")
        drop(out)
        found, taken, free = marked.agg(F.count_if("new"), F.sum(F.when(F.col("whole") | F.col("new"), F.col("tokens"))), F.sum(F.when(~F.col("whole") & ~F.col("new"), F.col("x")))).first()
        left = size - (taken or 0)
        out = marked.withColumns({"whole": F.col("whole") | F.col("new"), "x": F.when(F.col("whole") | F.col("new"), 0.0).otherwise(F.col("x"))})
        if not found or left <= 0 or not free:
            break
        sums = {d: within("x", d) for d in DIMS}
        rest = {d: F.when(now > 0, F.greatest(F.col(f"want_{d}") - within(F.when(F.col("new"), F.col("tokens")).otherwise(0), d), now)).otherwise(0.0) for d, now in sums.items()}
        out = stage(in_shares(out, rest, float(left)).drop("new"), "raked")
        drop(marked)
        out, _ = even_out(out, STEP, MOST, float(left))
    prob = F.when(F.col("whole"), 1.0).otherwise(F.least(F.col("x") / F.col("tokens"), F.lit(1.0)))
    return out.withColumn("prob", prob).select(*names)


def draw(key: Column, seed: int) -> Column:
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(docs: DataFrame, targets: dict | None = None, rounds: int = ROUNDS, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, weight: Column | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, prob, sampled for every row of ``docs``.

    Null sources, languages and topics are values of their own.  A null text counts as one
    token.  Rows repeated under one id are drawn together.  Other columns aren't read.
    The sample is expected to have the share ``least`` of the tokens, or more where every cell
    has enough tokens for more.
    """
    rows = stage(docs.select(F.col(key).alias("doc_id"), *placed(docs, key, text, source, lang, topic, weight)), "placed")
    joined = rows.join(chances(rows, targets, rounds, least).select(*DIMS, "prob"), list(DIMS))
    return joined.select("doc_id", *DIMS, "n_tokens", F.round("prob", 6).alias("prob"), (draw(F.col("doc_id"), seed) < F.col("prob")).alias("sampled"))


def sampled(docs: DataFrame, targets: dict | None = None, rounds: int = ROUNDS, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, with their columns as they are."""
    where = placed(docs, key, text, source, lang, topic)
    cells = chances(docs.select(*where), targets, rounds, least)
    renamed = [F.col(d).alias(f"__pitgrid_{d}") for d in DIMS]
    mine = docs.withColumns({f"__pitgrid_{d}": c for d, c in zip(DIMS, where)})
    joined = mine.join(cells.select(*renamed, F.col("prob").alias("__pitgrid_prob")), [f"__pitgrid_{d}" for d in DIMS])
    return joined.where(draw(F.col(key), seed) < F.col("__pitgrid_prob")).select(*[mine[f"`{c}`"] for c in docs.columns])


def margins(docs: DataFrame, targets: dict | None = None, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, least: float = LEAST) -> DataFrame:
    """dim, value, tokens, target, expected, met: the share of the sample's tokens that each value should have, will have, and whether they agree.

    A target that isn't met is of a value with no row or too few tokens (which is taken whole),
    gives way to such a value, or can't be met together with the others.
    """
    cells = chances(docs.select(*placed(docs, key, text, source, lang, topic)), targets, rounds, least)
    parts = []
    for d in DIMS:
        own = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), F.max(f"goal_{d}").alias("goal"), F.sum(F.col("tokens") * F.col("prob")).alias("in_sample"))
        listed = [(str(k), float(v)) for k, v in sorted(((targets or {}).get(d) or {}).items())]
        own = own.join(docs.sparkSession.createDataFrame(listed, "value string, listed double"), "value", "full")
        parts.append(own.select(F.lit(d).alias("dim"), "value", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("goal", "listed").alias("goal"), F.coalesce("in_sample", F.lit(0.0)).alias("in_sample")))
    every = Window.partitionBy("dim")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(every)), F.lit(0.0))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumns({"target": share("goal"), "expected": share("in_sample")})
    return out.select("dim", "value", "tokens", "target", "expected", (F.abs(F.col("target") - F.col("expected")) <= 2 * TOLERANCE).alias("met"))


def oracle_sql(rounds: int = ROUNDS, seed: int = 17) -> str:
    parts = [
        f"""placed as (select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang, coalesce({TOPIC}, '{NONE}') as topic,
  greatest(len(list_filter(string_split_regex(coalesce(text, ''), '{WHITE}'), lambda x: x <> '')), 1)::bigint as n_tokens from documents),
cells as (select source, lang, topic, sum(n_tokens)::bigint as tokens from placed group by all),
r0 as (select *, {", ".join(f"pow(sum(tokens) over (partition by {d})::double, {TEMPER[d]}) as goal_{d}" for d in DIMS)}, tokens::double as raked from cells)"""
    ]
    step = 0
    for _ in range(rounds):
        for d in DIMS:
            keep = "source, lang, topic, tokens, " + ", ".join(f"goal_{x}" for x in DIMS)
            parts.append(f"r{step + 1} as (select {keep}, raked * goal_{d} / sum(raked) over (partition by {d}) as raked from r{step})")
            step += 1
    return (
        "with " + ",\n".join(parts) + f""",
ratios as (select source, lang, topic, raked / tokens as ratio from r{step}),
chances as (select source, lang, topic, ratio / (select max(ratio) from ratios) as p from ratios)
select doc_id, source, lang, topic, n_tokens, round(p, 6) as prob,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{seed}'), 1, 8))::bigint / 4294967296.0 < p as sampled
from placed join chances using (source, lang, topic)"""
    )
