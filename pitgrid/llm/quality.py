"""Quality rules as weak supervision.

Each rule looks at the counts of a text and votes good, bad, or abstains.  How far each rule
can be trusted is estimated from the votes alone: expectation-maximisation of a two-class
model in which every rule has, for each class, probabilities of its three votes.  A text is
kept if the posterior probability that it is good is at least one half, unless the fixed base
rule fails it.  Everything is Spark SQL; the driver sees only the model's parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.staging import stage

WHITE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops")

#: name: (bad if, else good if, else it abstains); SQL over the features, shared by both engines.
RULES = {
    "length": ("n_words < 10", "n_words >= 40"),
    "symbols": ("10 * n_symbols > 2 * n_words", "50 * n_symbols <= n_words"),
    "word_length": ("word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    "repeats": ("100 * n_repeat_words > 15 * n_words", "50 * n_repeat_words <= n_words"),
    "capitals": ("10 * n_upper > 4 * word_chars", "10 * n_upper <= 2 * word_chars"),
    "sentences": ("n_words >= 40 and 200 * n_stops < n_words", "30 * n_stops >= n_words"),
}
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
ROUNDS = 12
#: Names of the model's parameters; the start holds each rule to be right four times of five.
START = {"prior": 0.8} | {f"{r}_{y}_{v}": p for r in RULES for y, ps in (("g", (0.05, 0.2, 0.75)), ("b", (0.35, 0.35, 0.3))) for v, p in zip("ban", (ps[0], ps[2], ps[1]), strict=True)}
VOTES = {"b": -1, "a": 1, "n": 0}


def vote_sql(rule: str) -> str:
    bad, good = RULES[rule]
    return f"case when {bad} then -1 when {good} then 1 else 0 end"


def posterior_sql(value) -> str:
    """Posterior that a text is good, of its votes; ``value`` gives the SQL of a parameter."""
    odds = [f"ln({value('prior')}) - ln(1 - {value('prior')})"]
    for r in RULES:
        cases = " ".join(f"when {v} then ln({value(f'{r}_g_{k}')}) - ln({value(f'{r}_b_{k}')})" for k, v in VOTES.items())
        odds.append(f"case v_{r} {cases} end")
    return f"1 / (1 + exp(-({' + '.join(odds)})))"


def estimate_sql() -> dict[str, str]:
    """The next value of every parameter, over rows of vote patterns with n and posterior p.

    Each probability starts from a thousandth of all texts spread over the three votes.
    """
    made = {"prior": "least(0.98, greatest(0.02, sum(n * p) / sum(n)))"}
    for r in RULES:
        for y, weight in (("g", "p"), ("b", "(1 - p)")):
            for k, v in VOTES.items():
                made[f"{r}_{y}_{k}"] = (
                    f"(sum(case when v_{r} = {v} then n * {weight} else 0 end) + 0.001 * sum(n)) / (sum(n * {weight}) + 0.003 * sum(n))"
                )
    return made


def repeated(words: Column) -> Column:
    """Words in windows of five that occur twice or more, the first included."""

    def windows(w):
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def covered(h):
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def among(o):
            beside = lambda j: F.get(o, j)["h"]
            twice = F.filter(o, lambda x, j: F.coalesce(x["h"] == beside(j - 1), F.lit(False)) | F.coalesce(x["h"] == beside(j + 1), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def length(at):
            first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
            step = lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum"))
            return F.aggregate(at, first, step, lambda acc: acc["sum"])

        return bind(bind(order, among), length)

    counted = bind(windows(words), lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0)).cast("long")


def bind(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def features(text: Column) -> Column:
    """Struct of the counts of a text; null counts as no text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    without = lambda letters: F.char_length(text) - F.char_length(F.translate(text, letters, ""))

    def counts(w):
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        made = {
            "n_words": F.size(w), "word_chars": F.char_length(F.array_join(w, "")), "n_symbols": without(SYMBOLS),
            "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_repeat_words": repeated(w),
            "n_lines": F.size(lines), "n_upper": without(UPPER), "n_stops": without(".!?"),
        }
        return F.struct(*[made[k].cast("long").alias(k) for k in FEATURES])

    return bind(words, counts)


def votes() -> list[Column]:
    return [F.expr(vote_sql(r)).alias(f"v_{r}") for r in RULES]


def fit(voted: DataFrame, rounds: int = ROUNDS) -> dict[str, float]:
    """The parameters after ``rounds`` of expectation-maximisation.

    ``voted`` has the v_ columns; their patterns, at most 3 to the number of rules, are counted once.
    """
    names = [f"v_{r}" for r in RULES]
    patterns = stage(voted.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1), "patterns")
    model = dict(START)
    for _ in range(rounds):
        scored = patterns.withColumn("p", F.expr(posterior_sql(lambda k: f"{model[k]!r}D")))
        row = scored.agg(*[F.expr(sql).alias(k) for k, sql in estimate_sql().items()]).first()
        if None in tuple(row):  # an empty table
            return model
        model = row.asDict()
    return model


def verdict(model: dict[str, float]) -> Column:
    return F.expr(posterior_sql(lambda k: f"{model[k]!r}D"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``key``, the base counts, base_failed, kept and quality_prob for every row of ``docs``.

    Null and empty texts have no words and fail the base rule.  Repeated rows give repeated
    rows, an empty table an empty one; other columns aren't read.
    """
    counted = docs.select(F.col(key), features(F.col(text)).alias("f")).select(key, "f.*")
    voted = stage(counted.select("*", *votes()), "votes")
    model = fit(voted, rounds)
    return voted.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(BASE_FAILED).alias("base_failed"), (~F.expr(BASE_FAILED) & (verdict(model) >= 0.5)).alias("kept"),
        F.round(verdict(model), 9).alias("quality_prob"),
    )


def keep_good(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns as they are.

    Rows are written with their votes once, so no text is counted twice.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__pitgrid_row")
    counted = docs.select(row, features(F.col(f"`{text}`")).alias("__pitgrid_f")).select("__pitgrid_row", "__pitgrid_f.*")
    voted = stage(counted.select("__pitgrid_row", F.expr(BASE_FAILED).alias("failed"), *votes()), "votes")
    model = fit(voted, rounds)
    return voted.where(~F.col("failed") & (verdict(model) >= 0.5)).select("__pitgrid_row.*")


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same in DuckDB, with every round of the estimation as a table expression."""
    names = ", ".join(f"v_{r}" for r in RULES)
    parts = [
        f"""docs as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
split as (select *, list_filter(string_split_regex(text, '{WHITE}'), lambda x: x <> '') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from docs),
windows as (select r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as t from split, unnest(range(1, len(w) - {WINDOW - 2})) as u(i)),
twice as (select r, i from (select *, count(*) over (partition by r, t) as c from windows) where c > 1),
covered as (select r, count(distinct p) as c from (select r, unnest(range(i, i + {WINDOW})) as p from twice) group by r),
counted as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
  (length(text) - length(translate(text, '{UPPER}', '')))::bigint as n_upper,
  (length(text) - length(translate(text, '.!?', '')))::bigint as n_stops from split left join covered using (r)),
voted as (select *, {", ".join(f"{vote_sql(r)} as v_{r}" for r in RULES)} from counted),
patterns as (select {names}, count(*)::double as n from voted group by all),
m0 as (select {", ".join(f"{v!r}::double as {k}" for k, v in START.items())})"""
    ]
    for i in range(rounds):
        parts.append(f"s{i} as (select patterns.*, {posterior_sql(lambda k: k)} as p from patterns, m{i})")
        parts.append(f"m{i + 1} as (select {', '.join(f'{sql} as {k}' for k, sql in estimate_sql().items())} from s{i})")
    return (
        "with " + ",\n".join(parts) + f"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) as base_failed,
  not ({BASE_FAILED}) and {posterior_sql(lambda k: k)} >= 0.5 as kept, round({posterior_sql(lambda k: k)}, 9) as quality_prob from voted, m{rounds}"""
    )
