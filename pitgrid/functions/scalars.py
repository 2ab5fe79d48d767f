"""Scalar column functions.  Missing is NULL: NaN and infinities become NULL on the way in."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """``x`` as double, with NaN and infinities as NULL."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == math.inf), None).otherwise(x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0 or the result isn't finite."""
    return clean(a / F.when(b != 0, b))


def once(**made: Column) -> Column:
    """Columns of a select that are computed once, as the row of a generator.

    A plain column that costs much is written out again in each place that reads it where a filter
    on it is moved down to the rows below, and computed there as often.
    """
    return F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()])))


def correlation(x: Column, y: Column) -> Column:
    """Correlation of pairs without NULL, as an aggregate; NULL where either side doesn't vary."""
    return safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def raw_div(a: Column, b: Column) -> Column:
    """a / b as floating-point arithmetic has it: infinite where only b is 0, NaN where both are."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b).when(b == 0, F.signum(a) * F.lit(math.inf))


def growth(now: Column, before: Column) -> Column:
    """Change over the size of what was; NULL on a zero base or a change of sign."""
    return F.when((before != 0) & (now * before >= 0), (now - before) / F.abs(before))


def cagr(now: Column, before: Column, years: int) -> Column:
    """Yearly growth of two positive values."""
    return F.when((now > 0) & (before > 0), F.pow(now / before, F.lit(1 / years)) - 1)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def average_rank(x: Column, *by) -> Column:
    """Rank from 1, ties at their mean rank; NULL has none."""
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last(x))
    ties = order.rangeBetween(Window.currentRow, Window.currentRow)
    return F.when(x.isNotNull(), F.rank().over(order) + (F.count(x).over(ties) - 1) / 2)


def pct_rank(x: Column, *by) -> Column:
    """Mean rank over the number of values that aren't NULL."""
    return average_rank(x, *by) / F.count(x).over(Window.partitionBy(*by))


#: Coefficients of Acklam's approximation of the inverse normal distribution.
TAIL_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
MID_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MID_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)


def inverse_normal_sql(p: str) -> str:
    """SQL of the inverse normal distribution at ``p``, for both engines; within 1.2e-9."""

    def poly(coefficients, x, last=None):
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return out if last is None else f"({out} * {x} + {last})"

    def tail(q):
        q = f"sqrt(-2 * ln({q}))"
        return f"({poly(TAIL_C, q)} / {poly(TAIL_D, q, '1.0')})"

    r = f"(({p}) - 0.5) * (({p}) - 0.5)"
    mid = f"({poly(MID_A, r)} * (({p}) - 0.5) / {poly(MID_B, r, '1.0')})"
    return f"case when ({p}) < 0.02425 then {tail(f'({p})')} when ({p}) > 0.97575 then -{tail(f'(1 - ({p}))')} else {mid} end"


def inverse_normal(p: Column) -> Column:
    """Inverse of the standard normal distribution; NULL outside (0, 1)."""
    bound = F.transform(F.array(p), lambda _: _)[0]

    def poly(coefficients, x, last=None):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out if last is None else out * x + last

    tail = lambda q: poly(TAIL_C, q) / poly(TAIL_D, q, 1.0)
    low, high = F.sqrt(-2 * F.log(bound)), F.sqrt(-2 * F.log(1 - bound))
    c = bound - 0.5
    mid = poly(MID_A, c * c) * c / poly(MID_B, c * c, 1.0)
    return F.when((bound > 0) & (bound < 1), F.when(bound < 0.02425, tail(low)).when(bound > 0.97575, -tail(high)).otherwise(mid))


def normalize_ticker(raw: Column) -> Column:
    """Upper case, no bracketed suffix, dots as dashes; NULL if it isn't a plausible symbol."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.upper(raw), r"\[.*?\]", ""), r"\.", "-"))
    return F.when(t.rlike("^[A-Z][A-Z0-9]{0,5}(-[A-Z0-9]{1,3})?$"), t)


#: Words of legal forms, which don't tell companies apart.
COMPANY_NOISE = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "the", "plc", "ltd", "limited", "holdings", "holding", "group", "class", "cl",
    "sa", "nv", "ag", "lp", "llc", "lc", "trust", "adr", "and", "of", "new", "com", "cos", "intl", "international",
)
#: What is taken off a name first: the state it is registered in, at the end, and its class of shares.
STATE, SHARE_CLASS = r"[/\\][a-z]{2}[/\\]?\s*$", r"\bclass\s+[abc]\b"


def company_key(name: Column, noise: tuple[str, ...] = COMPANY_NOISE) -> Column:
    """Distinct words of a name without state, class and legal forms, sorted and joined; & is read as and."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), STATE, " "), SHARE_CLASS, " ")
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(bare, "&", " and "), "[^a-z0-9]+", " ")), " +")
    return F.array_join(F.array_sort(F.array_distinct(F.array_except(words, F.array(*map(F.lit, (*noise, "")))))), " ")


def money(text: Column) -> Column:
    """$1,234.50 or ($0.12) as a number; what isn't money is NULL."""
    digits = F.regexp_replace(text, r"[$,()\s]", "").try_cast("double")
    return F.when(F.trim(text).rlike(r"^\("), -F.abs(digits)).otherwise(digits)


def normalize_title(title: Column) -> Column:
    """A headline without regard to case and white space; all other characters, of any script, stay."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))


def article_id(ticker: Column, title: Column) -> Column:
    """24 hex digits that stay the same for one headline about one ticker."""
    return F.substring(F.sha2(F.concat(F.coalesce(ticker, F.lit("")), F.lit("|"), normalize_title(title)), 256), 1, 24)


def signal_bucket(signal: Column) -> Column:
    """The broad class of a signal label."""
    s = F.lower(F.coalesce(signal, F.lit("")))
    has = lambda *words: F.greatest(*[s.contains(w) for w in (*words, words[0])])
    return F.when(has("buy", "enter"), "Buy").when(has("sell", "trim", "avoid"), "Sell").when(has("hold", "add", "watch"), "Hold").otherwise("Neutral")


def last_completed(local: Column, open_day: Column, previous: Column, close: str = "16:00", delay: int = 45) -> Column:
    """The newest session whose bar is final at a local time: that day's, once the close and the delay are over, else the one before."""
    minutes = F.hour(local) * 60 + F.minute(local)
    hour, minute = map(int, close.split(":"))
    return F.when(open_day & (minutes >= hour * 60 + minute + delay), F.to_date(local)).otherwise(previous)
