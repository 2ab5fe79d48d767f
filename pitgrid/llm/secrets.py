"""Secrets in texts: fixed patterns, and a randomness battery for what they miss.

Everything is Spark SQL.  Spans count code points, the end is exclusive.

The battery takes long unbroken tokens, infers the encoding of each from its characters,
and tests it against two hypotheses.  Against "drawn evenly from the alphabet": chi-squared
uniformity, runs about the middle of the alphabet, and serial correlation at lag 1, joined
by Fisher's rule; a token whose joint p-value is rejected isn't random.  Against "ordinary writing": the same
chi-squared statistic under an uneven alphabet, and the changes of character class, whose
joint p-value shrinks with length when a token really is random.  Benjamini-Hochberg, done
within each encoding and length band on counts of p-values in bins, controls the false
discoveries of both tests, so short tokens need stronger evidence than long ones.  A secret
is a token that the battery doesn't reject and that is rejected as writing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.staging import stage

# The patterns of the contract.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: name, pattern, alphabet size; the first that fits.
ENCODINGS = (
    ("decimal", "^[0-9+/_=-]*$", 0),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 16),
    ("base32", "^[A-Z2-7]+=*$", 32),
    ("base36", "^[a-z0-9]+$", 36),
    ("base64", "^.*$", 64),
)
ALPHABET = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
BINS_PER_DECADE = 4
#: Names that no table has, so that extra columns can't clash.
BASE, TESTED, SPANS = "__pitgrid_base", "__pitgrid_tested", "__pitgrid_spans"
SPAN = "array<struct<start:int,end:int,rank:int>>"


def bind(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, also where ``then`` uses it in a lambda."""
    return F.transform(F.array(value), then)[0]


def found(text: Column, pattern: str, rank: int, least: int = 0, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters.

    The text between matches and the matches themselves alternate, so a start is the sum of
    the lengths before it.
    """
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), F.regexp_extract_all(text, regex, F.lit(group)).alias("value")
    )
    none = F.array().cast(SPAN)
    start = lambda acc, x: acc["at"] + F.char_length(x["gap"])

    def step(acc, x):
        end = start(acc, x) + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        keep = F.coalesce(F.char_length(x["value"]) >= least, F.lit(False))
        span = F.array(F.struct(start(acc, x).alias("start"), end.alias("end"), F.lit(rank).alias("rank")))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(parts, first, step, lambda acc: acc["spans"])).otherwise(none)


def base_spans(text: Column) -> Column:
    spans = F.concat(found(text, ASSIGN, 0, least=8, group=2), found(text, ACCESS, 1), found(text, HEX, 2))
    return F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))


def normal_cdf(z: Column) -> Column:
    """Polynomial approximation, within 1e-7; the tail is kept above 1e-300."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.greatest(F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly, F.lit(1e-300))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_cdf(-F.abs(z)))


def battery(token: Column, ordinary: float, changes: float) -> Column:
    """Struct of the inferred encoding, its length band and both joint p-values of a token."""
    name, size, letters = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for enc, pattern, k in reversed(ENCODINGS):
        fits = token.rlike(pattern)
        name = F.when(fits, F.lit(enc)).otherwise(name)
        size = F.when(fits, F.lit(k)).otherwise(size)
        letters = F.when(fits, F.lit(ALPHABET.get(enc, ""))).otherwise(letters)
    made = F.struct(
        name.alias("enc"), size.alias("k"), F.char_length(token).alias("n"),
        F.filter(F.split(token, ""), lambda c: c != "").alias("chars"), letters.alias("letters"),
    )

    def sums(m):
        chars, n, k = m["chars"], m["n"].cast("double"), m["k"].cast("double")
        same = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.char_length(F.replace(token, c, F.lit(""))), F.lit(2)))
        chi = same * k / n - n
        lower = F.when(m["enc"] == "hex", F.lower(token)).otherwise(token)
        index = F.filter(F.transform(F.split(lower, ""), lambda c: F.when(c != "", F.instr(m["letters"], c).cast("double"))), lambda x: x.isNotNull())
        kind = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 1).when(c.rlike("[a-z]"), 2).when(c.rlike("[A-Z]"), 3).otherwise(0))
        return F.struct(n.alias("n"), k.alias("k"), m["enc"].alias("enc"), chi.alias("chi"), index.alias("x"), kind.alias("kind"))

    def moments(s):
        n = s["n"]
        mean = F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + v) / n
        pairs = F.zip_with(F.slice(s["x"], 1, (n - 1).cast("int")), F.slice(s["x"], 2, (n - 1).cast("int")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        kinds = F.zip_with(F.slice(s["kind"], 1, (n - 1).cast("int")), F.slice(s["kind"], 2, (n - 1).cast("int")), lambda a, b: ((a != b) & (a > 0) & (b > 0)).cast("double"))
        half = (s["k"] + 1) / 2
        return F.struct(
            n.alias("n"), s["k"].alias("k"), s["enc"].alias("enc"), s["chi"].alias("chi"), mean.alias("mean"), pairs.alias("pairs"), s["x"].alias("x"),
            F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + (v > half).cast("double")).alias("above"),
            F.aggregate(pairs, F.lit(1.0), lambda a, p: a + ((p["a"] > half) != (p["b"] > half)).cast("double")).alias("runs"),
            F.aggregate(kinds, F.lit(0.0), lambda a, v: a + v).alias("turns"),
        )

    def judged(v):
        n, k = v["n"], v["k"]
        df = k - 1
        even = two_sided((F.pow(v["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        n1, n2 = v["above"], n - v["above"]
        expected = 2 * n1 * n2 / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        runs = two_sided((v["runs"] - expected) / spread)
        mean = v["mean"]
        ss = F.aggregate(v["x"], F.lit(1e-9), lambda a, x: a + (x - mean) * (x - mean))
        sc = F.aggregate(v["pairs"], F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        serial = two_sided((sc / ss + 1 / n) * F.sqrt(n))
        s = -(F.log(even) + F.log(runs) + F.log(serial))
        p_random = F.exp(-s) * (1 + s + s * s / 2)
        shift = n * (ordinary - 1)
        as_writing = normal_cdf((v["chi"] - (df + shift)) / F.sqrt(2 * df + 4 * shift))
        few = normal_cdf(-(v["turns"] - changes * (n - 1)) / F.sqrt(changes * (1 - changes) * (n - 1)))
        w = -(F.log(as_writing) + F.log(few))
        return F.struct(
            v["enc"].alias("enc"), F.least(F.floor(F.log2(n)), F.lit(12)).cast("int").alias("band"),
            p_random.alias("p_random"), (F.exp(-w) * (1 + w)).alias("p_ordinary"),
        )

    whole = bind(bind(bind(made, sums), moments), judged)
    return F.when(~token.rlike(ENCODINGS[0][1]), whole)


def tested(text: Column, base: Column, ordinary: float, changes: float) -> Column:
    """The tokens outside base spans with what the battery says of each."""
    tokens = found(text, TOKEN, 3)
    clear = F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    def one(t):
        token = F.substring(text, t["start"] + 1, t["end"] - t["start"])
        return F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["end"].alias("end"), battery(token, ordinary, changes).alias("b"))

    return F.filter(F.transform(clear, one), lambda t: t["b"].isNotNull())


def bin_of(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-60))) * BINS_PER_DECADE), F.lit(60 * BINS_PER_DECADE)).cast("int")


def levels(candidates: DataFrame, q: float) -> dict[str, dict[tuple[str, int], int]]:
    """For each test, encoding and length band the least bin of p-values that Benjamini-Hochberg rejects at ``q``.

    "random" is the battery's own joint p-value, whose rejections aren't random; "ordinary" is
    that of ordinary writing, whose rejections aren't writing.  The counts are a table of at
    most tests x encodings x bands x bins rows, however large the corpus is.
    """
    both = F.array(*[F.struct(F.lit(k).alias("test"), bin_of(F.col(f"p_{k}")).alias("bin")) for k in ("random", "ordinary")])
    found = candidates.select(F.explode(TESTED).alias("t")).select("t.b.*").select("enc", "band", F.explode(both).alias("x"))
    strata: dict[str, dict[tuple[str, int], dict[int, int]]] = {"random": {}, "ordinary": {}}
    for r in found.groupBy("enc", "band", "x.test", "x.bin").count().collect():
        strata[r.test].setdefault((r.enc, r.band), {})[r.bin] = r["count"]
    least: dict[str, dict[tuple[str, int], int]] = {}
    for test, cells in strata.items():
        least[test] = {}
        for key, bins in cells.items():
            total, seen = sum(bins.values()), 0
            for b in sorted(bins, reverse=True):
                seen += bins[b]
                if total * 10 ** (-b / BINS_PER_DECADE) / seen <= q:
                    least[test][key] = b
    return least


def rejected(least: dict[tuple[str, int], int], token: Column, p: str) -> Column:
    """Whether a token's p-value lies in a bin that is rejected for its encoding and length band."""
    if not least:
        return F.lit(False)
    table = F.create_map(*[x for (enc, band), b in sorted(least.items()) for x in (F.lit(f"{enc}:{band}"), F.lit(b))])
    return F.coalesce(bin_of(token["b"][p]) >= F.try_element_at(table, F.concat_ws(":", token["b"]["enc"], token["b"]["band"].cast("string"))), F.lit(False))


def with_spans(docs: DataFrame, text: str = "text", q: float = 0.01, ordinary: float = 1.7, changes: float = 0.15, slim: bool = False) -> DataFrame:
    """``docs`` with ``BASE`` and ``SPANS`` columns: arrays of (start, rank, end), rank by ``KINDS``.

    q: rate of false discoveries, of tokens that the battery finds not to be random and of
    tokens that are found not to be writing; a token is a secret if the first test keeps it
    and the second rejects it.  ordinary: how many times likelier than by an even alphabet two characters of ordinary
    writing agree; changes: rate at which its character class changes.
    slim: leave the text out.  A null text counts as empty and has no span.  All other columns
    stay as they are.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    based = docs.withColumn(BASE, base_spans(whole)).withColumn(
        TESTED, F.when(whole.rlike(TOKEN), tested(whole, F.col(BASE), ordinary, changes))
    )
    # the battery is run once: its verdicts are counted, and then read again with the counts' levels
    based = stage(based.drop(text) if slim else based, "tested")
    least = levels(based.select(TESTED), q)
    passes = lambda t: rejected(least["ordinary"], t, "p_ordinary") & ~rejected(least["random"], t, "p_random")
    extra = F.transform(F.filter(TESTED, passes), lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["end"].alias("end")))
    return based.withColumn(SPANS, F.sort_array(F.when(F.col(TESTED).isNull(), F.col(BASE)).otherwise(F.concat(BASE, extra)))).drop(TESTED)


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each row of ``docs``: counts of base spans, their digest, and all spans.

    Null texts count as empty; repeated rows give repeated rows; other columns aren't read.
    """
    spans = with_spans(docs.select(key, text), text, slim=True, **how)
    number = lambda rank: F.size(F.filter(BASE, lambda s: s["rank"] == rank)).cast("long")
    return spans.select(
        key, number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(joined(F.col(BASE)), 256).alias("base_sha256"), joined(F.col(SPANS)).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", **how) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one mark."""
    made = with_spans(docs, text, **how)

    def step(acc, s):
        gap = F.when(s["start"] > acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        gap = F.coalesce(gap, F.when((s["start"] == acc["at"]) & (acc["at"] == 0), F.lit(mark)), F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(SPANS, first, step)
    rebuilt = bind(clean, lambda c: F.concat(c["out"], F.substring(text, c["at"] + 1, F.char_length(F.col(text)))))
    return made.withColumn(text, F.when(F.size(SPANS) > 0, rebuilt).otherwise(F.col(text))).drop(BASE, SPANS)
