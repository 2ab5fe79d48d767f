"""Phrase collocations of each language, from counts of the longest windows alone.

Every word of a piece leads one window: itself and the next two words, padded at the piece's
end.  Only these padded windows are counted; the window columns are the word column and its two
leads.  An occurrence of any shorter phrase begins exactly one window, so ROLLUP sums the counts
of windows over their shorter prefixes and no other n-gram is ever listed.

Windows are counted by batch before they are shuffled, and a window is three codes of 21 bits in
one number.  The codes are those of ``WORDS`` frequent words of a bounded sample
(``SAMPLE_ROWS`` documents on average); they only make keys short: a word without a code has
code 1 and stands as it is in the column ``x`` of the key, so that every word of every text
counts exactly, whatever the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.llm.staging import stage
from pitgrid.llm.stretches import groups

LEAST, SHARE, TOP = 10, 50, 2000
UND = "und"
#: Codes: 0 pads, 1 is a word without code, then these.
BITS, PAD, OUT, FIRST = 21, 0, 1, 2
WORDS, LONGEST, SAMPLE_ROWS = 1 << 18, 32, 4000
#: Code points of texts whose windows are counted together.
GROUP = 1 << 21
#: A-Z becomes lower case, ends of pieces a line feed, and the tab a space.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after the other, and which of them end a piece."""
    line = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass").translate(FOLD), np.uint8)
    gap = (line == 32) | (line == 10)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    breaks = np.concatenate(([0], np.cumsum(line == 10, dtype=np.int32)))
    last = np.ones(len(starts), bool)
    if len(starts):
        last[:-1] = breaks[starts[1:]] > breaks[ends[:-1]]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    own = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(line[~gap])])
    return own, last


def windows_of(texts: list[str], lexicon: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """k, x and n of the distinct padded windows of texts."""
    import pandas as pd

    own, last = words(texts)
    coded = own.dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64) + 1  # 0 pads
    found = pc.index_in(coded.dictionary, value_set=lexicon)
    code_of = np.concatenate(([PAD], pc.fill_null(pc.add(found.cast(pa.int64()), FIRST), OUT).to_numpy()))
    # the lead columns: the word, the next one and the one after, padded where the piece has ended
    more = np.concatenate((number, [0, 0]))
    second = np.where(last, 0, more[1 : 1 + len(number)])
    third = np.where((second == 0) | np.concatenate((last[1:], [True] * min(1, len(last)))), 0, more[2 : 2 + len(number)])
    leads = [number, second, third]
    codes = [code_of[x] for x in leads]
    k = (codes[0] << 2 * BITS) | (codes[1] << BITS) | codes[2]
    odd = (codes[0] == OUT) | (codes[1] == OUT) | (codes[2] == OUT)
    keys, n = np.unique(k[~odd], return_counts=True)
    rare = np.flatnonzero(odd)
    pair, _ = pd.factorize(leads[0][rare] * (len(code_of) + 1) + leads[1][rare])
    triple, listed = pd.factorize(pair.astype(np.int64) * (len(code_of) + 1) + leads[2][rare])
    first = np.full(len(listed), len(rare), np.int64)
    np.minimum.at(first, triple, np.arange(len(rare)))
    at = rare[first]
    raw = [pc.take(coded.dictionary, pa.array(np.where(c[at] == OUT, x[at] - 1, 0)), boundscheck=False) if len(coded.dictionary) else pa.array([], pa.large_binary()) for x, c in zip(leads, codes)]
    raw = [pc.if_else(pa.array(c[at] == OUT), r, pa.scalar(None, pa.large_binary())) for r, c in zip(raw, codes)]
    x = pc.binary_join_element_wise(*raw, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
    x = pa.concat_arrays([pa.nulls(len(keys), pa.large_binary()), x])
    return np.concatenate((keys, k[at])), x.cast(pa.large_string()).cast(pa.string()), np.concatenate((n, np.bincount(triple, minlength=len(listed))))


def frequent_words(docs: DataFrame, text: str) -> list[str]:
    """Frequent words of a bounded sample of rows, at most ``WORDS`` of at most ``LONGEST`` bytes."""
    rows = docs.select(F.col(text).alias("text")).where("text is not null")
    total = rows.count()
    some = rows if total <= SAMPLE_ROWS else rows.sample(SAMPLE_ROWS / total, seed=13)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in groups(batch.column(0).to_pylist(), GROUP):
                seen = words(texts)[0].value_counts()
                yield pa.RecordBatch.from_arrays([seen.field(0).cast(pa.large_string()).cast(pa.string()), seen.field(1)], names=["word", "n"])

    seen = some.mapInArrow(count, "word string, n long").where(F.octet_length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in seen.where("n > 1").orderBy(F.desc("n"), "word").limit(WORDS).select("word").collect()]


def top_windows(docs: DataFrame, lexicon: list[str], text: str, lang: str) -> DataFrame:
    """lang, k, x, n: the padded windows of all texts with the number of their occurrences."""
    known = docs.sparkSession.sparkContext.broadcast([w.encode() for w in lexicon])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(known.value, pa.large_binary())
        for batch in batches:
            own = batch.column(0).dictionary_encode()
            for i, name in enumerate(own.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(own.indices, i)).to_pylist()
                for _, part in groups(texts, GROUP):
                    k, x, n = windows_of(part, table)
                    yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(k), np.int64))), pa.array(k), x, pa.array(n, pa.int64())], names=["lang", "k", "x", "n"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UND)).alias("lang"), F.col(text).alias("text")).where("text <> ''")
    return rows.mapInArrow(run, "lang string, k long, x string, n long").groupBy("lang", "k", "x").agg(F.sum("n").alias("n"))


ROLLED = f"""
with w as (
  select lang, n, k >> {2 * BITS} as c1, (k >> {BITS}) & {(1 << BITS) - 1} as c2, split(x, ' ') as xs from {{windows}}),
p as (
  select lang, n, c1, c2, case when c1 = {OUT} then xs[0] end as x1, case when c2 = {OUT} then get(xs, if(c1 = {OUT}, 1, 0)) end as x2 from w)
select lang, (coalesce(c1, 0) << {2 * BITS}) | (coalesce(c2, 0) << {BITS}) as k, nullif(concat_ws(' ', x1, x2), '') as x, n from (
  select lang, c1, x1, c2, x2, sum(n) as n, grouping(c2) as g2, grouping(c1) as g1 from p group by lang, rollup((c1, x1), (c2, x2)))
where g1 = 1 or n >= {{least}} and (g2 = 1 or c2 <> {PAD})
"""


def phrases(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, words, n: all phrases of up to three words that occur ``least`` times, and '' with all occurrences of words."""
    lexicon = frequent_words(docs, text)
    longest = top_windows(docs, lexicon, text, lang)
    shorter = docs.sparkSession.sql(ROLLED.replace("{least}", str(least)), windows=longest)
    # padded windows go after the counts are in, below: asked for earlier, the windows would be counted twice
    full = longest.where(F.col("n") >= least).withColumn("whole", F.lit(True))
    known = docs.sparkSession.sparkContext.broadcast(lexicon)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(["", "", *known.value], object)
        for batch in batches:
            batch = batch.filter(pc.or_(pc.invert(batch.column(4)), pc.not_equal(pc.bit_wise_and(batch.column(1), (1 << BITS) - 1), PAD)))
            k = batch.column(1).to_numpy()
            codes = np.stack([k >> 2 * BITS, (k >> BITS) & ((1 << BITS) - 1), k & ((1 << BITS) - 1)])
            own = table[codes]
            x = batch.column(2).to_pylist()
            for i in np.flatnonzero((codes == OUT).any(axis=0)):
                own[codes[:, i] == OUT, i] = x[i].split(" ")
            told = [" ".join(filter(None, w)) for w in zip(*own)]
            size = (codes != PAD).sum(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string()), pa.array(size, pa.int32()), batch.column(3)], names=["lang", "phrase", "words", "n"])

    return stage(full.unionByName(shorter.withColumn("whole", F.lit(False))).mapInArrow(read, "lang string, phrase string, words int, n long"), "phrases")


def best(df: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each ``by`` with their rank: first of each of many hash buckets, then of fewer, so that no task gets all rows of a group."""
    hashed = F.xxhash64("phrase")
    for buckets in (4096, 64, 1):
        rank = F.row_number().over(Window.partitionBy(by, F.pmod(hashed, F.lit(buckets))).orderBy(*order))
        df = df.withColumn("rank", rank).where(F.col("rank") <= most)
    return df


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two and three words.

    A null or empty text has no words, a null language is ``und``, repeated rows count each, an
    empty table gives an empty one; other columns aren't read.  Ties of score and count go to the
    smaller phrase in UTF-8 order, ties of cuts to the earlier.  Numbers are exact: products are
    decimals of 38 digits, enough for counts below 1e16.
    """
    known = phrases(docs, least, text, lang)
    found = known.where("words >= 2").withColumnRenamed("n", "a")
    w = F.split("phrase", " ")
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(w, 1, k), " ").alias("left"), F.array_join(F.slice(w, F.lit(k + 1), F.size(w) - k), " ").alias("right"))
    inside = found.where("words = 3").select("lang", F.explode(F.array(F.concat_ws(" ", w[0], w[1]), F.concat_ws(" ", w[1], w[2]))).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stay = found.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {int(share)} * a").drop("longer")
    cuts = stay.select("lang", "phrase", "a", F.explode(F.when(F.col("words") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))).alias("cut")).select("lang", "phrase", "a", "cut.*")
    part = lambda side, n: known.where("words in (1, 2)").select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("cast(1000000 * cast(a as decimal(19, 0)) as decimal(25, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    lowest = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    rows = lowest.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    ranked = best(rows, "lang", [F.desc("score"), F.desc("a"), "phrase"], top)
    total = known.where("words = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB, each n-gram listed on its own.
ORACLE_SQL = r"""
with lower_case as (select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents where text is not null),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from lower_case),
lists as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda s: s <> '') as ws from pieces),
grams as (select lang, g.n as words, unnest(list_transform(range(1, len(ws) - g.n + 2), lambda i: array_to_string(ws[i:i + g.n - 1], ' '))) as phrase
  from lists, (select unnest([1, 2, 3]) as n) g where len(ws) >= g.n),
f as (select lang, words, phrase, count(*) as n from grams group by all),
totals as (select lang, sum(n)::bigint as n from f where words = 1 group by lang),
c as (select lang, words, phrase, n as a, string_split(phrase, ' ') as w from f where words >= 2 and n >= 10),
longer as (select lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as phrase, a from c where words = 3),
most as (select lang, phrase, max(a) as m from longer group by all),
stay as (select c.* from c left join most using (lang, phrase) where m is null or 100 * m < 50 * a),
cuts as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as lft, array_to_string(w[k + 1:], ' ') as rgt from stay, (select unnest([1, 2]) as k) q where k < words),
scored as (select cuts.lang, cuts.phrase, a, k, l.n as l, r.n as r, ((1000000::hugeint * a * a) // (l.n::hugeint * r.n))::bigint as score
  from cuts join f l on l.lang = cuts.lang and l.phrase = lft join f r on r.lang = cuts.lang and r.phrase = rgt),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select lang, rank, phrase, a, l, r, totals.n as n, score from ranked join totals using (lang) where rank <= 2000
"""
